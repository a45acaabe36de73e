import pytest

from leafwork.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(compare, name):
    compare(catalogue.QUERIES[name], catalogue.SQL[name])


def test_every_query_has_sql():
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_column_names_differ_whatever_their_case(spark, name):
    columns = [c.lower() for c in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").columns]
    assert len(columns) == len(set(columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 114
    assert set(e.oracle_sql()) <= set(e.queries())
