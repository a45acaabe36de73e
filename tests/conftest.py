import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).parent.parent}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over the smallest tables; rows and types must be equal."""
    import duckdb

    con = duckdb.connect()
    for f in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def run(query, sql):
        df = query(spark, SF)
        assert {c: kinds.get(t, t) for c, t in df.dtypes} == {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        cols = sorted(df.columns)
        cur = con.execute(sql)
        at = [[d[0] for d in cur.description].index(c) for c in cols]
        tidy = lambda v: round(v, 9) if isinstance(v, float) else v
        want = sorted((tuple(tidy(r[i]) for i in at) for r in cur.fetchall()), key=repr)
        got = sorted((tuple(tidy(r[c]) for c in cols) for r in df.collect()), key=repr)
        assert got == want

    return run
