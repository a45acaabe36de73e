from collections import defaultdict

import corpus_pipeline
from leafwork.llm import common, langid, lines
from pyspark.sql import functions as F

from tests.llm.test_operators import SF, check_sequences, hits, jaccard_classes


def dropped(texts):
    """Shared lines removed, by hand."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for k, t in texts.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(k)
    goes = lambda k, x: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and k != max(held[key(x)])
    return {k: t if t is None else "\n".join(x for x in t.split("\n") if not goes(k, x)) for k, t in texts.items()}


def test_pipeline_equals_brute_force(spark):
    """Each stage on what the one before it kept, restated by hand but for the trained model's own predictions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.99 * docs.count()
    second = corpus_pipeline.line_dedup(spark, first, SF).persist()
    want = {r["doc_id"]: r["kept"] for r in lines.line_dedup(first, with_text=True).collect()}
    assert {r["doc_id"]: r["text"] for r in second.collect()} == want == dropped({r["doc_id"]: r["text"] for r in first.collect()})
    assert second.where(F.col("n_chars") != F.length("text")).count() == 0
    third = {k: want[k] for k, (c, _, _) in jaccard_classes(want).items() if c == k}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = hits(third, items)
    last = {k: t for k, t in third.items() if not judged[k][4]}
    assert 0 < len(last) < len(third) < len(want)
    check_sequences(corpus_pipeline.run(spark, SF).collect(), last)


def test_stages_keep_awkward_rows(spark):
    rows = [(None, None, None, None, None, 1), (None, "words that are here", "en", "s", 9, 2), (1, "words that are here", "en", "s", 9, 3), (1, "words that are here", "en", "s", 9, 3), (2, "", "en", "s", 0, 4), (3, "other words in this one", "en", "s", 7, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class_id long")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert sorted(r["class_id"] for r in kept.collect()) == [2, 3, 3, 5]
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.decontamination):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert sorted(r["class_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect())[-1:] == [5]
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == 4
    assert sum(len(r["doc_ids"]) for r in corpus_pipeline.pack(spark, docs, SF).collect()) == 6
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_stages_leave_clashing_columns(spark):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [(i, words if i else "others that are here", "en", "s", 9, 7, "l", 0.5, "k", "r", "c", "i") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __rk int, lang_pred string, score double, row_key string, `__row` string, carried string, id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema == docs.schema
        assert sorted(map(tuple, out.collect())) == (rows[:2] if name == "n-gram Jaccard join" else rows)
    assert sum(len(r["doc_ids"]) for r in corpus_pipeline.pack(spark, docs, SF).collect()) == 3


def test_run_leaves_no_tables_behind(spark):
    before = common.mark()
    last = corpus_pipeline.run(spark, SF)
    left = common.mark() - before
    assert last.count() > 0 and len(left) <= 2  # the last stage's docs and token pieces


def test_unknown_is_rejected(spark):
    docs = spark.createDataFrame([(1, "12 34", "en"), (2, "some words", "en")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()] == [2]
    assert langid.UNKNOWN == "und"


def test_unlabelled_corpus_is_kept(spark):
    docs = spark.createDataFrame([(1, "12 34", None), (2, "some words", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()) == [2, 4]
