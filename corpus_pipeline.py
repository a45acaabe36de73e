"""From raw documents to packed training sequences: language, lines, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import common, decontaminate, jaccard, langid, lines, packing

LEAST_SCORE = 0.3


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of docs whose `key` is not in `gone`, without the key; `gone` is written first, so that Spark knows if it is small."""
    gone = common.materialize(gone.select(F.col(key)), "gone")
    return docs.join(gone, key, "left_anti").drop(key)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and those that no learned language describes; where no document is labelled, the first alone.

    Defined cases: a null text has no letters and goes; null ids and labels, repeated rows and columns of any name stay as
    they are; a tie of languages is as good as a choice; a very long text is read whole; an empty table stays empty.
    """
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = common.free_name("lang_pred", docs.columns), common.free_name("score", docs.columns)
    found = langid.identify(docs, model, pred=lang, score=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).drop(lang, score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from the text; n_chars follows where a line went.

    Defined cases: a null text stays null, a text that loses all lines becomes empty; repeated rows and null ids are
    documents of their own; the largest id keeps a shared line, of tied ones a single row; a very long text moves whole,
    once; columns of any name stay as they are; an empty table stays empty.
    """
    others = [c for c in docs.columns if c != "text"]
    kept = lines.line_dedup(docs, with_text=True, carry=others)
    own = F.col("carried")
    columns = {c: own.getField(c) for c in others} | {"text": F.col("kept")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own.getField("n_chars"))
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the first stays.

    Defined cases: a text that is null or without words is in no class and stays; where ids are null or repeat, the first
    is that of the rows as they are numbered, so of tied rows one stays; a very long text is compared whole; columns of
    any name stay as they are; an empty table stays empty.
    """
    key = common.free_name("row_key", docs.columns)
    numbered = common.number(docs, "doc_id", key)
    found = jaccard.ngram_jaccard_join(numbered, key)
    return _without(numbered, key, found.where(F.col("class_id") != F.col(key)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Defined cases: a text that is null or without words stays; each of repeated rows is judged, ids may be null; with no
    benchmark items all stay; a very long text is scanned whole; columns of any name stay as they are; an empty table
    stays empty.
    """
    key = common.free_name("row_key", docs.columns)
    numbered = common.number(docs, "doc_id", key)
    found = decontaminate.decontaminate(numbered, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    return _without(numbered, key, found.where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of permitted lengths, with the documents that they hold.

    Defined cases are those of packing.best_fit_packing: a null text is its end token, ties are packed by id, repeated
    rows each, very long texts in pieces; other columns go; an empty table gives no sequence.
    """
    return packing.best_fit_packing(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

ORACLE_SQL = None  # a trained model and a packing heuristic are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. Each result is written for the next; what a stage wrote beside it is then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, made = common.mark(), stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made = common.materialize(made, f"stage{k}")
        common.sweep(before, made)
        if k:
            common.forget(docs)
        docs = made
