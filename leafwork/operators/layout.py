"""Chapters of paged documents: from an outline, from typography, or from the first of these that finds any.

Tables: documents (doc_id, total_pages), outline (doc_id, seq, level, title, page), spans (doc_id, page, block, block_type,
line, span, text, size). Order is never implied: every window orders by a key of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork import options
from leafwork.functions import strings as S

CHAPTER = ("doc_id", "chapter_index", "title", "start_page", "end_page", "page_count", "level", "detection_method", "confidence")


def _chapters(rows: DataFrame, order: list[str], level: Column, method: str, confidence: Column) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    pages = F.col("end_page") - F.col("start_page") + 1
    return rows.withColumns({"chapter_index": index, "page_count": pages, "level": level, "detection_method": F.lit(method), "confidence": confidence}).select(*CHAPTER)


def _ends(order: list[str]) -> Column:
    """The page before the next chapter's first, or the document's last."""
    return F.coalesce(F.lead("page").over(Window.partitionBy("doc_id").orderBy(*order)) - 1, F.col("total_pages"))


def outline_chapters(documents: DataFrame, outline: DataFrame, level: int = 1) -> DataFrame:
    """Entries of one level, in outline order; those that would end before they start are dropped after the ends are known.

    The window for the ends and that for the index share one exchange by doc_id.
    """
    at = outline.where(F.col("level") == level).join(documents.select("doc_id", "total_pages"), "doc_id")
    rows = at.select("doc_id", "seq", S.strip(F.col("title")).alias("title"), F.col("page").alias("start_page"), _ends(["seq"]).alias("end_page"))
    return _chapters(rows.where("start_page <= end_page"), ["seq"], F.lit(level), "bookmark", F.lit(1.0))


def ranged_chapters(documents: DataFrame, outline: DataFrame, level: int = 1, size: int = 65536) -> DataFrame:
    """outline_chapters where a document's outline may be too long for one task.

    An outline is cut into ranges of `size` ordinals, and windows go by range. What a range's last entry needs of the next
    range is that one's first page; the index of a chapter is its place in its range and the sum of what the ranges before kept.
    Both come from a row a range, the only rows that a window by document sees.
    """
    c = F.col
    at = outline.where(c("level") == level).select("doc_id", "seq", S.strip(c("title")).alias("title"), c("page").alias("start_page"), F.floor(c("seq") / size).alias("range"))
    by_range, own = Window.partitionBy("doc_id").orderBy("range"), Window.partitionBy("doc_id", "range").orderBy("seq")
    page = F.struct("start_page")  # null where there is no entry, whatever its page
    heads = at.groupBy("doc_id", "range").agg(F.min_by(page, c("seq")).alias("head"))
    after = heads.select("doc_id", "range", F.lead("head").over(by_range).alias("after"))
    kept = at.join(after, ["doc_id", "range"]).withColumn("next", F.coalesce(F.lead(page).over(own), c("after"))).join(documents.select("doc_id", "total_pages"), "doc_id")
    kept = kept.withColumn("end_page", F.coalesce(c("next")["start_page"] - 1, c("total_pages"))).where("start_page <= end_page")
    counts = kept.groupBy("doc_id", "range").agg(F.count("*").alias("n"))
    before = counts.select("doc_id", "range", F.coalesce(F.sum("n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = kept.join(before, ["doc_id", "range"]).withColumn("place", F.row_number().over(own))
    return rows.select(
        "doc_id", (c("before") + c("place")).cast("int").alias("chapter_index"), "title", "start_page", "end_page", (c("end_page") - c("start_page") + 1).alias("page_count"),
        F.lit(level).alias("level"), F.lit("bookmark").alias("detection_method"), F.lit(1.0).alias("confidence"),
    )


def page_fonts(spans: DataFrame) -> DataFrame:
    """Mean size of each page's text spans of positive size, blank ones too; 0 if there is none."""
    sized = F.when((F.col("block_type") == 0) & (F.col("size") > 0), F.col("size"))
    return spans.groupBy("doc_id", "page").agg(F.coalesce(F.avg(sized), F.lit(0.0)).alias("avg_size"))


def heading_candidates(spans: DataFrame, sensitivity: str = "medium", patterns: Sequence[str] = S.HEADINGS) -> DataFrame:
    """The first heading-like span of each line with its confidence, whatever that is. patterns: what headings look like.

    The page mean and the choice within a line share one exchange by (doc_id, page): a page is the largest group.
    """
    t = options.thresholds(sensitivity)
    mean = F.coalesce(F.avg(F.when(F.col("size") > 0, F.col("size"))).over(Window.partitionBy("doc_id", "page")), F.lit(0.0))
    text = spans.where("block_type = 0").withColumn("avg_size", mean).withColumn("text", S.strip(F.col("text"))).where("text <> ''")
    large = (F.col("avg_size") > 0) & (F.col("size") >= F.col("avg_size") * t.ratio) & (S.word_count(F.col("text")) <= 10)
    like = text.where(S.is_heading(F.col("text"), patterns) | large)
    first = F.row_number().over(Window.partitionBy("doc_id", "page", "block", "line").orderBy("span"))
    return like.withColumn("rank", first).where("rank = 1").drop("rank").withColumn("confidence", S.heading_score(F.col("text"), F.col("size"), patterns))


def nested_headings(pages: DataFrame, sensitivity: str = "medium", patterns: Sequence[str] = S.HEADINGS) -> DataFrame:
    """heading_candidates of pages that are a row each: (doc_id, page, blocks), blocks an array of (type, lines: array of (spans: array of (text, size))).

    Mean size, the scoring and the choice within a line are made inside the row; what is left is exploded with its places, and
    nothing is shuffled. Nulls in place of arrays are empty.
    """
    t = options.thresholds(sensitivity)
    none = F.array().cast("array<struct<text:string,size:double>>")
    inside = lambda block: F.flatten(F.transform(F.when(block["type"] == 0, block["lines"]), lambda line: F.coalesce(line["spans"], none)))
    sized = F.filter(F.flatten(F.transform("blocks", lambda b: F.coalesce(inside(b), none))), lambda s: s["size"] > 0)
    mean = F.when(F.size(sized) > 0, F.aggregate(sized, F.lit(0.0), lambda total, s: total + s["size"]) / F.size(sized)).otherwise(F.lit(0.0))
    avg = F.col("avg_size")

    def heading(line: Column) -> Column:
        """The line's first span that looks like a heading, with its place."""
        own = F.transform(line["spans"], lambda s, k: F.struct(k.alias("span"), S.strip(s["text"]).alias("text"), s["size"].alias("size")))
        large = lambda s: (avg > 0) & (s["size"] >= avg * t.ratio) & (S.word_count(s["text"]) <= 10)
        return F.get(F.filter(own, lambda s: (s["text"] != "") & (S.is_heading(s["text"], patterns) | large(s))), F.lit(0))

    lines = lambda b: F.filter(F.transform(b["lines"], lambda line, j: F.struct(j.alias("line"), heading(line).alias("head"))), lambda x: x["head"].isNotNull())
    left = F.filter(F.transform("blocks", lambda b, i: F.struct(i.alias("block"), F.when(b["type"] == 0, lines(b)).alias("lines"))), lambda x: F.size(x["lines"]) > 0)
    found = pages.select("doc_id", "page", "blocks", F.explode(F.array(mean)).alias("avg_size")).withColumn("left", left)  # explode: the mean is made once a page, not once a span
    blocks = found.select("doc_id", "page", "avg_size", F.explode("left").alias("b")).select("doc_id", "page", "avg_size", "b.block", F.explode("b.lines").alias("l"))
    rows = blocks.select("doc_id", "page", "block", F.lit(0).alias("block_type"), "l.line", "l.head.span", "l.head.text", "l.head.size", "avg_size")
    return rows.withColumn("confidence", S.heading_score(F.col("text"), F.col("size"), patterns))


def heuristic_chapters(documents: DataFrame, spans: DataFrame, sensitivity: str = "medium", patterns: Sequence[str] = S.HEADINGS) -> DataFrame:
    """Confident headings as chapters, of spans, or of pages with nested blocks. Two on a page leave the first with no pages: it is kept (see is_inverted in split plans)."""
    order = ["start_page", "block", "line", "span"]
    candidates = nested_headings if "blocks" in spans.columns else heading_candidates
    kept = candidates(spans, sensitivity, patterns).where(F.col("confidence") >= options.thresholds(sensitivity).least)
    at = kept.join(documents.select("doc_id", "total_pages"), "doc_id")
    rows = at.select("doc_id", "block", "line", "span", F.col("text").alias("title"), F.col("page").alias("start_page"), "confidence", _ends(["page", "block", "line", "span"]).alias("end_page"))
    return _chapters(rows, order, F.lit(1), "heuristic", F.col("confidence"))


def whole_documents(documents: DataFrame) -> DataFrame:
    rows = documents.select("doc_id", F.lit("Complete Document").alias("title"), F.lit(1).cast("long").alias("start_page"), F.col("total_pages").cast("long").alias("end_page"))
    return _chapters(rows, ["title"], F.lit(1), "fallback", F.lit(1.0))


def detect_pdf(documents: DataFrame, outline: DataFrame, spans: DataFrame, strategy: str = "hybrid", sensitivity: str = "medium", level: int = 1, patterns: Sequence[str] = S.HEADINGS) -> DataFrame:
    """Chapters by strategy: bookmarks, heuristic, or hybrid (heuristic for documents whose outline gives none).

    A document with none becomes one chapter, as does every document under a strategy that isn't known. Spans of documents
    that their outline settles never reach the scoring; what is found, and a whole-document row for each document, is
    ranked, and each document keeps its rows of the least rank: nothing is scored twice to tell who has none.
    """
    ranked = []
    if strategy in ("bookmarks", "hybrid"):
        ranked.append(outline_chapters(documents, outline, level))
    if strategy in ("heuristic", "hybrid"):
        left = spans.join(ranked[0].select("doc_id").distinct(), "doc_id", "left_anti") if ranked else spans
        ranked.append(heuristic_chapters(documents, left, sensitivity, patterns))
    if not ranked:
        return whole_documents(documents)
    every = whole_documents(documents).withColumn("rank", F.lit(len(ranked)))
    for k, found in enumerate(ranked):
        every = every.unionByName(found.withColumn("rank", F.lit(k)))
    return every.withColumn("best", F.min("rank").over(Window.partitionBy("doc_id"))).where("rank = best").select(*CHAPTER)


def summarize_pdf(documents: DataFrame, outline: DataFrame, chapters: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """One row a document: the strategy as requested (or fallback), counts, whether there is any outline, and what found the chapters."""
    counts = chapters.groupBy("doc_id").agg(F.count("*").alias("chapter_count"), F.min("detection_method").alias("origin_strategy"))
    marks = outline.select("doc_id").distinct().withColumn("marked", F.lit(True))
    out = documents.select("doc_id", "total_pages").join(counts, "doc_id", "left").join(marks, "doc_id", "left")
    used = F.when(F.coalesce("origin_strategy", F.lit("fallback")) == "fallback", F.lit("fallback")).otherwise(F.lit(strategy))
    flag = F.coalesce("marked", F.lit(False))
    out = out.select("doc_id", used.alias("strategy_used"), F.coalesce("chapter_count", F.lit(0).cast("long")).alias("chapter_count"), "total_pages", flag.alias("has_bookmarks"), "origin_strategy")
    text = F.concat_ws("\n", F.concat(F.lit("Strategy: "), "strategy_used"), F.concat(F.lit("Chapters: "), F.col("chapter_count").cast("string")), F.concat(F.lit("Pages: "), F.col("total_pages").cast("string")), F.concat(F.lit("Bookmarks: "), S.yes_no(F.col("has_bookmarks"))))
    tip = ~F.col("has_bookmarks") & F.lit(strategy != "heuristic")
    return out.withColumns({"summary": text, "try_heuristic": tip, "confirm": F.col("strategy_used") == "fallback"})


def preview_pdf(chapters: DataFrame) -> DataFrame:
    return chapters.select(
        "doc_id", "chapter_index", "title", "page_count", F.format_string("%d-%d", "start_page", "end_page").alias("page_range"), S.percent(F.col("confidence")).alias("confidence_pct"),
        S.colour(F.col("confidence")).alias("colour"), "detection_method", F.when(F.col("detection_method") == "bookmark", "green").otherwise("yellow").alias("method_colour"), F.format_string("%s (pages %d-%d)", "title", "start_page", "end_page").alias("label"),
    )


def level_histogram(outline: DataFrame) -> DataFrame:
    return outline.groupBy("level").agg(F.count("*").alias("entries")).orderBy("level")


def first_entries(outline: DataFrame, n: int = 50) -> DataFrame:
    """The first n entries of each document's outline, indented by level."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return outline.withColumn("place", place).where(F.col("place") <= n).select("doc_id", "seq", F.concat(S.indent(F.col("level")), F.col("title")).alias("entry"), "page")
