"""Elements of content documents as intervals, and what lies within an element as an interval join.

Elements are numbered in the order of their start tags; an element's interval goes from its own number to that of the last
element inside it. So a heading, a reference or a section lies in an element if its number is in the element's interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.functions import html
from leafwork.functions.batches import small_batches


def elements(items: DataFrame) -> DataFrame:
    """(doc_id, href, first, last, tag, id, start, past, level, text, refs) of items (doc_id, href, content), each parsed once.

    start and past are places in the page's text; level and text are those of h1 to h3; refs are the element's own references.
    """
    return small_batches(items).select("doc_id", "href", F.inline(html.elements_of(F.col("content"))))


def sections(chapters: DataFrame, found: DataFrame) -> DataFrame:
    """chapters (doc_id, file_path, html_id, ...) with first, last, start, past of the element that their anchor names: the first with
    that id. Null where there is none."""
    named = found.where("id <> ''").groupBy("doc_id", F.col("href").alias("file_path"), F.col("id").alias("html_id")).agg(F.min_by(F.struct("first", "last", "start", "past"), "first").alias("e"))
    return chapters.join(named, ["doc_id", "file_path", "html_id"], "left").select(*chapters.columns, "e.first", "e.last", "e.start", "e.past")


def _within(bounds: DataFrame, found: DataFrame) -> DataFrame:
    """Sections with the elements inside them. Both meet by page, whose elements are one row's before: no group is larger than a page."""
    own = found.select("doc_id", F.col("href").alias("file_path"), F.col("first").alias("at"), "level", "text", "refs")
    return bounds.where("first IS NOT NULL").join(own, ["doc_id", "file_path"]).where("at BETWEEN first AND last")


def section_headings(bounds: DataFrame, found: DataFrame) -> DataFrame:
    """Headings that lie in each section, in their order, blank ones left out."""
    inside = _within(bounds, found.where("level IS NOT NULL AND text <> ''"))
    return inside.select("doc_id", "file_path", "html_id", "level", "text", (F.col("at") - F.col("first")).alias("place"))


def section_refs(bounds: DataFrame, found: DataFrame) -> DataFrame:
    """References that lie in each section."""
    inside = _within(bounds, found.where(F.size("refs") > 0))
    return inside.select("doc_id", "file_path", "html_id", F.inline("refs"))


def section_contents(bounds: DataFrame, items: DataFrame) -> DataFrame:
    """Each section's content, cut from its page by the element's place, in a page of its own; the whole page where there is none."""
    pages = small_batches(items).select("doc_id", F.col("href").alias("file_path"), html.text_of(F.col("content")).alias("page"))
    body = F.substring("page", F.col("start") + 1, F.col("past") - F.col("start"))
    own = F.when(F.col("first").isNull(), F.col("page")).otherwise(F.concat(F.lit("<html><head></head><body>"), body, F.lit("</body></html>")))
    return bounds.join(pages, ["doc_id", "file_path"]).withColumn("content", own).drop("page", "first", "last", "start", "past")
