"""Chapters of books made of files: from the table of contents, from headings, from reading order.

Tables: item (doc_id, item_id, ordinal, href, item_type, content), spine (doc_id, pos, item_id), toc (doc_id, seq, level,
title, href).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork import options
from leafwork.functions import html, opf
from leafwork.functions import strings as S
from leafwork.functions.batches import small_batches

CHAPTER = ("doc_id", "chapter_index", "title", "file_path", "html_id", "level", "detection_method", "confidence", "content_length")


def _chapters(rows: DataFrame, order: list[str], method: str) -> DataFrame:
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return rows.withColumns({"chapter_index": index, "detection_method": F.lit(method), "content_length": F.lit(0)}).select(*CHAPTER)


REPEATS, CIRCLE = "a node id repeats", "nodes that no root leads to go round in a circle"


def flatten_toc(nodes: DataFrame) -> DataFrame:
    """A tree (doc_id, node_id, parent_id, ordinal, title, href) in pre-order: (doc_id, seq, level, title, href, error).

    Parents come first, then their children by ordinal; levels are from 1, and the path of ordinals is the sort key. One recursive
    query walks down from the roots, a level a step. A node without title or href hands its children on and
    has no row itself, and nodes under a parent that isn't there have none. A book in which an id that has children repeats,
    or in which nodes go round in a circle, has one row with an error; other books are not touched by it.

    The session's limit on the rows of recursive queries is lifted.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    base = nodes.select("doc_id", "node_id", "parent_id", F.col("ordinal").cast("long").alias("ordinal"), "title", "href")
    parents = base.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("node_id"))
    twice = base.groupBy("doc_id", "node_id").agg(F.count("*").alias("n")).where("n > 1").join(parents, ["doc_id", "node_id"], "left_semi").select("doc_id").distinct()
    kids = base.where("parent_id IS NOT NULL").select("doc_id", F.col("parent_id").alias("up"), F.col("node_id").alias("kid"), F.array("ordinal").alias("o"), F.col("title").alias("t"), F.col("href").alias("h"))
    lost = kids.join(base.select("doc_id", F.col("node_id").alias("up")), ["doc_id", "up"], "left_anti")
    roots = base.where("parent_id IS NULL").select("doc_id", "node_id", F.array("ordinal").alias("path"), "title", "href", F.lit(True).alias("rooted"))
    tops = roots.unionByName(lost.select("doc_id", F.col("kid").alias("node_id"), F.col("o").alias("path"), F.col("t").alias("title"), F.col("h").alias("href"), F.lit(False).alias("rooted"))).join(twice, "doc_id", "left_anti")
    reached = spark.sql(
        """WITH RECURSIVE reached(doc_id, node_id, path, level, title, href, rooted) MAX RECURSION LEVEL 1000000 AS (
          SELECT doc_id, node_id, path, 1, title, href, rooted FROM {tops}
          UNION ALL
          SELECT k.doc_id, k.kid, concat(r.path, k.o), r.level + 1, k.t, k.h, r.rooted FROM reached r JOIN {kids} k ON r.doc_id = k.doc_id AND r.node_id = k.up)
        SELECT * FROM reached""",
        tops=tops, kids=kids,
    )
    books = base.groupBy("doc_id").agg(F.count("*").alias("nodes")).join(twice.withColumn("twice", F.lit(True)), "doc_id", "left")
    own = Window.partitionBy("doc_id")
    found = books.join(reached, "doc_id", "left").withColumn("found", F.count("level").over(own))
    error = F.when(F.col("twice"), REPEATS).when(F.col("found") < F.col("nodes"), CIRCLE)
    shown = F.col("rooted") & F.col("title").isNotNull() & F.col("href").isNotNull()
    ranked = found.withColumns({"error": error, "shown": F.when(error.isNull(), F.coalesce(shown, F.lit(False)))})
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("shown").desc(), "path", "node_id"))
    blank = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return ranked.withColumn("seq", seq).where(F.when(F.col("error").isNull(), F.col("shown")).otherwise(F.col("seq") == 1)).select("doc_id", *map(blank, ("seq", "level", "title", "href")), "error")


def package_tables(files: DataFrame) -> dict[str, DataFrame]:
    """items (without content), spine and metadata of books from the XML text of their package files (doc_id, xml), in the JVM.

    Metadata is a map of name spaces to maps of keys to lists of values with attributes, exploded three times; a file that is
    no XML gives no rows.
    """
    c = F.col
    items = files.select("doc_id", F.posexplode(opf.package_items(c("xml"))).alias("ordinal", "i")).select("doc_id", "i.item_id", "ordinal", "i.href", "i.item_type")
    spine = files.select("doc_id", F.posexplode(opf.package_spine(c("xml"))).alias("pos", "item_id"))
    spaces = files.select("doc_id", F.explode(F.map_entries(opf.package_metadata(c("xml")))).alias("s"))
    keys = spaces.select("doc_id", c("s.key").alias("namespace"), F.explode(F.map_entries("s.value")).alias("k"))
    values = keys.select("doc_id", "namespace", c("k.key").alias("key"), F.posexplode("k.value").alias("ordinal", "v"))
    return {"items": items, "spine": spine, "metadata": values.select("doc_id", "namespace", "key", "ordinal", "v.value", "v.attrs")}


def ncx_toc(files: DataFrame, deepest: int = 8) -> DataFrame:
    """toc (doc_id, seq, level, title, href) from the XML text of contents files (doc_id, xml), in the JVM; no rows of a file that is no XML."""
    rows = files.select("doc_id", F.posexplode(opf.ncx_entries(F.col("xml"), deepest)).alias("at", "e"))
    return rows.select("doc_id", (F.col("at") + 1).alias("seq"), "e.level", "e.title", "e.href")


def toc_chapters(toc: DataFrame, level: int = 1) -> DataFrame:
    """Entries of one level in pre-order; of all levels for level <= 0. A row with an error is no entry."""
    toc = toc.where("error IS NULL") if "error" in toc.columns else toc
    rows = toc if level <= 0 else toc.where(F.col("level") == level)
    parts = rows.select("doc_id", "seq", "title", S.href_file(F.col("href")).alias("file_path"), S.href_anchor(F.col("href")).alias("html_id"), "level", F.lit(1.0).alias("confidence"))
    return _chapters(parts, ["seq"], "native")


def _confidence(level: Column) -> Column:
    out = F.lit(None).cast("double")
    for n, c in options.HEADING_CONFIDENCE.items():
        out = F.when(level == n, F.lit(c)).otherwise(out)
    return out


_ROW = "array<struct<rank:int,ordinal:int,level:int,pos:int,title:string,html_id:string,confidence:double>>"


def _heading_rows(parsed: Column, ordinal: Column, sensitivity: str) -> Column:
    """A page's headings as rows of rank 1."""
    depth = options.heading_depth(sensitivity)
    wanted = F.filter(parsed.getField("headings"), lambda h: (h["level"] <= depth) & (h["text"] != ""))
    return F.transform(wanted, lambda h: F.struct(F.lit(1), ordinal.cast("int"), h["level"], h["pos"], h["text"], h["id"], _confidence(h["level"]))).cast(_ROW)


def _spine_rows(parsed: Column, places: Column) -> Column:
    """A page as rows of rank 2, one for each of its places in the reading order."""
    null = F.lit(None).cast("string")
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda p: F.struct(F.lit(2), p, F.lit(1), F.lit(0), parsed.getField("name"), null, F.lit(options.MANIFEST_CONFIDENCE))).cast(_ROW)


def _page_chapters(pages: DataFrame, rows: Callable[[Column], Column]) -> DataFrame:
    """Chapters of content documents, each parsed once: of a book's rows those of the least rank, in order."""
    parsed = small_batches(pages).withColumn("parsed", html.parse_html(F.col("content"), F.col("href")))
    made = parsed.select("doc_id", "href", F.explode(rows(F.col("parsed"))).alias("r")).select("doc_id", F.col("href").alias("file_path"), "r.*")
    best = F.min("rank").over(Window.partitionBy("doc_id"))
    kept = made.withColumn("best", best).where("rank = best")
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "level", "pos", "file_path"))
    method = F.when(F.col("rank") == 1, "structural").otherwise("manifest")
    return kept.withColumns({"chapter_index": index, "detection_method": method, "content_length": F.lit(0)}).select(*CHAPTER)


def _placed(items: DataFrame, spine: DataFrame) -> DataFrame:
    """Content documents with their places in the reading order (null: none)."""
    places = spine.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list(F.col("pos").cast("int"))).alias("places"))
    return items.where("item_type = 'document'").join(places, ["doc_id", "item_id"], "left")


def heading_chapters(items: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Headings of content documents: by document, then all h1, all h2, all h3, each in its place."""
    return _page_chapters(items.where("item_type = 'document'"), lambda p: _heading_rows(p, F.col("ordinal"), sensitivity))


def manifest_chapters(items: DataFrame, spine: DataFrame) -> DataFrame:
    """Every content document in reading order, titled by its title, first h1 or first h2, whichever exists first, else by its file name."""
    return _page_chapters(_placed(items, spine).where("places IS NOT NULL"), lambda p: _spine_rows(p, F.col("places")))


def detect_epub(items: DataFrame, spine: DataFrame, toc: DataFrame, strategy: str = "hybrid", sensitivity: str = "medium", toc_level: int = 1) -> DataFrame:
    """native, structural or manifest alone; else contents, then headings, then reading order, for each book the first that finds any.

    Files of books that their contents settle are never parsed; those of the others are parsed once, for headings and
    titles alike.
    """
    if strategy == "structural":
        return heading_chapters(items, sensitivity)
    if strategy == "manifest":
        return manifest_chapters(items, spine)
    native = toc_chapters(toc, toc_level)
    if strategy == "native":
        return native
    rest = items.join(native.select("doc_id").distinct(), "doc_id", "left_anti")
    return native.unionByName(_page_chapters(_placed(rest, spine), lambda p: F.concat(_heading_rows(p, F.col("ordinal"), sensitivity), _spine_rows(p, F.col("places")))))


def summarize_epub(items: DataFrame, toc: DataFrame, chapters: DataFrame, strategy: str = "hybrid") -> DataFrame:
    """One row a book. Under hybrid the strategy is what found the chapters; a table of contents counts for native and hybrid alone."""
    files = items.groupBy("doc_id").agg(F.count(F.when(F.col("item_type") == "document", 1)).alias("total_files"))
    counts = chapters.groupBy("doc_id").agg(F.count("*").alias("chapter_count"), F.min("detection_method").alias("method"))
    marks = toc.select("doc_id").distinct().withColumn("listed", F.lit(True))
    out = files.join(counts, "doc_id", "left").join(marks, "doc_id", "left")
    if strategy in ("native", "structural", "manifest"):
        used = F.lit(strategy)
    else:
        used = F.when(F.col("method") == "native", "native").when(F.col("method") == "structural", "structural (fallback)").otherwise("manifest (fallback)")
    has = F.coalesce("listed", F.lit(False)) if strategy not in ("structural", "manifest") else F.lit(False)
    return out.select("doc_id", used.alias("strategy_used"), F.coalesce("chapter_count", F.lit(0).cast("long")).alias("chapter_count"), "total_files", has.alias("has_toc"), S.yes_no(has).alias("toc"))


def preview_epub(chapters: DataFrame) -> DataFrame:
    return chapters.select(
        "doc_id", "chapter_index", S.ellipsis(F.col("title")).alias("title"), S.shown_file(F.col("file_path"), F.col("html_id")).alias("file"), "level", "detection_method",
        S.percent(F.col("confidence")).alias("confidence_pct"), S.colour(F.col("confidence"), 0.5).alias("colour"), S.location(F.col("file_path"), F.col("html_id")).alias("location"),
    )


def at_level(chapters: DataFrame, level: int) -> DataFrame:
    return chapters.where(F.col("level") == level)


def confident(chapters: DataFrame, least: float = 0.7) -> DataFrame:
    return chapters.where(F.col("confidence") >= least)


def low_confidence(chapters: DataFrame, below: float = 0.5) -> DataFrame:
    """Chapters below a confidence, counted for each document; any asks for a confirmation before splitting."""
    return chapters.groupBy("doc_id").agg(F.count_if(F.col("confidence") < below).alias("low_confidence"), F.count("*").alias("chapters"))
