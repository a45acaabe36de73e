"""What to write for each chapter: names, pages, contents, resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwork.functions import html
from leafwork.functions import strings as S
from leafwork.functions.batches import small_batches

PDF_PATTERN, EPUB_PATTERN = "{index:02d}_{title}.pdf", "{index:02d}_{title}"


def plan_pdf(chapters: DataFrame, pattern: str = PDF_PATTERN, keep_metadata: bool = True) -> DataFrame:
    """One row a file, with its page range; is_inverted marks ranges that hold no page."""
    c = F.col
    fields = {"index": c("chapter_index"), "title": S.safe_name(c("title")), "start": c("start_page"), "end": c("end_page"), "pages": c("page_count")}
    name = S.with_suffix(S.template(pattern, fields), ".pdf")
    return chapters.select("doc_id", "chapter_index", name.alias("output_name"), "title", "start_page", "end_page", (c("end_page") < c("start_page")).alias("is_inverted"), F.lit(keep_metadata).alias("preserve_metadata"))


def plan_epub(chapters: DataFrame, pattern: str = EPUB_PATTERN, output: str = "epub", keep_metadata: bool = True) -> DataFrame:
    """One row a file; a name that ends in the other format's suffix has that replaced whole."""
    c, other = F.col, {"epub": ".pdf", "pdf": ".epub"}[output]
    fields = {"index": c("chapter_index"), "title": S.safe_name(c("title")), "file": F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")}
    name = S.with_suffix(S.template(pattern, fields), f".{output}", other)
    return chapters.select("doc_id", "chapter_index", name.alias("output_name"), "title", "file_path", "html_id", F.lit(keep_metadata).alias("preserve_metadata"))


def collisions(plan: DataFrame) -> DataFrame:
    """Names that more than one chapter of a document would be written to."""
    return plan.groupBy("doc_id", "output_name").agg(F.count("*").alias("chapters")).where("chapters > 1")


BIN = 64  # pages


def chapter_pages(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page, ...) of each chapter: an interval join by bins.

    A range is cut to the pages that its document has, so that one to any number costs no more, then at bins of BIN pages; ranges
    and pages meet by document and bin, and a comparison settles the first and last bin.
    """
    bin_of = lambda c: F.floor(c / BIN)
    extent = pages.groupBy("doc_id").agg(F.min("page").alias("least"), F.max("page").alias("most"))
    low, high = F.greatest("start_page", "least"), F.least("end_page", "most")
    cut = plan.join(extent, "doc_id").select("doc_id", "chapter_index", low.alias("low"), high.alias("high")).where("low <= high")
    ranges = cut.select("doc_id", "chapter_index", "low", "high", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))).alias("bin"))
    own = pages.withColumn("bin", bin_of(F.col("page")))
    return ranges.join(own, ["doc_id", "bin"]).where("page BETWEEN low AND high").select("doc_id", "page", "chapter_index", *[c for c in pages.columns if c not in ("doc_id", "page")])


def chapter_contents(plan: DataFrame, items: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Content of each chapter's file; a miss stays with null content (book output) or goes, its number unused (page output)."""
    own = items.select("doc_id", F.col("href").alias("file_path"), "content", "item_id")
    return plan.join(own, ["doc_id", "file_path"], "left" if keep_missing else "inner")


def chapter_sections(contents: DataFrame) -> DataFrame:
    """Content, as text, cut to the element that the chapter's anchor names, whole where there is none; missing content stays so."""
    return small_batches(contents).withColumn("content", html.section_of(F.col("content"), F.coalesce("html_id", F.lit(""))))


def resource_refs(contents: DataFrame) -> DataFrame:
    """Style sheets, images and url() targets of inline styles that each chapter's content names."""
    found = small_batches(contents).select("doc_id", "chapter_index", "file_path", F.explode(html.parse_html(F.col("content")).getField("refs")).alias("r"))
    return found.select("doc_id", "chapter_index", "file_path", F.col("r.kind").alias("kind"), F.col("r.ref").alias("ref"))


def resolve_resources(refs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (doc_id, chapter_index, kind, ref, item_id, resolved_by): a reference, without its fragment, as an item's
    href, else below its chapter's folder; what is neither is dropped. `..` is not resolved."""
    bare = F.substring_index("ref", "#", 1)
    asked = refs.withColumn("raw", bare).withColumn("below", S.join_path(S.directory(F.col("file_path")), F.col("raw")))
    direct = items.select("doc_id", F.col("href").alias("raw"), F.col("item_id").alias("direct"))
    nested = items.select("doc_id", F.col("href").alias("below"), F.col("item_id").alias("nested"))
    got = asked.join(direct, ["doc_id", "raw"], "left").join(nested, ["doc_id", "below"], "left")
    by = F.when(F.col("direct").isNotNull(), "href").otherwise("folder")
    return got.select("doc_id", "chapter_index", "kind", "ref", F.coalesce("direct", "nested").alias("item_id"), by.alias("resolved_by")).where("item_id IS NOT NULL").distinct()


def chapter_books(contents: DataFrame, items: DataFrame, metadata: DataFrame) -> DataFrame:
    """contents with what a chapter's own book takes along: resources, the items that its content refers to, each once; and
    metadata, all entries (namespace, key, ordinal, value, attrs) of its document where they are to be kept.

    Items are joined by (document, item) to the distinct references, so a book's files travel only to chapters that show
    them. A chapter's book is one row: what it shows must fit in a task, as the file made of it does.
    """
    rows = contents.select("doc_id", "chapter_index", "file_path", "content")
    found = resolve_resources(resource_refs(rows.where("content IS NOT NULL")), items).select("doc_id", "chapter_index", "item_id").distinct()
    held = found.join(items.where("content IS NOT NULL"), ["doc_id", "item_id"]).groupBy("doc_id", "chapter_index")
    resources = held.agg(F.sort_array(F.collect_list(F.struct("href", "item_type", "content"))).alias("resources"))
    entry = F.struct("namespace", "key", "ordinal", "value", "attrs")
    kept = metadata.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry), _by_name).alias("all"))
    joined = contents.join(resources, ["doc_id", "chapter_index"], "left").join(kept, "doc_id", "left")
    return joined.withColumn("metadata", F.when(F.col("preserve_metadata"), F.col("all"))).drop("all")


def _by_name(a: Column, b: Column) -> Column:
    """Order of metadata entries; maps can't be compared, and needn't be."""
    left, right = (F.struct(x["namespace"], x["key"], x["ordinal"]) for x in (a, b))
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def merged_metadata(source: DataFrame, plan: DataFrame) -> DataFrame:
    """Metadata (doc_id, metadata map) of each output: the source's with the chapter's title, or the title alone."""
    own = F.create_map(F.lit("title"), F.col("title"))
    kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "title")
    return plan.join(source, "doc_id", "left").select("doc_id", "chapter_index", F.when(F.col("preserve_metadata"), F.map_concat(kept, own)).otherwise(own).alias("metadata"))
