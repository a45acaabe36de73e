"""Queries over the bridge views, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions import html, paginate
from leafwork.functions import strings as S
from leafwork.functions.batches import small_batches
from leafwork.operators import book, layout, markup, split
from leafwork.sources.bridges import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- views that the SQL shares
OUTLINE = """
outline AS (SELECT o_custkey AS doc_id, row_number() OVER w AS seq, CAST(1 + o_orderkey % 3 AS INTEGER) AS level, o_orderpriority || ' ' || o_orderkey AS title,
    CAST(1 + coalesce(sum(o_orderkey % 5) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
odocs AS (SELECT doc_id, max(page) + 2 AS total_pages FROM outline GROUP BY doc_id)"""


def _outline_chapters(level: int, outline: str = "outline", docs: str = "odocs") -> str:
    return f"""
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS chapter_index, title, start_page, end_page, end_page - start_page + 1 AS page_count,
    {level} AS level, 'bookmark' AS detection_method, CAST(1.0 AS DOUBLE) AS confidence
  FROM (SELECT o.doc_id, seq, title, page AS start_page, coalesce(lead(page) OVER (PARTITION BY o.doc_id ORDER BY seq) - 1, total_pages) AS end_page
        FROM {outline} o JOIN {docs} d ON o.doc_id = d.doc_id WHERE level = {level}) WHERE start_page <= end_page"""


LAYOUT = r"""
p AS (SELECT doc_id AS k, source AS doc_id, text, CAST(regexp_extract(source, '(\d+)$', 1) AS INTEGER) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents),
ldocs AS (SELECT source AS doc_id, count(*) AS total_pages FROM documents GROUP BY source),
l AS (SELECT k, doc_id, n, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM p),
spans AS (SELECT doc_id, page, line, CASE WHEN n < 16 AND line = 0 THEN [18.0, 16.0, 14.0, 12.0][k % 4 + 1] ELSE 11.0 END::DOUBLE AS size,
    CASE WHEN n < 16 AND line = 0 AND k % 3 = 0 THEN 'Chapter ' || page || ': ' || raw WHEN n < 16 AND line = 1 AND k % 5 = 0 THEN 'Part ' || page || ' ' || raw ELSE raw END AS text FROM l),
loutline AS (SELECT doc_id, page AS seq, CASE WHEN n % 3 = 0 THEN 1 + k % 2 ELSE 2 END AS level, 'Entry ' || k AS title, page FROM p WHERE n % 3 < 2),
t AS (SELECT doc_id, page, line, size, avg(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY doc_id, page) AS avg_size, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM spans),
f AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, regexp_matches(text, '(?i)^(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)') OR regexp_matches(text, '^\d+\.\s+.') AS pat FROM t WHERE text <> '')"""


def _candidates(ratio: float) -> str:
    return f"""
c AS (SELECT doc_id, page, line, text, size, avg_size, greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + CASE WHEN pat THEN 0.4::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN size >= 16 THEN 0.1::DOUBLE WHEN size >= 14 THEN 0.05::DOUBLE ELSE 0::DOUBLE END - CASE WHEN words > 10 THEN 0.2::DOUBLE WHEN words > 6 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)) AS confidence
  FROM f WHERE pat OR (avg_size > 0 AND size >= avg_size * {ratio}::DOUBLE AND words <= 10))"""


def _heuristic(least: float, where: str = "TRUE") -> str:
    return f"""
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, line) AS INTEGER) AS chapter_index, text AS title, page AS start_page, end_page, end_page - page + 1 AS page_count,
    1 AS level, 'heuristic' AS detection_method, confidence
  FROM (SELECT c.doc_id, page, line, text, confidence, coalesce(lead(page) OVER (PARTITION BY c.doc_id ORDER BY page, line) - 1, total_pages) AS end_page
        FROM c JOIN ldocs d ON c.doc_id = d.doc_id WHERE confidence >= {least}::DOUBLE AND {where.replace("doc_id", "c.doc_id", 1)})"""


_FALLBACK = "SELECT doc_id, 1 AS chapter_index, 'Complete Document' AS title, CAST(1 AS BIGINT) AS start_page, total_pages AS end_page, total_pages AS page_count, 1 AS level, 'fallback' AS detection_method, CAST(1.0 AS DOUBLE) AS confidence FROM ldocs"
HYBRID = (
    f"{LAYOUT}, {_candidates(1.3)}, b AS ({_outline_chapters(1, 'loutline', 'ldocs')}), h AS ({_heuristic(0.6, 'doc_id NOT IN (SELECT doc_id FROM b)')}), "
    f"ch AS (SELECT * FROM b UNION ALL SELECT * FROM h UNION ALL {_FALLBACK} WHERE doc_id NOT IN (SELECT doc_id FROM b) AND doc_id NOT IN (SELECT doc_id FROM h))"
)

_unescape = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
BOOK = f"""
fl AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS doc_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) AS pos,
    regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS href, html FROM pages),
hd AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, i) AS INTEGER) AS chapter_index, title, href AS file_path, CAST(NULL AS VARCHAR) AS html_id, 1 AS level, 'structural' AS detection_method, CAST(1.0 AS DOUBLE) AS confidence, 0 AS content_length
  FROM (SELECT doc_id, pos, href, unnest(range(1, len(h) + 1)) AS i, {_strip.format(_unescape.format("regexp_replace(unnest(h), '<[^>]+>', '', 'g')"))} AS title
        FROM (SELECT doc_id, pos, href, regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h FROM fl)) WHERE title <> ''),
mf AS (SELECT doc_id, CAST(pos AS INTEGER) AS chapter_index, {_strip.format(_unescape.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title, href AS file_path, CAST(NULL AS VARCHAR) AS html_id, 1 AS level,
    'manifest' AS detection_method, CAST(0.6 AS DOUBLE) AS confidence, 0 AS content_length FROM fl),
tl AS (SELECT doc_id, page_id, unnest(range(1, len(h) + 1)) AS nth, unnest(h) AS h, unnest(x) AS t FROM (SELECT doc_id, page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS x FROM fl)),
toc AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, nth) AS seq, 1 AS level, t AS title, h || '#p' || page_id AS href FROM tl)"""
_NATIVE = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS INTEGER) AS chapter_index, title, split_part(href, '#', 1) AS file_path,
  CASE WHEN strpos(href, '#') > 0 THEN substr(href, strpos(href, '#') + 1) ELSE '' END AS html_id, level, 'native' AS detection_method, CAST(1.0 AS DOUBLE) AS confidence, 0 AS content_length FROM {} WHERE {}"""
TREE = """
tt AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS seq, level, title, href FROM (
  SELECT r_regionkey AS doc_id, -1 AS a, -1 AS b, 1 AS level, r_name AS title, 'r' || r_regionkey AS href FROM region
  UNION ALL SELECT n_regionkey, n_nationkey, -1, 2, n_name, 'r' || n_regionkey || '#n' || n_nationkey FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 3, c_name, 'n' || n_nationkey || '#c' || c_custkey || '#x' FROM customer JOIN nation ON c_nationkey = n_nationkey))"""
_safe = r"""regexp_replace(regexp_replace(translate({}, '<>:"/\|?*', '_________'), '[\s_]+', '_', 'g'), '^_+|_+$', '', 'g')"""
_safe_cut = "CASE WHEN {0} = '' THEN 'untitled' WHEN length({0}) > 100 THEN regexp_replace(substr({0}, 1, 100), '_+$', '') ELSE {0} END"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# ---- outlines
for _level in (1, 2, 3):
    query(f"outline_chapters_l{_level}", f"WITH {OUTLINE} {_outline_chapters(_level)}")(lambda t, n=_level: layout.outline_chapters(t.outline_documents(), t.outline(), n))

query("outline_chapters_ranged", SQL["outline_chapters_l1"])(lambda t: layout.ranged_chapters(t.outline_documents(), t.outline(), 1, 4))

query("outline_level_histogram", f"WITH {OUTLINE} SELECT level, count(*) AS entries FROM outline GROUP BY level")(lambda t: layout.level_histogram(t.outline()))
for _most in (3, 50):  # of each document's outline
    query(f"outline_first_{_most}", f"WITH {OUTLINE} SELECT doc_id, CAST(seq AS INTEGER) AS seq, repeat('  ', level - 1) || title AS entry, page FROM outline WHERE seq <= {_most}")(lambda t, n=_most: layout.first_entries(t.outline(), n))
query("outline_has_bookmarks", "SELECT c_custkey AS doc_id, count(o_orderkey) AS entries, count(o_orderkey) > 0 AS has_bookmarks FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")(
    lambda t: t("customer").select(F.col("c_custkey").alias("doc_id")).join(t.outline().groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("entries"), (F.coalesce("n", F.lit(0)) > 0).alias("has_bookmarks"))
)

# ---- layouts
query("page_avg_font", f"WITH {LAYOUT} SELECT doc_id, page, coalesce(avg(CASE WHEN size > 0 THEN size END), 0)::DOUBLE AS avg_size FROM spans GROUP BY doc_id, page")(lambda t: layout.page_fonts(t.spans()))
query("heading_candidates", f"WITH {LAYOUT}, {_candidates(1.2)} SELECT doc_id, page, CAST(line AS INTEGER) AS line, text, size, avg_size, confidence FROM c")(
    lambda t: layout.heading_candidates(t.spans(), "high").select("doc_id", "page", "line", "text", "size", "avg_size", "confidence")
)
query("heading_confidence", f"WITH {LAYOUT}, {_candidates(0.0)} SELECT confidence, count(*) AS lines FROM c GROUP BY confidence")(
    lambda t: t.spans().select(S.strip(F.col("text")).alias("text"), "size").where((F.col("text") != "") & (S.is_heading(F.col("text")) | (S.word_count(F.col("text")) <= 10))).groupBy(S.heading_score(F.col("text"), F.col("size")).alias("confidence")).agg(F.count("*").alias("lines"))
)
for _name, _ratio, _least in (("low", 1.5, 0.8), ("medium", 1.3, 0.6), ("high", 1.2, 0.4)):
    query(f"heuristic_chapters_{_name}", f"WITH {LAYOUT}, {_candidates(_ratio)} {_heuristic(_least)}")(lambda t, s=_name: layout.heuristic_chapters(t.layout_documents(), t.spans(), s))

_MIXED = r"""
ms AS (SELECT doc_id, page, line // 3 AS block, line, 0 AS span, substr(text, 1, 12) AS text, size FROM spans UNION ALL SELECT doc_id, page, line // 3, line, 1, substr(text, 13), size + page % 2 * 3.0 FROM spans),
mt AS (SELECT doc_id, page, block, line, span, size, avg(CASE WHEN size > 0 THEN size END) OVER (PARTITION BY doc_id, page) AS avg_size, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM ms WHERE block % 4 <> 3),
mw AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words, regexp_matches(text, '(?i)^(?:chapter|part)\s+(?:\d+|[ivxlcdm]+)') OR regexp_matches(text, '^\d+\.\s+.') AS pat FROM mt WHERE text <> ''),
mc AS (SELECT * FROM mw WHERE pat OR (avg_size > 0 AND size >= avg_size * {ratio}::DOUBLE AND words <= 10) QUALIFY row_number() OVER (PARTITION BY doc_id, page, block, line ORDER BY span) = 1),
ma AS (SELECT doc_id, page, block, line, span, text, size, avg_size, greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + CASE WHEN pat THEN 0.4::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN size >= 16 THEN 0.1::DOUBLE WHEN size >= 14 THEN 0.05::DOUBLE ELSE 0::DOUBLE END - CASE WHEN words > 10 THEN 0.2::DOUBLE WHEN words > 6 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)) AS confidence FROM mc)"""
query("span_headings", f"WITH {LAYOUT}, {_MIXED.replace('{ratio}', '1.2')} SELECT doc_id, page, CAST(block AS INTEGER) AS block, CAST(line AS INTEGER) AS line, span, text, size, confidence FROM ma")(
    lambda t: layout.heading_candidates(t.mixed_spans(), "high").select("doc_id", "page", "block", "line", "span", "text", "size", "confidence")
)
_NESTED = lambda df: df.withColumn("line", F.col("block") * 3 + F.col("line"))  # noqa: E731  lines of spans count through the page
query("nested_headings", SQL["span_headings"])(lambda t: _NESTED(layout.nested_headings(t.nested_pages(), "high")).select("doc_id", "page", "block", "line", "span", "text", "size", "confidence"))
query(
    "span_chapters",
    f"""WITH {LAYOUT}, {_MIXED.replace('{ratio}', '1.3')} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, block, line, span) AS INTEGER) AS chapter_index, text AS title, page AS start_page, end_page,
    end_page - page + 1 AS page_count, 1 AS level, 'heuristic' AS detection_method, confidence
    FROM (SELECT ma.*, coalesce(lead(page) OVER (PARTITION BY ma.doc_id ORDER BY page, block, line, span) - 1, total_pages) AS end_page FROM ma JOIN ldocs d ON ma.doc_id = d.doc_id WHERE confidence >= 0.6::DOUBLE)""",
)(lambda t: layout.heuristic_chapters(t.layout_documents(), t.mixed_spans()))

query("nested_chapters", SQL["span_chapters"])(lambda t: layout.heuristic_chapters(t.layout_documents(), t.nested_pages()))


def _detect(t: Tables, strategy: str) -> DataFrame:
    return layout.detect_pdf(t.layout_documents(), t.layout_outline(), t.spans(), strategy)


query("pdf_hybrid", f"WITH {HYBRID} SELECT * FROM ch")(lambda t: _detect(t, "hybrid"))
query("pdf_bookmarks", f"WITH {LAYOUT}, b AS ({_outline_chapters(1, 'loutline', 'ldocs')}) SELECT * FROM b UNION ALL {_FALLBACK} WHERE doc_id NOT IN (SELECT doc_id FROM b)")(lambda t: _detect(t, "bookmarks"))
query("pdf_heuristic", f"WITH {LAYOUT}, {_candidates(1.3)}, h AS ({_heuristic(0.6)}) SELECT * FROM h UNION ALL {_FALLBACK} WHERE doc_id NOT IN (SELECT doc_id FROM h)")(lambda t: _detect(t, "heuristic"))
query("pdf_fallback", f"WITH {LAYOUT} {_FALLBACK}")(lambda t: _detect(t, "none"))
query(
    "pdf_summary",
    f"""WITH {HYBRID}, s AS (SELECT ldocs.doc_id, CASE WHEN min(detection_method) = 'fallback' THEN 'fallback' ELSE 'hybrid' END AS strategy_used, count(*) AS chapter_count, any_value(total_pages) AS total_pages,
      ldocs.doc_id IN (SELECT doc_id FROM loutline) AS has_bookmarks, min(detection_method) AS origin_strategy FROM ldocs JOIN ch ON ldocs.doc_id = ch.doc_id GROUP BY ldocs.doc_id)
    SELECT *, 'Strategy: ' || strategy_used || chr(10) || 'Chapters: ' || chapter_count || chr(10) || 'Pages: ' || total_pages || chr(10) || 'Bookmarks: ' || CASE WHEN has_bookmarks THEN 'Yes' ELSE 'No' END AS summary,
      NOT has_bookmarks AS try_heuristic, strategy_used = 'fallback' AS confirm FROM s""",
)(lambda t: layout.summarize_pdf(t.layout_documents(), t.layout_outline(), _detect(t, "hybrid")))
query(
    "pdf_preview",
    f"""WITH {HYBRID} SELECT doc_id, chapter_index, title, page_count, start_page || '-' || end_page AS page_range, CAST(round(confidence * 100) AS INTEGER) || '%' AS confidence_pct,
      CASE WHEN confidence >= 0.8::DOUBLE THEN 'green' WHEN confidence >= 0.6::DOUBLE THEN 'yellow' ELSE 'red' END AS colour, detection_method,
      CASE WHEN detection_method = 'bookmark' THEN 'green' ELSE 'yellow' END AS method_colour, title || ' (pages ' || start_page || '-' || end_page || ')' AS label FROM ch""",
)(lambda t: layout.preview_pdf(_detect(t, "hybrid")))
query("low_confidence_count", f"WITH {LAYOUT}, {_candidates(1.2)}, h AS ({_heuristic(0.4)}) SELECT doc_id, count(*) FILTER (WHERE confidence < 0.5::DOUBLE) AS low_confidence, count(*) AS chapters FROM h GROUP BY doc_id")(
    lambda t: book.low_confidence(layout.heuristic_chapters(t.layout_documents(), t.spans(), "high"))
)
query("confident_chapters", f"WITH {LAYOUT}, {_candidates(1.2)}, h AS ({_heuristic(0.4)}) SELECT * FROM h WHERE confidence >= 0.7::DOUBLE")(lambda t: book.confident(layout.heuristic_chapters(t.layout_documents(), t.spans(), "high")))

# ---- books
query("structural_headings", f"WITH {BOOK} SELECT * FROM hd")(lambda t: book.heading_chapters(t.items()))
query("manifest_chapters", f"WITH {BOOK} SELECT * FROM mf")(lambda t: book.manifest_chapters(t.items(), t.spine()))
query(
    "stem_title",
    rf"""WITH {BOOK}, s AS (SELECT doc_id, href, replace(regexp_replace(regexp_extract(href, '([^/]*)/*$', 1), '(.)\.[^.]+$', '\1'), '_', ' ') AS s FROM fl)
    SELECT doc_id, href, array_to_string(list_transform(range(1, length(s) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(substr(s, i - 1, 1), '\p{{L}}') THEN lower(substr(s, i, 1)) ELSE upper(substr(s, i, 1)) END), '') AS title FROM s""",
)(lambda t: t.items().select("doc_id", "href", html.title_of_stem(F.col("href")).alias("title")))
_H1 = """h1 AS (SELECT doc_id, pos, 1 AS level, i, title, CAST(NULL AS VARCHAR) AS html_id, href, 1.0 AS c FROM (SELECT doc_id, pos, href, unnest(range(1, len(h) + 1)) AS i, {} AS title
  FROM (SELECT doc_id, pos, href, regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h FROM fl)) WHERE title <> ''),
lv AS (SELECT * FROM h1 UNION ALL SELECT doc_id, pos, 2, 0, 'Sub ' || page_id, 's' || page_id, href, 0.7 FROM fl UNION ALL SELECT doc_id, pos, 3, 0, 'Deep ' || page_id, NULL, href, 0.5 FROM fl)""".format(
    _strip.format(_unescape.format("regexp_replace(unnest(h), '<[^>]+>', '', 'g')"))
)
for _name, _deepest in (("low", 1), ("medium", 2), ("high", 3)):
    query(
        f"headings_{_name}",
        f"""WITH {BOOK}, {_H1} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos, level, i) AS INTEGER) AS chapter_index, title, href AS file_path, html_id, level, 'structural' AS detection_method,
        CAST(c AS DOUBLE) AS confidence, 0 AS content_length FROM lv WHERE level <= {_deepest}""",
    )(lambda t, s=_name: book.heading_chapters(t.headed_items(), s))
query(
    "manifest_gaps",
    f"WITH {BOOK} SELECT mf.* REPLACE (CAST(row_number() OVER (PARTITION BY mf.doc_id ORDER BY pos) AS INTEGER) AS chapter_index) FROM mf JOIN fl ON mf.doc_id = fl.doc_id AND mf.chapter_index = fl.pos WHERE pos % 3 <> 0",
)(lambda t: book.manifest_chapters(t.gappy_items(), t.gappy_spine()))
query("toc_flat", f"WITH {BOOK} {_NATIVE.format('toc', 'TRUE')}")(lambda t: book.toc_chapters(t.toc()))
for _level in (1, 2, 3):
    query(f"toc_tree_level_{_level}", f"WITH {TREE} {_NATIVE.format('tt', f'level = {_level}')}")(lambda t, n=_level: book.toc_chapters(book.flatten_toc(t.toc_tree()), n))
query("toc_all_levels", f"WITH {TREE} {_NATIVE.format('tt', 'TRUE')}")(lambda t: book.toc_chapters(book.flatten_toc(t.toc_tree()), 0))

query(
    "package_metadata",
    """WITH p AS (SELECT * FROM pages WHERE page_id % 10 <> 9), m AS (
      SELECT page_id, 'dc' AS namespace, 'title' AS key, 0 AS ordinal, url AS value, 'id=t' || page_id AS attrs FROM p
      UNION ALL SELECT page_id, 'dc', 'creator', 0, 'Author ' || page_id, 'role=aut' FROM p UNION ALL SELECT page_id, 'dc', 'creator', 1, 'Other', '' FROM p
      UNION ALL SELECT page_id, 'dc', 'language', 0, 'en', '' FROM p WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'opf', 'meta', 0, '', 'content=i' || page_id || ' name=cover' FROM p)
    SELECT page_id AS doc_id, namespace, key, ordinal, value, attrs FROM m""",
)(lambda t: book.package_tables(t.packages())["metadata"].withColumn("attrs", F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")))
query(
    "package_items",
    """SELECT page_id AS doc_id, i.item_id, i.ordinal, i.href, i.item_type, i.pos FROM pages, (SELECT unnest([{'item_id': 'a', 'ordinal': 0, 'item_type': 'document', 'pos': 0}, {'item_id': 'n', 'ordinal': 1, 'item_type': 'navigation', 'pos': NULL}], recursive := true)) k,
      LATERAL (SELECT k.item_id, k.ordinal, k.item_type, k.pos, CASE WHEN k.ordinal = 0 THEN 'text/c ' || page_id || '.xhtml' ELSE 'toc.ncx' END AS href) i WHERE page_id % 10 <> 9""",
)(lambda t: (lambda x: x["items"].join(x["spine"], ["doc_id", "item_id"], "left"))(book.package_tables(t.packages())))
query(
    "ncx_toc",
    rf"""WITH {BOOK}, e AS (SELECT page_id, 1 AS seq, 1 AS level, 'Page ' || page_id AS title, url AS href FROM pages
      UNION ALL SELECT page_id, 2 * nth, 2, {_strip.format('t')}, h FROM tl UNION ALL SELECT page_id, 2 * nth + 1, 4, 'below ' || (nth - 1), 'y' FROM tl)
    SELECT page_id AS doc_id, CAST(seq AS INTEGER) AS seq, level, title, href FROM e""",
)(lambda t: book.ncx_toc(t.contents_files()))


def _partial_toc(t: Tables) -> DataFrame:
    return t.toc().where(F.length("doc_id") % 2 == 0)


_EPUB = f"{BOOK}, nt AS ({_NATIVE.format('toc', 'length(doc_id) % 2 = 0')}), eh AS (SELECT * FROM nt UNION ALL SELECT * FROM hd WHERE doc_id NOT IN (SELECT doc_id FROM nt) UNION ALL SELECT * FROM mf WHERE doc_id NOT IN (SELECT doc_id FROM nt) AND doc_id NOT IN (SELECT doc_id FROM hd))"
query("epub_hybrid", f"WITH {_EPUB} SELECT * FROM eh")(lambda t: book.detect_epub(t.items(), t.spine(), _partial_toc(t)))
query("epub_native", f"WITH {BOOK} {_NATIVE.format('toc', 'length(doc_id) % 2 = 0')}")(lambda t: book.detect_epub(t.items(), t.spine(), _partial_toc(t), "native"))
query(
    "epub_summary",
    f"""WITH {_EPUB}, n AS (SELECT doc_id, count(*) AS total_files FROM fl GROUP BY doc_id), s AS (SELECT doc_id, count(*) AS chapter_count, min(detection_method) AS m FROM eh GROUP BY doc_id)
    SELECT n.doc_id, CASE m WHEN 'native' THEN 'native' WHEN 'structural' THEN 'structural (fallback)' ELSE 'manifest (fallback)' END AS strategy_used, coalesce(chapter_count, 0) AS chapter_count, total_files,
      n.doc_id IN (SELECT doc_id FROM toc WHERE length(doc_id) % 2 = 0) AS has_toc, CASE WHEN n.doc_id IN (SELECT doc_id FROM toc WHERE length(doc_id) % 2 = 0) THEN 'Yes' ELSE 'No' END AS toc FROM n LEFT JOIN s ON n.doc_id = s.doc_id""",
)(lambda t: book.summarize_epub(t.items(), _partial_toc(t), book.detect_epub(t.items(), t.spine(), _partial_toc(t))))
query(
    "epub_preview",
    f"""WITH {_EPUB} SELECT doc_id, chapter_index, CASE WHEN length(title) > 50 THEN substr(title, 1, 47) || '...' ELSE title END AS title,
      regexp_extract(file_path, '([^/]*)$', 1) || CASE WHEN coalesce(html_id, '') <> '' THEN '#' || html_id ELSE '' END AS file, level, detection_method, CAST(round(confidence * 100) AS INTEGER) || '%' AS confidence_pct,
      CASE WHEN confidence >= 0.8::DOUBLE THEN 'green' WHEN confidence >= 0.5::DOUBLE THEN 'yellow' ELSE 'red' END AS colour, file_path || CASE WHEN coalesce(html_id, '') <> '' THEN '#' || html_id ELSE '' END AS location FROM eh""",
)(lambda t: book.preview_epub(book.detect_epub(t.items(), t.spine(), _partial_toc(t))))
query("chapters_by_level", f"WITH {TREE}, c AS ({_NATIVE.format('tt', 'TRUE')}) SELECT * FROM c WHERE level = 2")(lambda t: book.at_level(book.toc_chapters(book.flatten_toc(t.toc_tree()), 0), 2))

# ---- splitting
query("sanitize_titles", f"WITH {BOOK}, s AS (SELECT *, {_safe.format('title')} AS x FROM mf) SELECT doc_id, chapter_index, {_safe_cut.format('x')} AS name FROM s")(
    lambda t: book.manifest_chapters(t.items(), t.spine()).select("doc_id", "chapter_index", S.safe_name(F.col("title")).alias("name"))
)
query(
    "output_filenames",
    f"""WITH {OUTLINE}, ch AS ({_outline_chapters(1)}), s AS (SELECT *, {_safe.format('title')} AS x FROM ch)
    SELECT doc_id, chapter_index, CASE WHEN chapter_index < 10 THEN '0' ELSE '' END || chapter_index || '_' || {_safe_cut.format('x')} || '.pdf' AS output_name, title, start_page, end_page, FALSE AS is_inverted, TRUE AS preserve_metadata FROM s""",
)(lambda t: split.plan_pdf(layout.outline_chapters(t.outline_documents(), t.outline())))
query("filename_collisions", f"WITH {BOOK}, s AS (SELECT *, {_safe.format('title')} AS x FROM toc) SELECT doc_id, {_safe_cut.format('x')} || '.epub' AS output_name, count(*) AS chapters FROM s GROUP BY ALL HAVING count(*) > 1")(
    lambda t: split.collisions(split.plan_epub(book.toc_chapters(t.toc()), "{title}"))
)
query("chapter_pages", f"WITH {OUTLINE}, ch AS ({_outline_chapters(1)}), pg AS (SELECT doc_id, unnest(range(1, total_pages + 1)) AS page FROM odocs) SELECT ch.doc_id, chapter_index, pg.page FROM ch JOIN pg ON ch.doc_id = pg.doc_id AND pg.page BETWEEN start_page AND end_page")(
    lambda t: split.chapter_pages(split.plan_pdf(layout.outline_chapters(t.outline_documents(), t.outline())), t.outline_documents().select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "total_pages")).alias("page"))).select("doc_id", "chapter_index", "page")
)
_LABELLED = """pl AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY l.doc_id) AS i, l.doc_id AS k FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
it AS (SELECT doc_id AS k, text FROM documents WHERE doc_id % 3 <> 0)"""
for _join, _keep in (("left", True), ("inner", False)):
    query(f"content_{_join}", f"WITH {_LABELLED} SELECT pl.doc_id, CAST(i AS INTEGER) AS chapter_index, 'd' || pl.k AS file_path, length(text)::INTEGER AS chars FROM pl {_join.upper()} JOIN it ON pl.k = it.k")(
        lambda t, keep=_keep: split.chapter_contents(t.labelled_plan(), t.labelled_items(), keep).select("doc_id", "chapter_index", "file_path", F.length("content").alias("chars"))
    )
_REFS = """rf AS (SELECT doc_id, pos, href, unnest(['css', 'img', 'style_url']) AS kind, unnest(['css/s' || page_id % 3 || '.css#v1', '/img/' || page_id % 7 || '.png', 'fonts/f' || page_id % 5 || '.woff']) AS ref FROM fl)"""


def _rich(t: Tables) -> tuple[DataFrame, DataFrame]:
    items = t.rich_items()
    pages = items.where("item_type = 'document'")
    return items, split.resource_refs(pages.select("doc_id", F.col("ordinal").alias("chapter_index"), F.col("href").alias("file_path"), "content"))


query("resource_refs", f"WITH {BOOK}, {_REFS} SELECT doc_id, CAST(pos AS INTEGER) AS chapter_index, href AS file_path, kind, ref FROM rf")(lambda t: _rich(t)[1])
query(
    "resource_resolved",
    f"""WITH {BOOK}, {_REFS}, dr AS (SELECT DISTINCT doc_id, regexp_extract(href, '^(.*)/[^/]*$', 1) AS dir FROM fl),
    rs AS (SELECT DISTINCT doc_id, unnest(['css/s0.css', dir || '/css/s1.css', '/img/3.png', '/img/5.png', dir || '/fonts/f2.woff', 'fonts/f4.woff']) AS h FROM dr WHERE dir <> ''),
    q AS (SELECT *, split_part(ref, '#', 1) AS raw, CASE WHEN ref LIKE '/%' THEN split_part(ref, '#', 1) ELSE (CASE WHEN regexp_matches(href, '^/[^/]*$') THEN '' ELSE regexp_extract(href, '^(.*)/[^/]*$', 1) END) || '/' || split_part(ref, '#', 1) END AS below FROM rf)
    SELECT DISTINCT q.doc_id, CAST(pos AS INTEGER) AS chapter_index, kind, ref, coalesce(a.h, b.h) AS item_id, CASE WHEN a.h IS NOT NULL THEN 'href' ELSE 'folder' END AS resolved_by
    FROM q LEFT JOIN rs a ON q.doc_id = a.doc_id AND q.raw = a.h LEFT JOIN rs b ON q.doc_id = b.doc_id AND q.below = b.h WHERE coalesce(a.h, b.h) IS NOT NULL""",
)(lambda t: split.resolve_resources(_rich(t)[1], t.rich_items().where("item_type = 'resource'")))
query("css_urls", f"WITH {BOOK}, {_REFS} SELECT doc_id, pos AS ordinal, ref AS url FROM rf WHERE kind = 'style_url'")(
    lambda t: t.rich_items().where("item_type = 'document'").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.explode(S.css_urls(F.col("content"))).alias("url"))
)
_strip_tags = r"regexp_replace(regexp_replace({}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
query(
    "html_text_paragraphs",
    rf"""WITH {BOOK}, sp AS (SELECT doc_id, page_id, regexp_extract(html, '(?s)^(.*?)<script>(.*?)</script>(.*)$', ['a', 'b', 'c']) AS x FROM fl),
    tx AS (SELECT doc_id, page_id, string_split({_unescape.format(_strip_tags.format('x.a'))} || x.b || {_unescape.format(_strip_tags.format('x.c'))}, chr(10)) AS t FROM sp)
    SELECT doc_id, CAST(page_id AS VARCHAR) AS item_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS paragraph, text
    FROM (SELECT doc_id, page_id, generate_subscripts(t, 1) AS i, {_strip.format('unnest(t)')} AS text FROM tx) WHERE text <> ''""",
)(lambda t: small_batches(t.items()).select("doc_id", "item_id", F.posexplode(F.filter(F.transform(F.split(html.parse_html(F.col("content")).getField("text"), "\n"), S.strip), lambda x: x != "")).alias("paragraph", "text")))
query(
    "wrapped_pages",
    r"""WITH RECURSIVE c AS (SELECT conv_id AS doc_id, turn + 1 AS turn_page, text, row_number() OVER () AS k FROM conversations),
    w AS (SELECT k, par, list_filter(string_split_regex(x, '\s+'), lambda v: v <> '') AS words FROM (SELECT k, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS par FROM c) WHERE regexp_matches(x, '\S')),
    l(k, par, i, line, used) AS (SELECT k, par, 1, CASE WHEN length(words[1]) > 80 THEN 2 ELSE 1 END, length(words[1]) FROM w
      UNION ALL SELECT l.k, l.par, i + 1, CASE WHEN used + 1 + length(words[i + 1]) <= 80 THEN line ELSE line + 1 END, CASE WHEN used + 1 + length(words[i + 1]) <= 80 THEN used + 1 ELSE 0 END + length(words[i + 1])
      FROM l JOIN w ON l.k = w.k AND l.par = w.par WHERE i < len(words)),
    t AS (SELECT l.k, l.par, line, string_agg(words[i], ' ' ORDER BY i) AS text FROM l JOIN w ON l.k = w.k AND l.par = w.par GROUP BY ALL UNION ALL SELECT k, par, 1, '' FROM l WHERE i = 1 AND line = 2),
    n AS (SELECT k, text, row_number() OVER o AS r, CASE WHEN par <> lag(par, 1, par) OVER o THEN 22 ELSE 15 END AS step FROM t WINDOW o AS (PARTITION BY k ORDER BY par, line)),
    g(k, r, page, y) AS (SELECT k, 1, 1, 50 FROM n WHERE r = 1 UNION ALL SELECT n.k, n.r::INTEGER, CASE WHEN y + step > 792 THEN page + 1 ELSE page END, CASE WHEN y + step > 792 THEN 50 ELSE y + step END FROM g JOIN n ON n.k = g.k AND n.r = g.r + 1)
    SELECT doc_id, turn_page, page, y, n.text FROM g JOIN n ON g.k = n.k AND g.r = n.r JOIN c ON c.k = g.k""",
)(lambda t: t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("turn_page"), F.inline(paginate.page_lines(F.col("text")))))
query("wrapped_pages_folded", SQL["wrapped_pages"])(lambda t: t("conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("turn_page"), F.inline(paginate.folded_lines(F.col("text")))))
_FRONT = """'<img src=""><img><link rel="stylesheet" href=""><img src="/i' || page_id || '.png"><h3>Deep ' || page_id || '</h3>'"""
query(
    "chapter_sections",
    f"""WITH {BOOK} SELECT doc_id, CAST(pos AS INTEGER) AS chapter_index, CASE WHEN page_id % 2 = 0 THEN '<html><head></head><body><h2 id="s' || page_id || '">Sub ' || page_id || '</h2></body></html>'
      ELSE {_FRONT} || html || '<h2 id="s' || page_id || '">Sub ' || page_id || '</h2><h2> </h2>' END AS content FROM fl""",
)(
    lambda t: split.chapter_sections(
        t.headed_items().select("doc_id", F.col("ordinal").alias("chapter_index"), F.col("content").cast("binary").alias("content"), F.concat(F.when(F.col("item_id").cast("long") % 2 == 0, "s").otherwise("none"), "item_id").alias("html_id"))
    ).drop("html_id")
)
query("empty_refs", f"WITH {BOOK} SELECT doc_id, CAST(pos AS INTEGER) AS chapter_index, href AS file_path, 'img' AS kind, '/i' || page_id || '.png' AS ref FROM fl")(
    lambda t: split.resource_refs(t.headed_items().select("doc_id", F.col("ordinal").alias("chapter_index"), F.col("href").alias("file_path"), "content"))
)
query("default_outputs", rf"""WITH {BOOK} SELECT doc_id, href, regexp_replace(href, '([^/])\.[^./]+$', '\1') || '_chapters' AS folder, lower(href) LIKE '%.html' AS is_html FROM fl""")(
    lambda t: t.items().select("doc_id", "href", S.default_output(F.col("href")).alias("folder"), S.is_kind(F.col("href"), "html").alias("is_html"))
)
query(
    "chapter_metadata",
    f"""WITH {OUTLINE}, ch AS ({_outline_chapters(1)}) SELECT ch.doc_id, chapter_index, ch.title, CASE WHEN ch.doc_id % 2 = 0 THEN c_mktsegment END AS subject, CASE WHEN ch.doc_id % 2 = 0 THEN 2 ELSE 1 END AS entries
    FROM ch JOIN customer ON ch.doc_id = c_custkey""",
)(
    lambda t: split.merged_metadata(
        t("customer").select(F.col("c_custkey").alias("doc_id"), F.create_map(F.lit("title"), "c_name", F.lit("subject"), "c_mktsegment").alias("metadata")),
        split.plan_pdf(layout.outline_chapters(t.outline_documents(), t.outline())).withColumn("preserve_metadata", F.col("doc_id") % 2 == 0),
    ).select("doc_id", "chapter_index", F.col("metadata")["title"].alias("title"), F.col("metadata")["subject"].alias("subject"), F.size("metadata").alias("entries"))
)
query(
    "pdf_patterns",
    rf"WITH {LAYOUT}, x AS (SELECT *, regexp_matches(text, '(?i)^chapter \d') AS own FROM f) SELECT doc_id, page, CAST(line AS INTEGER) AS line, text FROM x WHERE own OR (avg_size > 0 AND size >= avg_size * 1.5::DOUBLE AND words <= 10)",
)(lambda t: layout.heading_candidates(t.spans(), "low", [r"^Chapter \d.*$"]).select("doc_id", "page", "line", "text"))

# ---- elements
_SECTIONS = """sc AS (SELECT doc_id, page_id, href || '/' || page_id AS file_path, unnest(['a', 'b', 'p', 'x']) || page_id AS html_id FROM fl)"""


def _bounds(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = markup.elements(t.sectioned_items())
    return markup.sections(t.sections(), found), found


query(
    "section_refs",
    f"""WITH {BOOK}, r AS (SELECT page_id, 'a' AS k, 'img' AS kind, '/i' || page_id || '.png' AS ref FROM fl UNION ALL SELECT page_id, unnest(['a', 'p']), 'img', '/j.png' FROM fl
      UNION ALL SELECT page_id, 'b', 'css', 's.css' FROM fl UNION ALL SELECT page_id, 'b', 'style_url', 'bg.png' FROM fl)
    SELECT doc_id, href || '/' || fl.page_id AS file_path, k || r.page_id AS html_id, kind, ref FROM r JOIN fl ON r.page_id = fl.page_id""",
)(lambda t: markup.section_refs(*_bounds(t)))
query(
    "section_headings",
    f"""WITH {BOOK}, h AS (SELECT page_id, unnest(['a', 'p']) AS k, 3 AS level, 'Deep ' || page_id AS text, unnest([4, 2]) AS place FROM fl UNION ALL SELECT page_id, 'b', 2, 'Sub ' || page_id, 3 FROM fl)
    SELECT doc_id, href || '/' || fl.page_id AS file_path, k || h.page_id AS html_id, level, text, CAST(place AS INTEGER) AS place FROM h JOIN fl ON h.page_id = fl.page_id""",
)(lambda t: markup.section_headings(*_bounds(t)))
query(
    "element_sections",
    f"""WITH {BOOK}, {_SECTIONS}, c AS (SELECT page_id, '<p id="p' || page_id || '"><img src="/j.png"><h3>Deep ' || page_id || '</h3></p>' AS p, html FROM fl),
    d AS (SELECT page_id, p, '<div id="a' || page_id || '"><img src="/i' || page_id || '.png">' || p || '</div>' AS a, '<div id="b' || page_id || '"><link rel="stylesheet" href="s.css"><style>b{{background:url(bg.png)}}</style><h2>Sub ' || page_id || '</h2><h1> </h1></div>' AS b, html FROM c)
    SELECT doc_id, CAST(sc.page_id AS VARCHAR) AS item_id, file_path, html_id, CASE left(html_id, 1) WHEN 'x' THEN a || b || html ELSE '<html><head></head><body>' || CASE left(html_id, 1) WHEN 'a' THEN a WHEN 'b' THEN b ELSE p END || '</body></html>' END AS content
    FROM sc JOIN d ON sc.page_id = d.page_id""",
)(lambda t: markup.section_contents(markup.sections(t.sections(), markup.elements(t.sectioned_items())), t.sectioned_items()))
