"""The operators' queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import align, decontaminate, fingerprint, jaccard, langid, lines, neighbours, packing, runs, substring, token_files, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.suffix_array_dedup(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents")).drop("n_spans")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    span = lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["past"].cast("string"))
    return found.withColumn("hits", F.array_join(F.transform("hits", span), ","))  # byte offsets in the original text


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(_table(spark, sf_dir, "documents"), token_files.tokenizer_path())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokenizers(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(_table(spark, sf_dir, "documents"), planted=True).drop("n_words", "runs", "collapsed")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_line_dedup, op3_substring_dedup, op4_ngram_jaccard_join, op5_best_fit_packing, op6_language_id,
        op7_document_fingerprints, op8_benchmark_decontamination, op9_token_files, op10_warc,
        op11_cross_tokenizer_alignment, op12_periodic_runs, op13_nearest_neighbours, pipeline,
    )
}

_STRIP = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op2_line_dedup": f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_STRIP})")} AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op3_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
x AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS h FROM s),
d AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM d),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
k AS (SELECT p.doc_id, p.p, p.word, g.p IS NOT NULL AS gone FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p),
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON w.doc_id = a.doc_id""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i : i + 4], ' ')))) AS sh
  FROM w WHERE len(words) > 0),
c AS (SELECT sh, min(doc_id) AS rep FROM s GROUP BY sh),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM c),
i AS (SELECT a.rep AS a, b.rep AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i WHERE shared >= 0.8::DOUBLE * (na + nb - shared) - 1e-9),
r(node, root) AS (SELECT rep, rep FROM c UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b),
t AS (SELECT node, min(root) AS root FROM r GROUP BY node),
d AS (SELECT s.doc_id, c.rep, t.root, coalesce(q.n, 0) AS n FROM s JOIN c ON s.sh = c.sh JOIN t ON t.node = c.rep LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) q ON q.a = c.rep)
SELECT documents.doc_id, coalesce(d.root, documents.doc_id) AS class_id, coalesce(d.rep, documents.doc_id) AS copy_id, coalesce(d.n, 0) AS n_links
FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id""",
    "op8_benchmark_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
b AS (SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[i : i + 12], ' ') AS win FROM bw, unnest(range(1, greatest(len(words) - 11, 2))) t(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM b),
x AS (SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS win FROM dw, sizes, unnest(range(1, greatest(len(words) - n + 2, 1))) t(i)),
h AS (SELECT x.doc_id, x.i, x.n, b.item_id FROM x JOIN b ON x.win = b.win AND x.n = b.n),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id),
cut AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words, string_split_regex(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS gaps FROM documents WHERE doc_id IN (SELECT doc_id FROM g)),
place AS (SELECT doc_id, p, strlen(gap) AS gap, strlen(word) AS word FROM (SELECT doc_id, unnest(words) AS word, unnest(gaps[: len(words)]) AS gap, generate_subscripts(words, 1) AS p FROM cut)),
pos AS (SELECT doc_id, p, sum(gap + word) OVER w AS past, sum(gap + word) OVER w - word AS start FROM place WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
run AS (SELECT doc_id, min(start) AS start, max(past) AS past, count(*) AS n FROM (SELECT pos.*, pos.p - row_number() OVER (PARTITION BY pos.doc_id ORDER BY pos.p) AS island FROM pos JOIN g ON pos.doc_id = g.doc_id AND pos.p = g.p) GROUP BY doc_id, island),
r AS (SELECT doc_id, sum(n) AS n_hit, string_agg(start || '-' || past, ',' ORDER BY start) AS hits FROM run GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated, coalesce(hits, '') AS hits
FROM dw LEFT JOIN r ON dw.doc_id = r.doc_id LEFT JOIN q ON dw.doc_id = q.doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to
FROM k""",
}
