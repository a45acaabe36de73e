"""One-permutation MinHash fingerprints: one hash of each shingle, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm import hashing as H
from leafwork.llm.common import CHUNK_TEXT, RK, keyed, map_arrow, raw, row_chunks

_U = np.uint64
BINS, WORDS = 256, 5  # 8 low-order bits a bin
ROWS = 512  # texts whose bins are filled at once
EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_donors: list[np.ndarray] = []


def donors(attempt: int) -> np.ndarray:
    """The bin that each empty bin borrows from at its attempt-th try."""
    while len(_donors) <= attempt:
        _donors.append((H.mix(np.arange(BINS, dtype=_U) * _U(H.BASE) + _U(1 + len(_donors))) % _U(BINS)).astype(np.int64))
    return _donors[attempt]


def shingle_hashes(buf: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-word shingles and their first positions by row; a row of fewer words, but not none, is one shingle."""
    starts, ends, rows = H.words(buf, offs)
    codes = H.word_hashes(buf, starts, ends)
    got = H.rolling(codes, n)
    words = np.diff(rows)
    count = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), _U)
    at = np.arange(len(out)) - np.repeat(first - rows[:-1], count)
    full = np.repeat(words >= n, count)
    out[full] = got[at[full]]
    for i in np.flatnonzero((words > 0) & (words < n)).tolist():
        out[first[i]] = H.rolling(codes[rows[i] : rows[i + 1]], int(words[i]))[0]
    return out, np.append(first, len(out))


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of BINS bytes for each text; and for a text without words zeros. ROWS texts at a time: short ones have many empty bins."""
    n = len(offs) - 1
    if n > ROWS:
        return np.concatenate([fingerprints(buf[offs[a] : offs[min(a + ROWS, n)]], offs[a : min(a + ROWS, n) + 1] - offs[a]) for a in range(0, n, ROWS)])
    hashes, first = shingle_hashes(buf, offs)
    least = np.full(n * BINS, EMPTY, _U)
    row = np.repeat(np.arange(n), np.diff(first))
    np.minimum.at(least, row * BINS + (hashes >> _U(56)).astype(np.int64), hashes & _U((1 << 56) - 1))
    least = least.reshape(n, BINS)
    full = least != EMPTY
    out = (least & _U(255)).astype(np.uint8)
    r, b = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(r):
        lender = donors(attempt)[b] if attempt < 4096 else (b + attempt) % BINS
        ok = full[r, lender]
        out[r[ok], b[ok]] = out[r[ok], lender[ok]]
        r, b = r[~ok], b[~ok]
        attempt += 1
    out[~full.any(1)] = 0
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity: agreement of the bins less what low-order bits agree on by chance. Fingerprints may be b'' (no words)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    same = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    chance = 1 / 256
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def fingerprint_rows(texts: list[bytes]) -> list[bytes]:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    got = fingerprints(buf, offs)
    blank = [not t.translate(None, b" \t\n\x0b\x0c\r") for t in texts]
    return [b"" if no else x.tobytes() for x, no in zip(got, blank, strict=True)]


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _part(bounds: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many of the bounds, rows (id, row) in ascending order, stand before each (id, row)."""
    part = np.searchsorted(bounds[:, 0], ids, "left")
    again = np.unique(bounds[:, 0][1:][bounds[1:, 0] == bounds[:-1, 0]])
    for i in again.tolist():  # ids with so many rows that they are cut by row
        some = ids == i
        part[some] += np.searchsorted(bounds[bounds[:, 0] == i, 1], rows[some], "left")
    return part.astype(np.int32)


def _bounds(keys: DataFrame, n: int) -> np.ndarray:
    """About n - 1 cuts (id, row): at quantiles of the ids, and within an id that holds several of them at quantiles of its rows."""
    top = int(np.iinfo(np.int64).max)
    cuts = keys.agg(F.percentile_approx("at", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    ids, often = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    out = [(i, top) for i in ids.tolist()]
    heavy = {i: m for i, m in zip(ids.tolist(), often.tolist(), strict=True) if m > 1}
    if heavy:
        inner = [k / (max(heavy.values()) + 1) for k in range(1, max(heavy.values()) + 1)]
        found = keys.where(F.col("at").isin(list(heavy))).groupBy("at").agg(F.percentile_approx(RK, inner, 20 * n).alias("q")).collect()  # n ids at most
        out += [(r["at"], q) for r in found for q in r["q"]]
    return np.array(sorted(set(out)), np.int64).reshape(-1, 2)


def _deal(bounds: np.ndarray, parts: dict[int, list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Give each row (at, row, id, text) its range; a row that opens a range goes as a tail to the range before it too. parts: range to (opening row, range before)."""
    opens = {i: to for pairs in parts.values() for i, to in pairs}
    keys = np.array(sorted(opens), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            at = np.flatnonzero(np.isin(rows, keys))
            names = ["part", "tail", *batch.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(_part(bounds, ids, rows)), pa.array(np.zeros(len(ids), bool)), *batch.columns], names=names)
            if len(at):
                extra = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([opens[int(rows[i])] for i in at], pa.int32()), pa.array(np.ones(len(at), bool)), *extra.columns], names=names)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, tail, id and row descending), as (part, tail, id, text): each row's successor is the next row; a part ends with its tail."""
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None  # (part, tail, id, text, fingerprint)

    def done(rows: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([r[0][2] for r in rows])
        new = [edited(r[0][3], r[1][3]).encode() for r in rows]
        prints = fingerprint_rows(new)
        out = [(len(a[3]), hashlib.sha256(e).hexdigest(), a[4].hex(), p.hex(), likeness(a[4], p), likeness(a[4], b[4])) for (a, b), e, p in zip(rows, new, prints, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=names)

    for batch in batches:
        data, offs = raw(batch.column(3))
        for lo, hi in row_chunks(offs, CHUNK_TEXT):
            texts = [data[offs[i] : offs[i + 1]].tobytes() for i in range(lo, hi)]
            parts, tails = (batch.column(k).slice(lo, hi - lo).to_pylist() for k in (0, 1))
            rows = []
            for i, (part, tail, text, fp) in enumerate(zip(parts, tails, texts, fingerprint_rows(texts), strict=True)):
                now = (part, tail, batch.column(2).slice(lo + i, 1), text.decode(), fp)
                if last is not None and not last[1] and last[0] == part:
                    rows.append((last, now))
                last = now
            if rows:
                yield done(rows)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprint each text, and its text edited with the next document's; order is by descending id, after the last the first.

    The text moves once, dealt by id ranges; each range's first row is sent to the range before it too, so that every row
    finds its successor in its own task. An id with the rows of several ranges is cut by row. What the driver sees is one id for each range.

    Returns id, n_chars, edited_sha256, fingerprint and edited_fingerprint (hex of 256 one-byte bins; empty for a text
    without words), near_edited and near_next (estimated Jaccard similarity of five-word shingles).

    Defined cases: a null text is empty; a text of one to four words is one shingle; two texts without words are alike
    (1.0), and unlike any other (0.0); a single document is its own successor; rows that repeat an id follow each other, in an
    order that the operator chooses once, and those whose id is null come after all others, so other rows keep their
    successors but where such a row stands in between; ids that are no integers are ordered by a number that rows are given; a very long text is held
    whole, with about 60 bytes for each of its bytes; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    numbered = keyed(docs, id_col, text_col)
    whole = isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    at = F.coalesce(F.col("id").cast("long"), F.lit(int(np.iinfo(np.int64).min))) if whole else F.col(RK)  # null ids come last
    rows = numbered.select(at.alias("at"), RK, "id", "text")
    n = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select("at", RK)
    bounds = _bounds(keys, n)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = _part(bounds, *(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(part), *batch.columns], names=["part", "at", "row"])

    top = {r["part"]: r["m"]["row"] for r in map_arrow(keys, tops, "part int, at long, row long").groupBy("part").agg(F.max(F.struct("at", "row")).alias("m")).collect()}  # a row a range
    order = sorted(top, reverse=True)
    opens: dict[int, list[tuple[int, int]]] = {p: [(top[p], order[i - 1])] for i, p in enumerate(order)}  # the first range follows the last
    dealt = map_arrow(rows, _deal(bounds, opens), f"part int, tail boolean, at long, {RK} long, id {id_type}, text string")
    parts = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 4))
    sorted_ = dealt.repartition(parts, "part").sortWithinPartitions("part", "tail", F.desc("at"), F.desc(RK)).select("part", "tail", "id", "text")
    return map_arrow(sorted_, _pairs, f"id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
