"""Periodic runs of words: maximal stretches that repeat a short sequence of words again and again.

Stretches of 2 ** k words get equal names if and only if they are equal: a name of level k + 1 is the pair of names of level k
at its two halves (Karp, Miller and Rosenberg). The longest common extension of two places is read off the names from the
highest level down. Every run of period q holds a place of a grid of 2q words at which as many words as the greatest power
of two up to q equal those q words on; such places are extended both ways. All documents of a chunk are named together.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import cover, free_name, map_arrow, raw, row_chunks

CHUNK = 1 << 20  # bytes of text worked on at once
GRID = 1 << 20  # grid places looked at together
FOUND = "id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def names(first: np.ndarray) -> list[np.ndarray]:
    """Names of all levels, from those of single words. Equal names stand for equal words; what occurs once has a negative name.

    The list ends before the level at which all stretches differ, which is found by sorting only those that still have an equal.
    """
    n = len(first)
    out, level = [], first.astype(np.int64)
    own = -1 - np.arange(n)
    while True:
        some = np.flatnonzero(level >= 0)
        if not len(some):
            return out
        order = np.argsort(level[some], kind="stable")
        sorted_ = level[some][order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        alone = new & np.concatenate((new[1:], [True]))
        level = own.copy()
        level[some[order]] = np.where(alone, own[some[order]], np.cumsum(new) - 1)
        if (level < 0).all():
            return out
        out.append(level.astype(np.int32))
        half = 1 << len(out) - 1
        after = np.full(n, -1, np.int64)
        after[: max(n - half, 0)] = level[half:]
        level = np.where((level >= 0) & (after >= 0), level * n + after, -1)


def extension(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from i on equal those from j on, i < j; with back, how many before them do."""
    n = len(levels[0])
    same = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        wide = 1 << k
        a, b = (i - same - wide, j - same - wide) if back else (i + same, j + same)
        inside = (a >= 0) & (b < n)
        name = levels[k][np.where(inside, a, 0)]
        same += np.where(inside & (name >= 0) & (name == levels[k][np.where(inside, b, 0)]), wide, 0)
    return same


def _grid(first: np.ndarray, size: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods from low to high (past): each 2q-th word of documents of at least 4q words."""
    at, q = [], []
    held = 0
    for doc in np.flatnonzero(size >= 4 * low).tolist():
        n = int(size[doc])
        most = min(high, n // 4 + 1)
        period = low
        while period < most:
            step = max(1, min(most - period, GRID * 2 * period // n + 1))
            some = np.arange(period, period + step)
            count = -(-n // (2 * some))
            which = np.repeat(some, count)
            at.append(first[doc] + (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)) * 2 * which)
            q.append(which)
            held += len(which)
            period += step
            if held >= GRID:
                yield np.concatenate(at), np.concatenate(q)
                at, q, held = [], [], 0
    if held:
        yield np.concatenate(at), np.concatenate(q)


def find_runs(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of documents that stand one after another, sorted; words: equal numbers are equal words."""
    first, total = np.cumsum(size) - size, int(size.sum())
    owner = np.repeat(np.arange(len(size)), size)
    _, own = np.unique(owner * (int(words.max(initial=0)) + 1) + words, return_inverse=True)  # a word of another document is another word
    levels = names(own)
    found = []
    for k, level in enumerate(levels):
        alike = np.add.reduceat((level >= 0).astype(np.int64), first[size > 0]) if total else np.zeros(0, np.int64)
        live = np.where(size > 0, size, 0)
        live[np.flatnonzero(size > 0)[alike == 0]] = 0  # nothing of 2 ** k words is there twice
        for i, q in _grid(first, live, 1 << k, 2 << k):
            some = (level[i] >= 0) & (i + q < total)
            i, q = i[some], q[some]
            some = level[i] == level[i + q]
            i, q = i[some], q[some]
            if not len(i):
                continue
            forth, back = extension(levels, i, i + q), extension(levels, i, i + q, back=True)
            length = forth + back + q
            some = length >= np.maximum(6, 4 * q)
            found.append(np.unique(np.stack([(i - back)[some], length[some], q[some]], 1), axis=0))
    every = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if not len(every):
        return np.zeros((0, 4), np.int64)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    least = np.concatenate(([True], (every[1:, :2] != every[:-1, :2]).any(1)))  # of the periods of a stretch the smallest
    every = every[least]
    doc = owner[every[:, 0]]
    every = np.stack([doc, every[:, 0] - first[doc], every[:, 1], every[:, 2]], 1)
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def periodic_tail(n: int, doc_id: int) -> np.ndarray | None:
    """Which word stands at each place of a document of n words that is made periodic from some word on; None: it stays as it is.

    With h the CRC-32 of the id in decimal, one document in ten is changed: from word g % n on, g = h // 10, its words
    repeat with a period of one more than the rest's length over 3 + g % 8.
    """
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _run(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw(batch.column(1))
            ids = batch.column(0)
            flat = data.tobytes()
            for lo, hi in row_chunks(offs, CHUNK):
                texts = [flat[offs[k] : offs[k + 1]].split() for k in range(lo, hi)]  # at ASCII white space
                if planted:
                    for k, i in enumerate(ids.slice(lo, hi - lo).to_pylist()):
                        if i is not None and (moved := periodic_tail(len(texts[k]), i)) is not None:
                            texts[k] = [texts[k][x] for x in moved.tolist()]
                yield _summed(ids.slice(lo, hi - lo), texts)

    return run


def _summed(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    size = np.array([len(x) for x in texts], np.int64)
    numbers = pa.array([w for x in texts for w in x], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    every = find_runs(numbers, size)
    bounds = np.searchsorted(every[:, 0], np.arange(len(texts) + 1))
    rows = []
    for k, words in enumerate(texts):
        own = every[bounds[k] : bounds[k + 1], 1:]
        gone = cover(len(words), np.stack([own[:, 0] + own[:, 2], own[:, 0] + own[:, 1]], 1))
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if len(own) else b" ".join(words)
        listed = own.tolist()
        digest = hashlib.sha256("".join([f"{s},{n},{q}\n" for s, n, q in listed]).encode()).hexdigest()
        best = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else [None] * 3
        power = 1000 * best[1] // best[2] if listed else None
        rows.append((len(words), len(listed), *best, power, digest, hashlib.sha256(kept).hexdigest(), [{"start": s, "length": n, "period": q} for s, n, q in listed], kept.decode()))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
    columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns], names=[x.split()[0] for x in FOUND.split(", ")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """One row a document: its id, n_words, n_runs, the longest run (start, length, period, exponent_milli), digests, all runs, and the text with runs collapsed to one period.

    A run is a maximal stretch whose words equal those q words on, q its smallest period, of at least six words and four
    periods. Every document is found in the task that reads it: nothing is shuffled. planted: some documents are first made
    periodic (see periodic_tail).

    Defined cases: a null or empty text has no words; of longest runs the first, then that of the smallest period, is named,
    and a text without runs has nulls there; a null id is never planted; repeated rows and ids are documents of their own; a very
    long text is searched whole, in some 200 bytes a word and four more for each level of names; an empty table gives no
    row; other columns are ignored, whatever their names. Texts are taken as UTF-8 and split at ASCII white space.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = map_arrow(rows, _run(planted), FOUND)
    return found.withColumnRenamed("id", id_col if id_col == "id" else free_name(id_col, [c for c in found.columns if c != "id"]))
