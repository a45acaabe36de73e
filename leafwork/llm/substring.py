"""Exact removal of repeated passages: by bytes (suffix order) and by words (super-k-mers)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm import hashing as H
from leafwork.llm.common import RK, cover, keyed, map_arrow, plan_bytes, raw, row_chunks, spans_of
from leafwork.llm.prefix_free import repeated_windows
from leafwork.llm.superwindow import CHUNK, Kind, repeated_spans


def repeated_word_windows(strings: list[bytes], size: int) -> list[np.ndarray]:
    """Which `size`-word windows of each string (words joined by single spaces) occur more than once in the strings together."""
    sizes = np.array([len(s) for s in strings], np.int64)
    offs = np.concatenate(([0], np.cumsum(sizes)))
    text = b"".join(strings)
    starts, ends, rows = H.words(np.frombuffer(text, np.uint8), offs)
    hashes = H.rolling(H.word_hashes(np.frombuffer(text, np.uint8), starts, ends), size)
    wins = np.maximum(np.diff(rows) - size + 1, 0)
    total = int(wins.sum())
    at = np.arange(total) - np.repeat(np.cumsum(wins) - wins, wins) + np.repeat(rows[:-1], wins)
    order = np.argsort(hashes[at])
    near = hashes[at[order]]
    same = np.flatnonzero(near[1:] == near[:-1])
    hit = np.zeros(total, bool)
    froms, tos = starts[at[order]], ends[at[order] + size - 1]
    odd = []
    for i in same.tolist():  # equal hashes are confirmed word for word
        if text[froms[i] : tos[i]] == text[froms[i + 1] : tos[i + 1]]:
            hit[order[i]] = hit[order[i + 1]] = True
        else:
            odd.append(near[i])
    for h in set(odd):
        seen: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(near == h).tolist():
            seen.setdefault(text[froms[i] : tos[i]], []).append(int(order[i]))
        for x in seen.values():
            hit[x] = len(x) > 1
    return np.split(hit, np.cumsum(wins)[:-1])


def remove(kind: Kind, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (id, text, list of spans) to (id, units, removed, spans, SHA-256 of what stays[, text])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw(batch.column(1))
            for lo, hi in row_chunks(offs, CHUNK):
                ids = batch.column(0).slice(lo, hi - lo)
                out = []
                buf, off = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                text = buf.tobytes()
                if kind.words:
                    starts, ends, rows = H.words(buf, off)
                for i, found in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist()):
                    n = int(rows[i + 1] - rows[i]) if kind.words else int(off[i + 1] - off[i])
                    spans = np.frombuffer(b"".join(found or ()), np.int64).reshape(-1, 2)
                    gone = cover(n, spans)
                    if kind.words:
                        at = rows[i] + np.flatnonzero(~gone)
                        kept = b" ".join([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                    else:
                        kept = buf[off[i] : off[i + 1]][~gone].tobytes() if len(spans) else text[off[i] : off[i + 1]]
                    row = [n, int(gone.sum()), len(spans_of(gone)), hashlib.sha256(kept).hexdigest()]
                    out.append(row + [kept] if with_text else row)
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], names=["id", "n", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(cols)])

    return run


def _dedup(docs: DataFrame, id_col: str, text_col: str, kind: Kind, repeats, n_name: str, with_text: bool) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, "text", kind, repeats, plan_bytes(docs)).groupBy(RK).agg(F.collect_list("data").alias("__found"))
    joined = rows.join(spans, RK, "left").select("id", "text", "__found")
    kept = ", kept binary" if with_text else ""
    kind_of = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(joined, remove(kind, with_text), f"id {kind_of}, n long, n_removed long, n_spans long, kept_sha256 string{kept}")
    return out.withColumnsRenamed({"id": id_col, "n": n_name})


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, with_text: bool = False) -> DataFrame:
    """Remove each byte that a `size`-byte string covers which also starts anywhere else in the table.

    Buckets of super-windows bring equal windows together; within a bucket prefix-free parsing puts their suffixes in
    corpus order, where equal windows are neighbours. Returns id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    `with_text`, kept (bytes: a cut may fall inside a character).

    Defined cases: a null text is empty; texts under `size` bytes lose nothing; an empty table gives no rows; rows that
    repeat an id, or whose id is null, are documents of their own; equal texts lose all their windows, in every copy: there
    are no ties to break; a very long text is held whole, with about 100 bytes for each of its bytes; columns other than
    the two named are ignored, whatever their names.
    """
    kind = Kind(size, min(24, size), False)
    return _dedup(docs, id_col, text_col, kind, partial(repeated_windows, size=size), "n_bytes", with_text)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 35, with_text: bool = False) -> DataFrame:
    """Remove each word that a window of `size` consecutive words covers which also starts anywhere else in the table.

    Words are runs of anything but space and bytes 9-13. Super-k-mers (consecutive windows with one minimiser) go as one
    packed string to the minimiser's bucket, where sorting counts their windows. Returns id, n_words, n_removed, n_spans,
    kept_sha256 (words joined by one space) and, with `with_text`, kept.

    Defined cases: as for suffix_array_dedup; a text of fewer than `size` words loses nothing.
    """
    kind = Kind(size, min(4, size), True)
    return _dedup(docs, id_col, text_col, kind, partial(repeated_word_windows, size=size), "n_words", with_text)
