"""Packing of tokenized documents into training sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm.common import RK, keyed, map_arrow, materialize, raw, row_chunks
from leafwork.llm.token_files import encoder, tokenizer_path

SIZES = (1024, 4096, 16384)
OVERHEAD = 64  # what a sequence costs beside its length
SHARD = 2048  # pieces packed together
CHUNK = 1 << 20  # bytes of text encoded at once


def fits(sizes: Sequence[int], length: int) -> int:
    return next(s for s in sizes if s >= length)


def best_fit(lengths: Sequence[int], sizes: Sequence[int], overhead: int, ceiling: int) -> tuple[list[int], list[int]]:
    """Bin of each length (given in descending order) and each bin's contents.

    An item goes to the open bin that it fills best. If none holds it, a bin opens, of the size, `ceiling` at most where
    the item allows, with the least cost for each token that it could still be filled with.
    """
    rest = sum(lengths)
    where, used, room = [], [], []
    spare: dict[int, list[int]] = {}  # bins by free room
    mask = 0  # bit r: there is a bin with r free
    for n in lengths:
        high = mask >> n
        if high:
            free = n + (high & -high).bit_length() - 1
            b = spare[free].pop()
            if not spare[free]:
                mask &= ~(1 << free)
        else:
            open_to = [s for s in sizes if s >= n and (s <= ceiling or s == fits(sizes, n))]
            size = min(open_to, key=lambda s: ((s + overhead) / min(s, rest), s))
            b, free = len(used), size
            used.append(0)
            room.append(size)
        where.append(b)
        used[b] += n
        rest -= n
        free -= n
        if free:
            spare.setdefault(free, []).append(b)
            mask |= 1 << free
    return where, used


def pack_lengths(lengths: Sequence[int], sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Bin of each length, in the order given, and each bin's size: the cheapest plan over all ceilings, every bin cut down to the least size that holds its contents."""
    sizes = sorted(sizes)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    best = None
    for ceiling in sizes:
        where, used = best_fit([lengths[i] for i in order], sizes, overhead, ceiling)
        final = [fits(sizes, u) for u in used]
        cost = sum(final) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, where, final
    out = [0] * len(lengths)
    for i, b in zip(order, best[1], strict=True):
        out[i] = b
    return out, best[2]


def _pieces(tokenizer: str, end: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, key, text) to token ids, `end` behind each text, cut into pieces of at most `most`: (id, key, piece, start, length, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = encoder(tokenizer)
            data, offs = raw(batch.column(2))
            for lo, hi in row_chunks(offs, CHUNK):
                ids, n = encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], end)
                per = -(-n // most)
                row = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * most
                length = np.minimum(n[row] - start, most)
                bounds = np.concatenate(([0], np.cumsum(length))) * ids.itemsize
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.tobytes())])
                own = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(piece), pa.array(start), pa.array(length), body.cast(pa.binary())], names=["id", RK, "piece", "start", "length", "ids"])

    return run


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, sizes: Sequence[int] = SIZES, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """Tokenize every document, one end token behind it, and pack the tokens into sequences of permitted lengths.

    What is longer than the longest sequence is cut into pieces. Pieces are dealt by a hash into shards of about `shard`
    pieces, or 512 tokens for each of them, and each shard is packed by itself: no task grows with the table, and at most
    a few sequences a shard stay half full. Text is encoded where it lies; token ids move once. `tokenizer` is a file of
    the tokenizers library (the 50k byte-level vocabulary if None).

    Returns a row for each sequence: shard, bin, capacity (the least permitted length that holds it), used (its tokens),
    doc_ids, starts and lengths (of its pieces: their documents, where in these they start, their tokens), and ids: the
    tokens of all pieces end to end, little-endian, two bytes each where the vocabulary allows it, else four.

    Defined cases: a null text is empty and takes one token, its end; pieces tied in length are packed by id, then piece;
    rows that repeat an id, or have none, are packed each; a very long text is encoded whole, at about thirty bytes a byte,
    and cut; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    sizes, place = sorted(sizes), tokenizer or tokenizer_path()
    rows = keyed(docs, id_col, text_col).select("id", RK, "text")
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = materialize(map_arrow(rows, _pieces(place, end_id, sizes[-1]), f"id {kind}, {RK} long, piece long, start long, length long, ids binary"), "pieces")
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    shards = max(1, -(-n // shard), -(-tokens // (512 * shard)))

    def pack(table: pa.Table) -> pa.Table:
        order = np.lexsort([table["piece"].to_numpy(), table[RK].to_numpy()])
        table = table.take(pa.array(order))
        bins, final = pack_lengths(table["length"].to_pylist(), sizes, overhead)
        by = np.argsort(bins, kind="stable")
        first = np.searchsorted(np.array(bins)[by], np.arange(len(final) + 1))
        table = table.take(pa.array(by))
        length = table["length"].to_numpy()
        used = np.add.reduceat(length, first[:-1])
        body = table["ids"].to_pylist()
        ids = [b"".join(body[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        nested = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), table[c].combine_chunks()) for c in ("id", "start", "length")]
        head = [pa.array([table["shard"][0].as_py()] * len(final), pa.int64()), *(pa.array(x, pa.int64()) for x in (range(len(final)), final, used))]
        return pa.table([*head, *nested, pa.array(ids, pa.binary())], names=["shard", "bin", "capacity", "used", "doc_ids", "starts", "lengths", "ids"])

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(RK, "piece"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(pack, f"shard long, bin long, capacity long, used long, doc_ids array<{kind}>, starts array<long>, lengths array<long>, ids binary")
