"""Overlap of documents with benchmark items, by one Aho-Corasick automaton over the items' words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm import hashing as H
from leafwork.llm.common import RK, cover, keyed, map_arrow, materialize, raw, spans_of

#: Bytes that stand in words; a word is a maximal run of them once A-Z are lower-cased.
NOT_WORD = np.ones(256, bool)
NOT_WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = False
TABLE = bytes(32 if NOT_WORD[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ITEM_BYTES = 16 << 20  # of item text in one automaton: about 25 bytes of memory each, a worker
AT_ONCE = 1 << 14  # places of items that are compared at once


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Matcher:
    """Finds the `size`-word windows of items in texts.

    Words become numbers, and numbers two or three symbols, so that no node of the automaton has more than 256 children.
    Every window of `size` words holds one whole block of (size + 1) // 2 words that starts at a multiple of that length
    in its item: the automaton holds these blocks, a node or three for each word of the items, and what it finds is
    extended word by word to both sides. An item of fewer words than a window is a pattern of its own.
    """

    def __init__(self, items: list[tuple[str, bytes]], size: int) -> None:
        self.size, self.block = size, (size + 1) // 2
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        rows, owners = [], []
        for name, text in items:
            found = normal_words(text)
            if found:
                rows.append([self.number.setdefault(w, len(self.number) + 1) for w in found])
                owners.append(name)
        pad = [-1] * size  # no number of a text's word: nothing extends beyond an item
        self.flat = np.array([*pad, *(x for r in rows for x in (*r, *pad))], np.int32)
        self.width = 2 if len(self.number) < 1 << 16 else 3
        self.owner = np.repeat(np.arange(len(rows)), [len(r) + size for r in rows])
        self.names = owners
        places: dict[str, list[int]] = {}
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        at = size
        lengths = []
        for r in rows:
            step = self.block if len(r) >= size else len(r)
            for i in range(0, len(r) - step + 1, step):
                key = self.symbols(np.array(r[i : i + step], np.uint32))
                if key not in places:
                    places[key] = []
                    lengths.append(step)
                places[key].append(at + i if len(r) >= size else -1 - at)
            at += len(r) + size
        for i, key in enumerate(places):
            self.tree.add_word(key, i)
        self.any = bool(places)
        if self.any:
            self.tree.make_automaton()
        counts = [len(x) for x in places.values()]
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        self.places = np.array([x for v in places.values() for x in v], np.int64)
        self.lengths = np.array(lengths, np.int64)

    def symbols(self, numbers: np.ndarray) -> str:
        parts = numbers.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - self.width :]
        return parts.tobytes().decode("latin-1")

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Runs (start, past) of words that lie in windows, and the items that have such windows."""
        none = np.zeros((0, 2), np.int64), set()
        get, size, block = self.number.get, self.size, self.block
        ids = np.array([get(w, 0) for w in words], np.int32)
        if not self.any or not ids.any():
            return none
        hits = [(e, k) for e, k in self.tree.iter(self.symbols(ids.view(np.uint32))) if (e + 1) % self.width == 0]
        if not hits:
            return none
        past, which = np.array(hits, np.int64).T
        past = (past + 1) // self.width
        many = self.first[which + 1] - self.first[which]
        padded = np.concatenate([np.zeros(size, np.int32), ids, np.zeros(size, np.int32)])
        spans, held = [], set()
        ends = np.cumsum(many)
        lo = 0
        while lo < len(many):  # a block that many items hold is compared piece by piece
            base = ends[lo] - many[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
            n = many[lo:hi]
            hit = np.repeat(np.arange(lo, hi), n)
            at = self.places[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[which[lo:hi]], n)]
            end = past[hit]
            begin = end - self.lengths[which[hit]]
            short = at < 0
            for part in (short, ~short):
                a, e, q = begin[part], end[part], at[part]
                if not len(q):
                    continue
                if part is short:
                    good = np.ones(len(q), bool)
                    q = -1 - q
                else:
                    reach = size - block
                    back, ahead = np.arange(1, reach + 1), np.arange(reach)
                    left = np.cumprod(padded[size + a[:, None] - back] == self.flat[q[:, None] - back], 1).sum(1)
                    right = np.cumprod(padded[size + e[:, None] + ahead] == self.flat[q[:, None] + block + ahead], 1).sum(1)
                    good = left + right + block >= size
                    a, e = a - left, e + right
                spans.append(np.stack([a[good], e[good]], 1))
                held |= {self.names[i] for i in np.unique(self.owner[q[good] - size]).tolist()}
            lo = hi
        found = np.concatenate(spans)
        return (spans_of(cover(len(words), found)), held) if len(found) else none


_built: dict[str, Matcher] = {}


def matcher(key: str, items: list[tuple[str, bytes]], size: int) -> Matcher:
    """A worker process keeps the last automaton from task to task."""
    if key not in _built:
        _built.clear()
        _built[key] = Matcher(items, size)
    return _built[key]


def _scan(items: list[tuple[str, bytes]], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, key, text) to the same with n_words, spans (runs of words, as int64 pairs) and the items held."""
    key = hashlib.sha256(repr((size, items)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(key, items, size)
        for batch in batches:
            out = []
            data, offs = raw(batch.column(2))
            for i in range(len(batch)):
                words = normal_words(data[offs[i] : offs[i + 1]].tobytes())
                spans, held = match.find(words)
                out.append((len(words), spans.tobytes(), sorted(held)))
            n, spans, held = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(spans, pa.binary()), pa.array(held, pa.list_(pa.string()))], names=["id", RK, "text", "n_words", "spans", "items"])

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, n_words, spans of each automaton, items of each) to the answer."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("past", pa.int64())]))]
    for batch in batches:
        out = []
        data, offs = raw(batch.column(1))
        for i, (n, spans, items) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
            mask = cover(n, np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2))
            hit = int(mask.sum())
            held = sorted({x for part in items for x in part})
            places = []
            if hit:  # runs of hit words, as byte offsets in the text as it came
                starts, ends, _ = H.words(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]), NOT_WORD)
                places = [{"start": int(starts[a]), "past": int(ends[b - 1])} for a, b in spans_of(mask).tolist()]
            out.append([n, hit, len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), hit > 0 and 20 * hit >= n, places])
        cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits"])


def _at_once(scan: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scan and judge in one worker, where one automaton holds all items."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in scan(batches):
            spans, items = (pa.ListArray.from_arrays(pa.array(range(len(b) + 1), pa.int32()), b.column(k)) for k in (4, 5))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), spans, items], names=["id", "text", "n_words", "spans", "items"])

    return lambda batches: _judge(listed(batches))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Find the words of each document that lie in a `size`-word window of a benchmark item.

    Words are runs of letters and digits (ASCII) and anything beyond ASCII, A-Z lower-cased; an item of fewer words is one
    window. Texts are scanned once, with no shuffle, by an automaton that a worker builds once. Items go to the workers
    only while their text is at most `item_bytes`; a larger benchmark is dealt by a hash of the item into parts of about
    half that size, one automaton each. Each part is collected, scanned for and its hits written before the next, so the
    driver holds one part; the hits of all are joined by document.

    Returns id, n_words, n_hit, n_items, items_sha256, contaminated (at least a twentieth of the words are hit) and hits:
    runs of hit words as byte offsets (start, past) of the original text.

    Defined cases: null text, of document or item, has no words; an item without words is ignored; items that share an id
    are one item; a null item id is the empty string; no documents give no rows, no items give no hits; rows that repeat
    a document id are judged each alone; there are no ties: all items that occur count; a very long text is held whole,
    with about 60 bytes for each of its words; an item longer than `item_bytes` is a part of its own; other columns are
    ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{item_text_col}`"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answer = f"id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hits array<struct<start:long,past:long>>"
    pick = F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")
    if total <= item_bytes:
        scan = _scan(sorted((r["item"], r["text"].encode()) for r in items.collect()), size)  # at most item_bytes
        return map_arrow(docs.select(pick[0], F.lit(0).cast("long").alias(RK), pick[1]), _at_once(scan), answer).withColumnRenamed("id", id_col)
    rows = keyed(docs, id_col, text_col).select("id", RK, "text")
    shards = 2 * (total // item_bytes + 1)
    hits, schema = None, f"id {id_type}, {RK} long, text string, n_words long, spans binary, items array<string>"
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect()  # about half of item_bytes
        scanned = map_arrow(rows, _scan(sorted((r["item"], r["text"].encode()) for r in part), size), schema)
        found = materialize(scanned.where(F.size("items") > 0).select(RK, "spans", "items"), "hits")
        hits = found if hits is None else hits.union(found)
    hits = hits.groupBy(RK).agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    none = F.array().cast("array<binary>"), F.array().cast("array<array<string>>")
    counted = map_arrow(rows, _scan([], size), schema)
    joined = counted.drop("spans", "items").join(hits, RK, "left").select("id", "text", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    return map_arrow(joined, _judge, answer).withColumnRenamed("id", id_col)
