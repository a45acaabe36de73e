"""Alignment of two tokenizers: minimal groups of tokens that cover the same bytes, and how many documents link two ids.

Tokens of the two tokenizers that overlap in bytes are joined by an edge; the components that union-find leaves are the
minimal groups, and each component's members are linked with each other. Ids that are linked are counted over all documents
by Spark. The counts come back to the documents by blocks: a block is some documents of one task with the distinct pairs
that they hold, so a frequent pair travels once a block and never once a document.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import free_name, map_arrow, materialize, raw, row_chunks
from leafwork.llm.token_files import Encoder, slices, tokenizer_path

CHUNK = 2 << 20  # bytes of text aligned at once
ASKED = 4096  # pieces encoded at once: encodings are large
BLOCK = 3_000_000  # pairs of documents that a block holds before it is closed
EXPANDED = 4096  # links that a group may have to be written out; larger groups are reduced to distinct ids first
ALIGNED = "block long, row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pairs array<long>, held array<int>"


def piece_path() -> str:
    """The 32k piece vocabulary: LEAFWORK_PIECES, or that of the installed public_tokenizers package."""
    if place := os.environ.get("LEAFWORK_PIECES"):
        return place
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def union_find(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least node of each node's component. Roots hook on to smaller roots, all edges at a time, and paths are halved till flat."""
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := parent[parent], parent):
            parent = above
    return parent


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 35 in as many bytes as each needs, seven bits a byte."""
    numbers = numbers.astype(np.uint64)
    width = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(5):
        some = width > k
        more = np.where(width[some] > k + 1, 128, 0)
        out[at[some] + k] = (numbers[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw_bytes = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw_bytes < 128)
    first = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    if not len(last):
        return np.zeros(0, np.int64)
    place = np.arange(len(raw_bytes)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw_bytes & 127).astype(np.int64) << 7 * place, first)


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """A worker process keeps its tokenizers from task to task."""
    return Aligner(a_path, b_path)


class Aligner:
    """Groups and links of texts, by a byte-level tokenizer of the tokenizers library and a model of the sentencepiece library.

    A text with a space before it is cut before each space that follows a character that is neither white space nor
    one whose last bytes leave that open. Byte-level pre-tokenization starts anew there, and no piece of the model holds a
    space after another character: pieces encode as they do within the text, and no group crosses a cut. So each distinct
    piece of a chunk is encoded and aligned once. If the model does have such pieces, texts are not cut.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece

        self.a = Encoder(a_path)
        self.a.tool.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies show these bytes as themselves, others from 256 on
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        a_bytes = [b""] * self.a.tool.get_vocab_size()
        for token, i in self.a.tool.get_vocab().items():
            a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.many = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.many)]
        b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lone = [self.b.piece_to_id("▁")]
        self.may_cut = not any("▁" in x.lstrip("▁") for x in names)
        self.tables = tuple((x, np.frombuffer(b"".join(x), np.uint8), np.array([len(y) for y in x], np.int64)) for x in (a_bytes, b_bytes))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where a piece may start: at spaces behind a character that is surely no white space."""
        at = np.flatnonzero(data == 32)
        at = at[at > 0] if self.may_cut else at[:0]
        one, two, three, four = (data[np.maximum(at - k, 0)] for k in (1, 2, 3, 4))
        tail = one >= 128
        sure = (one > 32) & (one < 127) | tail & ((two >= 0xC3) & (two <= 0xDF) | (two < 0xC0) & ((three == 0xE0) | (three >= 0xE4) & (three < 0xF0) | (three >= 128) & (three < 0xC0) & (four >= 0xF0)))
        return at[sure]

    def encode(self, pieces: pa.Array, data: np.ndarray, offs: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
        """Ids and their number for each piece, of both tokenizers. Each piece begins with a space; the second puts its own in front, but of an empty text."""
        ids, n = self.a(data, offs, 0)
        stays = np.ones(len(ids), bool)
        stays[np.cumsum(n) - 1] = False
        texts = pc.utf8_slice_codeunits(pieces.cast(pa.large_string()), 1)
        b, n_b = [], []
        for k in range(0, len(pieces), ASKED):
            got = [x or self.lone for x in self.b.encode(texts[k : k + ASKED].to_pylist(), num_threads=1)]
            n_b.append(np.fromiter(map(len, got), np.int64, len(got)))
            b.append(np.fromiter(chain.from_iterable(got), np.int64, int(n_b[-1].sum())))
        return (ids[stays].astype(np.int64), n - 1), (np.concatenate(b), np.concatenate(n_b))

    def align(self, pieces: pa.Array) -> dict:
        """For each piece: whether both tokenizers give back its bytes, numbers of tokens, groups and links, the groups as text, and its linked pairs with how often."""
        data, offs = raw(pieces)
        (a, n_a), (b, n_b) = self.encode(pieces, data, offs)
        size = np.diff(offs)
        whole = np.ones(len(pieces), bool)
        for ids, n, (_, flat, length) in zip((a, b), (n_a, n_b), self.tables, strict=True):
            whole &= np.bincount(np.repeat(np.arange(len(pieces)), n), length[ids], len(pieces)).astype(np.int64) == size
            right = np.flatnonzero(whole)
            ids = ids[np.repeat(whole, n)]
            differ = flat[slices((np.cumsum(length) - length)[ids], length[ids])] != data[slices(offs[right], size[right])]
            if differ.any():
                whole[right[np.logical_or.reduceat(differ, np.cumsum(size[right]) - size[right])]] = False
        keep_a, keep_b = np.repeat(whole, n_a), np.repeat(whole, n_b)
        a, b = a[keep_a], b[keep_b]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        ends_a, ends_b = np.cumsum(self.tables[0][2][a]), np.cumsum(self.tables[1][2][b])
        cut = np.union1d(ends_a, ends_b)  # between two of these lies one token of each side: an edge
        root = union_find(len(a) + len(b), np.searchsorted(ends_a, cut), len(a) + np.searchsorted(ends_b, cut))
        names, group = np.unique(root, return_inverse=True)  # the least node is the first token of the first side: groups are in order
        of_a, of_b = group[: len(a)], group[len(a) :]
        size_a, size_b = np.bincount(of_a, minlength=len(names)), np.bincount(of_b, minlength=len(names))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        owner = np.repeat(np.arange(len(pieces)), n_a)[first_a] if len(names) else np.zeros(0, np.int64)
        links = size_a * size_b
        n_groups = np.bincount(owner, minlength=len(pieces))
        text, written = self._written(a, b, of_a, of_b, first_a, first_b, size_a, size_b)
        chars = np.bincount(np.repeat(np.arange(len(pieces)), n_groups), np.add.reduceat(written, first_a + first_b) if len(names) else written, len(pieces)).astype(np.int64)
        pair, times, whose = self._pairs(a, b, first_a, size_a, first_b, size_b, owner)
        return {"whole": whole, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(owner, links, len(pieces)).astype(np.int64), "text": text, "chars": chars, "pair": pair, "times": times, "pairs": np.bincount(whose, minlength=len(pieces))}

    @staticmethod
    def _written(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a1,a2|b1; of each group, as characters, and how many of these each token has: its id in decimal and what stands behind it."""
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        place_a, place_b = np.arange(len(a)) + first_b[of_a], np.arange(len(b)) + (first_a + size_a)[of_b]
        ids[place_a], ids[place_b] = a, b
        mark[first_a + first_b + size_a - 1], mark[first_a + first_b + size_a + size_b - 1] = ord("|"), ord(";")
        digits = 1 + sum((ids >= 10**k).astype(np.int64) for k in range(1, 7))
        at = np.cumsum(digits + 1) - digits - 1
        out = np.zeros(int((digits + 1).sum()), np.uint8)
        out[at + digits] = mark
        for k in range(7):
            some = digits > k
            out[(at + digits - 1 - k)[some]] = ids[some] // 10**k % 10 + ord("0")
        return out, digits + 1

    def _pairs(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, size_a: np.ndarray, first_b: np.ndarray, size_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs (a * pieces of the second side + b), how often each, and the piece that holds it, by piece."""
        links = size_a * size_b
        small = np.flatnonzero(links <= EXPANDED)
        n = links[small]
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(size_b[small], n)
        left = a[np.repeat(first_a[small], n) + k // wide] if len(k) else a[:0]
        right = b[np.repeat(first_b[small], n) + k % wide] if len(k) else b[:0]
        pair, times, whose = [left * self.many + right], [np.ones(len(k), np.int64)], [np.repeat(owner[small], n)]
        for g in np.flatnonzero(links > EXPANDED).tolist():
            (x, nx), (y, ny) = (np.unique(ids[f : f + s], return_counts=True) for ids, f, s in ((a, first_a[g], size_a[g]), (b, first_b[g], size_b[g])))
            pair.append((x[:, None] * self.many + y).ravel())
            times.append((nx[:, None] * ny).ravel())
            whose.append(np.full(len(pair[-1]), owner[g]))
        pair, times, whose = (np.concatenate(x) for x in (pair, times, whose))
        order = np.argsort(whose, kind="stable")
        return pair[order], times[order], whose[order]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Of each row: numbers, the groups' digest, and its distinct pairs with how often."""
        rows = len(offs) - 1
        text = np.insert(data, offs[:-1], 32)
        offs = offs + np.arange(rows + 1)
        start = np.zeros(len(text) + 1, bool)
        start[self.cuts(text)] = True
        start[offs] = True
        places = np.flatnonzero(start)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(text)])
        coded = cut.dictionary_encode()
        which = coded.indices.to_numpy()
        made = self.align(coded.dictionary)
        begin = np.searchsorted(places, offs)  # of each row's pieces
        whole = (np.logical_and.reduceat(made["whole"][which], begin[:-1]) if rows else np.zeros(0, bool)) & (np.diff(offs) > 1)
        numbers = {k: np.where(whole, np.add.reduceat(made[k][which], begin[:-1]), 0) for k in ("n_a", "n_b", "n_groups", "n_links")}
        at, text_at = np.cumsum(made["pairs"]) - made["pairs"], np.cumsum(made["chars"]) - made["chars"]
        digests, pairs = [], []
        for row in range(rows):
            if not whole[row]:
                digests.append("")
                pairs.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            own = which[begin[row] : begin[row + 1]]
            digest = hashlib.sha256()
            for k in range(0, len(own), ASKED):
                some = own[k : k + ASKED]
                written = made["text"][slices(text_at[some], made["chars"][some])]
                digest.update(written[: len(written) - (k + ASKED >= len(own))].tobytes())  # nothing stands behind the last group
            digests.append(digest.hexdigest())
            one, often = np.unique(own, return_counts=True)
            n = made["pairs"][one]
            from_ = slices(at[one], n)
            pair, inverse = np.unique(made["pair"][from_], return_inverse=True)
            pairs.append((pair, np.bincount(inverse, made["times"][from_] * np.repeat(often, n), len(pair)).astype(np.int64)))
        return numbers, digests, pairs


def _encode(a_path: str, b_path: str):
    """Rows of documents, with their pairs as places in the block's; behind them a row with the block's pairs, sorted, and how many of its documents hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, block, row, rows, size = None, TaskContext.get().partitionId() << 32, 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            pair, place = np.unique(np.concatenate([r[-1][0] for r in rows]), return_inverse=True)
            held, at = np.bincount(place, minlength=len(pair)), 0
            packed = []
            for r in rows:
                here = place[at : at + len(r[-1][0])]
                at += len(here)
                packed.append(pack(np.concatenate([np.diff(here, prepend=0), r[-1][1] - 1])))
            n, blank = len(rows), [None]
            columns = [[block] * (n + 1), *([r[k] for r in rows] + blank for k in range(7)), packed + blank, [None] * n + [pair], [None] * n + [held.astype(np.int32)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

        for batch in batches:
            if not len(batch):
                continue
            work = work or aligner(a_path, b_path)
            data, offs = raw(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in row_chunks(offs, CHUNK):
                numbers, digests, pairs = work(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                for k in range(hi - lo):
                    rows.append((row, ids[lo + k], *(int(numbers[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links")), digests[k], pairs[k]))
                    row, size = row + 1, size + len(pairs[k][0])
                if size >= BLOCK:
                    yield from close()
                    block, rows, size = block + 1, [], 0
        if rows:
            yield from close()

    return run


_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in ALIGNED.split(", ")]
_OUT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Documents of a block with the counts of the block's pairs."""
    order = np.argsort(known.column("pair").to_numpy())
    count, best = (known.column(c).to_numpy()[order].astype(np.int64) for c in ("documents", "best"))
    n_best, sums = [], []
    for data in docs.column("links").to_pylist():
        numbers = unpack(data)
        place, times = np.cumsum(numbers[: len(numbers) // 2]), numbers[len(numbers) // 2 :] + 1
        n_best.append(int((best[place] * times).sum()))
        sums.append(int((count[place] * times).sum()))
    named = {c: docs.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table({**named, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": docs.column("groups_sha256")})


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents and of blocks (see _encode), written to the shared folder."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return materialize(map_arrow(rows, _encode(a_path, b_path), ALIGNED), "aligned")


def pair_counts(aligned: DataFrame, many: int) -> DataFrame:
    """(pair, a, b, documents, best): how many documents hold each linked pair, and whether no pair of its first id is in more.

    Blocks are summed up where they are read; the window over a first id holds the second vocabulary at most.
    """
    held = aligned.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    counts = held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.held").cast("long")).alias("documents"))
    split = counts.withColumns({"a": F.expr(f"pair div {many}"), "b": F.col("pair") % many})
    return split.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))


def align_tokenizers(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a_path: a byte-level vocabulary of the tokenizers library; b_path: a sentencepiece model.

    Defined cases: a text that is null, empty, or that either tokenizer doesn't give back has no tokens: zeros and an empty
    digest; rows that repeat an id, or have none, are documents of their own, and equal rows count as often as they stand
    there; ties for an id's most frequent partner are all best; a very long text is aligned whole, a megabyte without a
    cut at about 600 bytes a byte, else at some 60; an empty table gives no row; other columns are ignored, whatever their names.
    """
    a_path, b_path = a_path or tokenizer_path(), b_path or piece_path()
    aligned = aligned_texts(docs, a_path, b_path, id_col, text_col)
    counts = materialize(pair_counts(aligned, aligner(a_path, b_path).many), "pair-counts")
    wanted = aligned.where("pairs IS NOT NULL").select(F.col("block").alias("whose"), F.explode("pairs").alias("pair"))
    known = wanted.join(counts.select("pair", "documents", "best"), "pair")
    rows = aligned.where("pairs IS NULL").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    out = rows.groupBy("block").cogroup(known.groupBy("whose")).applyInArrow(_looked_up, _OUT)
    return out.withColumnRenamed("id", id_col if id_col == "id" else free_name(id_col, [c for c in out.columns if c != "id"]))
