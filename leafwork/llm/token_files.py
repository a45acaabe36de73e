"""Token-id files: ids of all documents end to end, document bounds and document ids as Elias-Fano sequences.

A file: magic, id width in bytes, two bytes spare; the ids; the bounds (tokens before each document, then the total); the
document ids less their least; and a tail with where these start. Files of one table are numbered in ascending document id;
documents without an id come first, and the tail has their number.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm import elias_fano
from leafwork.llm import hashing as H
from leafwork.llm.common import map_arrow, materialize, new_path, raw, row_chunks

MAGIC = b"EFTK"
TAIL = "<QQqQQ4s"  # where the bounds and the document ids start, least document id, documents, how many of them have no id, magic
CHUNK = 4 << 20
FILE_TEXT = 256 << 20  # bytes of text that a file is made of
KNOWN, ASKED = 1_000_000, 4096  # pieces that a worker remembers, and that it encodes at once
#: Bits of a byte. 1: ASCII graphic; 2: ASCII letter; 4: white space, cut off behind 1; 8: digit or sign, cut off behind 2.
KIND = np.array([4 if b in (9, 10, 13, 32) else 0 if not 33 <= b < 127 else 3 if chr(b).isalpha() else 9 for b in range(256)], np.uint8)


def tokenizer_path() -> str:
    """The 50k byte-level vocabulary: LEAFWORK_TOKENIZER, or that of the installed public_tokenizers package."""
    if place := os.environ.get("LEAFWORK_TOKENIZER"):
        return place
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str) -> Encoder:
    """A worker process keeps its encoder, and what it remembers, from task to task."""
    return Encoder(path)


class Encoder:
    """A tokenizer of the tokenizers library, asked once for each distinct piece of text.

    A text is cut where byte-level pre-tokenization never joins two characters: before ASCII white space that follows an
    ASCII graphic character or one from U+00C0 to U+00FF, and before an ASCII digit or sign that follows a letter of
    these ranges. Pieces so encode as they do within the text. That holds for byte-level pre-tokenization by the usual
    pattern, with no space put in front and no normalizer; a text is a single piece under any other tokenizer.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.dtype = np.dtype(np.uint16 if self.tool.get_vocab_size() <= 1 << 16 else np.uint32)
        self.kind = KIND.copy() if self.may_cut(json.loads(self.tool.to_str())) else np.zeros(256, np.uint8)
        for token in self.tool.get_added_tokens_decoder().values():  # never cut inside one
            for byte in token.content.encode()[1:]:
                self.kind[byte] &= 3
        self.forget(np.zeros(0, np.int64))

    def forget(self, keep: np.ndarray) -> None:
        """Remember the pieces at `keep` alone. A known piece takes about 45 bytes: all are arrays, sorted by the pieces' hash."""
        if not len(keep):
            self.keys, self.text, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, self.dtype)
            self.text_at, self.text_n, self.ids_at, self.ids_n = (np.zeros(0, np.int64) for _ in range(4))
        else:
            self.text, self.ids = self.text[slices(self.text_at[keep], self.text_n[keep])], self.ids[slices(self.ids_at[keep], self.ids_n[keep])]
            self.keys, self.text_n, self.ids_n = self.keys[keep], self.text_n[keep], self.ids_n[keep]
            self.text_at, self.ids_at = np.cumsum(self.text_n) - self.text_n, np.cumsum(self.ids_n) - self.ids_n
        self.used = np.zeros(len(self.keys), bool)  # since the last time that pieces were forgotten

    def learn(self, keys: np.ndarray, data: np.ndarray, at: np.ndarray, n: np.ndarray, ids_at: np.ndarray, ids_n: np.ndarray) -> None:
        """Remember pieces whose ids stand in self.ids already; of those that share a hash, also with a known one, one."""
        _, first = np.unique(keys, return_index=True)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys[first]), len(self.keys) - 1)
            first = first[self.keys[place] != keys[first]]
        text_at = len(self.text) + np.cumsum(n[first]) - n[first]
        self.text = np.concatenate([self.text, data[slices(at[first], n[first])]])
        merged = np.concatenate([self.keys, keys[first]])
        order = np.argsort(merged)
        self.keys = merged[order]
        for name, new in (("text_at", text_at), ("text_n", n[first]), ("ids_at", ids_at[first]), ("ids_n", ids_n[first]), ("used", np.zeros(len(first), bool))):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])

    @staticmethod
    def may_cut(made: dict) -> bool:
        before = made.get("pre_tokenizer") or {}
        return not made.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True) and not made.get("truncation") and not made.get("padding")

    def __call__(self, buf: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by `end`, and how many each row has."""
        cut = np.zeros(len(buf) + 1, bool)
        kind = self.kind[buf]
        after = kind[:-1] & 3
        after[1:] |= np.where((buf[:-2] == 0xC3) & (buf[1:-1] >= 0x80), np.where((buf[1:-1] == 0x97) | (buf[1:-1] == 0xB7), 1, 3), 0).astype(np.uint8)
        cut[1:-1] = (after & (kind[1:] >> 2)) != 0
        cut[offs] = True
        places = np.flatnonzero(cut)
        if len(buf) == 0:
            return np.full(len(offs) - 1, end, self.dtype), np.ones(len(offs) - 1, np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        data, at = raw(coded.dictionary)
        at, n = at[:-1], np.diff(at)
        keys = H.word_hashes(data, at, at + n)
        found = np.zeros(len(keys), bool)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            some = np.flatnonzero((self.keys[place] == keys) & (self.text_n[place] == n))
            if len(some):  # the hash finds, the bytes decide
                own = place[some]
                differ = data[slices(at[some], n[some])] != self.text[slices(self.text_at[own], n[some])]
                same = np.add.reduceat(differ, np.cumsum(n[some]) - n[some]) == 0
                some, own = some[same], own[same]
                found[some] = self.used[own] = True
                begin[some], size[some] = self.ids_at[own], self.ids_n[own]
        new = np.flatnonzero(~found)
        if len(new):
            made = [self.ids]
            for k in range(0, len(new), ASKED):  # encodings are large
                part = new[k : k + ASKED]
                got = [x.ids for x in self.tool.encode_batch_fast([x.decode() for x in coded.dictionary.take(pa.array(part)).to_pylist()], add_special_tokens=False)]
                size[part] = [len(x) for x in got]
                made.append(np.fromiter(chain.from_iterable(got), self.dtype, int(size[part].sum())))
            begin[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
            self.ids = np.concatenate(made)
            self.learn(keys[new], data, at[new], n[new], begin[new], size[new])
        per = size[which]
        before = np.concatenate(([0], np.cumsum(per)))
        ids = self.ids[slices(begin[which], per)]
        if len(self.keys) > KNOWN:
            keep = np.flatnonzero(self.used)
            self.forget(keep if len(keep) <= 3 * KNOWN // 4 else np.zeros(0, np.int64))
        rows = before[np.searchsorted(places, offs)]
        return np.insert(ids, rows[1:], end), np.diff(rows) + 1


def slices(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions at[0] .. at[0] + n[0] - 1, at[1] .., one after another."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - n), n)


def _write(place: str, tokenizer: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ends, ids, nameless, path = None, array("q", [0]), array("q"), 0, ""  # eight bytes each, and an eighth to grow
        encode = None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                encode = encoder(tokenizer)
                fs, base = pyarrow.fs.FileSystem.from_uri(place)
                fs.create_dir(base, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.eftk"  # each attempt has a file of its own
                path = f"{place}/{name}"
                out = fs.open_output_stream(f"{base}/{name}")
                out.write(MAGIC + struct.pack("<BBH", encode.dtype.itemsize, 0, 0))
            data, offs = raw(batch.column(1))
            nameless += batch.column(0).null_count  # null ids are the first
            ids.frombytes(batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
            for lo, hi in row_chunks(offs, CHUNK):
                tokens, n = encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], end)
                out.write(tokens.tobytes())
                ends.frombytes((ends[-1] + np.cumsum(n)).astype(np.int64).tobytes())
        if out is None:
            return
        n, total, least = len(ends) - 1, ends[-1], ids[0] if len(ids) else 0
        bounds = 8 + total * encode.dtype.itemsize
        coded = elias_fano.encode(np.frombuffer(ends, np.int64))
        del ends
        own = np.frombuffer(ids, np.int64).copy() if least else np.frombuffer(ids, np.int64)
        del ids
        if least:
            own -= least
        out.write(coded)
        out.write(elias_fano.encode(own))
        out.write(struct.pack(TAIL, bounds, bounds + len(coded), least, n, nameless, MAGIC))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([path]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["part", "path", "docs", "tokens"])

    return run


class TokenFile:
    """Random access to one file: only its tail sections are read at once."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str) -> None:
        self.file = fs.open_input_file(path)
        size, end = self.file.size(), struct.calcsize(TAIL)
        bounds, names, self.least, self.n, self.nameless, magic = struct.unpack(TAIL, self.file.read_at(end, size - end))
        head = self.file.read_at(8, 0)
        if magic != MAGIC or head[:4] != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.dtype = np.dtype({2: np.uint16, 4: np.uint32}[head[4]])
        rest = self.file.read_at(size - end - bounds, bounds)
        self.bounds, self.names = elias_fano.EliasFano(rest), elias_fano.EliasFano(rest, names - bounds)

    def span(self, first: int, count: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Document ids (null for those that have none), bounds (one more) and token ids of `count` documents from number `first` on."""
        ends = self.bounds.select(first, count + 1).astype(np.int64)
        wide = self.dtype.itemsize
        ids = np.frombuffer(self.file.read_at(int(ends[-1] - ends[0]) * wide, 8 + int(ends[0]) * wide), self.dtype)
        none = min(max(self.nameless - first, 0), count)
        names = self.names.select(first + none - self.nameless, count - none).astype(np.int64) + self.least if none < count else np.zeros(0, np.int64)
        return pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(names, pa.int64())]), ends, ids


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = TokenFile(*pyarrow.fs.FileSystem.from_uri(path))
            for first in range(0, got.n, 256):
                names, ends, ids = got.span(first, min(256, got.n - first))
                flat, at = ids.astype("<u4").tobytes(), (ends - ends[0]) * 4
                sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names, pa.array(ends[:-1] + base), pa.array(np.diff(ends)), pa.array(sums, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, place: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, files: int | None = None) -> DataFrame:
    """Encode each text, append `end_id`, and write the ids in ascending document id under `place`; returns (part, path, docs, tokens), already written.

    The table is dealt by ranges of the id, so the order of parts is the order of ids and each task streams one file:
    its memory holds a batch of text and, until the file ends, some twenty bytes a document. There are `files` of them, or as
    many as make about FILE_TEXT bytes of text each, and at least the session's number of shuffle partitions.

    Defined cases: a null text is empty and has the end id alone; rows that repeat an id come one after another, by text
    (tied rows are equal); documents whose id is null come before all others, by text; a very long text is encoded whole,
    at about thirty bytes a byte; an empty table writes no file; other columns are ignored, whatever their names. The id
    is an integer.
    """
    if not isinstance(docs.schema[id_col].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise TypeError(f"{id_col} must be an integer")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if not files:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_TEXT))
    n = files
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    return materialize(map_arrow(dealt, _write(place, tokenizer, end_id), "part long, path string, docs long, tokens long"), "token-manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files; start counts the ids of all files."""
    files = sorted(manifest.select("part", "path", "tokens").collect())  # a row a file: bounded by the number of parts
    base, todo = 0, []
    for _, path, tokens in files:
        todo.append((path, base))
        base += tokens
    spark = manifest.sparkSession
    listed = spark.createDataFrame(todo, "path string, base long").repartition(max(1, len(todo)))
    return map_arrow(listed, _read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_round_trip(docs: DataFrame, tokenizer: str, **names) -> DataFrame:
    """write_token_files to the shared folder, then read_token_files."""
    return read_token_files(write_token_files(docs, new_path(docs.sparkSession, "tokens"), tokenizer, **names), names.get("id_col", "doc_id"))
