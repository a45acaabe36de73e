"""Repeated fixed-length windows of a corpus, found by super-windows.

A window is `size` consecutive units (bytes or words) of one document. Its minimiser is the least hash among the
`gram`-unit strings in it. Consecutive windows that share a minimiser travel as one packed string to the minimiser's
bucket; equal windows share their minimiser and so meet there. One shuffle moves about three times the text, compressed;
the bucket alone decides which windows repeat, and returns spans of units.

Hot strings: a packed string that a map task sees again among 12 MB of text is settled there (all its windows repeat), and
only its first copy travels, marked. The task remembers those it met most often, 4 MB of them: such a string travels once a
task, not once for each 12 MB. A bucket that gets more than it may hold first reduces equal strings to one marked
copy; so however many documents hold a string, it takes the room of one. If the strings that are left differ, as those of a
very common minimiser in ever new surroundings do, or those of one minimiser are more than are compared at once, they are cut again by a longer minimiser under another hash and dealt to
64 buckets of the next level, by one more shuffle of that part alone. At the last level the minimiser is the window itself.
Equal windows take the same way through all levels, so every level is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm import hashing as H
from leafwork.llm.common import RK, map_arrow, materialize, raw, row_chunks, spans_of

_U = np.uint64
CHUNK = 1 << 20  # bytes of text worked on at once
FLUSH = 12 << 20  # bytes of text whose strings are packed together
BUCKET_BYTES = 2 << 20  # of input, for each bucket
KNOWN = 4 << 20  # bytes of hot strings that a map task remembers
HELD = 32 << 20  # bytes of strings that a bucket holds before it reduces or cuts them
COMPARED = 4 << 20  # bytes of strings compared at once; strings with one minimiser stay together
GROUP = 4 << 20  # bytes of strings with one minimiser that are compared; more are cut as a bucket is
FAN = 64  # buckets of the next level for one that is cut
MOST_PARTS = 1 << 15  # shuffle partitions, if the session doesn't ask for more; each streams its buckets one by one
UNKNOWN = 1 << 47  # an estimate beyond this is none
PACKED = pa.schema([("bucket", pa.int64()), (RK, pa.int64()), ("data", pa.binary()), ("settled", pa.bool_())])
_COLUMNS = (("val", np.uint32), ("first", np.int64), ("wins", np.int64), ("rk", np.int64), ("flag", np.uint8), ("len", np.int64))


@dataclass(frozen=True)
class Kind:
    """size: units in a window; gram: units of a minimiser candidate; words: units are words, else bytes."""

    size: int
    gram: int
    words: bool
    level: int = 0

    def next(self) -> Kind | None:
        """The kind that cuts a bucket of this one: a longer minimiser under another hash; None where windows are cut one by one already."""
        return None if self.gram == self.size else Kind(self.size, min(self.size, 2 * self.gram), self.words, self.level + 1)


def least(codes: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        codes = np.minimum(codes[:-step], codes[step:])
        have += step
    return codes


def squeeze(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with one space for each run of white space."""
    space = H.SPACE[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.concatenate(([0], np.cumsum(keep)))
    out = np.where(space, np.uint8(32), buf)[keep]
    return out, at[offs]


def super_windows(kind: Kind, codes: np.ndarray, rows: np.ndarray):
    """Runs of windows that share a minimiser: minimiser, first unit, windows, row, and whether the minimiser moves."""
    spare = np.diff(rows) - (kind.size - 1)
    spare = np.maximum(spare, 0)
    total = int(spare.sum())
    if not total:
        return None
    grams = H.rolling(codes, kind.gram)
    if kind.level:
        grams = H.mix(grams + _U(kind.level))
    key = ((grams >> _U(32)) << _U(32)) | np.arange(len(grams), dtype=_U)
    mins = least(key, kind.size - kind.gram + 1)
    row = np.repeat(np.arange(len(spare)), spare)
    win = np.arange(total) - np.repeat(np.cumsum(spare) - spare, spare) + rows[row]
    got = mins[win]
    val = (got >> _U(32)).astype(np.uint32)
    new = np.ones(total, bool)
    new[1:] = (val[1:] != val[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], total) - 1
    return val[head], win[head], tail - head + 1, row[head], got[head] != got[tail]


def cut(kind: Kind, buf: np.ndarray, offs: np.ndarray):
    """Super-windows of the rows of a buffer: minimiser, first unit in the row, windows, row, whether the minimiser moves, and the string of each; None if there are none."""
    if kind.words:
        buf, offs = squeeze(buf, offs)
        starts, ends, rows = H.words(buf, offs)
        codes = H.word_hashes(buf, starts, ends)
    else:
        rows, codes = offs, H.BYTE_CODE[buf]
    got = super_windows(kind, codes, rows)
    if got is None:
        return None
    val, first, wins, row, moves = got
    past = first + wins + kind.size - 1
    froms, tos = (starts[first], ends[past - 1]) if kind.words else (first, past)
    text = buf.tobytes()
    return val, first - rows[row], wins, row, moves, [text[a:b] for a, b in zip(froms.tolist(), tos.tolist(), strict=True)]


def blob(squash: zstandard.ZstdCompressor, table: dict[str, np.ndarray], strings: list[bytes]) -> bytes:
    head = [np.diff(table[n], prepend=0).astype(t) if n == "rk" else table[n].astype(t) for n, t in _COLUMNS]
    return squash.compress(b"".join([np.int64(len(strings)).tobytes(), *(x.tobytes() for x in head), *strings]))


def unpacked(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], list[bytes]]:
    heads: dict[str, list] = {name: [] for name, _ in _COLUMNS}
    strings: list[bytes] = []
    for x in blobs:
        flat = zstandard.ZstdDecompressor().decompress(x)
        n, pos = int(np.frombuffer(flat, np.int64, 1)[0]), 8
        for name, t in _COLUMNS:
            col = np.frombuffer(flat, t, n, pos)
            heads[name].append(np.cumsum(col) if name == "rk" else col)
            pos += n * np.dtype(t).itemsize
        ends = pos + np.cumsum(heads["len"][-1])
        strings += [flat[a:b] for a, b in zip((ends - heads["len"][-1]).tolist(), ends.tolist(), strict=True)]
    return {name: np.concatenate(x) for name, x in heads.items()}, strings


def by_bucket(kind: Kind, table: dict[str, np.ndarray], strings: list[bytes], home: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Strings as a compressed row for each bucket."""
    squash = zstandard.ZstdCompressor(level=3)
    order = np.argsort(home, kind="stable")
    edges = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = order[a:b]
        out.append((int(home[part[0]]), 0, blob(squash, {n: table[n][part] for n, _ in _COLUMNS}, [strings[i] for i in part.tolist()]), False))
        if len(out) == 64 or b == len(order):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), PACKED, strict=True)], schema=PACKED)
            out = []


def spans_batch(found: np.ndarray) -> pa.RecordBatch:
    """(key, start, past) rows as rows of PACKED that are settled: an array of spans for each key."""
    rk, data = by_row(found)
    return pa.RecordBatch.from_arrays([pa.array(rk & 0x7FFFFFFF), pa.array(rk), pa.array(data, pa.binary()), pa.array([True] * len(rk))], schema=PACKED)


def hottest(met: dict[bytes, int], most: int) -> dict[bytes, int]:
    """The strings met most often, of at most so many bytes in all."""
    out, size = {}, 0
    for x, n in sorted(met.items(), key=lambda e: -e[1]):
        size += len(x)
        if size > most:
            break
        out[x] = n
    return out


def pack(kind: Kind, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side: (key, text) to packed strings by bucket, and spans that this task alone can settle (bucket from the row's key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, list] = {name: [] for name, _ in _COLUMNS}
        seen: dict[bytes, int] = {}
        marked: list[int] = []
        known: dict[bytes, int] = {}  # strings that were sent marked, and how often they were met; to forget one costs a copy
        local: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, known
            if seen:
                table = {n: np.concatenate(cols[n]).astype(t) for n, t in _COLUMNS}
                table["flag"][marked] |= 2
                sent = list(seen)
                known = hottest(known | {sent[j]: n + 1 for j, n in Counter(marked).items()}, KNOWN)
                yield from by_bucket(kind, table, sent, (H.mix(table["val"].astype(_U)) % _U(buckets)).astype(np.int64))
            if local:
                yield spans_batch(np.concatenate(local))
            for x in cols.values():
                x.clear()
            seen.clear()
            marked.clear()
            local.clear()
            held = 0

        for batch in batches:
            data, offs = raw(batch.column(1))
            rks = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(offs, CHUNK):
                got = cut(kind, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                if got is not None:
                    val, begin, wins, row, moves, strings = got
                    at, new, n = [], [], len(seen)
                    for i, x in enumerate(strings):
                        if x in known:
                            known[x] += 1
                            at.append(i)
                            continue
                        j = seen.setdefault(x, n)
                        if j == n:
                            n += 1
                            new.append(i)
                        else:
                            marked.append(j)
                            at.append(i)
                    rk = rks[lo + row]
                    if new:
                        for name, x in (("val", val), ("first", begin), ("wins", wins), ("rk", rk), ("flag", moves), ("len", np.array([len(x) for x in strings]))):
                            cols[name].append(x[new])
                    if at:
                        local.append(np.stack([rk[at], begin[at], begin[at] + wins[at] + kind.size - 1], 1))
                held += int(offs[hi] - offs[lo])
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return run


def by_row(found: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(key, start, past) rows to one array of spans for each key."""
    found = found[np.argsort(found[:, 0], kind="stable")]
    edges = np.flatnonzero(np.diff(found[:, 0], prepend=found[0, 0] - 1))
    spans = np.ascontiguousarray(found[:, 1:])
    return found[edges, 0], [x.tobytes() for x in np.split(spans, edges[1:])]


class Folded:
    """Packed strings, equal ones counted. every: all windows repeat; moves: a minimiser value stands at two places."""

    def __init__(self, kind: Kind, table: dict[str, np.ndarray], strings: list[bytes]) -> None:
        ids: dict[bytes, int] = {}
        self.kind, self.table = kind, table
        self.which = which = np.array([ids.setdefault(x, len(ids)) for x in strings], np.int64)
        self.strings = list(ids)
        n = len(self.strings)
        self.every = np.bincount(which, minlength=n) > 1
        self.every[which[(table["flag"] & 2) > 0]] = True
        self.moves = np.zeros(n, bool)
        self.moves[which[(table["flag"] & 1) > 0]] = True
        self.first_of = np.zeros(n, np.int64)
        self.first_of[which[::-1]] = np.arange(len(which))[::-1]

    def whole(self) -> np.ndarray:
        """(key, start, past) of all copies of strings that repeat whole."""
        t, at = self.table, np.flatnonzero(self.every[self.which])
        return np.stack([t["rk"][at], t["first"][at], t["first"][at] + t["wins"][at] + self.kind.size - 1], 1)

    def reduced(self) -> tuple[dict[str, np.ndarray], list[bytes]]:
        """One marked copy of each string."""
        table = {n: x[self.first_of] for n, x in self.table.items()}
        table["flag"] = (self.moves | (self.every * 2)).astype(np.uint8)
        return table, self.strings


def settle(kind: Kind, repeats: Callable[[list[bytes]], list[np.ndarray]], most: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bucket side; rows come sorted by bucket. Gives settled rows, and rows for the next level of buckets that were cut.

    repeats: of distinct strings, which windows occur more than once in them; most: bytes of strings that a bucket may
    hold (HELD if None).
    """
    most = most or HELD

    def finish(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        table, strings = unpacked(blobs)
        _, group, count = np.unique(table["val"], return_inverse=True, return_counts=True)
        cand = np.flatnonzero((count[group] > 1) | (table["flag"] > 0))
        if not len(cand):
            return
        got = Folded(kind, {n: x[cand] for n, x in table.items()}, [strings[i] for i in cand.tolist()])
        strings.clear()
        kin = group[cand[got.first_of]]
        mixed = np.flatnonzero((np.bincount(kin)[kin] > 1) | got.moves)
        mixed = mixed[np.argsort(kin[mixed], kind="stable")]
        found = [got.whole()]
        t, lone = got.table, got.first_of
        length = t["len"][lone[mixed]]
        large = np.bincount(kin[mixed], length)[kin[mixed]] > GROUP if len(mixed) and kind.next() is not None else np.zeros(len(mixed), bool)
        if large.any():
            marked, every = got.reduced()
            part = mixed[large]
            yield from deeper(bucket, {n: x[part] for n, x in marked.items()}, [every[i] for i in part.tolist()])
            mixed, length = mixed[~large], length[~large]
        sizes = np.cumsum(length)
        stops = np.append(np.flatnonzero(np.diff(kin[mixed])) + 1, len(mixed))  # where the strings of a minimiser end
        lo = 0
        while lo < len(mixed):  # as many whole groups as fit, one at least
            fit = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + COMPARED, "right"))
            k = int(np.searchsorted(stops, fit, "right")) - 1
            hi = int(stops[k]) if k >= 0 and stops[k] > lo else int(stops[np.searchsorted(stops, lo, "right")])
            part = mixed[lo:hi]
            for i, mask in zip(part.tolist(), repeats([got.strings[i] for i in part.tolist()]), strict=True):
                if not got.every[i] and mask.any():
                    spans, at = spans_of(mask), lone[i]
                    found.append(np.stack([np.full(len(spans), t["rk"][at]), t["first"][at] + spans[:, 0], t["first"][at] + spans[:, 1] + kind.size - 1], 1))
            lo = hi
        found = np.concatenate(found)
        if len(found):
            yield spans_batch(found)

    def deeper(bucket: int, table: dict[str, np.ndarray], strings: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The strings cut by the next kind, under the numbers of the bucket's FAN parts."""
        after = kind.next()
        offs = np.concatenate(([0], np.cumsum([len(x) for x in strings]))).astype(np.int64)
        for lo, hi in row_chunks(offs, CHUNK):
            val, begin, wins, row, moves, parts = cut(after, np.frombuffer(b"".join(strings[lo:hi]), np.uint8), offs[lo : hi + 1] - offs[lo])
            own = lo + row
            new = {"val": val, "first": table["first"][own] + begin, "wins": wins, "rk": table["rk"][own], "flag": moves | (table["flag"][own] & 2), "len": np.array([len(x) for x in parts])}
            yield from by_bucket(after, new, parts, bucket * FAN + (H.mix(val.astype(_U)) % _U(FAN)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, held, limit, over = None, [], 0, most, False

        def shrink() -> Iterator[pa.RecordBatch]:
            """Equal strings become one; what is still too much goes to the next level."""
            nonlocal blobs, held, limit, over
            got = Folded(kind, *unpacked(blobs))
            blobs, held = [], 0
            if got.every.any():
                yield spans_batch(got.whole())
            table, strings = got.reduced()
            size = int(table["len"].sum())
            over = over or (kind.next() is not None and 2 * size > limit)
            if over:
                yield from deeper(now, table, strings)
            else:
                blobs, held = [blob(zstandard.ZstdCompressor(level=1), table, strings)], size
                limit = max(limit, 2 * size)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal blobs, held, limit, over
            if blobs:
                yield from shrink() if over else finish(now, blobs)
            blobs, held, limit, over = [], 0, most, False

        for batch in batches:
            if batch.column(3).true_count:
                yield batch.filter(batch.column(3))
                batch = batch.filter(pc.invert(batch.column(3)))
            for i, bucket in enumerate(batch.column(0).to_pylist()):
                if bucket != now:
                    yield from close()
                    now = bucket
                x = batch.column(2)[i].as_py()
                blobs.append(x)
                held += zstandard.get_frame_parameters(x).content_size
                if held > limit:
                    yield from shrink()
        yield from close()

    return run


def repeated_spans(docs: DataFrame, text_col: str, kind: Kind, repeats: Callable[[list[bytes]], list[np.ndarray]], size: int) -> DataFrame:
    """(__rk, data): int64 pairs (start, past) of units that repeated windows cover; several rows a key may come. size: an estimate of the text's bytes."""
    spark = docs.sparkSession
    if size > UNKNOWN:  # the optimizer has no idea: measure
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    schema = f"bucket long, {RK} long, data binary, settled boolean"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, MOST_PARTS))
    now, found = map_arrow(docs.select(RK, text_col), pack(kind, buckets), schema), None
    while kind is not None:
        dealt = now.repartition(parts, "bucket").sortWithinPartitions("bucket")
        out = materialize(map_arrow(dealt, settle(kind, repeats), schema), "spans")
        spans = out.where("settled").select(RK, "data")
        found = spans if found is None else found.union(spans)
        now, kind = out.where("NOT settled"), kind.next()
        if now.isEmpty():
            break
    return found
