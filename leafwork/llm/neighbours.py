"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is cut into clusters of about equal size, whose centroids and a graph over them are the index that every
task holds. A vector goes to the list of its nearest centroid, and near a border to those of others as well; a query goes to
the lists whose centroids are at most a certain ratio farther than its nearest. Spark brings lists and queries together, and
each list scores its queries exactly. The ratio is fitted on the sample so that the wanted share of neighbours is found.

Inner products are searched as distances: a vector x gets one more component, sqrt(M * M - |x| * |x|), M the greatest norm,
and a query is brought to norm M and gets 0; the nearest are then those of the largest inner product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm.common import map_arrow, materialize

CHUNK = 1024  # rows searched at once
BLOCK = 256  # queries scored at once
LEAST = 4  # lists that a query goes to at least: the ratio says little where a query lies on a centroid
SAMPLE_NUMBERS = 1 << 23  # components that the driver takes at most, whatever the length of vectors
SPARE = 12  # candidates beyond those asked for that are scored once more, in a fixed order of summation
PART_ROWS, PART_QUERIES = 8192, 16384  # about as many vectors, and queries, of a list go to one place; longer lists are dealt out


def balanced_lists(x: np.ndarray, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of x in clusters of at most `size`, near ones next to each other: each is split into up to eight by k-means with a
    price on what is too full, until it is small enough."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        k = min(8, -(-len(rows) // size))
        own = x[rows]
        centers, price = own[rng.choice(len(own), k, replace=False)], np.zeros(k)
        for turn in range(12):
            d = (centers * centers).sum(1) - 2 * own @ centers.T
            which = (d + price).argmin(1)
            count = np.bincount(which, minlength=k)
            spread = max(float(np.median(np.sort(d, 1)[:, 1] - d.min(1))), 1e-9)
            price += spread * (count * k / len(own) - 1) * (0.5 if turn < 8 else 0.2)
            sums = np.zeros_like(centers)
            np.add.at(sums, which, own)
            centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
        if count.max() == len(own):  # nothing tells them apart
            which = np.arange(len(own)) * k // len(own)
        todo.extend(rows[which == c] for c in range(k - 1, -1, -1) if (which == c).any())
    return done


@dataclass
class Index:
    """Centroids, each with links to its nearest ones and to its neighbours in the order of lists, so that all are reached."""

    centers: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    norm: float  # the greatest of any vector
    ratio: float = 1.0  # of distances, up to which a query goes to lists
    share: np.ndarray | None = None  # of all vectors, by list
    first: np.ndarray | None = None  # number of each list's first place, and how many places its vectors and its queries are dealt to
    parts: np.ndarray | None = None
    turns: np.ndarray | None = None

    @classmethod
    def over(cls, centers: np.ndarray, norm: float, degree: int = 16) -> Index:
        n = len(centers)
        links = []
        square = (centers * centers).sum(1)
        for lo in range(0, n, CHUNK):
            d = square - 2 * centers[lo : lo + CHUNK] @ centers.T
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            links.append(np.argsort(d, 1, kind="stable")[:, : min(degree, n - 1)])
        own = np.arange(n)[:, None]
        links = np.concatenate([*links], 0) if n > 1 else own
        return cls(centers, np.concatenate([links, np.maximum(own - 1, 0), np.minimum(own + 1, n - 1)], 1), np.unique(np.linspace(0, n - 1, max(1, int(n**0.5))).astype(int)), norm)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their further component."""
        return np.concatenate([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1, keepdims=True), 0))], 1)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries, none of them zero, at the greatest norm and with their further component."""
        return np.concatenate([q * (self.norm / np.sqrt((q * q).sum(1, keepdims=True))), np.zeros((len(q), 1))], 1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids that a best-first walk of the graph finds, and their squared distances, in order.

        Each row keeps the best `width` and goes on from the nearest two that it hasn't gone on from, until none are left.
        """
        n = len(self.centers)
        width = min(width, n)
        square = (self.centers * self.centers).sum(1)
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        dist = (x * x).sum(1)[:, None] + square[self.entries] - 2 * x @ self.centers[self.entries].T
        ids, dist, gone = self._best(ids, dist, np.zeros(ids.shape, bool), width)
        live = np.arange(len(x))
        while len(live):
            ahead = np.where(gone[live], np.inf, dist[live])
            step = np.argsort(ahead, 1, kind="stable")[:, :2]
            some = np.take_along_axis(ahead, step, 1) < np.inf
            live, step, some = live[some[:, 0]], step[some[:, 0]], some[some[:, 0]]
            if not len(live):
                break
            from_ = np.where(some, np.take_along_axis(ids[live], step, 1), np.take_along_axis(ids[live], step[:, :1], 1))
            gone[live[:, None], step] = True
            near = self.links[from_].reshape(len(live), -1)
            d = (x[live] * x[live]).sum(1)[:, None] + square[near] - 2 * np.einsum("bd,bkd->bk", x[live], self.centers[near])
            ids[live], dist[live], gone[live] = self._best(np.concatenate([ids[live], near], 1), np.concatenate([dist[live], d], 1), np.concatenate([gone[live], np.zeros(near.shape, bool)], 1), width)
        return ids, np.maximum(dist, 0)

    @staticmethod
    def _best(ids: np.ndarray, dist: np.ndarray, gone: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest `width` of each row, each once; what is missing is at an infinite distance."""
        order = np.lexsort((~gone, ids), axis=1)  # of equal ids that first from which the walk went on
        ids, dist, gone = (np.take_along_axis(v, order, 1) for v in (ids, dist, gone))
        twice = np.zeros(ids.shape, bool)
        twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
        dist = np.where(twice, np.inf, dist)
        gone = gone | twice
        order = np.argsort(dist, 1, kind="stable")[:, :width]
        ids, dist, gone = (np.take_along_axis(v, order, 1) for v in (ids, dist, gone))
        if ids.shape[1] < width:
            fill = ((0, 0), (0, width - ids.shape[1]))
            ids, dist, gone = np.pad(ids, fill), np.pad(dist, fill, constant_values=np.inf), np.pad(gone, fill, constant_values=True)
        return ids, dist, gone

    def lists_of(self, x: np.ndarray, copies: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each vector: its nearest list and, near a border, those not farther than 1 + margin times as far, `copies` in all."""
        ids, dist = self.search(x, 2 * copies + 8)
        row, place = np.nonzero(dist[:, :copies] <= (1 + margin) ** 2 * dist[:, :1])
        return row, ids[row, place]

    def probes(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for queries: lists whose centroids are at most `ratio` times as far as the nearest, LEAST at least, and as many
        as hold the share `least` of all vectors. The graph finds them; where that isn't all of them, all centroids are compared."""
        ids, dist = self.search(q, 64)
        wanted = self._wanted(ids, dist, least)
        row, place = np.nonzero(wanted)
        open_ = np.flatnonzero(wanted[:, -1]) if ids.shape[1] < len(self.centers) else np.zeros(0, int)
        closed = ~np.isin(row, open_)
        rows, lists = [row[closed]], [ids[row[closed], place[closed]]]
        for k in range(0, len(open_), BLOCK):
            part = open_[k : k + BLOCK]
            d = np.maximum((q[part] * q[part]).sum(1)[:, None] + (self.centers * self.centers).sum(1) - 2 * q[part] @ self.centers.T, 0)
            order = np.argsort(d, 1, kind="stable")
            r, place = np.nonzero(self._wanted(order, np.take_along_axis(d, order, 1), least))
            rows.append(part[r])
            lists.append(order[r, place])
        return np.concatenate(rows), np.concatenate(lists)

    def _wanted(self, ids: np.ndarray, dist: np.ndarray, least: float) -> np.ndarray:
        before = np.cumsum(self.share[ids], 1) - self.share[ids]
        return (dist < np.inf) & ((dist <= self.ratio**2 * dist[:, :1]) | (before < least) | (np.arange(ids.shape[1]) < LEAST))


def fit(sample: np.ndarray, norm: float, lists: int, k: int, recall: float, copies: int, margin: float, seed: int = 1) -> Index:
    """An index over `sample` (rows of double precision): clusters, graph, and the ratio at which the share `recall` of the sample's own
    neighbours is in lists that queries go to."""
    rng = np.random.default_rng(seed)
    index = Index.over(np.zeros((1, sample.shape[1] + 1)), norm)
    lifted = index.lifted(sample)
    clusters = balanced_lists(lifted, max(1, -(-len(sample) // lists)), rng)
    index = Index.over(np.stack([lifted[c].mean(0) for c in clusters]), norm)
    row, where = (np.concatenate(v) for v in zip(*(_shifted(index.lists_of(lifted[lo : lo + CHUNK], copies, margin), lo) for lo in range(0, len(sample), CHUNK)), strict=True))
    nearest = where[np.concatenate(([True], row[1:] != row[:-1]))]
    index.share = np.bincount(nearest, minlength=len(clusters)) / len(sample)
    held = np.full((len(sample), copies), -1)
    held[row, np.arange(len(row)) - np.searchsorted(row, row)] = where
    some = rng.choice(len(sample), min(512, len(sample)), replace=False)
    needed = []
    for lo in range(0, len(some), 64):
        part = some[lo : lo + 64]
        score = sample[part] @ sample.T
        score[np.arange(len(part)), part] = -np.inf
        best = np.argpartition(-score, min(k, len(sample) - 1), 1)[:, : min(k, len(sample) - 1)]
        q = index.asked(sample[part])
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (index.centers * index.centers).sum(1) - 2 * q @ index.centers.T, 1e-18))
        lists_of = held[best]  # query, neighbour, copy
        far = np.where(lists_of >= 0, np.take_along_axis(d, np.maximum(lists_of, 0).reshape(len(part), -1), 1).reshape(lists_of.shape), np.inf).min(2)
        needed.append((far / d.min(1, keepdims=True)).ravel())
    every = np.concatenate(needed) if needed else np.zeros(0)
    index.ratio = float(np.quantile(every, recall)) if len(every) else 1.0
    return index


def _shifted(found: tuple[np.ndarray, np.ndarray], by: int) -> tuple[np.ndarray, np.ndarray]:
    return found[0] + by, found[1]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists without nulls, each of `dim` numbers, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _post(index, dim: int, copies: int, margin: float) -> Callable:
    """Vectors (ids, v) to their places: each list's vectors are dealt to its parts by id, once for each of its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = index.value
            for lo in range(0, len(batch), CHUNK):
                part = batch.slice(lo, CHUNK)
                row, where = own.lists_of(own.lifted(_matrix(part.column("v"), dim)), copies, margin)
                least = np.array([x[0] for x in part.column("ids").to_pylist()], np.int64)[row]
                dealt = (least * -7046029254386353131 >> 33) % own.parts[where]
                turns = own.turns[where]
                which = np.repeat(np.arange(len(row)), turns)
                turn = np.arange(len(which)) - np.repeat(np.cumsum(turns) - turns, turns)
                place = own.first[where[which]] + dealt[which] * turns[which] + turn
                take = pa.array(row[which])
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.zeros(len(place), np.int32)), part.column("ids").take(take), part.column("v").take(take)], names=["place", "kind", "ids", "v"])

    return run


def _ask(index, dim: int, least: float) -> Callable:
    """Queries (g, v) to the places of their lists: to all parts of each, in one of its turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = index.value
            for lo in range(0, len(batch), CHUNK):
                part = batch.slice(lo, CHUNK)
                g = part.column("g").to_numpy()
                row, where = own.probes(own.asked(_matrix(part.column("v"), dim)), least)
                parts, turns = own.parts[where], own.turns[where]
                which = np.repeat(np.arange(len(row)), parts)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                place = own.first[where[which]] + nth * turns[which] + g[row[which]] % turns[which]
                for k in range(0, len(place), 8192):  # a query goes to many places
                    rows = row[which[k : k + 8192]]
                    ids = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32)), pa.array(g[rows]))
                    yield pa.RecordBatch.from_arrays([pa.array(place[k : k + 8192]), pa.array(np.ones(len(rows), np.int32)), ids, part.column("v").take(pa.array(rows))], names=["place", "kind", "ids", "v"])

    return run


def _score(dim: int, k: int) -> Callable:
    """Rows come by place, the vectors before the queries. For each query the best k ids of a place, as (0 - score, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, counts, vectors, whole = None, [], [], [], None
        for batch in batches:
            place, kind = batch.column("place").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
                if lo == hi:
                    continue
                if place[lo] != now:
                    now, ids, counts, vectors, whole = place[lo], [], [], [], None
                part = batch.slice(lo, hi - lo)
                lists, v = part.column("ids"), _matrix(part.column("v"), dim)
                if kind[lo] == 0:
                    ids.append(lists.flatten().to_numpy())
                    counts.append(lists.value_lengths().to_numpy())
                    vectors.append(v)
                    continue
                if not vectors:
                    continue
                if whole is None:
                    whole, vectors = (np.concatenate(ids), np.concatenate(counts).astype(np.int64), np.concatenate(vectors)), [()]
                g = lists.flatten().to_numpy()
                for a in range(0, len(g), BLOCK):
                    yield _best(g[a : a + BLOCK], v[a : a + BLOCK], *whole, k)

    return run


def _best(g: np.ndarray, q: np.ndarray, ids: np.ndarray, counts: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    rough = q @ x.T
    wide = min(k + SPARE, len(x))
    some = np.argpartition(-rough, wide - 1, 1)[:, :wide] if wide < len(x) else np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
    exact = np.stack([(q * x[some[:, j]]).sum(1) for j in range(wide)], 1)  # summed alike wherever the two meet
    n = counts[some].ravel()
    row = np.repeat(np.repeat(np.arange(len(q)), wide), n)
    score = np.repeat(exact.ravel(), n)
    at = np.repeat((np.cumsum(counts) - counts)[some].ravel(), n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    name = ids[at]
    order = np.lexsort((name, -score, row))
    row, score, name = row[order], score[order], name[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    row, score, name = row[keep], score[keep], name[keep]
    offs = np.searchsorted(row, np.arange(len(q) + 1)).astype(np.int32)
    found = pa.StructArray.from_arrays([pa.array(0.0 - score), pa.array(name)], names=["less", "id"])
    return pa.RecordBatch.from_arrays([pa.array(g), pa.ListArray.from_arrays(pa.array(offs), found)], names=["g", "found"])


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows that have an id and a vector of finite components, one of them not 0."""
    own = F.col(f"`{vec_col}`")
    wide = T.ArrayType(T.FloatType()) if vectors.schema[vec_col].dataType.elementType == T.FloatType() else T.ArrayType(T.DoubleType())
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), own.cast(wide).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is greater than all numbers
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, list_rows: int = 1024, most_lists: int = 4096,
    sample_rows: int = 65536, recall: float = 0.985, copies: int = 4, margin: float = 0.02,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id is divisible by `every` the k others of the largest inner product.

    Ranks are from 1, ties go to the smaller id; scores are inner products in double precision. Lists hold about `list_rows`
    vectors, or more where that would be over `most_lists` lists; they are fitted on at most `sample_rows` distinct vectors, and every
    vector is in one to `copies` of them. `recall` is aimed at, on the sample. Equal vectors are searched once, and a list
    with more than is scored at a time is dealt to several places, as are the queries of one that many ask.

    Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id and
    vectors of another length than most; rows that repeat id and vector count once, and no vector of a query's own id
    is found for it; with fewer candidates than k all that are found come; a table with none gives no row; other columns are
    ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("square")).collect()  # a row a length
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, total, square = max(((r["dim"], r["n"], r["square"]) for r in sizes), key=lambda r: (r[1], r[0]))
    keyed = rows.where(F.size("v") == dim).withColumn("h", F.xxhash64("v"))
    # a sample by hash holds each of equal vectors or none
    most = max(1, min(sample_rows, SAMPLE_NUMBERS // dim))
    share = min(1.0, 0.9 * most / total)
    drawn = keyed.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("h", "v").dropDuplicates(["h", "v"]).orderBy("h").limit(most).select("v")
    sample = _matrix(drawn.toArrow().column("v").combine_chunks(), dim)
    index = fit(sample, float(square) ** 0.5, int(min(most_lists, max(1, total // list_rows))), k, recall, copies, margin)
    _deal(index, total, total / every, sample)
    held = spark.sparkContext.broadcast(index)  # at most most_lists centroids
    # equal vectors: one row with the least ids that any query could ask for
    place = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("id"))
    groups = keyed.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    asking = keyed.where(F.col("id") % every == 0)
    queries = materialize(asking.select("h", "v").distinct().withColumn("g", F.monotonically_increasing_id()), "queries")
    posted_type = T.StructType([T.StructField("place", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("v", rows.schema["v"].dataType)])
    posted = map_arrow(groups.select("ids", "v"), _post(held, dim, copies, margin), posted_type)
    asked = map_arrow(queries.select("g", "v"), _ask(held, dim, 8 * (k + 1) / total), posted_type)
    met = posted.unionByName(asked).repartition("place").sortWithinPartitions("place", "kind")
    found = map_arrow(met, _score(dim, k + 1), "g long, found array<struct<less:double,id:long>>")
    best = found.groupBy("g").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    best = best.withColumn("found", F.slice(F.array_distinct(F.slice("found", 1, (k + 1) * copies)), 1, k + 1))  # a vector is in as many lists at most
    own = asking.join(queries, ["h", "v"]).select(F.col("id").alias("query_id"), "g").distinct()
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = own.join(best, "g").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (F.lit(0.0) - F.col("x.less")).alias("score"))


def _deal(index: Index, total: float, queries: float, sample: np.ndarray) -> None:
    """How many places the vectors and the queries of each list are dealt to, by what the sample lets expect."""
    some = sample[:: max(1, len(sample) // 1024)]
    _, where = index.probes(index.asked(some), 0.0)
    asked = np.bincount(where, minlength=len(index.centers)) / len(some) * queries
    index.parts = np.ceil(np.maximum(index.share * total, 1) / PART_ROWS).astype(np.int64)
    index.turns = np.ceil(np.maximum(asked, 1) / PART_QUERIES).astype(np.int64)
    index.first = np.cumsum(index.parts * index.turns) - index.parts * index.turns
