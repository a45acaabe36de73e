"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafwork.llm import hashing as H
from leafwork.llm.common import CHUNK_TEXT, RK, forget, keyed, map_arrow, materialize, raw, row_chunks
from leafwork.llm.fingerprint import shingle_hashes
from leafwork.llm.graph import Union, components

_U = np.uint64
WORDS, SIMILAR = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.9995
NODE = 512  # members of a trie node that are compared at once; more are dealt out in pairs of blocks
_rng = np.random.Generator(np.random.PCG64(99))
_MUL = _rng.integers(1, 2**62, TREES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)


def meeting(similar: float, depth: int) -> float:
    """Probability that two sets of that similarity share a prefix of `depth` values in some tree."""
    return 1 - (1 - similar**depth) ** TREES


def ladder(similar: float, recall: float) -> list[int]:
    """Prefix lengths: the whole depth, halved down to the longest at which two sets of just that similarity meet with that probability."""
    last = next((d for d in range(DEPTH, 1, -1) if meeting(similar, d) >= recall), 1)
    out = [DEPTH]
    while out[-1] > last:
        out.append(max(out[-1] // 2, last))
    return out


def missing(found: dict[int, int], depth: int) -> float:
    """Links that prefixes of `depth` values are expected to have missed, by those that were found, counted by similarity in hundredths (rounded down)."""
    return sum(n * (1 / meeting(s / 100, depth) - 1) for s, n in found.items())


def chance_floor(similar: float, n: int, sigmas: float = 5.0) -> int:
    """Agreements of n MinHashes that a pair of at least that similarity has, but for one case in millions."""
    return int(n * similar - sigmas * (n * similar * (1 - similar)) ** 0.5)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32-bit MinHashes, a row of TREES * DEPTH for each set."""
    n = len(first) - 1
    out = np.full((n, TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        at = first[some]
        for k in range(TREES * DEPTH):
            out[some, k] = np.minimum.reduceat(((hashes * _MUL[k] + _ADD[k]) >> _U(32)).astype(np.uint32), at)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, digest of the shingle set, signature); texts without words are left out."""
    for batch in batches:
        data, offs = raw(batch.column(1))
        for lo, hi in row_chunks(offs, CHUNK_TEXT):
            hashes, first = shingle_hashes(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], WORDS)
            sigs = signatures(hashes, first)
            some = np.flatnonzero(np.diff(first))
            sets = [hashlib.blake2b(np.unique(hashes[first[i] : first[i + 1]]).tobytes(), digest_size=16).digest() for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(sets, pa.binary()), pa.array([sigs[i].tobytes() for i in some.tolist()], pa.binary())], names=[RK, "digest", "sig"])


def prefixes(sigs: np.ndarray, depth: int) -> np.ndarray:
    """The node of each signature in each tree, as a hash of the tree and its first `depth` values: (n, TREES)."""
    parts = sigs.reshape(len(sigs), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
    node = np.broadcast_to(np.arange(TREES, dtype=_U), (len(sigs), TREES))
    for i in range(depth):
        node = H.mix(node * _U(H.BASE) + parts[:, :, i])
    return node


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), TREES * DEPTH)


def _plant(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(representative, signature) to a row for each tree: the node its prefix leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                nodes = prefixes(_matrix(batch.column(1).to_pylist()), depth)
                for t in range(TREES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), t, np.int32)), pa.array(nodes[:, t].view(np.int64)), batch.column(0)], names=["tree", "node", "rep"])

    return run


class Node:
    """Members of a trie node, or of two blocks of it, and which of their pairs are candidates here.

    A pair is a candidate where its signatures agree in `floor` places or more. It belongs to the longest prefix of the
    ladder at which it meets, and there to the first tree: so each pair is looked at once, whatever it shares.
    """

    def __init__(self, tree: int, blocks: np.ndarray, low: np.ndarray, now: np.ndarray, before: np.ndarray | None, apart: bool, floor: int) -> None:
        """low: the signatures' low bytes; now and before: their prefixes of this length and of the one before, if any; apart: the members are of two blocks, only pairs across count."""
        self.tree, self.blocks, self.low, self.now, self.before, self.floor = tree, blocks, low, now, before, floor
        self.left = blocks.min() if apart else None

    def partners(self, i: int) -> np.ndarray:
        """The candidates of member i; each pair is given by one of its members."""
        if self.left is None:
            others = np.arange(i + 1, len(self.low))
        elif self.blocks[i] != self.left:
            return np.zeros(0, np.int64)
        else:
            others = np.flatnonzero(self.blocks != self.left)
        t = self.tree
        others = others[self.now[others, t] == self.now[i, t]]
        others = others[~(self.now[others, :t] == self.now[i, :t]).any(1)]
        if self.before is not None and len(others):
            others = others[~(self.before[others] == self.before[i]).any(1)]
        return others[(self.low[others] == self.low[i]).sum(1) >= self.floor]


def _nodes(batches: Iterator[pa.RecordBatch], depth: int, before: int | None, floor: int) -> Iterator[tuple[pa.Table, list[tuple[int, int, Node]]]]:
    """Rows (tree, node, i, j, block, rep, sig ...) sorted by the first four, as tables of whole groups, and in each the groups of two rows or more."""
    rest = None

    def done(table: pa.Table, edges: np.ndarray) -> tuple[pa.Table, list[tuple[int, int, Node]]]:
        sigs = _matrix(table["sig"].to_pylist())
        now, old, low = prefixes(sigs, depth), prefixes(sigs, before) if before else None, sigs.astype(np.uint8)
        tree, i, j, blocks = (table[c].to_numpy() for c in ("tree", "i", "j", "block"))
        some = np.flatnonzero(np.diff(edges) > 1)
        return table, [(a, b, Node(int(tree[a]), blocks[a:b], low[a:b], now[a:b], None if old is None else old[a:b], i[a] != j[a], floor)) for a, b in zip(edges[some].tolist(), edges[some + 1].tolist(), strict=True)]

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        key = np.stack([table[c].to_numpy().astype(np.int64) for c in ("tree", "node", "i", "j")])
        edges = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1))
        rest = table.slice(int(edges[-1]))  # the last group may go on
        if edges[-1]:
            yield done(table.slice(0, int(edges[-1])), edges)
    if rest is not None:
        yield done(rest, np.array([0, len(rest)]))


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


FOUND = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])


def _active(depth: int, before: int | None, floor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (tree, node, i, j, block, rep, sig), sorted by the first four, those that have a candidate in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, nodes in _nodes(batches, depth, before, floor):
            alive = np.zeros(len(table), bool)
            for a, b, node in nodes:
                for i in range(b - a):
                    if len(found := node.partners(i)):
                        alive[a + i] = True
                        alive[a + found] = True
            if alive.any():
                yield from table.filter(pa.array(alive)).to_batches()

    return run


def count_links(sets: list[np.ndarray], partners: Callable[[int], np.ndarray], similar: float) -> tuple[list[int], list[tuple[int, int]], dict[int, int]]:
    """Exact Jaccard similarity of sorted sets of hashes with their partners: links of each set, pairs that join the linked, and the links by similarity in hundredths."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    links, union, out, levels = np.zeros(n, np.int64), Union(n), [], {}
    for i, own in enumerate(sets):
        others = partners(i)
        if not len(others):
            continue
        a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
        many = b - a
        at = np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        shared = np.bincount(owner[at], minlength=n)[others]
        either = sizes[i] + sizes[others] - shared
        ok = shared >= similar * either - 1e-9
        found = others[ok]
        links[i] += len(found)
        links[found] += 1
        for s, k in zip(*np.unique((shared[ok] * 100 // either[ok]), return_counts=True), strict=True):
            levels[int(s)] = levels.get(int(s), 0) + int(k)
        for j in found.tolist():
            if union.join(i, j):
                out.append((i, j))
    return links.tolist(), out, levels


def _verify(similar: float, depth: int, before: int | None, floor: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tree, node, i, j, block, rep, sig, text) sorted by the first four to FOUND: (rep, null, links), edges (rep, other, 0) that join the linked, and links by similarity (null, hundredths, links)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table, nodes in _nodes(batches, depth, before, floor):
            reps = table["rep"].to_pylist()
            data, offs = raw(table["text"])
            for a, b, node in nodes:
                hashes, first = shingle_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], WORDS)
                sets = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(b - a)]
                links, pairs, levels = count_links(sets, node.partners, similar)
                yield from ((r, None, n) for r, n in zip(reps[a:b], links, strict=True) if n)
                yield from ((reps[a + x], reps[a + y], 0) for x, y in pairs)
                yield from ((None, s, n) for s, n in levels.items())

    return lambda batches: _in_batches(rows(batches), FOUND)


def in_blocks(members: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Add i, j and block: a node of at most `size` members is one block (0, 0); more are dealt by a hash into blocks, and each row goes to all block pairs that hold its own. counts: (tree, node, n)."""
    joined = members.join(counts, ["tree", "node"]).withColumn("b", F.ceil(F.col("n") / size).cast("int"))
    joined = joined.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("b")).cast("int"))
    spread = joined.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return spread.withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("n", "b", "o")


def _pass(rows: DataFrame, single: DataFrame, similar: float, depth: int, before: int | None, floor: int) -> DataFrame:
    """Links of the pairs that meet at `depth` and did not at `before`, as _verify gives them; written."""
    key, parts = ["tree", "node", "i", "j"], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planted = map_arrow(single, _plant(depth), "tree int, node long, rep long")
    counts = materialize(planted.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1"), "node-sizes")
    nodes = in_blocks(planted, counts, NODE).join(single, "rep").select(*key, "block", "rep", "sig")
    dealt = nodes.repartition(parts, *key).sortWithinPartitions(*key)
    active = materialize(map_arrow(dealt, _active(depth, before, floor), "tree int, node long, i int, j int, block int, rep long, sig binary"), "candidates")
    texts = rows.select(F.col(RK).alias("rep"), "text").join(active, "rep").select(*key, "block", "rep", "sig", "text")
    dealt = texts.repartition(parts, *key).sortWithinPartitions(*key)
    found = materialize(map_arrow(dealt, _verify(similar, depth, before, floor), "rep long, other long, links long"), "links")
    forget(counts, active)
    return found


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """Link documents whose sets of five-word shingles have a Jaccard similarity of at least `similar`.

    Documents with equal sets are copies; the least stands for them. Sixteen prefix trees of eight MinHash values hold the
    representatives. Pairs that share a whole prefix in some tree, and whose signatures agree enough (five standard
    deviations under the threshold, so that this loses nothing), are verified exactly on whole texts by an inverted index
    over the members of the node. Then the prefix is halved and what newly meets is verified, until the
    similarities found say that at most 1 - `recall` of the links, and less than one, are still to be expected, or two
    sets at the very threshold meet with probability `recall`. A pair is counted at the first prefix and in the first tree
    where it meets; none is emitted but those that join a class. A node of many members is dealt into pairs of blocks.

    Returns id, class_id (least id linked to it, directly or through others; its own if none), copy_id (least id with an
    equal shingle set) and n_links (other shingle sets linked directly to this one; copies count once).

    Defined cases: a null text, or one without words, is in a class of its own without links; a text of one to four
    words is one shingle; a pair just at the threshold is linked; of tied representatives the least id stands; where rows
    repeat an id, or ids are null or no integers, class_id and copy_id are row numbers that the operator gives; a very
    long text is held whole, with about 40 bytes for each of its bytes, and beside it the texts of up to 2 x 512 members
    of its node that have candidates; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = keyed(docs, id_col, text_col)
    signed = materialize(map_arrow(rows.select(RK, "text"), _sign, f"{RK} long, digest binary, sig binary"), "signatures")
    copies = materialize(signed.groupBy("digest").agg(F.min(RK).alias("rep")), "copies")
    single = signed.join(copies, (signed["digest"] == copies["digest"]) & (signed[RK] == copies["rep"]), "left_semi").select(F.col(RK).alias("rep"), "sig")
    single = materialize(single, "representatives")
    floor, before, tables, levels = chance_floor(similar, TREES * DEPTH), None, [], {}
    for depth in ladder(similar, recall):
        tables.append(_pass(rows, single, similar, depth, before, floor))
        for r in tables[-1].where("rep IS NULL").groupBy("other").agg(F.sum("links").alias("n")).collect():  # a row for each hundredth
            levels[r["other"]] = levels.get(r["other"], 0) + r["n"]
        still, before = missing(levels, depth), depth
        if levels and still < 1 and still <= (1 - recall) * sum(levels.values()):
            break
    found = tables[0]
    for x in tables[1:]:
        found = found.union(x)
    classes = components(found.where("rep IS NOT NULL AND other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("n_links"))
    reps = copies.select("digest", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
    reps = materialize(reps.select("digest", "rep", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes")
    done = materialize(signed.select(RK, "digest").join(reps, "digest").select(RK, "rep", "root", "n_links"), "members")
    forget(signed, copies, single, reps, *tables)
    out = rows.select(RK, "id").join(done, RK, "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("root", RK).alias("class_id"), F.coalesce("rep", RK).alias("copy_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
