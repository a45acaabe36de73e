"""Cross-tokenizer alignment, periodic runs and nearest neighbours against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from leafwork.llm import align, neighbours, queries, runs
from leafwork.llm.token_files import tokenizer_path

SF = "/root/testdata/sf0.001"
sha = lambda x: hashlib.sha256(x).hexdigest()
CLASH = "doc_id long, text string, id string, block string, n_runs string, pairs int, start binary, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "i", "b", "n", 1, b"s", "v") for i, t in rows], CLASH).repartition(3)


# ---- alignment
AWKWARD = [
    None, "", " ", "  ", "\n", "a" * 900, " a  b ", "▁x", "x ▁y z", "é à ü　 x  y", "<|endoftext|> <s> </s>", " x", "\x00", "日本語 テキスト 。 はい", "привет мир  ok", "😀 😀😀 a", "\x1c a\x1f b", "=" * 700,
    "the same words", "the same words", "other words and the same",
]


def aligned_by_hand(texts):
    """The contract, token by token."""
    from tokenizers import Tokenizer

    work = align.aligner(tokenizer_path(), align.piece_path())
    plain = Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    found, held = [], Counter()
    for t in texts:
        a, b = (plain.encode(" " + t, add_special_tokens=False).ids, work.b.encode(t)) if t else ([], [])
        parts = [[table[i] for i in ids] for ids, (table, _, _) in zip((a, b), work.tables)]
        if not t or any(b"".join(x) != (" " + t).encode() for x in parts):
            found.append((0, 0, 0, 0, "", Counter()))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in parts]
        groups, links, i, j = [], Counter(), 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            links.update((x, y) for x in a[i:p] for y in b[j:q])
            i, j = p, q
        held.update(links.keys())
        found.append((len(a), len(b), len(groups), sum(links.values()), sha(";".join(groups).encode()), links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return [(na, nb, g, n, sum(m for p, m in links.items() if held[p] == most[p[0]]), sum(m * held[p] for p, m in links.items()), h) for na, nb, g, n, h, links in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block", [5, align.BLOCK])
def test_alignment(spark, monkeypatch, block):
    rng = random.Random(5)
    made = ["".join(rng.choice(" \n\t ab▁é 日 😀　.'s1") if rng.random() < 0.9 else chr(rng.randrange(1, 0xD800)) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts = AWKWARD + made
    monkeypatch.setattr(align, "BLOCK", block)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align_tokenizers(table(spark, enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == aligned_by_hand(texts)


def test_alignment_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_cross_tokenizer_alignment(spark, SF).collect()}
    assert [got[r["doc_id"]] for r in rows] == aligned_by_hand([r["text"] for r in rows])


def test_alignment_ids_and_empty(spark):
    rows = [(None, "x y"), (1, "x y"), (1, "x y"), (1, "z"), (None, None)]
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in align.align_tokenizers(table(spark, rows)).collect()), key=repr)
    assert got == sorted(((i, *w) for (i, _), w in zip(rows, aligned_by_hand([t for _, t in rows]))), key=repr)
    assert align.align_tokenizers(table(spark, rows).limit(0)).count() == 0


def test_large_groups_are_reduced(monkeypatch):
    """Groups beyond the bound give the same pairs without being written out."""
    work = align.aligner(tokenizer_path(), align.piece_path())
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 300)
    size_a, size_b = np.array([100, 0, 300]) + [0, 1, -1], np.array([50, 1, 249])
    args = a, b, np.cumsum(size_a) - size_a, size_a, np.cumsum(size_b) - size_b, size_b, np.array([0, 0, 1])
    want = Counter()
    for pair, times, whose in zip(*work._pairs(*args)):
        want[pair, whose] += times
    monkeypatch.setattr(align, "EXPANDED", 10)
    got = Counter()
    for pair, times, whose in zip(*work._pairs(*args)):
        got[pair, whose] += times
    assert got == want and sum(want.values()) == int((size_a * size_b).sum())


def test_union_find_and_packing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = int(rng.integers(1, 200)), int(rng.integers(0, 200))
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        want = np.arange(n)
        for _ in range(n):
            np.minimum.at(want, u, want[v])
            np.minimum.at(want, v, want[u])
        assert align.union_find(n, u, v).tolist() == want.tolist()
    chain = np.arange(100_000)
    assert not align.union_find(100_001, chain, chain + 1).any()
    x = rng.integers(0, 1 << 34, 1000) >> rng.integers(0, 34, 1000)
    assert align.unpack(align.pack(x)).tolist() == x.tolist() and not len(align.unpack(align.pack(x[:0])))


# ---- runs
def runs_by_hand(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i = max(i, s + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def run_row(i, text, planted):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode())
    if planted and i is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = runs_by_hand(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(kept)


RUN = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_random_words():
    rng = random.Random(1)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(0, 6)):
            n = rng.choice([0, 1, 5, 6, 7, 30, 100])
            w = [rng.randint(0, rng.choice([0, 1, 1, 2, 5])) for _ in range(n)]
            if n > 20 and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 9)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            docs.append(w)
        got = runs.find_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs], np.int64))
        assert got.tolist() == [[k, *r] for k, d in enumerate(docs) for r in runs_by_hand(d)]


@pytest.mark.parametrize("chunk", [100, runs.CHUNK])
def test_periodic_runs(spark, monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK", chunk)
    long = " ".join(f"w{k % 70}" for k in range(3_000))
    texts = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "x " + "a b c " * 5 + "a y", "a a a a a a b b b b b b", long, "é é " * 9, "a\x1cb " * 7, "A a " * 8]
    rows = [*((i, t) for i, t in enumerate(texts)), (None, "q " * 9), (3, "q " * 9), (3, "q " * 9)]
    for planted in (False, True):
        found = runs.periodic_runs(table(spark, rows), planted=planted)
        assert sorted((tuple(r[c] for c in RUN) for r in found.collect()), key=repr) == sorted((run_row(i, t, planted) for i, t in rows), key=repr)
    kept = {r["doc_id"]: r["collapsed"] for r in runs.periodic_runs(table(spark, rows[:14])).collect()}
    assert kept[7] == "a b" and kept[8] == "x a b c y" and kept[9] == "a b" and kept[0] == ""
    assert runs.periodic_runs(table(spark, rows).limit(0)).count() == 0


def test_runs_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[c] for c in RUN) for r in queries.op12_periodic_runs(spark, SF).collect()}
    short = [r for r in rows if len(r["text"] or "") < 6000]
    assert len(got) == len(rows) and len(short) > 100
    assert [got[r["doc_id"]] for r in short] == [run_row(r["doc_id"], r["text"], True) for r in short]


# ---- neighbours
def near_by_hand(rows, every, k):
    out = []
    for qid, q in sorted({(i, tuple(v)) for i, v in rows if i % every == 0}):
        best = sorted({(-float((np.array(q) * np.array(v)).sum()), i) for i, v in rows if i != qid})[:k]
        out += [(qid, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def neighbours_of(df, **given):
    return sorted(tuple(r) for r in neighbours.nearest_neighbours(df, **given).collect())


def test_neighbours_of_awkward_vectors(spark):
    """One list: exact, with ties, copies, and what takes no part."""
    rng = np.random.default_rng(3)
    good = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(40)]
    good = [(i, v if any(v) else [1.0] * 4) for i, v in good]
    good += [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(100, 160)]  # copies, more than are asked for
    bad = [(200, None), (220, [0.0] * 4), (240, [1.0, None, 0.0, 0.0]), (260, [float("nan"), 1.0, 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0, 1.0]), (300, [1.0]), (320, []), (None, [1.0] * 4)]
    schema = "vec_id long, embedding array<double>, id string, v int, g int"
    make = lambda rows: spark.createDataFrame([(*r, "i", 1, 2) for r in rows], schema).repartition(3)
    want = sorted(near_by_hand(good, 20, 20))
    got = neighbours_of(make(good + bad + good[:5]))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)
    assert [r[:3] for r in neighbours_of(make([(0, [1.0, 2.0]), (1, [3.0, 1.0])]))] == [(0, 1, 1)]
    assert neighbours_of(make(bad)) == [] and neighbours_of(make(bad[:1]).limit(0)) == []


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_in_many_lists(spark, monkeypatch, scale):
    """Clusters, a crowd of near copies and equal vectors, norms that differ: recall against brute force; lists dealt to several places."""
    monkeypatch.setattr(neighbours, "PART_ROWS", 20)
    monkeypatch.setattr(neighbours, "PART_QUERIES", 5)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, 16))
    x = np.concatenate([centers[rng.integers(0, 30, 2000)] + 0.3 * rng.normal(size=(2000, 16)), centers[0] + 0.01 * rng.normal(size=(600, 16)), np.repeat(centers[:1], 400, 0)])
    if scale:
        x *= rng.uniform(0.5, 2, size=(len(x), 1))
    rows = [(int(i), v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours_of(df, list_rows=60)
    m, found = np.array([v for _, v in rows]), defaultdict(list)
    for q, rank, i, score in got:
        found[q].append(i)
        assert rank == len(found[q]) and abs(score - (m[q] * m[i]).sum()) < 1e-9 and i != q
    share = []
    for q in range(0, len(m), 20):
        s = m @ m[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(m)), -np.round(s, 9)))[:20]
        share.append(len(set(best.tolist()) & set(found[q])) / 20)
        assert len(found[q]) == 20
    assert np.mean(share) >= 0.95


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(6)
    index = neighbours.Index.over(rng.normal(size=(500, 12)), 1.0)
    x = rng.normal(size=(300, 12))
    ids, dist = index.search(x, 32)
    exact = ((x[:, None] - index.centers) ** 2).sum(2)
    assert (ids[:, 0] == exact.argmin(1)).mean() > 0.97 and np.allclose(np.take_along_axis(exact, ids, 1), dist)
    assert all(len(set(r)) == 32 for r in ids.tolist())


def test_lists_are_balanced():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(500, 8)), 5 + 0.001 * rng.normal(size=(1500, 8)), np.zeros((300, 8))])
    lists = neighbours.balanced_lists(x, 50, rng)
    assert sorted(np.concatenate(lists).tolist()) == list(range(len(x))) and max(map(len, lists)) <= 50 and len(lists) < 120


def test_neighbour_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = defaultdict(set)
    for r in queries.op13_nearest_neighbours(spark, SF).collect():
        found[r["query_id"]].add(r["vec_id"])
    share = []
    for at in np.flatnonzero(ids % 20 == 0):
        s = m @ m[at]
        s[at] = -np.inf
        share.append(len({int(i) for i in ids[np.lexsort((ids, -s))[:20]]} & found[int(ids[at])]) / 20)
    assert len(found) == len(share) and np.mean(share) >= 0.9


