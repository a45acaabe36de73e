"""Each operator against a brute-force restatement, on hand-made cases and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from leafwork.llm import decontaminate, elias_fano, fingerprint, hashing, jaccard, langid, lines, packing, prefix_free, queries, substring, superwindow, token_files, warc
from leafwork.llm.common import cover
from leafwork.llm.graph import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_removed int, id string, kept string, start string, digest binary"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def awkward():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long = prose(80), prose(30_000)
    near = shared.split()
    near[10] = "changed"
    line = "This is a Line that very many documents do share"
    texts = [None, "", " ", "\n", "x", "12 34", shared, shared, " ".join(near), prose(20) + "\n" + shared + "\t" + prose(20), "=" * 700, "ab" * 300, long, long[:50_000] + " end", "é" * 250, prose(3), prose(200)]
    texts += [f"{prose(5)}\n  {line.upper() if i % 2 else line} \n{line}\n{i}" for i in range(6)] + [line + "\n" + line, "a\r\nb\x0bc\x1cd", "\x00\x00" * 150]
    return texts


@pytest.fixture(scope="module")
def cases(spark):
    texts = awkward()
    return spark.createDataFrame([(i * 3, t, 1, "i", "k", "s", b"d") for i, t in enumerate(texts)], SCHEMA).repartition(3), {i * 3: t for i, t in enumerate(texts)}


@pytest.fixture(scope="module")
def odd(spark):
    """Ids that are null or repeat, and whole rows that repeat."""
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (1, "other"), (2, None)]
    return spark.createDataFrame([(i, t, 1, "i", "k", "s", b"d") for i, t in rows], SCHEMA)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def removed(parts, size, join):
    """Brute force: units that a repeated window covers."""
    seen = Counter(join(u[a : a + size]) for u in parts.values() for a in range(len(u) - size + 1))
    out = {}
    for k, u in parts.items():
        gone = bytearray(len(u))
        for a in range(len(u) - size + 1):
            if seen[join(u[a : a + size])] > 1:
                gone[a : a + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(u), sum(gone), spans, sha(join([x for x, g in zip(u, gone) if not g])))
    return out


def by_id(df, *cols):
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.mark.parametrize("size", [200, 40])
def test_suffix_array_dedup(cases, size):
    docs, texts = cases
    small = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 60_000)
    want = removed({k: list((t or "").encode()) for k, t in texts.items() if len(t or "") < 60_000}, size, bytes)
    assert by_id(substring.suffix_array_dedup(small, size=size), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


@pytest.mark.parametrize("size", [35, 3])
def test_substring_dedup(cases, size):
    docs, texts = cases
    want = removed({k: WORD.findall((t or "").encode()) for k, t in texts.items()}, size, b" ".join)
    assert by_id(substring.substring_dedup(docs, size=size), "n_words", "n_removed", "n_spans", "kept_sha256") == want


def test_long_documents_meet(cases):
    docs, texts = cases
    got = by_id(substring.suffix_array_dedup(docs), "n_bytes", "n_removed")
    assert got[36][1] > 50_000 and got[39][1] >= 50_000


def test_prefix_free_order_is_suffix_order():
    rng = random.Random(1)
    for alphabet, n in ((b"ab", 3000), (b"\x00a", 1500), (bytes(range(97, 123)), 4000), (b"a", 500)):
        text = bytes(rng.choice(alphabet) for _ in range(n))
        text = text + text[: n // 2] + text
        at = np.arange(len(text) - 60)
        keys = prefix_free.suffix_keys(np.frombuffer(text, np.uint8), at, 60)
        order = at[np.argsort(keys, kind="stable")].tolist()
        heads = [text[i : i + 60] for i in order]
        assert heads == sorted(heads)


def drive(kind, repeats, texts, tasks, buckets):
    """Both sides of the shuffle without Spark, level by level: spans of each text, and how many levels were needed."""
    rows, step = [], -(-len(texts) // tasks)
    for a in range(0, len(texts), step):
        b = pa.RecordBatch.from_arrays([pa.array(range(a, min(a + step, len(texts))), pa.int64()), pa.array(texts[a : a + step], pa.binary())], names=["rk", "text"])
        rows += [r for out in superwindow.pack(kind, buckets)(iter([b])) for r in out.to_pylist()]
    found, levels = defaultdict(list), 0
    while rows:
        rows.sort(key=lambda r: r["bucket"])
        parts = [pa.RecordBatch.from_pylist(rows[k : k + 50], schema=superwindow.PACKED) for k in range(0, len(rows), 50)]
        out = [r for x in superwindow.settle(kind, repeats)(iter(parts)) for r in x.to_pylist()]
        for r in out:
            if r["settled"]:
                found[r["__rk"]].append(r["data"])
        rows, kind, levels = [r for r in out if not r["settled"]], kind.next(), levels + 1
    return {k: np.frombuffer(b"".join(v), np.int64).reshape(-1, 2) for k, v in found.items()}, levels


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize(("held", "levels"), [(1 << 25, 1), (600, 3), (60, 3)])
def test_buckets_reduce_and_are_cut_exactly(monkeypatch, words, held, levels):
    """A string in every text, in ever new surroundings; many flushes, buckets that hold far more than they may."""
    for name, value in (("HELD", held), ("FLUSH", 500), ("CHUNK", 300), ("COMPARED", 100), ("FAN", 4)):
        monkeypatch.setattr(superwindow, name, value)
    rng = random.Random(held)
    kind = superwindow.Kind(6, 2, True) if words else superwindow.Kind(12, 3, False)
    some = (lambda n: "".join(rng.choice(["a ", "b ", "cc ", "d "]) for _ in range(n))) if words else (lambda n: "".join(rng.choice("abcd") for _ in range(n)))
    common = "a a b cc d a b b cc a " if words else "abcabcabcdddaabbccdd"
    texts = [(some(rng.randint(0, 80)) + common + some(rng.randint(0, 60))).encode() for _ in range(60)] + [b"", None, b"a" * 80, b"a " * 12]
    repeats = partial(substring.repeated_word_windows, size=6) if words else partial(prefix_free.repeated_windows, size=12)
    got, used = drive(kind, repeats, texts, 5, 7)
    assert used == levels
    units = [(t or b"").split() if words else list(t or b"") for t in texts]
    seen = Counter(tuple(u[i : i + kind.size]) for u in units for i in range(len(u) - kind.size + 1))
    for k, u in enumerate(units):
        want = np.zeros(len(u), bool)
        for i in range(len(u) - kind.size + 1):
            if seen[tuple(u[i : i + kind.size])] > 1:
                want[i : i + kind.size] = True
        assert (cover(len(u), got.get(k, np.zeros((0, 2), np.int64))) == want).all()


@pytest.mark.parametrize("words", [False, True])
@pytest.mark.parametrize("group", [40, 400])
def test_groups_of_a_minimiser_are_cut_exactly(monkeypatch, words, group):
    """Buckets that hold what they may, of which some minimisers' strings are too many to be compared together."""
    for name, value in (("FLUSH", 500), ("CHUNK", 300), ("GROUP", group), ("FAN", 4)):
        monkeypatch.setattr(superwindow, name, value)
    rng = random.Random(group)
    kind = superwindow.Kind(6, 2, True) if words else superwindow.Kind(12, 3, False)
    some = (lambda n: "".join(rng.choice(["a ", "b ", "cc ", "d "]) for _ in range(n))) if words else (lambda n: "".join(rng.choice("abcd") for _ in range(n)))
    common = "a a b cc d a b b cc a " if words else "abcabcabcdddaabbccdd"
    texts = [(some(rng.randint(0, 80)) + common + some(rng.randint(0, 60))).encode() for _ in range(60)] + [b"", None, b"a" * 80, b"a " * 12]
    repeats = partial(substring.repeated_word_windows, size=6) if words else partial(prefix_free.repeated_windows, size=12)
    got, used = drive(kind, repeats, texts, 5, 7)
    assert used > 1
    units = [(t or b"").split() if words else list(t or b"") for t in texts]
    seen = Counter(tuple(u[i : i + kind.size]) for u in units for i in range(len(u) - kind.size + 1))
    for k, u in enumerate(units):
        want = np.zeros(len(u), bool)
        for i in range(len(u) - kind.size + 1):
            if seen[tuple(u[i : i + kind.size])] > 1:
                want[i : i + kind.size] = True
        assert (cover(len(u), got.get(k, np.zeros((0, 2), np.int64))) == want).all()


def grown_by_a_minimiser(megabytes):
    """MB by which a process grows that settles so many of strings around one passage, half of them repeating in part; in a process of its own."""
    import resource

    rng = np.random.default_rng(1)
    n = megabytes * 2500
    passage = bytes(range(65, 89))
    kind = superwindow.Kind(200, 24, False)
    sides = rng.integers(97, 123, (n, 2, 190), np.uint8)
    sides[1::2] = sides[::2]
    sides[1::2, 1, 180:] = 48
    strings = [a.tobytes() + passage + b.tobytes() for a, b in sides]
    size = np.full(n, len(strings[0]))
    table = {"val": np.zeros(n, np.uint32), "first": np.zeros(n, np.int64), "wins": size - 199, "rk": np.arange(n), "flag": np.zeros(n, np.uint8), "len": size}
    data = [superwindow.blob(zstandard.ZstdCompressor(level=1), {k: v[a : a + 1000] for k, v in table.items()}, strings[a : a + 1000]) for a in range(0, n, 1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(data), pa.int64()), pa.array([0] * len(data), pa.int64()), pa.array(data, pa.binary()), pa.array([False] * len(data))], schema=superwindow.PACKED)
    del strings, sides, data
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    deeper = sum(not r for out in superwindow.settle(kind, partial(prefix_free.repeated_windows, size=200))(iter([batch])) for r in out.column(3).to_pylist())
    return (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, deeper


def test_memory_of_one_minimiser_is_bounded():
    import multiprocessing

    with multiprocessing.get_context("spawn").Pool(1) as pool:
        grown, deeper = pool.apply(grown_by_a_minimiser, (24,))
    assert deeper > 0 and grown < 700


def test_hot_string_takes_the_room_of_one(monkeypatch):
    """However many tasks send it, a bucket keeps one copy and never goes deeper for it."""
    monkeypatch.setattr(superwindow, "HELD", 4000)
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400)).encode()
    got, used = drive(superwindow.Kind(200, 24, False), partial(prefix_free.repeated_windows, size=200), [passage] * 300, 300, 1)
    assert used == 1 and all(cover(400, got[k]).all() for k in range(300))


def test_hot_string_travels_once_a_task(monkeypatch):
    """Over many flushes; and again where the task's memory is full, with the same result."""
    monkeypatch.setattr(superwindow, "FLUSH", 2000)
    monkeypatch.setattr(superwindow, "CHUNK", 500)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh") for _ in range(400)).encode()
    kind, repeats = superwindow.Kind(200, 24, False), partial(prefix_free.repeated_windows, size=200)
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array([passage] * 100, pa.binary())], names=["rk", "text"])
    copies = []
    for known in (1 << 20, 0):
        monkeypatch.setattr(superwindow, "KNOWN", known)
        sent = [r["data"] for out in superwindow.pack(kind, 1)(iter([batch])) for r in out.to_pylist() if not r["settled"]]
        copies.append(Counter(x for data in sent for x in superwindow.unpacked([data])[1]))
        got, _ = drive(kind, repeats, [passage] * 100, 1, 1)
        assert all(cover(400, got[k]).all() for k in range(100))
    assert set(copies[0]) == set(copies[1]) and set(copies[0].values()) == {1} and min(copies[1].values()) >= 10


@pytest.mark.parametrize("held", [20_000, 2000])
def test_dedup_with_small_buckets(spark, monkeypatch, held):
    """The operators over the smallest table, buckets cut: levels are separate jobs."""
    monkeypatch.setattr(superwindow, "BUCKET_BYTES", 1 << 16)
    monkeypatch.setattr(superwindow, "settle", partial(superwindow.settle, most=held))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = removed({k: WORD.findall((t or "").encode()) for k, t in docs.items()}, 35, b" ".join)
    assert by_id(substring.substring_dedup(spark.read.parquet(f"{SF}/documents.parquet")), "n_words", "n_removed", "n_spans", "kept_sha256") == want


def test_line_dedup(cases):
    docs, texts = cases
    keys = defaultdict(set)
    low = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for k, t in texts.items():
        for x in (t or "").split("\n"):
            if len(low(x)) >= 40:
                keys[low(x)].add(k)
    want = {}
    for k, t in texts.items():
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(keys.get(low(x), ())) < 5 or k == max(keys[low(x)])]
        want[k] = (len(all_), len(all_) - len(kept), sha("\n".join(kept).encode()))
    assert sum(w[1] for w in want.values()) == 13 - 1
    assert by_id(lines.line_dedup(docs), "n_lines", "n_dropped", "kept_sha256") == want


def jaccard_classes(texts):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").encode())
        if w:
            sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    reps = {}
    for k in sorted(sets):
        reps.setdefault(sets[k], k)
    root = {k: k for k in reps.values()}
    find = lambda x: x if root[x] == x else find(root[x])
    links = Counter()
    items = [(k, s) for s, k in reps.items()]
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (find(reps[sets[k]]), reps[sets[k]], links[reps[sets[k]]]) if k in sets else (k, k, 0) for k in texts}


@pytest.mark.parametrize("node", [2048, 4])
def test_jaccard_join(spark, cases, monkeypatch, node):
    monkeypatch.setattr(jaccard, "NODE", node)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
    texts = dict(cases[1])
    for i in range(30):  # near copies of one text, each with some words changed
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(300)] = f"y{rng.random()}"
        texts[1000 + i] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(jaccard.ngram_jaccard_join(docs), "class_id", "copy_id", "n_links")
    assert got == jaccard_classes(texts)
    assert len({c for k, (c, _, _) in got.items() if k >= 1000}) < 30


def test_forest_shortens_as_far_as_needed():
    assert jaccard.ladder(0.8, 0.9995) == [8, 4] and jaccard.ladder(0.99, 0.9) == [8]
    assert jaccard.meeting(0.8, 4) >= 0.9995 > jaccard.meeting(0.8, 5)
    assert jaccard.missing({97: 100}, 8) < 0.01 and jaccard.missing({80: 100}, 8) > 5 and jaccard.missing({}, 8) == 0


def test_forest_recall(spark, monkeypatch):
    """Pairs of measured similarity just above the threshold, each in words of its own: links found of links there are, and no others."""
    rng = random.Random(8)
    texts, near = {}, 0
    while near < 400:
        words = [f"{near}_{rng.randrange(10**6)}" for _ in range(250)]
        other = list(words)
        for k in rng.sample(range(250), rng.choice([5, 5, 6])):
            other[k] = f"{near}_x{k}"
        a, b = (frozenset(tuple(w[i : i + 5]) for i in range(246)) for w in (words, other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            texts[2 * near], texts[2 * near + 1] = " ".join(words), " ".join(other)
            near += 1
    passes = []
    real = jaccard._pass
    monkeypatch.setattr(jaccard, "_pass", lambda *a: passes.append(a[3]) or real(*a))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = by_id(jaccard.ngram_jaccard_join(docs), "class_id", "n_links")
    found = sum(got[2 * k + 1] == (2 * k, 1) for k in range(near))
    assert found >= 0.995 * near and all(n <= 1 for _, n in got.values())
    assert passes == [8, 4]
    passes.clear()  # where all that is found is far above the threshold, the whole prefix is enough
    docs = spark.createDataFrame([(k, texts[k // 2 * 2] + (" end" if k % 2 else "")) for k in texts], "doc_id long, text string")
    assert sum(n for _, n in by_id(jaccard.ngram_jaccard_join(docs), "class_id", "n_links").values()) == 2 * near
    assert passes == [8]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for k in near:
        todo, seen = [k], {k}
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got.get(k, k) == min(seen)


def check_sequences(rows, texts, sizes=packing.SIZES):
    """Each sequence is the tokens of its pieces, each document is in sequences whole and once, capacities are the least."""
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(token_files.tokenizer_path())
    parts = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2").tolist()
        assert r["used"] == len(ids) == sum(r["lengths"]) and r["capacity"] == packing.fits(sizes, r["used"])
        at = 0
        for k, start, n in zip(r["doc_ids"], r["starts"], r["lengths"], strict=True):
            parts[k].append((start, ids[at : at + n]))
            at += n
    assert set(parts) == set(texts)
    for k, t in texts.items():
        held = sorted(parts[k])
        assert [a for a, _ in held] == [i * sizes[-1] for i in range(len(held))]
        assert [x for _, ids in held for x in ids] == [*tool.encode(t or "", add_special_tokens=False).ids, 0]


def test_packing(cases):
    docs, texts = cases
    check_sequences(packing.best_fit_packing(docs, shard=10).collect(), texts)
    few = packing.best_fit_packing(docs, sizes=(64, 256)).collect()
    check_sequences(few, texts, (64, 256))
    lengths = defaultdict(list)  # each shard is packed as pack_lengths says
    for r in few:
        lengths[r["shard"]] += r["lengths"]
    for shard, sizes in lengths.items():
        want = packing.pack_lengths(sorted(sizes, reverse=True), (64, 256))[1]
        assert sum(want) == sum(r["capacity"] for r in few if r["shard"] == shard)


def test_best_fit_is_best_fit():
    """Against a plain search over all bins."""
    rng = random.Random(4)
    for _ in range(30):
        sizes = sorted(rng.sample(range(5, 60), 3))
        lengths = sorted((rng.randint(1, sizes[-1]) for _ in range(60)), reverse=True)
        where, used = packing.best_fit(lengths, sizes, 3, sizes[-1])
        room, at, rest = [], [], sum(lengths)
        for n, w in zip(lengths, where, strict=True):
            free = [c - u for c, u in zip(room, at, strict=True)]
            ok = [f for f in free if f >= n]
            if ok:
                assert w < len(room) and free[w] == min(ok)
            else:
                assert w == len(room)
                room.append(min((s for s in sizes if s >= n), key=lambda s: ((s + 3) / min(s, rest), s)))
                at.append(0)
            at[w] += n
            rest -= n
        assert used == at
        bins, final = packing.pack_lengths(lengths, sizes, 3)
        assert sum(final) + 3 * len(final) <= sum(packing.fits(sizes, u) + 3 for u in used)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_id(docs)
    both = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(both) == docs.count()
    for r in both:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in both if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.95


def test_language_gradient():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in langid.start(3).items()}
    x, y = rng.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1])
    _, g = langid.gradients(p, x, y)
    for k in ("Uf", "Ub", "cf", "Ob", "o", "Wb"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        ends = []
        for step in (1e-4, -1e-4):
            q = {n: v.copy() for n, v in p.items()}
            q[k][i] += step
            ends.append(langid.gradients(q, x, y)[0])
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(float(g[k][i]), rel=0.02, abs=1e-4)


def test_language_inference_equals_training_pass():
    model = langid.Model(["a", "b"], langid.start(2))
    text = np.frombuffer(b"some bytes, more than a window holds, and a shorter rest of them at the end...", np.uint8)
    got = langid.probabilities(model, text, np.array([0, 0, len(text)]))
    want = np.zeros(2)
    for k in range(0, len(text), langid.STEPS):
        x = text[k : k + langid.STEPS, None]
        f, b = langid.forward(model.params, "f", x)[0], langid.forward(model.params, "b", x[::-1])[0]
        for t in range(len(x)):
            z = (model.params["Of"] @ f[t] + model.params["Ob"] @ b[len(x) - 1 - t] + model.params["o"])[:, 0]
            want += np.exp(z) / np.exp(z).sum()
    assert got[0].tolist() == [0, 0]
    assert got[1] == pytest.approx(want / len(text), abs=1e-4)


def test_language_of_textless(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "", None), (4, "words", "en")], "doc_id long, text string, lang string")
    got = by_id(langid.language_id(docs), "lang_pred", "score")
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4] == ("en", 1.0)
    assert {r[0] for r in by_id(langid.language_id(docs.withColumn("lang", F.lit(None).cast("string"))), "lang_pred").values()} == {"und"}


def test_language_query_restated(spark):
    """Every prediction of the query again, by the training pass over the windows of the whole text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    got = by_id(queries.op6_language_id(spark, SF), "lang_pred", "score")
    for r in docs.collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        whole = raw[: len(raw) // langid.STEPS * langid.STEPS].reshape(-1, langid.STEPS).T
        total = np.zeros(len(model.labels))
        for x in (whole, raw[whole.size :, None]):
            if x.size:
                f, b = langid.forward(model.params, "f", x)[0], langid.forward(model.params, "b", x[::-1])[0]
                for t in range(len(x)):
                    z = np.exp(model.params["Of"] @ f[t] + model.params["Ob"] @ b[len(x) - 1 - t] + model.params["o"])
                    total += (z / z.sum(0)).sum(1)
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]] == ("und", 0.0)
        else:
            assert got[r["doc_id"]][1] == pytest.approx(total.max() / len(raw), abs=1e-3)
            assert got[r["doc_id"]][0] == model.labels[total.argmax()] or np.ptp(np.sort(total)[-2:]) < 1e-3 * len(raw)


def test_language_sample_sees_whole_texts(spark, monkeypatch):
    text = bytes(range(256)) * 400
    thin = langid.spread(text, 64)
    assert len(thin) == 64 * langid.STEPS and thin.startswith(text[: langid.STEPS]) and thin.endswith(text[-langid.STEPS :])
    assert langid.spread(b"short", 64) == b"short" and langid.spread(text[:4096], 64) == text[:4096]
    seen = []
    monkeypatch.setattr(langid, "train", lambda texts, langs, seed: seen.append(sorted(texts)))
    rows = [(i, "words here " + str(i) if i % 50 == 0 else "12 34", "en") for i in range(2000)]  # most labelled texts have no letters
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.fit(docs, sample_docs=20)
    langid.fit(docs, sample_docs=10_000)
    assert len(seen[0]) == 20 and set(seen[0]) < set(seen[1]) and len(seen[1]) == sum(i % 50 == 0 and zlib.crc32(str(i).encode()) % 4 != 2 for i in range(2000))


def shingles(t):
    w = WORD.findall(t.encode())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(cases):
    docs, texts = cases
    got = by_id(fingerprint.fingerprint_documents(docs, ranges=7), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    ids = sorted(texts, reverse=True)
    likeness = lambda x, y: 1.0 if x == y else len(x & y) / len(x | y)
    for k, after in zip(ids, ids[1:] + ids[:1], strict=True):
        t, u = texts[k] or "", texts[after] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert got[k][:2] == (len(t), sha(edited.encode()))
        assert got[k][2:4] == tuple(x.hex() for x in fingerprint.fingerprint_rows([t.encode(), edited.encode()]))
        assert got[k][4] == pytest.approx(likeness(shingles(t), shingles(edited)), abs=0.15)
        assert got[k][5] == pytest.approx(likeness(shingles(t), shingles(u)), abs=0.15)
    assert got[18][2] == got[21][2]


def successors(spark, texts, **given):
    """Of each row its edited text's digest, by (id, text)."""
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.fingerprint_documents(docs, **given).collect())


def edited_by_hand(rows):
    out = Counter()
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        out[i, len(t), sha((t[: len(t) - half] + u[:half]).encode())] += 1
    return out


@pytest.mark.parametrize("ranges", [1, 6, 40])
def test_fingerprint_order_with_repeated_and_null_ids(spark, ranges):
    """The contract's order whatever else the table holds: an id that repeats, here with equal texts, or is null changes no other row's successor but its neighbour's."""
    rows = [(i, f"{i} " + "word " * (i % 7 + 2)) for i in range(40, 0, -1)]
    assert successors(spark, rows, ranges=ranges) == edited_by_hand(rows)
    twice = [r for r in rows for _ in range(2 if r[0] == 17 else 1)]
    assert successors(spark, twice, ranges=ranges) == edited_by_hand(twice)
    null = [*rows, (None, "no id at all")]
    assert successors(spark, null, ranges=ranges) == edited_by_hand(null)
    many = [r for r in rows for _ in range(60 if r[0] == 17 else 1)] + [(None, "none here")] * 50
    assert successors(spark, many, ranges=ranges) == edited_by_hand(many)


def test_rows_of_an_id_are_cut():
    bounds = np.array([(3, 10), (3, 20), (3, 1 << 62), (5, 1 << 62)], np.int64)
    got = fingerprint._part(bounds, np.array([1, 3, 3, 3, 3, 4, 5, 9]), np.array([99, 5, 10, 11, 21, 0, 0, 0]))
    assert got.tolist() == [0, 0, 0, 1, 2, 3, 3, 4]


M = (1 << 64) - 1


def mixed(h):
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * times & M
    return h ^ (h >> 31)


def one_permutation(text):
    """A fingerprint by loops over Python's integers: one hash a shingle, a bin by its high bits, the least in each, loans for empty bins, low bits."""
    poly = lambda codes: sum(c * pow(hashing.BASE, k, 1 << 64) for k, c in enumerate(codes)) & M
    words = [mixed((poly([int(hashing.BYTE_CODE[b]) for b in w]) + len(w)) & M) for w in WORD.findall(text.encode())]
    if not words:
        return ""
    least = {}
    for i in range(max(1, len(words) - 4)):
        h = mixed(poly(words[i : i + 5]))
        least[h >> 56] = min(least.get(h >> 56, M), h & ((1 << 56) - 1))
    out = []
    for b in range(256):
        lender, attempt = b, 0
        while lender not in least:
            attempt += 1
            lender = mixed((b * hashing.BASE + attempt) & M) % 256
        out.append(least[lender] & 255)
    return bytes(out).hex()


def test_fingerprint_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = by_id(queries.op7_document_fingerprints(spark, SF), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    prints = {k: one_permutation(t) for k, t in docs.items()}
    near = lambda p, q: 1.0 if p == q else 0.0 if not p or not q else min(1.0, max(0.0, (sum(p[i : i + 2] == q[i : i + 2] for i in range(0, 512, 2)) / 256 - 1 / 256) * 256 / 255))
    for n, k in enumerate(ids):
        t, u = docs[k], docs[after[k]]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[k][:3] == (len(t), sha(edited.encode()), prints[k])
        assert got[k][5] == pytest.approx(near(prints[k], prints[after[k]]), abs=1e-9)
        if n % 10 == 0:  # the loops are slow
            assert got[k][3] == one_permutation(edited) and got[k][4] == pytest.approx(near(prints[k], got[k][3]), abs=1e-9)


def test_fingerprint_error_is_small(spark):
    rng = random.Random(6)
    off = []
    for n in (3, 40, 400):
        for _ in range(20):
            a = [str(rng.randint(0, 10**6)) for _ in range(n + 4)]
            b = a[: n // 2] + [str(rng.randint(0, 10**6)) for _ in range(n // 2 + 4)]
            p, q = fingerprint.fingerprint_rows([" ".join(a).encode(), " ".join(b).encode()])
            x, y = shingles(" ".join(a)), shingles(" ".join(b))
            off.append(fingerprint.likeness(p, q) - len(x & y) / len(x | y))
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.25  # a set of three gives bins that agree in thirds


def hits(texts, items, size=13):
    tidy = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for k, t in items:
        w = tidy(t)
        for i in range(max(len(w) - size + 1, min(1, len(w)))):
            windows[tuple(w[i : i + size])].add(str(k))
    out = {}
    for k, t in texts.items():
        w, hit, held = tidy(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    held |= own
        out[k] = (len(w), len(hit), len(held), sha(",".join(sorted(held)).encode()), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_decontamination(spark, cases, most):
    docs, texts = cases
    items = [(1, texts[18]), (2, "END"), (10, "a-b"), (3, None), (4, "..."), (5, "É x"), (2, "this is a line")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, item_bytes=most)
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == hits(texts, items)
    for r in got.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert sum(len(decontaminate.normal_words(raw[h["start"] : h["past"]])) for h in r["hits"]) == r["n_hit"]


@pytest.mark.parametrize("size", [1, 2, 4, 13])
def test_windows_of_any_size(size):
    """Few words, so that blocks repeat in items and overlap in texts."""
    rng = random.Random(size)
    some = lambda n: " ".join(rng.choice(["a", "b", "c", "É"]) for _ in range(n))
    items = [(str(i), some(rng.randint(0, 3 * size)).encode()) for i in range(12)]
    match = decontaminate.Matcher(items, size)
    for _ in range(150):
        text = some(rng.randint(0, 40)) + " zz " + some(rng.randint(0, 20))
        spans, held = match.find(decontaminate.normal_words(text.encode()))
        want = hits({0: text}, [(k, t.decode()) for k, t in items], size)[0]
        assert (int(cover(99, spans).sum()), sha(",".join(sorted(held)).encode())) == (want[1], want[3])


def test_matcher_is_small():
    """Half a megabyte of items; memory grows by about 25 bytes for each of theirs."""
    rng = random.Random(2)
    vocabulary = [f"w{i}".encode() for i in range(70_000)]  # more than two symbols number
    items = [(str(i), b" ".join(rng.choices(vocabulary, k=60))) for i in range(1500)] + [("all", b" ".join(vocabulary))]
    match = decontaminate.Matcher(items, 13)
    assert match.width == 3 and len(match.tree) <= sum(len(t.split()) for _, t in items) // 7 + len(items)
    words = items[7][1].split()[20:40]
    spans, held = match.find([b"x", *words, b"y"])
    assert spans.tolist() == [[1, 21]] and held == {"7"}


def test_elias_fano_is_made_in_blocks(monkeypatch):
    """Bytes and memory of a long sequence: those of one block at a time, whatever its length."""
    import tracemalloc

    rng = np.random.default_rng(8)
    cases = [np.cumsum(rng.integers(0, 900, 5000)), np.sort(rng.integers(0, 1 << 40, 3000)), np.zeros(777, np.int64), np.array([5]), np.array([], np.int64), np.concatenate([np.zeros(999, np.int64), [1 << 35]])]
    whole = [elias_fano.encode(x) for x in cases]
    monkeypatch.setattr(elias_fano, "BLOCK", 256)
    for x, data in zip(cases, whole, strict=True):
        assert elias_fano.encode(x) == data and elias_fano.EliasFano(data).select(0, len(x)).tolist() == x.tolist()
    monkeypatch.undo()
    long = np.cumsum(rng.integers(0, 1000, 2_000_000))
    tracemalloc.start()
    data = elias_fano.encode(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(long) and elias_fano.EliasFano(data).select(1_999_990, 10).tolist() == long[-10:].tolist()


def test_token_files_follow_the_text(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(100)], "doc_id long, text string")
    monkeypatch.setattr(token_files, "FILE_TEXT", 1000)
    assert token_files.token_round_trip(docs, token_files.tokenizer_path()).count() == 100
    monkeypatch.setattr(token_files, "new_path", lambda *_: pytest.fail("not here"))
    from leafwork.llm.common import new_path

    made = token_files.write_token_files(docs, new_path(spark, "tokens"), token_files.tokenizer_path())
    assert 8 <= made.count() <= 10


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in ([], [0], [5], [0, 0, 0], np.sort(rng.integers(0, 10**9, 3000)), np.arange(2000), np.repeat(7, 900), np.cumsum(rng.integers(0, 50, 5000))):
        data = b"xy" + elias_fano.encode(np.array(values, np.uint64))
        got = elias_fano.EliasFano(data, 2)
        assert got.end == len(data) and got.n == len(values)
        assert got.select(0, len(values)).tolist() == list(values)
        for i in range(0, len(values), 97):
            assert got.select(i)[0] == values[i]
    big = np.cumsum(rng.integers(200, 800, 50_000))
    assert len(elias_fano.encode(big)) < 2.0 * len(big)  # of 8 bytes each
    with pytest.raises(IndexError):
        got.select(got.n)


def test_token_files(cases):
    docs, texts = cases
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(token_files.tokenizer_path())
    got = by_id(token_files.token_round_trip(docs, token_files.tokenizer_path()), "start", "n_tokens", "ids_crc32")
    begin = 0
    for k in sorted(texts):
        ids = [*tool.encode(texts[k] or "", add_special_tokens=False).ids, 0]
        assert got[k] == (begin, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        begin += len(ids)


def test_encoder_pieces():
    from tokenizers import Tokenizer

    tool, own = Tokenizer.from_file(token_files.tokenizer_path()), token_files.Encoder(token_files.tokenizer_path())
    rng = random.Random(9)
    marks = [" ", "  ", "\n", "\r\n", "\t ", " ", " ", "'s", "'re", "it's", "é", "×", "ß", "1", "a1", "!?", "x,", "…", "<|endoftext|>", "a\x1cb", "̀", "\x85", "A's "]
    texts = ["".join(rng.choice(marks + ["word", "The"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    data = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, n = own(np.frombuffer(b"".join(data), np.uint8), offs, 0)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*e.ids, 0] for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_encoder_cuts_only_where_it_may(tmp_path):
    """Other pre-tokenization, normalizers and truncation: whole texts are encoded."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    texts = ["It's 12 words, a1 b2\n\n  and  More", "", " x", "Ünder é1"]
    data = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    for change in (lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=True)), lambda t: setattr(t, "normalizer", normalizers.Lowercase()), lambda t: setattr(t, "pre_tokenizer", pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))):
        tool = Tokenizer.from_file(token_files.tokenizer_path())
        change(tool)
        tool.save(str(tmp_path / "other.json"))
        ids, n = token_files.Encoder(str(tmp_path / "other.json"))(np.frombuffer(b"".join(data), np.uint8), offs, 0)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [[*e.ids, 0] for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_archive_names_and_frames(spark, tmp_path):
    big = "<p>x</p>" * 300
    odd_ids = ["a\r\nWARC-Type: x", None, "", "<urn:page:1>", "é %41>", "plain", None]
    df = spark.createDataFrame([(i, f"http://{k}", big if k % 2 else f"own {k}") for k, i in enumerate(odd_ids)], "page_id string, url string, html string")
    got = warc.warc_round_trip(df).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(map(str, odd_ids))
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == len(big)) == [("<urn:page:1>", "revisit", "plain"), ("None", "revisit", "plain"), ("plain", "response", None)]
    none = spark.createDataFrame([(None, None, big), (None, None, big)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(none).collect()) == [(None, "response", None), (None, "revisit", None)]
    pages = [(i, f"http://n/{i}", f"<html>{i} " + "lorem ipsum dolor " * (60 + i)) for i in range(80)]
    (made,) = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w").collect()
    data = open(made["path"].removeprefix("file://"), "rb").read()
    size = int.from_bytes(data[4:8], "little")
    dictionary, rest, n = zstandard.ZstdCompressionDict(data[8 : 8 + size]), data[8 + size :], 0
    while rest:  # each record is a frame of its own, that only the embedded dictionary opens
        with pytest.raises(zstandard.ZstdError):
            zstandard.ZstdDecompressor().decompress(rest, max_output_size=1 << 20)
        tool = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        body = tool.decompress(rest)
        assert body.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and body.count(b"WARC-Record-ID: ") == 1
        rest, n = tool.unused_data, n + 1
    assert n == 80


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 200
    pages = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://c", None), (4, "http://d", "x"), (5, "http://e", "x"), (6, "http://f", big + "!"), (7, "http://g", "WARC/1.1\r\n\r\n" * 90)]
    pages += [(100 + i, f"http://n/{i}", f"<html>{i} " + "lorem ipsum dolor " * (60 + i)) for i in range(60)]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, target string")
    got = {r["page_id"]: tuple(r)[1:5] for r in warc.warc_round_trip(df).collect()}
    assert len(got) == len(pages)
    for k, _, h in pages:
        body = (h or "").encode()
        kept = max(i for i, _, x in pages if x == h) if len(body) >= 1000 else k
        assert got[k] == (len(body), hashlib.sha1(body).hexdigest(), "response" if kept == k else "revisit", None if kept == k else kept)
    manifest = warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w").collect()
    head = open(manifest[0]["path"].removeprefix("file://"), "rb").read(4)
    assert head == b"\x5d\x2a\x4d\x18"


def test_repeated_and_null_ids(odd):
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.substring_dedup(odd, size=5).collect()) == [(0, 0, 0), (0, 6, 6), (1, 1, 0), (1, 6, 6), (1, 6, 6), (2, 0, 0)]
    assert substring.suffix_array_dedup(odd, size=5).agg(F.sum("n_removed")).first()[0] == 33
    assert lines.line_dedup(odd, least_docs=2, least_chars=3).agg(F.sum("n_dropped")).first()[0] == 2
    got = jaccard.ngram_jaccard_join(odd).collect()
    assert len(got) == 6 and Counter(r["class_id"] for r in got).most_common(1)[0][1] == 3
    assert Counter(k for r in packing.best_fit_packing(odd).collect() for k in r["doc_ids"]) == {None: 2, 1: 3, 2: 1}
    assert langid.language_id(odd.withColumn("lang", F.lit("en"))).count() == 6
    prints = fingerprint.fingerprint_documents(odd).collect()
    assert Counter(r["fingerprint"] for r in prints).most_common(2)[0][1] == 3
    assert decontaminate.decontaminate(odd, odd, item_col="doc_id").count() == 6
    assert warc.warc_round_trip(odd, id_col="doc_id", url_col="id", payload_col="text").collect()[5:]
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in token_files.token_round_trip(odd, token_files.tokenizer_path()).collect())
    assert [i for _, _, i in got] == [None, None, 1, 1, 1, 2] and got[0][:2] == (0, 1)
    assert all(b == a + n for (a, n, _), (b, _, _) in zip(got, got[1:]))
    none = token_files.token_round_trip(odd.where("doc_id IS NULL"), token_files.tokenizer_path()).collect()
    assert [r["doc_id"] for r in none] == [None, None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (
        substring.suffix_array_dedup(none), substring.substring_dedup(none), lines.line_dedup(none), jaccard.ngram_jaccard_join(none), packing.best_fit_packing(none), langid.language_id(none),
        fingerprint.fingerprint_documents(none), decontaminate.decontaminate(none, bench), token_files.token_round_trip(none, token_files.tokenizer_path()), warc.warc_round_trip(pages),
    ):
        assert df.collect() == []


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(compare, name):
    compare(queries.QUERIES[name], queries.SQL[name])


def test_other_queries_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = removed({k: list((t or "").encode()) for k, t in docs.items()}, 200, bytes)
    assert by_id(queries.op1_suffix_array_dedup(spark, SF), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    check_sequences(queries.op5_best_fit_packing(spark, SF).collect(), docs)


def test_clashing_names(spark):
    """Columns named as the operators name theirs, and an id and a text under odd names."""
    names = ["__rk", "the text", "id", "text", "drop", "key", "lang_pred", "score", "__row", "n_words", "class_id", "rep", "sig", "spans", "lang"]
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(i, words, 1, "x", 2, "k", "l", 0.5, "r", 3, 4, 5, b"s", "p", "en") for i in range(6)], " ".join(["__rk long,", "`the text` string,", "id int, text string, drop int, key string, lang_pred string, score double, __row string, n_words int, class_id int, rep int, sig binary, spans string, lang string"]))
    assert docs.columns == names
    use = {"id_col": "__rk", "text_col": "the text"}
    assert {r["n_removed"] for r in substring.suffix_array_dedup(docs, size=20, **use).collect()} == {len(words)}
    assert {r["n_removed"] for r in substring.substring_dedup(docs, size=5, **use).collect()} == {14}
    assert sum(r["n_dropped"] for r in lines.line_dedup(docs, **use).collect()) == 5
    assert {(r["class_id"], r["n_links"]) for r in jaccard.ngram_jaccard_join(docs, **use).collect()} == {(0, 0)}
    assert sorted(k for r in packing.best_fit_packing(docs, **use).collect() for k in r["doc_ids"]) == list(range(6))
    assert {r["lang_pred"] for r in langid.language_id(docs, **use).collect()} == {"en"}
    assert {r["near_next"] for r in fingerprint.fingerprint_documents(docs, **use).collect()} == {1.0}
    bench = docs.select(F.col("the text").alias("hits"), "id").limit(1)
    assert {r["n_hit"] for r in decontaminate.decontaminate(docs, bench, item_col="id", item_text_col="hits", **use).collect()} == {14}
    assert min(r["start"] for r in token_files.token_round_trip(docs, token_files.tokenizer_path(), **use).collect()) == 0
    assert Counter(r["record_type"] for r in warc.warc_round_trip(docs, id_col="__rk", url_col="key", payload_col="the text", least=10).collect()) == {"response": 1, "revisit": 5}
