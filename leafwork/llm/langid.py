"""Language identification by a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm.common import map_arrow, raw, row_chunks

HIDDEN, STEPS = 8, 64  # units in each direction; bytes of a window
SAMPLE_DOCS, SAMPLE_WINDOWS = 4000, 64  # bound of what training sees: labelled documents, and windows of each
ROUNDS, BATCH, RATE = 240, 192, 0.02
WINDOWS = 2048  # worked on at once
UNKNOWN = "und"
_f = np.float32


@dataclass
class Model:
    """Byte tables (3 * HIDDEN gates by 256), recurrent weights, output weights; for both directions."""

    labels: list[str]
    params: dict[str, np.ndarray]


def start(classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"W{d}"] = rng.normal(0, 0.5, (3 * HIDDEN, 256))
        p[f"U{d}"] = rng.normal(0, 0.4, (3 * HIDDEN, HIDDEN))
        p[f"c{d}"] = np.zeros((HIDDEN, 1))
        p[f"O{d}"] = rng.normal(0, 0.4, (classes, HIDDEN))
    p["o"] = np.zeros((classes, 1))
    return {k: v.astype(_f) for k, v in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + _f(0.5)


def forward(p: dict[str, np.ndarray], d: str, x: np.ndarray):
    """x: bytes (steps, n) in the direction's own order. All states, and what the gates were."""
    h = np.zeros((HIDDEN, x.shape[1]), _f)
    states, kept = [], []
    for t in range(len(x)):
        a = p[f"W{d}"][:, x[t]]
        u = p[f"U{d}"] @ h
        zr = sigmoid(a[: 2 * HIDDEN] + u[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        v = u[2 * HIDDEN :] + p[f"c{d}"]
        n = np.tanh(a[2 * HIDDEN :] + r * v)
        kept.append((h, z, r, v, n))
        h = n + z * (h - n)
        states.append(h)
    return states, kept


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Cross-entropy of every position's label, and its gradient through time. x: (steps, n) bytes; y: n labels."""
    steps, n = x.shape
    states_f, kept_f = forward(p, "f", x)
    states_b, kept_b = forward(p, "b", x[::-1])
    g = {k: np.zeros_like(v) for k, v in p.items()}
    loss, dh = 0.0, {"f": [], "b": []}
    for t in range(steps):
        logits = p["Of"] @ states_f[t] + p["Ob"] @ states_b[steps - 1 - t] + p["o"]
        logits -= logits.max(0)
        e = np.exp(logits)
        q = e / e.sum(0)
        loss -= float(np.log(q[y, np.arange(n)] + 1e-9).sum())
        q[y, np.arange(n)] -= 1
        q /= steps * n
        g["Of"] += q @ states_f[t].T
        g["Ob"] += q @ states_b[steps - 1 - t].T
        g["o"] += q.sum(1, keepdims=True)
        dh["f"].append(p["Of"].T @ q)
        dh["b"].append(p["Ob"].T @ q)
    dh["b"].reverse()
    for d, kept, seq in (("f", kept_f, x), ("b", kept_b, x[::-1])):
        carry = np.zeros((HIDDEN, n), _f)
        inputs = np.empty((steps, 3 * HIDDEN, n), _f)
        for t in range(steps - 1, -1, -1):
            h, z, r, v, c = kept[t]
            carry = carry + dh[d][t]
            dc = carry * (1 - z) * (1 - c * c)
            dz = carry * (h - c) * z * (1 - z)
            dv = dc * r
            dr = dc * v * r * (1 - r)
            gates = np.concatenate([dz, dr, dv])
            inputs[t] = np.concatenate([dz, dr, dc])
            g[f"U{d}"] += gates @ h.T
            g[f"c{d}"] += dv.sum(1, keepdims=True)
            carry = carry * z + p[f"U{d}"].T @ gates
        by = np.zeros((256, 3 * HIDDEN), _f)
        np.add.at(by, seq.ravel(), inputs.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN))
        g[f"W{d}"] += by.T
    return loss / (steps * n), g


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> Model:
    """Adam on windows drawn evenly from the languages."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    p = start(len(labels), seed)
    pools = [np.frombuffer(b"\n".join(t for t, g in zip(texts, langs, strict=True) if g == label) + b"\n" * STEPS, np.uint8) for label in labels]
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        y = rng.integers(0, len(labels), BATCH)
        x = np.stack([pools[c][(a := rng.integers(0, len(pools[c]) - STEPS + 1)) : a + STEPS] for c in y], 1)
        _, g = gradients(p, x, y)
        norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
        rate = RATE * min(1.0, 2 * (1 - step / (ROUNDS + 1)))
        for k in p:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-6))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(_f)
    return Model(labels, p)


def window_sums(model: Model, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Summed label probabilities (labels, n) over the first `sizes` positions of each window. x: (n, steps) bytes."""
    p, steps, n = model.params, x.shape[1], len(x)
    halves = {}
    for d in "fb":  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2: the halving is done to the weights once
        scale = np.repeat(np.array([0.5, 0.5, 1], _f), HIDDEN)[:, None]
        halves[d] = np.ascontiguousarray(p[f"W{d}"] * scale), p[f"U{d}"] * scale
    seq = np.ascontiguousarray(x.T).astype(np.intp)
    logits = np.empty((steps, len(model.labels), n), _f)
    a, u, h, t1 = (np.empty((k, n), _f) for k in (3 * HIDDEN, 3 * HIDDEN, HIDDEN, HIDDEN))
    for d in "fb":
        w, rec = halves[d]
        h[:] = 0
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(w, seq[t], 1, out=a, mode="clip")
            np.matmul(rec, h, out=u)
            zr = a[: 2 * HIDDEN]
            zr += u[: 2 * HIDDEN]
            np.tanh(zr, out=zr)
            zr *= _f(0.5)
            zr += _f(0.5)
            v, c = u[2 * HIDDEN :], a[2 * HIDDEN :]
            v += p[f"c{d}"]
            v *= zr[HIDDEN:]
            c += v
            np.tanh(c, out=c)
            np.subtract(h, c, out=t1)
            t1 *= zr[:HIDDEN]
            np.add(c, t1, out=h)
            if d == "b":  # a shorter window begins, read backwards, at its own last byte
                h *= t < sizes
            if d == "f":
                np.matmul(p["Of"], h, out=logits[t])
            else:
                logits[t] += p["Ob"] @ h
    logits += p["o"]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    logits *= (np.arange(steps)[:, None] < sizes)[:, None]
    return logits.sum(0)


def probabilities(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean label probabilities (rows, labels) over all bytes of each row; every byte is labelled in one window."""
    per = -(-np.diff(offs) // STEPS)
    row = np.repeat(np.arange(len(per)), per)
    begin = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * STEPS
    sizes = np.minimum(offs[row + 1] - begin, STEPS)
    padded = np.concatenate([buf, np.zeros(STEPS, np.uint8)])
    out = np.zeros((len(per), len(model.labels)))
    for k in range(0, len(row), WINDOWS):
        part = slice(k, k + WINDOWS)
        x = padded[begin[part, None] + np.arange(STEPS)]
        np.add.at(out, row[part], window_sums(model, x, sizes[part]).T)
    return out / np.maximum(np.diff(offs), 1)[:, None]


_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def _predict(model: Model, field: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw(batch.column(0).field(field))
            for lo, hi in row_chunks(offs, 1 << 20):
                got = probabilities(model, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                known = [has_letter(data[offs[i] : offs[i + 1]].tobytes()) for i in range(lo, hi)]
                best = got.argmax(1)
                pred = [model.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)]
                score = np.where(known, np.clip(got.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(pred), pa.array(score)], names=[*batch.schema.names, "__pred", "__score"])

    return run


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the documents, by the CRC-32 of the id as text, that training never sees."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def spread(text: bytes, windows: int) -> bytes:
    """A text of at most so many windows; of a longer one that many, evenly spread from its first byte to its last."""
    if len(text) <= windows * STEPS:
        return text
    return b"".join(text[a : a + STEPS] for a in (i * (len(text) - STEPS) // max(windows - 1, 1) for i in range(windows)))


def _sample(windows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(place, text, label) to the same with each text thinned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = raw(batch.column(1))
            thin = [spread(data[offs[i] : offs[i + 1]].tobytes(), windows) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(thin, pa.binary()), batch.column(2)], names=["h", "t", "g"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 7, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> Model | None:
    """Learn from at most `sample_docs` labelled documents with letters that aren't held out, the least by a hash of their
    id, and from `sample_windows` 64-byte windows of each, spread over its whole text. None if there are no such documents.

    The hash range that is looked at is widened until it holds enough documents or is all: the sample is the same at every
    width, and tasks send the driver about what it takes.
    """
    usable = docs.where(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull())
    place, full = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string")), F.lit(1 << 40)), 1 << 40
    width = min(full, full * 2 * sample_docs // max(usable.count(), 1))  # ids and labels alone
    while True:
        near = usable.where((place < width) & F.col(f"`{text_col}`").rlike(r"\p{L}"))
        picked = map_arrow(near.select(place.alias("h"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("g")), _sample(sample_windows), "h long, t binary, g string")
        rows = picked.orderBy("h", "t", "g").limit(sample_docs).collect()  # bounded by the two sample sizes
        if len(rows) == sample_docs or width >= full:
            return train([bytes(r["t"]) for r in rows], [r["g"] for r in rows], seed) if rows else None
        width = min(full, 4 * width)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """All columns of docs and the predicted language with its probability, under names that docs don't have; documents stay where they are, nothing moves."""
    if model is None:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    taken = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    schema = T.StructType([*taken.schema.fields, T.StructField("__pred", T.StringType()), T.StructField("__score", T.DoubleType())])
    found = map_arrow(taken, _predict(model, docs.columns.index(text_col)), schema)
    return found.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns], F.col("__pred").alias(pred), F.col("__score").alias(score))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """Fit on a bounded sample of the labelled documents that aren't held out, then label every byte of every document.

    Each byte's label probabilities come from a forward and a backward gated recurrent pass over its 64-byte window; a
    document's are their mean. Language, source and id are no inputs of a prediction. The bound of the sample is
    `sample_docs` labelled documents and `sample_windows` windows of each; every byte is labelled, however long the text.

    Returns id, held_out, lang_pred, score.

    Defined cases: a text that is null or has no letter is `und` with score 0; with no labelled document all are `und`;
    of tied languages the first by name is taken; rows that repeat are predicted alike, a null id is not held out; a very
    long text is held whole, with about 60 bytes for each of its bytes; an empty table gives no rows; other columns are
    ignored, whatever their names. A label too rare for the sample isn't learned.
    """
    model = fit(docs, id_col, text_col, lang_col, sample_docs=sample_docs, sample_windows=sample_windows)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return identify(rows, model).select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
