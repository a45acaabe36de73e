"""Removal of lines that many documents share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwork.llm.common import RK, map_arrow, materialize, number


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """A 128-bit hash of the normalised line; None for a line too short to count."""
    key = line.strip(b" \t\n\x0b\x0c\r").lower()  # bytes.lower() touches A-Z alone
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def _keys(least_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, key, text) to a row for each distinct line key of a text, with the positions of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, places = [], [], []
            for i, text in enumerate(_texts(batch.column(2))):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate(text.split(b"\n")):
                    if len(line) >= least_chars and (key := line_key(line, least_chars)) is not None:
                        found.setdefault(key, []).append(at)
                keys += found
                places += found.values()
                rows += [i] * len(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["id", RK, "key", "places"])

    return run


def _reassemble(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, text, lists of positions to drop, carried ...) to what is left of each text."""
    names = ["id", "n_lines", "n_dropped", "kept_sha256", *["kept"] * with_text]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for null, text, drop in zip(batch.column(1).is_null().to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                body, n, gone = text, text.count(b"\n") + 1, {x for part in drop or () for x in part}
                if gone:
                    body = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in gone])
                out.append([n, len(gone), hashlib.sha256(body).hexdigest(), *[None if null else body.decode()] * with_text])
            cols = zip(*out, strict=True) if out else [[]] * (len(names) - 1)
            rest = batch.columns[3:]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=False)), *rest], names=names + ["carried"] * len(rest))

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 5, least_chars: int = 40, with_text: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Drop the lines whose normalised form at least `least_docs` documents hold, but in the document with the largest id.

    A line's key is the line without space and bytes 9-13 at its ends, A-Z lower-cased; keys under `least_chars` code
    points never count. Distinct keys of each document are hashed to 128 bits, go with the positions of their lines, and
    are counted with map-side partial sums; the frequent keys, written out so that Spark knows their size, are joined to
    the (key, document) pairs, where the runtime splits a hot key's partition. Text is moved once, to the positions that
    it loses, and put together again by position.

    Returns id, n_lines, n_dropped, kept_sha256, with `with_text` kept, and carried: a struct of the columns in `carry`, if any.

    Defined cases: a null or empty text is one empty line, which stays (kept is null for null); a document whose every
    line goes keeps the empty text; a key's lines stay all together in its largest document; rows that repeat an id, or
    whose id is null, are documents of their own (null is least; of tied ids one row counts as the largest); a very long
    text is held whole, three times over; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    own = F.col(f"`{id_col}`").alias("id", metadata=docs.schema[id_col].metadata)
    whole = number(docs.select(own, F.col(f"`{text_col}`").alias("text"), *extra), "id")
    rows = whole.select("id", RK, "text")
    pairs = materialize(map_arrow(rows, _keys(least_chars), f"id {id_type}, {RK} long, key binary, places array<int>"), "line-keys")
    frequent = pairs.groupBy("key").agg(F.count("*").alias("docs"), F.max(F.struct("id", RK)).alias("last"))
    frequent = materialize(frequent.where(F.col("docs") >= least_docs).select("key", F.col(f"last.{RK}").alias("keeper")), "line-frequent")
    drops = pairs.select(RK, "key", "places").join(frequent, "key").where(F.col(RK) != F.col("keeper")).groupBy(RK).agg(F.collect_list("places").alias("drop"))
    joined = whole.join(drops, RK, "left").select("id", "text", "drop", *["carried"] * bool(carry))
    schema = T.StructType([joined.schema["id"], *(T.StructField(n, t) for n, t in (("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_sha256", T.StringType())))])
    if with_text:
        schema.add("kept", T.StringType())
    if carry:
        schema.add(joined.schema["carried"])
    return map_arrow(joined, _reassemble(with_text), schema).withColumnRenamed("id", id_col)
