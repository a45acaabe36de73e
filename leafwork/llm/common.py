"""Plumbing shared by the corpus operators: row keys, tables in the shared folder, byte views of Arrow columns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RK = "__rk"
UNIQUE = "leafwork.unique"  # metadata of a column that is known to identify rows
BATCH = 4 << 20
CHUNK_TEXT = 1 << 20  # bytes of text worked on at once
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it is unset, a new one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = _local_dir()
    return place.rstrip("/")


_made: list[str] = []


def _local_dir() -> str:
    if not _made:
        _made.append("file://" + tempfile.mkdtemp(prefix="leafwork-"))
    return _made[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the files are then the cluster's to clean
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and gives Spark real sizes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafwork_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing that is still to be computed reads them."""
    for x in tables:
        remove(x.sparkSession, x._leafwork_path)


def mark() -> set[str]:
    """What is in the shared folder now, for sweep()."""
    return set(_written)


def sweep(since: set[str], keep: DataFrame) -> None:
    """Delete what was written since mark() was called, but the table `keep`."""
    for path in [x for x in _written if x not in since and x != keep._leafwork_path]:
        remove(_written[path], path)


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow, with record batches of at most BATCH bytes: what a task holds follows from that, not from the rows' size."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH:
        conf.set(name, str(BATCH))
    return df.mapInArrow(partial(_lean, run), schema)


def _lean(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, then give freed memory back: workers live on idle between tasks, several to a core."""
    try:
        yield from run(batches)
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate: for a file scan, the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as make it differ from all that are taken, whatever their case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def number(df: DataFrame, id_col: str, name: str = RK) -> DataFrame:
    """df with a long column `name` that is unique for each row, and marked so: numbering by it again costs nothing.

    An integer id without nulls and repeats is its own key. Else the rows are numbered and written to the shared
    folder, so that a recomputed partition can't renumber them.
    """
    field = df.schema[id_col]
    known = {UNIQUE: True}
    if isinstance(field.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        own = F.col(f"`{id_col}`")
        if not field.metadata.get(UNIQUE):
            seen = df.select(own.alias("i")).groupBy("i").count().where((F.col("count") > 1) | F.col("i").isNull())
            if seen.limit(1).count():
                own = None
        if own is not None:
            return df.withColumn(name, own.cast("long").alias(name, metadata=known))
    return materialize(df.withColumn(name, F.monotonically_increasing_id().alias(name, metadata=known)), "numbered")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__rk as number() gives it, id and text, whatever these two are called in df."""
    own = df.select(F.col(f"`{id_col}`").alias("id", metadata=df.schema[id_col].metadata), F.col(f"`{text_col}`").alias("text"))
    return number(own, "id").select(RK, "id", "text")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and where each row starts (one more than rows). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    buffers = column.buffers()
    offs = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def row_chunks(offs: np.ndarray, most: int):
    """(first, past) row ranges of about `most` bytes; a longer row stands alone."""
    first, n = 0, len(offs) - 1
    while first < n:
        past = max(first + 1, int(np.searchsorted(offs, offs[first] + most, "right")) - 1)
        yield first, past
        first = past


def spans_of(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows (start, past)."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def cover(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the rows (start, past)."""
    if not len(spans):
        return np.zeros(n, bool)
    edge = np.bincount(spans[:, 0], minlength=n + 1) - np.bincount(spans[:, 1], minlength=n + 1)
    return np.cumsum(edge)[:n] > 0
