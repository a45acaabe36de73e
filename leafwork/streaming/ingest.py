"""New book files as they come (an extension: the batch operators have no counterpart of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafwork.sources.epub_files import NAMES, parse_epubs


def stream_epubs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of parsed books, each file once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", NAMES).load(path)
    return parse_epubs(files.select("path", "content"))


def append_books(spark: SparkSession, path: str, table: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a Parquet folder, then stop; call again for what came since."""
    return stream_epubs(spark, path).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
