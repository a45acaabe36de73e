"""What a Python worker holds at once: small Arrow batches in, small slices of their rows out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

BATCH = 4 << 20  # bytes of an Arrow batch that goes to a worker
SLICE = 1 << 19  # characters of texts whose results leave it together


def small_batches(df: DataFrame) -> DataFrame:
    """df itself. Its session's Arrow batches hold at most BATCH bytes from now on, whatever the rows' size, unless it has a lower bound."""
    spark = df.sparkSession
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return df


def slices(content: pd.Series) -> Iterator[slice]:
    """A batch in parts of whole rows, each about SLICE long or one longer row."""
    start = size = 0
    for i, x in enumerate(content):
        size += len(x) if x is not None else 0
        if size >= SLICE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(content):
        yield slice(start, len(content))
