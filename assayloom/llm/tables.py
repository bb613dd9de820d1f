"""Tables in the shared folder, and joins against a side whose size is checked first."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom.runtime import work_path

#: A side of at most so many narrow rows (keys and counts, under 100 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000


#: Sizes of the Arrow batches that whole texts travel in, where the session sets none: a batch is held several times over by
#: an executor and its Python worker.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small from now on, unless the session has sizes of its own."""
    for key, value in _BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


@contextmanager
def arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what is run inside, unless the session has sizes of its own; its settings come back after."""
    ours = [key for key in _BATCHES if spark.conf.get(key, None) is None]
    for key in ours:
        spark.conf.set(key, _BATCHES[key])
    try:
        yield
    finally:
        for key in ours:
            spark.conf.unset(key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def put(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, lost executors cost nothing."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow_side(written: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast only if its counted rows are few; else joined by shuffle."""
    return F.broadcast(written) if written.count() <= most else written
