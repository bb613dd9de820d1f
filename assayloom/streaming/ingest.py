"""File ingest as a stream: every raw file once, resumable, in any order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from assayloom.plans.ingest import write_ingested
from assayloom.sources.files import split_lines
from assayloom.streaming.results import feed_name


def ingest_files(
    lines: DataFrame, validate: Callable[[DataFrame], DataFrame], root: str, checkpoint: str,
    every_seconds: int | None = None,
) -> StreamingQuery:
    """The checkpoint's file log decides what is new; the tables are safe to write twice."""
    def each(df: DataFrame, i: int) -> None:
        write_ingested(validate(split_lines(df)), root, f"{feed_name(df.sparkSession, checkpoint)}-{i}")

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{every_seconds} seconds") if every_seconds else writer.trigger(availableNow=True)
    return writer.start()
