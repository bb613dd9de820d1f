"""Result feeds as streams: append, running best, live progress.

Every sink writes under its micro-batch number, so a batch replayed after a failure replaces what
it wrote before. Hot feeds are aggregated as ordinary batch jobs inside foreachBatch: keyed
streaming state would put one feed's results through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from assayloom.operators.windows import feed_state, progress_checkpoints
from assayloom.runtime import path_exists
from assayloom.sinks.tables import append_scores, write_progress_snapshot
from assayloom.streaming.feed_states import FeedStates


def read_results(
    spark: SparkSession, folder: str, schema: T.StructType | str, files_per_trigger: int = 100
) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _start(df: DataFrame, each, checkpoint: str, every_seconds: int | None, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=f"{every_seconds} seconds") if every_seconds else writer.trigger(availableNow=True)
    return writer.start()


def feed_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that the checkpoint gave its query: the same after a restart, another for every other feed."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def append_results(stream: DataFrame, scores_path: str, checkpoint: str, every_seconds: int | None = None) -> StreamingQuery:
    """One row per attempt, failed ones with a NULL score. Feeds that share a table keep their rows apart by name."""
    def each(df: DataFrame, i: int) -> None:
        append_scores(df, scores_path, f"{feed_name(df.sparkSession, checkpoint)}-{i}")

    return _start(stream, each, checkpoint, every_seconds)


def running_best(
    stream: DataFrame, by: Sequence[str], arrival: Sequence[str], out: str, state_path: str, checkpoint: str,
    every: int = 500, every_seconds: int | None = None,
) -> StreamingQuery:
    """At every `every`-th result of a feed: docked, valid, failed and n-th best so far.

    State per feed is three columns: two counts and its best 1000 scores. It is kept in buckets of feeds, and a micro-batch
    reads and rewrites only the buckets of its own feeds.
    """
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in by)

    def each(df: DataFrame, i: int) -> None:
        states = FeedStates(df.sparkSession, state_path, by, kinds)
        versions = states.versions(i - 1)
        rows = df.select(*by, *arrival, "score").persist()
        try:
            touched = states.touched(rows)
            state = states.read(versions, touched)
            progress_checkpoints(rows, by, arrival, every, state=state, at_end=False).write.mode("overwrite").parquet(
                f"{out}/batch={i}"
            )
            states.write(i, feed_state(rows, by, state), touched)
        finally:
            rows.unpersist()

    return _start(stream, each, checkpoint, every_seconds)


def live_progress(
    stream: DataFrame, by: Sequence[str], history: str, latest: str, checkpoint: str, every_seconds: int | None = None
) -> StreamingQuery:
    """Per feed and round, over everything seen: docked, valid, failed, mean, best."""
    table = stream.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docked"), F.count("score").alias("valid"),
        F.count_if(F.col("score").isNull()).alias("failed"), F.avg("score").alias("mean"), F.min("score").alias("best1"),
    )
    def each(df: DataFrame, i: int) -> None:
        rows = df.persist()
        try:
            write_progress_snapshot(rows, history, latest, i)
        finally:
            rows.unpersist()

    return _start(table, each, checkpoint, every_seconds, "complete")


def stop_requested(spark: SparkSession, path: str | None) -> bool:
    """True once someone created the stop file."""
    return path is not None and path_exists(spark, path)
