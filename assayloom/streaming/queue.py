"""A queue of full batches fed by a stream: what does not fill a batch waits for the next micro-batch.

The number of a row is its place in the whole feed, so batches do not depend on how the feed was cut into micro-batches. The
state after micro-batch i is one table, v=i: the next batch number, and the rows of the unfinished batch, fewer than a batch.
A micro-batch reads the state before it and replaces its own outputs, so a replay after a failure changes nothing. Rows are
numbered by range partitions, so a micro-batch of any size meets in no task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from assayloom.operators.ranking import rank_within
from assayloom.runtime import delete_path, list_names, table_complete

_NEXT, _PLACE = "_next_batch", "_place"


def batches_of(rows: DataFrame, size: int, order: Sequence[str], first: int = 0) -> DataFrame:
    """Adds batch_no: rows in order, `size` to a batch, numbered from `first`. Rows alike in `order` go by all their columns."""
    ties = [c for c in rows.columns if c not in order]
    ranked = rank_within(rows, [], [*order, *ties], _PLACE)
    return ranked.withColumn("batch_no", F.floor((F.col(_PLACE) - 1) / size) + F.lit(first))


def _state(spark: SparkSession, path: str, i: int, schema: T.StructType) -> tuple[int, DataFrame]:
    """(next batch number, waiting rows) after micro-batch i; nothing waits before the first."""
    if i < 0:
        return 0, spark.createDataFrame([], schema)
    if table_complete(spark, f"{path}/v={i}/closed"):
        path = f"{path}/v={i}/closed"
    elif table_complete(spark, f"{path}/v={i}/open"):
        path = f"{path}/v={i}/open"
    else:
        raise RuntimeError(f"the queue's state after micro-batch {i} is missing: {path}")
    held = spark.read.parquet(path)
    mark = held.where(F.col(_PLACE) == 0).select(_NEXT).first()[0]
    return mark, held.where(F.col(_PLACE) > 0).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])


def _write_state(waiting: DataFrame, next_batch: int, schema: T.StructType, path: str) -> None:
    """The waiting rows and one row that holds the number."""
    spark = waiting.sparkSession
    names = [f.name for f in schema]
    mark = spark.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], F.lit(0).cast("long").alias(_PLACE), F.lit(next_batch).cast("long").alias(_NEXT),
    )
    rows = waiting.select(*[F.col(f"`{n}`") for n in names], F.col(_PLACE).cast("long").alias(_PLACE), F.lit(next_batch).cast("long").alias(_NEXT))
    rows.unionByName(mark).coalesce(1).write.mode("overwrite").parquet(path)


def take_micro_batch(
    rows: DataFrame, i: int, size: int, order: Sequence[str], queue_path: str, state_path: str
) -> None:
    """Queues all full batches of what waited and what came; the rest waits on. Fewer than `size` rows are carried."""
    spark, schema = rows.sparkSession, rows.schema
    next_batch, waiting = _state(spark, state_path, i - 1, schema)
    # what waited is older than what came, whatever the order columns say
    aged = waiting.withColumn("_age", F.lit(0)).unionByName(rows.withColumn("_age", F.lit(1)))
    numbered = batches_of(aged, size, ["_age", *order], next_batch).drop("_age").persist()
    try:
        full = numbered.count() // size
        queued = numbered.where(F.col(_PLACE) <= full * size).drop(_PLACE)
        queued.write.mode("overwrite").parquet(f"{queue_path}/micro={i}")
        _write_state(numbered.where(F.col(_PLACE) > full * size), next_batch + full, schema, f"{state_path}/v={i}/open")
    finally:
        numbered.unpersist()
    # a replay needs the state before it and no older one
    if i > 1:
        delete_path(spark, f"{state_path}/v={i - 2}")


def queue_micro_batches(
    stream: DataFrame, size: int, order: Sequence[str], queue_path: str, failed_path: str, state_path: str, checkpoint: str,
    every_seconds: int | None = None,
) -> StreamingQuery:
    """Rows whose `prepared` is true go to the queue in batches of exactly `size`; all others bypass it at once.

    The feed's end is said by `finish_queue`. A feed that goes on after it starts a new batch.
    """
    def each(df: DataFrame, i: int) -> None:
        rows = df.persist()
        try:
            good = F.coalesce(F.col("prepared"), F.lit(False))
            take_micro_batch(rows.where(good), i, size, order, queue_path, state_path)
            rows.where(~good).write.mode("overwrite").parquet(f"{failed_path}/micro={i}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{every_seconds} seconds") if every_seconds else writer.trigger(availableNow=True)
    return writer.start()


def finish_queue(spark: SparkSession, schema: T.StructType, size: int, order: Sequence[str], queue_path: str, state_path: str) -> int:
    """Queues the last, short batch after a feed has ended and its query has stopped; returns its rows. A second call adds nothing."""
    states = [f for f in list_names(spark, state_path) if f.startswith("v=")]
    if not states:
        return 0
    i = max(int(f[2:]) for f in states)
    if table_complete(spark, f"{state_path}/v={i}/closed"):
        return 0
    next_batch, waiting = _state(spark, state_path, i, schema)
    rest = batches_of(waiting, size, order, next_batch)
    n = waiting.count()
    if n:
        rest.drop(_PLACE).write.mode("overwrite").parquet(f"{queue_path}/micro={i}-end")
    _write_state(rest.where(F.lit(False)), next_batch + (n > 0), schema, f"{state_path}/v={i}/closed")
    return n

