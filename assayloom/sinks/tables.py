"""Table writers that can be rerun: each one either has an existence guard or overwrites its own slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayloom import schemas
from assayloom.functions.text import joined_sorted
from assayloom.operators.ingest import backfill
from assayloom.runtime import cut_lineage, path_exists, table_complete
from assayloom.sinks import swap


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def batch_exists(spark: SparkSession, path: str, target: str, experiment_id: str, rnd: int) -> bool:
    """Looks at one partition folder only."""
    rows = read_or_empty(spark, path, schemas.BATCHES).where(
        (F.col("target") == target) & (F.col("experiment_id") == experiment_id) & (F.col("round") == rnd)
    )
    return not rows.limit(1).isEmpty()


def append_batch(
    ids: DataFrame, path: str, target: str, experiment_id: str, rnd: int, source: str
) -> bool:
    """Adds a round's batch once. Returns False, and writes nothing, where the round already has rows.

    The round is one partition folder, replaced as a whole: a rerun after a crash cannot double it.
    """
    if batch_exists(ids.sparkSession, path, target, experiment_id, rnd):
        return False
    rows = ids.select(
        F.col("id").alias("compound_id"), F.lit(target).alias("target"), F.lit(experiment_id).alias("experiment_id"),
        F.lit(rnd).alias("round"), F.lit(source).alias("source"),
    )
    _replace_partitions(rows, path, ["target", "experiment_id", "round"])
    return True


def append_scores(rows: DataFrame, path: str, batch: str) -> None:
    """Appends attempts, failed ones included. The same batch name replaces its own earlier write."""
    named = rows.withColumn("batch", F.lit(batch))
    _replace_partitions(named, path, ["target", "experiment_id", "al_round", "batch"])


def _replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_quarantine(errors: DataFrame, path: str, batch: str) -> None:
    _replace_partitions(errors.withColumn("batch", F.lit(batch)), path, ["batch"])


#: Tasks that write one partition value at most.
_WRITERS = 16


def update_from(updates: DataFrame, library: str, schema: T.StructType, by: str = "tranche") -> None:
    """Applies the updates to a library partitioned by `by`: only files that hold an updated row are written again.

    A run that broke off is finished or cleared first. Rows go out by partition value and id hash, so a huge tranche is still
    many tasks and a task writes few tranches. Of several updates of one id the one with the smallest values counts. One
    writer at a time.
    """
    spark = updates.sparkSession
    swap.finish(spark, library)
    rows = spark.read.schema(schema).parquet(library)
    updates = cut_lineage(updates.groupBy("id").agg(F.min(F.struct("mw", "logp")).alias("_u")).select("id", "_u.mw", "_u.logp"))
    hits = rows.select("id", F.col("_metadata.file_path").alias("_file")).join(updates, "id", "left_semi")
    touched = [r["_file"] for r in hits.select("_file").distinct().collect()]
    if not touched:
        return
    done = backfill(rows.where(F.col("_metadata.file_path").isin(touched)), updates)
    dealt = done.repartition(F.col(by), F.pmod(F.xxhash64("id"), F.lit(_WRITERS)))
    staged = swap.staging(library)
    dealt.write.partitionBy(by).parquet(staged)
    swap.decide(spark, library, staged, touched)
    swap.finish(spark, library)


def write_alert_report(hits: DataFrame, path: str) -> None:
    """One row per hit in its order of score: id, score, whether flagged, and the names of its alerts."""
    hits.orderBy("score", "compound_id").select(
        "compound_id", F.format_string("%.3f", "score").alias("score"), F.col("flagged").cast("int").alias("flagged"), "alert_names",
    ).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_fingerprints(fps: DataFrame, path: str, parts: int | None = None) -> None:
    """Sorted by id over the whole table, so an id range reads few row groups."""
    cols = [F.col("id")]
    ranged = fps.repartitionByRange(parts, *cols) if parts else fps.repartitionByRange(*cols)
    ranged.sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def write_predictions(pred: DataFrame, path: str, **attrs: str) -> bool:
    """Writes once. Done means committed: a folder left by a crash is written again."""
    if table_complete(pred.sparkSession, path):
        return False
    tagged = pred.select("*", *[F.lit(v).alias(k) for k, v in attrs.items()])
    tagged.write.mode("overwrite").parquet(path)
    return True


def write_group_report(stats: DataFrame, path: str) -> None:
    """Largest groups first, three decimals, rounds joined by a bar."""
    stats.orderBy(F.desc("n"), "best", "group_key").select(
        F.col("group_key"), F.col("n").alias("count"),
        F.format_string("%.3f", "best").alias("best_score"), F.format_string("%.3f", "worst").alias("worst_score"),
        joined_sorted(F.col("rounds")).alias("rounds"),
    ).write.mode("overwrite").csv(path, header=True, emptyValue="")


def append_round_metrics(row: DataFrame, path: str) -> None:
    """One typed row per round; unknown numbers stay NULL. A rerun of a round replaces its row."""
    _replace_partitions(row, path, ["target", "experiment_id", "round"])


def write_progress_snapshot(progress: DataFrame, history: str, latest: str, batch: int) -> None:
    """Appends to the CSV history under the batch's own folder and replaces the latest JSON."""
    progress.write.mode("overwrite").csv(f"{history}/batch={batch}", header=True)
    progress.coalesce(1).write.mode("overwrite").json(latest, ignoreNullFields=False)
