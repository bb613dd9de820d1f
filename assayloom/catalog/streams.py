"""Streams drained to their end, so that their tables can be compared with a batch answer."""

from pyspark.sql import functions as F

from assayloom import schemas
from assayloom.catalog.registry import query, rounded
from assayloom.catalog.sinks import LINES, staged
from assayloom.catalog.sources import lang_of, write_line_files
from assayloom.catalog.windowed import CHECKPOINTS
from assayloom.runtime import work_path
from assayloom.sinks.keyed import read_keyed
from assayloom.sources.files import stream_lines
from assayloom.streaming import ingest as SI, queue as Q, results as R


def result_feed(v, chunks: int = 3):
    """The scores as a folder that received them in id order, one write after the other."""
    folder = work_path(v.spark, "feed")
    rows = v.scores
    last = rows.agg(F.max("compound_id")).first()[0]
    for i in range(chunks):
        lo, hi = last * i // chunks, last * (i + 1) // chunks
        part = rows.where((F.col("compound_id") > lo) & (F.col("compound_id") <= hi)) if i else rows.where(F.col("compound_id") <= hi)
        part.coalesce(1).write.mode("append").parquet(folder)
    return R.read_results(v.spark, folder, rows.schema, files_per_trigger=1)


@query("st_results_append", "SELECT compound_id, target, experiment_id, al_round, score FROM v_scores")
def _(v):
    out = work_path(v.spark, "st-scores")
    R.append_results(result_feed(v), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return v.spark.read.schema(schemas.SCORES).parquet(f"{out}/table").drop("docked_at", "batch")


@query("st_running_best_n", CHECKPOINTS.replace("docked_at, compound_id", "compound_id").replace(" OR i = total", ""))
def _(v):
    out = work_path(v.spark, "st-best")
    R.running_best(
        result_feed(v), ["experiment_id"], ["compound_id"], f"{out}/table", f"{out}/state", f"{out}/checkpoint"
    ).awaitTermination()
    return v.spark.read.parquet(f"{out}/table").drop("batch")


@query("st_live_progress", """
    SELECT experiment_id, al_round, count(*) AS docked, count(score) AS valid, count(*) - count(score) AS failed, round(avg(score), 6) AS mean, min(score) AS best1
    FROM v_scores GROUP BY 1, 2""")
def _(v):
    out = work_path(v.spark, "st-live")
    R.live_progress(
        result_feed(v), ["experiment_id", "al_round"], f"{out}/history", f"{out}/latest", f"{out}/checkpoint"
    ).awaitTermination()
    schema = "experiment_id string, al_round int, docked long, valid long, failed long, mean double, best1 double"
    return rounded(v.spark.read.schema(schema).json(f"{out}/latest"), "mean")


@query("st_file_ingest", f"""
    WITH {LINES} SELECT zinc_id, count(*) AS n FROM c WHERE error_msg IS NULL GROUP BY 1""")
def _(v):
    out = work_path(v.spark, "st-ingest")
    line = F.concat(F.md5("text"), F.lit(" Z"), (F.col("doc_id") % 701).cast("string"))
    folder = write_line_files(v, "st-smi", line)
    SI.ingest_files(stream_lines(v.spark, folder, files_per_trigger=8), staged, out, f"{out}/checkpoint").awaitTermination()
    # How often each library key was offered; every offered key is in the library once.
    library = read_keyed(v.spark, f"{out}/compounds", schemas.COMPOUNDS).select("zinc_id")
    offered = v.table("documents").select(
        F.concat(F.lit("Z"), (F.col("doc_id") % 701).cast("string")).alias("zinc_id"), F.md5("text").alias("raw")
    ).where("substring(raw, 1, 1) not in ('0', '1', '2')")
    return library.join(offered, "zinc_id").groupBy("zinc_id").agg(F.count(F.lit(1)).alias("n"))


@query("st_queue_micro_batch", """
    SELECT experiment_id, compound_id, score IS NOT NULL AS prepared,
           CASE WHEN score IS NOT NULL THEN (row_number() OVER (PARTITION BY score IS NULL ORDER BY compound_id) - 1) // 100 END AS batch_no
    FROM v_scores""")
def _(v):
    out = work_path(v.spark, "st-queue")
    stream = result_feed(v).withColumn("prepared", F.col("score").isNotNull())
    order = ["compound_id"]
    Q.queue_micro_batches(
        stream, 100, order, f"{out}/queue", f"{out}/failed", f"{out}/state", f"{out}/checkpoint"
    ).awaitTermination()
    Q.finish_queue(v.spark, stream.schema, 100, order, f"{out}/queue", f"{out}/state")
    queued = v.spark.read.parquet(f"{out}/queue").select("experiment_id", "compound_id", "prepared", "batch_no")
    failed = v.spark.read.parquet(f"{out}/failed").select(
        "experiment_id", "compound_id", "prepared", F.lit(None).cast("long").alias("batch_no")
    )
    return queued.unionByName(failed)
