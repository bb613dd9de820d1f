"""Raw files to library, quarantine and manifest; missing properties to backfilled library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom import schemas
from assayloom.operators.filters import missing_properties
from assayloom.operators.ingest import good_rows, quarantined
from assayloom.sinks.keyed import insert_first
from assayloom.sinks.tables import read_or_empty, write_quarantine
from assayloom.runtime import delete_path
from assayloom.sources.files import list_files, read_lines


def mark_tranches(tranches: DataFrame, root: str, batch: str, status: str) -> None:
    """Writes the batch's part of the manifest anew."""
    rows = tranches.select("tranche").distinct().withColumn("status", F.lit(status)).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{root}/tranche_status")


def write_ingested(staged: DataFrame, root: str, batch: str, tranches: DataFrame | None = None) -> None:
    """Library rows, errors, then the manifest. A tranche is completed only after both tables hold it.

    tranches names what was read, also files without a usable line; by default those of the rows.

    The staged rows are written once, so that validation runs once and a lost executor cannot
    make the three outputs disagree.
    """
    spark = staged.sparkSession
    stage = f"{root}/staging/{batch}"
    staged.write.mode("overwrite").parquet(stage)
    rows = spark.read.schema(staged.schema).parquet(stage)
    insert_first(
        good_rows(rows).select("zinc_id", "tranche", "block", "pos", "smiles", "mw", "logp"),
        f"{root}/compounds", "zinc_id", ["tranche", "block", "pos"], schemas.COMPOUNDS, serial="id",
    )
    write_quarantine(quarantined(rows), f"{root}/ingestion_errors", batch)
    mark_tranches(tranches if tranches is not None else rows, root, batch, "completed")
    delete_path(spark, stage)


def ingest_folder(
    spark: SparkSession, folder: str, validate: Callable[[DataFrame], DataFrame], root: str, batch: str, glob: str = "*.smi"
) -> None:
    """Everything below a folder whose tranche is not completed yet.

    Files are listed first, and only those left are opened. Their tranches are marked as in processing before any work, so
    a run that breaks off leaves its claim behind and the next run takes them again.
    """
    status = read_or_empty(spark, f"{root}/tranche_status", schemas.TRANCHE_STATUS)
    done = status.where(F.col("status") == "completed").select("tranche").distinct()
    # One name per file and run: a list for the driver, as any file listing is.
    left = list_files(spark, folder, glob).join(done, "tranche", "left_anti").collect()
    if not left:
        return
    claimed = spark.createDataFrame(sorted({(r["tranche"],) for r in left}), "tranche string")
    mark_tranches(claimed, root, batch, "processing")
    write_ingested(validate(read_lines(spark, [r["file"] for r in left], glob)), root, batch, claimed)


def computed_updates(
    compounds: DataFrame, mw: Callable[[Column], Column], logp: Callable[[Column], Column],
    first_id: int | None = None, end_id: int | None = None,
) -> DataFrame:
    """Both properties for rows lacking either; rows whose string gives nothing are left alone."""
    todo = missing_properties(compounds, first_id, end_id).select("id", "smiles")
    found = todo.select("id", mw(F.col("smiles")).alias("mw"), logp(F.col("smiles")).alias("logp"))
    return found.where(F.col("mw").isNotNull() & F.col("logp").isNotNull())
