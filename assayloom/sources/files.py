"""Text, CSV, JSON and XML files as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayloom import schemas
from assayloom.functions.text import tokens, trailing_round, tranche_name

# One column per line: a separator that does not occur, and no quoting.
_LINE_OPTIONS = {
    "header": "true", "sep": "\u0001", "quote": "", "escape": "", "mode": "PERMISSIVE",
    "recursiveFileLookup": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def _raw_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def split_lines(raw: DataFrame) -> DataFrame:
    """(raw, zinc_id, tranche, file, block, pos) from lines; those of fewer than two tokens drop out.

    block and pos keep the order of lines inside a file, also when a large file is read in splits.
    """
    parts = raw.select(tokens(F.col("value")).alias("_t"), "file", "block", F.monotonically_increasing_id().alias("pos"))
    return parts.where(F.size("_t") >= 2).select(
        F.col("_t")[0].alias("raw"), F.col("_t")[1].alias("zinc_id"), tranche_name(F.col("file")).alias("tranche"),
        "file", "block", "pos",
    )


def list_files(spark: SparkSession, folder: str, glob: str = "*.smi") -> DataFrame:
    """(file, tranche) of all matching files below a folder; no file is opened."""
    found = spark.read.schema("value string").options(**_LINE_OPTIONS).option("pathGlobFilter", glob).csv(folder).inputFiles()
    return spark.createDataFrame([(unquote(f),) for f in found], "file string").withColumn("tranche", tranche_name(F.col("file")))


def read_lines(spark: SparkSession, folder: str | list[str], glob: str = "*.smi") -> DataFrame:
    """All matching files below a folder, or the given files, without each file's header line."""
    raw = spark.read.schema("value string").options(**_LINE_OPTIONS).option("pathGlobFilter", glob).csv(folder)
    return split_lines(_raw_lines(raw))


def stream_lines(spark: SparkSession, folder: str, glob: str = "*.smi", files_per_trigger: int = 1000) -> DataFrame:
    """Unsplit lines as a stream; a micro-batch is numbered and split by split_lines."""
    return _raw_lines(
        spark.readStream.schema("value string").options(**_LINE_OPTIONS).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    )


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, schema=schema)


def read_progress(spark: SparkSession, path: str, round_of: Callable[[Column], Column] = trailing_round) -> DataFrame:
    """Progress rows with al_round from the file name.

    An empty best cell is NULL. A row with a cell that is neither empty nor a number is left out.
    """
    text = spark.read.csv(path, header=True, schema=schemas.PROGRESS_TEXT).withColumn(
        "al_round", round_of(F.col("_metadata.file_path"))
    )
    best = ["best1", "best10", "best100", "best1000"]
    num = lambda c: F.col(c).try_cast("double").alias(c)
    sound = F.col("docked").try_cast("long").isNotNull()
    for c in best:
        cell = F.coalesce(F.col(c), F.lit(""))
        sound = sound & ((cell == "") | cell.try_cast("double").isNotNull())
    return text.where(sound).select("al_round", F.col("docked").try_cast("long").alias("docked"), *[num(c) for c in best])


def read_metrics_json(spark: SparkSession, path: str, round_of: Callable[[Column], Column] = trailing_round) -> DataFrame:
    """(round, val_rmse, ...) from one JSON object per file; files without the error or a round drop out."""
    rows = spark.read.schema(schemas.TRAINING_METRICS).option("multiLine", True).json(path)
    return rows.select(round_of(F.col("_metadata.file_path")).alias("round"), "*").where(
        F.col("val_rmse").isNotNull() & F.col("round").isNotNull()
    )


def read_hparams_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True)
    return rows.select(
        trailing_round(F.col("_metadata.file_path")).alias("round"),
        F.from_json("value", "map<string,double>").alias("params"),
    ).where(F.col("round").isNotNull())


# The two tags under which a result file may hold its energies.
_FIRST_TAG, _SECOND_TAG = "best_energy", "free_NRG_binding"


def best_energy(xml: Column, threshold: float = 0.0) -> Column:
    """Lowest energy of one result document.

    The second tag counts only where the first has no value. NULL without any value, for broken
    XML, and for a best value at or above the threshold. Well-formedness is asked of the
    permissive parser first: the path functions throw on a broken document.
    """
    parsed = F.from_xml(xml, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    sound = F.when(parsed["_corrupt_record"].isNull(), xml)

    def lowest(tag: str) -> Column:
        values = F.xpath(sound, F.lit(f"//{tag}/text()"))
        return F.array_min(F.array_compact(F.transform(values, lambda v: F.trim(v).try_cast("double"))))

    best = F.coalesce(lowest(_FIRST_TAG), lowest(_SECOND_TAG))
    return F.when(best < threshold, best)


def _results(files: DataFrame, threshold: float) -> DataFrame:
    cid = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)[^/\d]*$", 1).try_cast("long")
    return files.select(cid.alias("compound_id"), best_energy(F.col("value"), threshold).alias("score"))


def read_result_xml(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """(compound_id, score) from one result file per compound; the id is the number in the file name."""
    return _results(spark.read.text(path, wholetext=True), threshold)


def stream_result_xml(spark: SparkSession, path: str, threshold: float = 0.0, files_per_trigger: int = 10_000) -> DataFrame:
    """The same as a stream: result files are picked up as they arrive."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    return _results(files, threshold)
