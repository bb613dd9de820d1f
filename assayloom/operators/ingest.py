"""Raw lines to library rows: validation, quarantine, first-wins de-duplication, backfill."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# The reasons under which a row is quarantined.
NOT_NORMALISED = "Protonation Failed"
NOT_PARSED = "RDKit Mol Conversion Failed"
CRASH_PREFIX = "Crash: "


def validate(
    lines: DataFrame, normalise: Callable[[Column], Column], mw: Callable[[Column], Column],
    logp: Callable[[Column], Column], parsable: Callable[[Column], Column],
    crash: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Adds smiles, mw, logp and error_msg (NULL for a good row) in one pass.

    The per-row chemistry is passed in as column functions: SQL expressions or pandas UDFs.
    `crash` gives the message of a row whose transform failed, NULL otherwise.
    """
    normal = normalise(F.col("raw"))
    message = crash(F.col("raw")) if crash else F.lit(None).cast("string")
    staged = lines.withColumn("smiles", normal).withColumn("_crash", message)
    reason = (
        F.when(F.col("_crash").isNotNull(), F.concat(F.lit(CRASH_PREFIX), F.col("_crash")))
        .when(F.col("smiles").isNull(), F.lit(NOT_NORMALISED))
        .when(~parsable(F.col("smiles")), F.lit(NOT_PARSED))
    )
    return staged.withColumn("error_msg", reason).withColumn("mw", mw(F.col("smiles"))).withColumn(
        "logp", logp(F.col("smiles"))
    ).drop("_crash")


def good_rows(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("error_msg").isNull())


def quarantined(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("error_msg").isNotNull()).select(
        "zinc_id", F.col("raw").alias("original_smiles"), "error_msg", "tranche"
    )


def first_per_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: the first in the given order.

    A minimum over (order, row) structs is combined before the shuffle, so a key repeated in a
    third of the rows reaches its reducer once per input split.
    """
    rest = [c for c in rows.columns if c != key and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in [*order, *rest]])


def backfill(compounds: DataFrame, updates: DataFrame) -> DataFrame:
    """Both properties replaced on every row that has an update; other rows as they were."""
    given = updates.select("id", F.col("mw").alias("_mw"), F.col("logp").alias("_logp"), F.lit(True).alias("_hit"))
    joined = compounds.join(given, "id", "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) if c in ("mw", "logp") else F.col(c) for c in compounds.columns])


def id_ranges(compounds: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """n contiguous inclusive id ranges; the last takes the remainder.

    Ranges are counted from 1 up to the highest id, one row each.
    """
    width = F.greatest(F.lit(1), F.floor(F.col("max_id") / n))
    start = F.col("k") * F.col("width") + 1
    return compounds.agg(F.max(id_col).alias("max_id")).withColumn("width", width).select(
        "max_id", "width", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    ).select(
        "k", start.cast("long").alias("start_id"),
        F.when(F.col("k") == n - 1, F.col("max_id")).otherwise(start + F.col("width") - 1).cast("long").alias("end_id"),
    ).where(F.col("start_id") <= F.col("end_id"))


def half_open_chunks(compounds: DataFrame, step: int, done: DataFrame, id_col: str = "id") -> DataFrame:
    """[start, start + step) chunks over the ids, without the starts already recorded as done."""
    starts = compounds.agg(F.max(id_col).alias("_max")).select(
        F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("_max", F.lit(1).cast("long")), F.lit(step).cast("long"))).alias("start_id")
    )
    return starts.join(done.select("start_id").distinct(), "start_id", "left_anti").withColumn(
        "end_id", F.col("start_id") + step
    )
