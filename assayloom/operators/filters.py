"""Row filters and small projections. All of them reach the scan as pushed filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayloom.functions.bits import is_nonzero


def in_scope(
    df: DataFrame, target: str, experiment_id: str, rnd: int | None = None, round_col: str = "al_round"
) -> DataFrame:
    """Rows of one experiment on one target, and of one round when given."""
    rows = df.where((F.col("target") == target) & (F.col("experiment_id") == experiment_id))
    return rows if rnd is None else rows.where(F.col(round_col) == rnd)


def valid_scores(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score").isNotNull())


def trainable(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    return scores.where(F.col("score") < threshold)


def threshold_null(score: Column, threshold: float) -> Column:
    """A score at or above the threshold counts as failed."""
    return F.when(score < threshold, score)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


def missing_properties(compounds: DataFrame, first_id: int | None = None, end_id: int | None = None) -> DataFrame:
    """Rows lacking either property, inside a half-open id range, that have a string to compute from."""
    rows = compounds.where(F.col("mw").isNull() | F.col("logp").isNull())
    if first_id is not None:
        rows = rows.where(F.col("id") >= first_id)
    if end_id is not None:
        rows = rows.where(F.col("id") < end_id)
    return rows.where(F.col("smiles").isNotNull() & (F.col("smiles") != ""))


def nonzero_fingerprints(fps: DataFrame) -> DataFrame:
    """An all-zero vector is at distance 1 from everything and would always be picked as diverse."""
    return fps.where(is_nonzero(F.col("fp")))


def todo(units: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Units without a completed entry in the status table."""
    return units.join(status.where(F.col("status") == "completed").select(key).distinct(), key, "left_anti")


def negative_logit(score: Column, temperature: float) -> Column:
    """Log weight of a softmax draw. No shift by the maximum is needed: Gumbel keys do not overflow."""
    return -score.cast("double") / F.lit(float(temperature))


def top_parsable(hits: DataFrame, n: int, parsable: Column) -> DataFrame:
    """The n best rows that parse. Filtering first makes any over-fetch needless."""
    return hits.where(parsable).orderBy("score", "compound_id").limit(n)
