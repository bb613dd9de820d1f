"""Key joins of the screening tables.

No side is forced to broadcast. Batches are small today but grow with the campaign, so the
planner and adaptive execution choose from measured sizes, and skewed keys are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from assayloom.operators.filters import in_scope, is_finite, valid_scores


def batch_with_compounds(batches: DataFrame, compounds: DataFrame, target: str, experiment_id: str, rnd: int) -> DataFrame:
    ids = in_scope(batches, target, experiment_id, rnd, "round").select(F.col("compound_id").alias("id"))
    return ids.join(compounds.select("id", "smiles"), "id")


def scores_with_compounds(
    scores: DataFrame, compounds: DataFrame, target: str, experiment_id: str, n: int | None = None
) -> DataFrame:
    """Valid scores with the compound's string and external id.

    With n, the best n matched rows are cut from a narrow join first, so that the wide text
    columns are read for n rows and not shuffled for all of them.
    """
    rows = valid_scores(in_scope(scores, target, experiment_id)).select("compound_id", "score", "al_round")
    wide = compounds.select(F.col("id").alias("compound_id"), "zinc_id", "smiles")
    if n is not None:
        known = compounds.select(F.col("id").alias("compound_id"))
        rows = rows.join(known, "compound_id", "left_semi").orderBy("score", "compound_id").limit(n)
    return rows.join(wide, "compound_id").select("compound_id", "zinc_id", "smiles", "score", "al_round")


def labels_with_features(labels: DataFrame, fps: DataFrame) -> DataFrame:
    return labels.join(fps, labels["compound_id"] == fps["id"]).select("id", "fp", "score")


def fingerprints_of(ids: DataFrame, fps: DataFrame) -> DataFrame:
    """Vectors for a list of ids; rows are matched by key, never by position."""
    return ids.select("id").join(fps.select("id", "fp"), "id")


def not_done(batches: DataFrame, scores: DataFrame, target: str, experiment_id: str, rnd: int) -> DataFrame:
    """Batch ids without a recorded attempt in the round. A failed attempt is an attempt."""
    batch = in_scope(batches, target, experiment_id, rnd, "round").select("compound_id")
    done = in_scope(scores, target, experiment_id, rnd).select("compound_id").distinct()
    return batch.join(done, "compound_id", "left_anti")


def used_ids(scores: DataFrame, batches: DataFrame, target: str, experiment_id: str) -> DataFrame:
    """Ids labelled or batched in the experiment, each once."""
    return (
        in_scope(scores, target, experiment_id).select(F.col("compound_id").alias("id"))
        .unionByName(in_scope(batches, target, experiment_id).select(F.col("compound_id").alias("id")))
        .distinct()
    )


def not_used(pred: DataFrame, scores: DataFrame, batches: DataFrame, target: str, experiment_id: str) -> DataFrame:
    return pred.join(used_ids(scores, batches, target, experiment_id), "id", "left_anti")


def only_known(rows: DataFrame, compounds: DataFrame) -> DataFrame:
    """Rows whose id exists in the library."""
    return rows.join(compounds.select("id"), "id", "left_semi")


def eligible(
    pred: DataFrame, compounds: DataFrame, scores: DataFrame, batches: DataFrame, target: str, experiment_id: str
) -> DataFrame:
    """Known, unused rows with a finite prediction."""
    finite = pred.where(is_finite(F.col("predicted")))
    return not_used(only_known(finite, compounds), scores, batches, target, experiment_id)


def as_of_rounds(rounds: DataFrame, hparams: DataFrame, by: list[str], value: str) -> DataFrame:
    """For every (group, round) the value of the latest round at or before it.

    Both sides hold one row per round here, so the union sorts per group instead of a range join.
    """
    stream = rounds.select(*by, "round").distinct().select(*by, "round", F.lit(None).alias("_v"), F.lit(1).alias("_side")).unionByName(
        hparams.select(*by, "round", F.col(value).alias("_v"), F.lit(0).alias("_side"))
    )
    w = Window.partitionBy(*by).orderBy("round", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        stream.withColumn(value, F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_side") == 1)
        .select(*by, "round", value)
    )


def latest_hparams(hparams: DataFrame, rnd: int) -> DataFrame:
    """The one parameter set in force at a round; NULL columns where none was saved yet."""
    return hparams.where(F.col("round") <= rnd).agg(
        F.max("round").alias("round"), F.max_by("params", "round").alias("params")
    )
