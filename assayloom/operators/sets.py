"""Set operations between experiments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from assayloom.operators.filters import valid_scores
from assayloom.operators.ranking import smallest_k


def rounds_union(*tables: tuple[DataFrame, str]) -> DataFrame:
    """All rounds present in any table; each table is reduced to its rounds first."""
    out = None
    for df, col in tables:
        rounds = df.select(F.col(col).alias("al_round")).distinct()
        out = rounds if out is None else out.unionByName(rounds)
    return out.distinct()


def overlap_ids(scores: DataFrame, a: str, b: str, library_rows: int) -> DataFrame:
    """Ids labelled in both experiments: per round of the first, in total (round NULL), and by chance.

    Sides are told apart by flags in one aggregate per id, so no join is needed. Two draws of a and b rows from N share
    a * b / N by chance.
    """
    rows = scores.where(F.col("experiment_id").isin(a, b)).select("compound_id", "experiment_id", "al_round")
    in_a, in_b = F.col("experiment_id") == a, F.col("experiment_id") == b
    per_id = rows.groupBy("compound_id").agg(
        F.min(F.when(in_a, F.col("al_round"))).alias("al_round"),
        F.max(in_b.cast("int")).alias("_in_b"),
        F.max(in_a.cast("int")).alias("_in_a"),
    )
    n_b = per_id.agg(F.count_if(F.col("_in_b") == 1)).first()[0]
    return (
        per_id.where(F.col("_in_a") == 1).rollup("al_round").agg(
            F.count_if(F.col("_in_b") == 1).alias("n_shared"), F.count(F.lit(1)).alias("n_a")
        ).withColumn("expected", F.col("n_a").cast("double") * F.lit(float(n_b)) / F.lit(float(library_rows)))
    )


def overlap_keys(
    keyed: DataFrame, side: str, a: str, b: str, key: str = "group_key", top: Sequence[int] = ()
) -> DataFrame:
    """Unique keys per side, shared and in total; also within the best rows of each side."""
    def counts(rows: DataFrame, label: str) -> DataFrame:
        sides = rows.groupBy(key).agg(
            F.max((F.col(side) == a).cast("int")).alias("_a"), F.max((F.col(side) == b).cast("int")).alias("_b")
        )
        return sides.agg(
            F.lit(label).alias("within"),
            F.count_if(F.col("_a") == 1).alias("n_a"),
            F.count_if(F.col("_b") == 1).alias("n_b"),
            F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_shared"),
            F.count_if((F.col("_a") == 1) | (F.col("_b") == 1)).alias("n_union"),
        )

    rows = valid_scores(keyed).where(F.col(side).isin(a, b))
    out = counts(rows, "all")
    for k in top:
        best = smallest_k(rows.where(F.col(side) == a), "score", ["compound_id"], k).unionByName(
            smallest_k(rows.where(F.col(side) == b), "score", ["compound_id"], k)
        )
        out = out.unionByName(counts(best, f"top{k}"))
    return out
