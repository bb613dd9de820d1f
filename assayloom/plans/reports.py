"""The campaign's reports, each a set of named DataFrames. Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayloom.operators import aggregates as A, density as D
from assayloom.operators.features import pattern_flags, with_group_key
from assayloom.operators.filters import in_scope, top_parsable, valid_scores
from assayloom.operators.joins import scores_with_compounds
from assayloom.operators.similarity import max_similarity, max_similarity_self
from assayloom.operators.windows import cumulative_best_n, delta_best1, round_offset_curve


def top_hits(
    scores: DataFrame, compounds: DataFrame, target: str, experiment_id: str, n: int = 50, parsable: Column | None = None
) -> DataFrame:
    """The n best rows with their strings; with `parsable`, the n best that parse."""
    if parsable is None:
        return scores_with_compounds(scores, compounds, target, experiment_id, n)
    return top_parsable(scores_with_compounds(scores, compounds, target, experiment_id), n, parsable)


def alert_report(
    hits: DataFrame, catalogue: Sequence[tuple[str, str]], text: str = "smiles", parsable: Column | None = None, k: int = 15
) -> dict[str, DataFrame]:
    """Pattern alerts among hits: per row, per round, and the most frequent alerts."""
    flags = pattern_flags(hits, catalogue, text, parsable)
    rows = flags.select("compound_id", "zinc_id", "score", "al_round", "flagged", "alert_names")
    return {"rows": rows, "by_round": A.flag_rate_by_round(flags), "alerts": A.alert_counts(flags, k)}


def group_report(hits: DataFrame, key, text: str = "smiles", k: int = 20) -> dict[str, DataFrame]:
    """Group keys among hits: statistics per key, the largest groups, diversity, and rows without a key."""
    keyed = with_group_key(hits, text, key)
    known = keyed.where(F.col("group_key").isNotNull())
    stats = A.group_key_stats(known)
    failed = keyed.agg(F.count_if(F.col("group_key").isNull()).alias("n_failed"))
    return {"groups": stats, "largest": A.group_rank(stats, k), "diversity": A.entropy(known), "failed": failed}


def novelty_report(scores: DataFrame, fps: DataFrame, target: str, experiment_id: str) -> dict[str, DataFrame]:
    """Highest similarity of every labelled row to the round-0 set; round 0 against its own other rows."""
    rows = valid_scores(in_scope(scores, target, experiment_id)).select(
        F.col("compound_id").alias("id"), "score", "al_round"
    ).join(fps.select("id", "fp"), "id")
    seed = rows.where("al_round = 0").select("id", "fp")
    sims = max_similarity_self(seed).unionByName(max_similarity(rows.where("al_round > 0").select("id", "fp"), seed))
    points = rows.select("id", "score", "al_round").join(sims, "id")
    return {"rows": points, "by_round": A.novelty_summary(points)}


def distribution_report(scores: DataFrame, target: str, experiment_id: str) -> dict[str, DataFrame]:
    rows = in_scope(scores, target, experiment_id)
    return {
        "values": A.scores_by_round(rows), "hit_rates": A.hit_rates(rows), "shift": A.distribution_shift(rows),
        "fold_enrichment": A.fold_enrichment(A.hit_rates(rows)),
    }


def discovery_report(scores: DataFrame, progress: DataFrame, metrics: DataFrame, target: str) -> dict[str, DataFrame]:
    """Cumulative best-n per experiment, the within-round curve moved to its place, and model error by round."""
    rows = scores.where(F.col("target") == target)
    error = metrics.where(F.col("val_rmse").isNotNull()).select("experiment_id", "round", "val_rmse")
    return {"cumulative": cumulative_best_n(rows), "within_round": round_offset_curve(progress, rows), "error": error}


def comparison_report(scores: DataFrame, metrics: DataFrame, target: str, experiments: Sequence[str]) -> dict[str, DataFrame]:
    rows = scores.where((F.col("target") == target) & F.col("experiment_id").isin(*experiments))
    table = A.experiment_table(rows, metrics)
    return {
        "table": table, "percentiles": A.round_percentiles(rows),
        "best_side_by_side": A.side_by_side(table, "best1", experiments), "best_delta": delta_best1(metrics),
    }


def diversity_report(background: DataFrame, picks: DataFrame, other: DataFrame, bins: int = 150, min_bg: int = 3) -> dict[str, DataFrame]:
    """Two pick sets against one background on shared bins."""
    edges = D.edges_of([background, picks, other], bins)
    a, b = D.density_ratio(background, picks, edges, min_bg), D.density_ratio(background, other, edges, min_bg)
    return {
        "ratio": a, "ratio_other": b, "difference": D.bins_diff(a, b), "summary": D.ratio_summary(a),
        "summary_other": D.ratio_summary(b), "comparison": D.ratio_compare(a, b),
        "coverage": D.coverage_fraction(background, picks, edges, min_bg),
        "log_density": D.log_density(background, picks, edges), "levels": D.contour_levels(D.hist2d(background, edges)),
    }
