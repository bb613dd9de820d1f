"""Score summaries. Every one is a partial aggregate first, so a hot round or key costs no more than others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayloom.functions.binning import bin_inside
from assayloom.operators.filters import in_scope, valid_scores
from assayloom.operators.ranking import exact_percentiles, nth_best, smallest_k, top_n_by_group
from assayloom.runtime import cut_lineage, join_keys

BEST_NS = (1, 10, 100, 1000)
# The score thresholds and percentiles that the reports quote.
HIT_THRESHOLDS = (-12.0, -13.0, -14.0, -15.0)
ROUND_PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def round_summary(scores: DataFrame, target: str, experiment_id: str, rnd: int) -> DataFrame:
    return in_scope(scores, target, experiment_id, rnd).agg(
        F.count("score").alias("n_valid"),
        F.count_if(F.col("score").isNull()).alias("n_failed"),
        F.min("score").alias("best"),
        F.avg("score").alias("mean"),
    )


def n_screened(scores: DataFrame, by: Sequence[str] = ("target", "experiment_id")) -> DataFrame:
    """Valid rows per round and up to each round."""
    per_round = valid_scores(scores).groupBy(*by, "al_round").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy("al_round").rowsBetween(Window.unboundedPreceding, 0)
    return per_round.withColumn("n_cumulative", F.sum("n").over(w))


def best_n(scores: DataFrame, target: str, experiment_id: str, rnd: int) -> DataFrame:
    rows = in_scope(scores, target, experiment_id, rnd)
    return nth_best(rows, ["al_round"], "score", BEST_NS)


def round_percentiles(scores: DataFrame, by: Sequence[str] = ("experiment_id", "al_round")) -> DataFrame:
    return exact_percentiles(
        scores, by, "score", ROUND_PERCENTILES, {"mean": F.avg("score"), "best1": F.min("score")}
    )


def distribution_shift(scores: DataFrame, by: Sequence[str] = ("al_round",)) -> DataFrame:
    return exact_percentiles(scores, by, "score", ROUND_PERCENTILES, {"best": F.min("score")}).drop("n")


def hit_rates(
    scores: DataFrame, by: Sequence[str] = ("al_round",), thresholds: Sequence[float] = HIT_THRESHOLDS
) -> DataFrame:
    """Percent of valid scores strictly below each threshold, one row per group and threshold."""
    counted = valid_scores(scores).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("score") < t).alias(f"_h{i}") for i, t in enumerate(thresholds)],
    )
    pairs = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"_h{i}").alias("hits")) for i, t in enumerate(thresholds)]
    )
    return counted.select(*by, "n", F.inline(pairs)).select(
        *by, "threshold", (F.col("hits").cast("double") * 100 / F.col("n")).alias("pct")
    )


def fold_enrichment(rates: DataFrame, round_col: str = "al_round") -> DataFrame:
    """Last round's rate over the first round's, per threshold."""
    ends = rates.groupBy("threshold").agg(
        F.min_by("pct", round_col).alias("first_pct"), F.max_by("pct", round_col).alias("last_pct")
    )
    return ends.withColumn("fold", F.when(F.col("first_pct") > 0, F.col("last_pct") / F.col("first_pct")))


def scores_by_round(scores: DataFrame, by: Sequence[str] = ("al_round",)) -> DataFrame:
    """Each round's scores as (value, copies), which holds the same multiset as an array would.

    A list of all scores of a round would sit in one row of one task; this stays distributed.
    """
    return valid_scores(scores).groupBy(*by, "score").agg(F.count(F.lit(1)).alias("copies"))


def watch_progress(batches: DataFrame, scores: DataFrame, target: str, experiment_id: str) -> DataFrame:
    """Per round: queued, docked, valid, percent done, mean and n-th best."""
    queued = (
        in_scope(batches, target, experiment_id).groupBy(F.col("round").alias("al_round"))
        .agg(F.count(F.lit(1)).alias("queued"))
    )
    mine = in_scope(scores, target, experiment_id)
    docked = mine.groupBy("al_round").agg(
        F.count(F.lit(1)).alias("docked"), F.count("score").alias("valid"), F.avg("score").alias("mean")
    )
    done = join_keys(docked, nth_best(mine, ["al_round"], "score", BEST_NS), ["al_round"], "left")
    return full_progress(queued, done)


def full_progress(queued: DataFrame, done: DataFrame) -> DataFrame:
    """Rounds known to either side: a missing count is 0, a missing score stays NULL."""
    counts = [c for c in ("queued", "docked", "valid") if c in queued.columns + done.columns]
    both = queued.join(done, "al_round", "full_outer")
    rest = [c for c in both.columns if c not in ("al_round", *counts)]
    out = both.select("al_round", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts], *rest)
    pct = F.when(F.col("queued") > 0, F.col("docked").cast("double") * 100 / F.col("queued"))
    return out.withColumn("pct", pct)


def flag_rate_by_round(flags: DataFrame) -> DataFrame:
    counted = flags.groupBy("al_round").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("flagged")).alias("n_flagged")
    )
    flagged = F.col("n_flagged").cast("double") * 100 / F.col("total")
    return counted.withColumn("pct_flagged", flagged).withColumn("pct_clean", F.lit(100.0) - flagged)


def alert_counts(flags: DataFrame, k: int = 15) -> DataFrame:
    """How many rows each alert matched; the k most frequent."""
    return (
        # The outer form, as the plain one makes the planner match all patterns once more in a filter.
        flags.select(F.explode_outer("alerts").alias("alert")).where("alert is not null").groupBy("alert").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "alert").limit(k)
    )


def group_key_stats(keyed: DataFrame) -> DataFrame:
    """Per key: rows, best, worst, and the rounds it occurs in.

    Grouped by (key, round) first: the set of rounds is then built from one row per round.
    """
    per_round = keyed.groupBy("group_key", "al_round").agg(
        F.count(F.lit(1)).alias("_n"), F.min("score").alias("_b"), F.max("score").alias("_w")
    )
    return per_round.groupBy("group_key").agg(
        F.sum("_n").alias("n"), F.min("_b").alias("best"), F.max("_w").alias("worst"),
        F.array_sort(F.collect_list("al_round")).alias("rounds"),
    )


def group_rank(stats: DataFrame, k: int = 20) -> DataFrame:
    return stats.orderBy(F.desc("n"), "best", "group_key").limit(k)


def entropy(keyed: DataFrame, key: str = "group_key") -> DataFrame:
    """Shannon entropy in bits over key counts, with unique and singleton keys.

    H = log2 N - sum(n log2 n) / N needs no second pass for the total.
    """
    sizes = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_unique"),
        F.count_if(F.col("n") == 1).alias("n_single"),
        F.sum(F.col("n") * F.log2("n")).alias("_nlogn"),
    )
    h = F.log2("n_rows") - F.col("_nlogn") / F.col("n_rows")
    pct = F.col("n_single").cast("double") * 100 / F.col("n_unique")
    return out.select("n_rows", "n_unique", "n_single", pct.alias("pct_single"), h.alias("entropy_bits"))


def novelty_summary(sims: DataFrame, by: Sequence[str] = ("al_round",)) -> DataFrame:
    """Per round: n, median and mean of the highest similarity, and how much of it is above 0.4 and 0.6.

    The median reads its rows twice; the checkpoint keeps that from computing similarities twice.
    """
    share = lambda t: (F.count_if(F.col("max_sim") > t).cast("double") * 100 / F.count(F.lit(1)))
    sims = cut_lineage(sims.select(*by, "max_sim"))
    also = {"mean": F.avg("max_sim"), "pct04": share(0.4), "pct06": share(0.6)}
    return exact_percentiles(sims, by, "max_sim", {"median": 0.5}, also)


def experiment_table(scores: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per experiment and round: n, best, median, mean, deep-hit rates, and the model error from the log."""
    by = ["experiment_id", "al_round"]
    below = lambda t: F.count_if(F.col("score") < t).cast("double") * 100 / F.count(F.lit(1))
    also = {"best1": F.min("score"), "mean": F.avg("score"), "pct14": below(-14.0), "pct15": below(-15.0)}
    stats = exact_percentiles(scores, by, "score", {"median": 0.5}, also)
    log = metrics.where(F.col("val_rmse").isNotNull()).select(
        "experiment_id", F.col("round").alias("al_round"), "val_rmse", F.col("best1").alias("log_best1")
    )
    return stats.join(log, by, "left")


def side_by_side(table: DataFrame, value: str, experiments: Sequence[str]) -> DataFrame:
    """One column per experiment. The names are given, so no extra job looks them up."""
    return table.groupBy("al_round").pivot("experiment_id", list(experiments)).agg(F.first(value))


def slot_summary(scores: DataFrame, all_slot: int = -1) -> DataFrame:
    """n, best and mean per round, and over all rounds under the slot number given."""
    rows = valid_scores(scores)
    out = rows.rollup("al_round").agg(
        F.grouping("al_round").alias("_all"), F.count(F.lit(1)).alias("n"),
        F.min("score").alias("best"), F.avg("score").alias("mean"),
    )
    slot = F.when(F.col("_all") == 1, F.lit(all_slot)).otherwise(F.col("al_round"))
    return out.select(slot.alias("slot"), "n", "best", "mean")


def hist1d(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per bin on [lo, hi]; values outside are dropped, the right edge belongs to the last bin."""
    b = bin_inside(F.col(value).cast("double"), lo, (hi - lo) / bins, bins)
    return df.select(b.alias("bin")).where(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def preflight(compounds: DataFrame) -> DataFrame:
    out = compounds.agg(F.count("id").alias("n"), F.max("id").alias("max_id"))
    return out.withColumn("gaps", F.col("max_id") - F.col("n"))


def valid_fill(fps: DataFrame, compounds: DataFrame) -> DataFrame:
    """How many vectors belong to a library row: one left join, one aggregate."""
    known = compounds.select("id").distinct().withColumn("_known", F.lit(1))
    out = fps.select("id").join(known, "id", "left").agg(
        F.count("_known").alias("n_valid"), F.count(F.lit(1)).alias("n")
    )
    return out.withColumn("pct", F.col("n_valid").cast("double") * 100 / F.col("n"))


def library_counts(compounds: DataFrame, status: DataFrame) -> DataFrame:
    """Molecules, completed tranches and tranches in work, as (what, n) rows."""
    molecules = compounds.agg(F.count(F.lit(1)).alias("n")).select(F.lit("molecules").alias("what"), "n")
    tranches = status.where(F.col("status").isin("completed", "processing")).groupBy(
        F.concat(F.lit("tranches_"), F.col("status")).alias("what")
    ).agg(F.count(F.lit(1)).alias("n"))
    return molecules.unionByName(tranches)


def job_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def failure_taxonomy(attempts: DataFrame, examples: dict[str, int] | None = None) -> DataFrame:
    """Failures per (stage, category) with the first few ids of each.

    Examples are ranked and cut before they are gathered, so no list grows with the failures.
    """
    quota = examples or {"prep": 5, "dock": 3}
    failed = attempts.where(F.col("category").isNotNull())
    counts = failed.groupBy("stage", "category").agg(F.count(F.lit(1)).alias("n"))
    most = max(quota.values())
    limit = F.lit(most)
    for stage, n in quota.items():
        limit = F.when(F.col("stage") == stage, F.lit(n)).otherwise(limit)
    first = (
        top_n_by_group(failed.select("stage", "category", "compound_id"), ["stage", "category"], ["compound_id"], most)
        .where(F.col("rank") <= limit)
        .groupBy("stage", "category")
        .agg(F.array_sort(F.collect_list("compound_id")).alias("examples"))
    )
    return counts.join(first, ["stage", "category"], "left")


def score_range(scores: DataFrame) -> DataFrame:
    return valid_scores(scores).agg(
        F.count(F.lit(1)).alias("n_valid"), F.min("score").alias("min"), F.avg("score").alias("mean"),
        F.max("score").alias("max"),
    )


def rmse(pairs: DataFrame, predicted: str = "predicted", actual: str = "score") -> DataFrame:
    err = F.col(predicted) - F.col(actual)
    return pairs.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.count(err).alias("n"))


def selection_quality(batch: DataFrame, pred: DataFrame) -> DataFrame:
    return batch.select("id").join(pred, "id").agg(
        F.min("predicted").alias("min"), F.max("predicted").alias("max"), F.avg("predicted").alias("mean"),
        F.count(F.lit(1)).alias("n"),
    )


def round_distribution_topk(scores: DataFrame, k: int = 50) -> DataFrame:
    """From which rounds the k best scores come."""
    best = smallest_k(valid_scores(scores), "score", ["compound_id"], k)
    return best.groupBy("al_round").agg(F.count(F.lit(1)).alias("n"))


def batch_by_source(batches: DataFrame) -> DataFrame:
    return batches.groupBy("experiment_id", "round", "source").agg(F.count(F.lit(1)).alias("n"))
