"""Running and windowed reports."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from assayloom.functions.hashing import uniform
from assayloom.operators.aggregates import BEST_NS
from assayloom.operators.filters import valid_scores
from assayloom.operators.ranking import nth_best, rank_within, top_n_by_group
from assayloom.runtime import cut_lineage, join_keys


def delta_best1(metrics: DataFrame, by: Sequence[str] = ("experiment_id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("round")
    return metrics.select(*by, "round", "best1", (F.col("best1") - F.lag("best1").over(w)).alias("delta"))


def cumulative_best_n(
    scores: DataFrame, by: Sequence[str] = ("experiment_id",), ns: Sequence[int] = BEST_NS
) -> DataFrame:
    """After each round: valid rows so far and the n-th best over all rounds so far.

    Only a round's best max(ns) rows can matter later, so those alone are carried to later rounds.
    """
    rows = valid_scores(scores).select(*by, "al_round", "score")
    sizes = rows.groupBy(*by, "al_round").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("al_round").rowsBetween(Window.unboundedPreceding, 0)
    totals = sizes.select(*by, "al_round", F.sum("_n").over(w).alias("cum_docked"))
    rounds = sizes.groupBy(*by).agg(F.collect_list("al_round").alias("_rounds"))
    top = top_n_by_group(rows, [*by, "al_round"], ["score"], max(ns)).drop("rank")
    later = F.filter("_rounds", lambda r: r >= F.col("al_round"))
    carried = join_keys(top, rounds, list(by)).select(*by, F.explode(later).alias("at"), "score")
    best = nth_best(carried, [*by, "at"], "score", ns).withColumnRenamed("at", "al_round")
    return join_keys(totals, best, [*by, "al_round"])


def _running_best(ns: Sequence[int], every: int, at_end: bool):
    """Per-block helper: walk one block in arrival order and emit a row at every checkpoint."""
    keep = max(ns)

    def walk(key, rows: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        arrival = rows["_i"].to_numpy()
        scores = rows["score"].to_numpy(dtype=float)
        start = carry.iloc[0]
        best = np.asarray(start["_top"], dtype=float)
        valid, total = int(start["_valid_before"]), int(start["_total"])
        stops = np.flatnonzero((arrival % every == 0) | (at_end & (arrival == total))) + 1
        out, begin = [], 0
        for stop in stops:
            seg = scores[begin:stop]
            seg = seg[~np.isnan(seg)]
            valid += len(seg)
            best = np.sort(np.concatenate([best, seg]))[:keep]
            docked = int(arrival[stop - 1])
            nth = [float(best[n - 1]) if len(best) >= n else None for n in ns]
            out.append((*key[:-1], docked, valid, docked - valid, *nth))
            begin = stop
        return pd.DataFrame(out, columns=list(walk.columns))

    return walk


def progress_checkpoints(
    results: DataFrame, by: Sequence[str], arrival: Sequence[str], every: int = 500,
    ns: Sequence[int] = BEST_NS, block_rows: int | None = None, state: DataFrame | None = None,
    at_end: bool = True,
) -> DataFrame:
    """In arrival order, at every `every` results and at the end: docked, valid, failed, n-th best.

    `state` (feed_state of everything before) continues feeds that began earlier.

    A feed is cut into blocks. Each block's best rows are found in parallel; one small pass per
    feed turns them into the best list before each block; then all blocks are walked in parallel.
    With blocks of sqrt(keep * rows) neither step holds more than about that many rows at once.
    """
    keep = max(ns)
    numbered = rank_within(results.select(*by, *arrival, "score"), by, arrival, "_i").select(*by, "_i", "score")
    if state is None:
        before_all = results.select(*by).limit(0).select(
            *by, F.lit(0).cast("long").alias("docked"), F.lit(0).cast("long").alias("valid"),
            F.array().cast("array<double>").alias("top"),
        )
    else:
        before_all = state.select(*by, "docked", "valid", "top")
        numbered = join_keys(numbered, before_all.select(*by, F.col("docked").alias("_d0")), list(by), "left").select(
            *by, (F.col("_i") + F.coalesce("_d0", F.lit(0))).alias("_i"), "score"
        )
    if block_rows is None:
        longest = results.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
        block_rows = max(100_000, int(math.sqrt(keep * longest)))
    block_rows = max(every, block_rows // every * every)
    blocks = numbered.withColumn("_b", F.floor((F.col("_i") - 1) / block_rows))
    sizes = blocks.groupBy(*by, "_b").agg(F.count("score").alias("_valid"), F.max("_i").alias("_last"))
    so_far = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    sizes = join_keys(sizes.select(
        *by, "_b", F.coalesce(F.sum("_valid").over(so_far), F.lit(0)).alias("_valid_here"),
        F.max("_last").over(whole).alias("_total"),
    ), before_all.select(*by, "valid", "top"), list(by), "left").select(
        *by, "_b", "_total", (F.col("_valid_here") + F.coalesce("valid", F.lit(0))).alias("_valid_before"),
        F.col("top").alias("_start"),
    )
    tops = (
        top_n_by_group(blocks.where(F.col("score").isNotNull()), [*by, "_b"], ["score"], keep)
        .groupBy(*by, "_b").agg(F.array_sort(F.collect_list("score")).alias("_own"))
    )
    key_fields = [results.schema[c] for c in by]
    carry_schema = T.StructType([*key_fields, T.StructField("_b", T.LongType()), T.StructField("_top", T.ArrayType(T.DoubleType()))])

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_b")
        start = pdf["_start"].iloc[0]
        best, before = np.empty(0) if start is None else np.asarray(start, dtype=float), []
        for own in pdf["_own"]:
            before.append(best)
            if own is not None:
                best = np.sort(np.concatenate([best, np.asarray(own, dtype=float)]))[:keep]
        return pdf[[*by, "_b"]].assign(_top=before)

    before = join_keys(sizes, tops, [*by, "_b"], "left").groupBy(*by).applyInPandas(carry, carry_schema)
    carried = join_keys(sizes.drop("_start"), before, [*by, "_b"])
    out_schema = T.StructType([
        *key_fields,
        *[T.StructField(c, T.LongType()) for c in ("docked", "valid", "failed")],
        *[T.StructField(f"best{n}", T.DoubleType()) for n in ns],
    ])
    walk = _running_best(ns, every, at_end)
    walk.columns = out_schema.names
    keys = [*by, "_b"]
    right = carried.select(*[F.col(c).alias(f"{c}_r" if c in keys else c) for c in carried.columns])
    return blocks.groupBy(*keys).cogroup(right.groupBy(*[f"{k}_r" for k in keys])).applyInPandas(walk, out_schema)


def feed_state(
    results: DataFrame, by: Sequence[str], state: DataFrame | None = None, keep: int = max(BEST_NS)
) -> DataFrame:
    """Per feed: docked, valid and the best `keep` scores, on top of an earlier state."""
    counts = results.groupBy(*by).agg(F.count(F.lit(1)).alias("docked"), F.count("score").alias("valid"))
    pool = results.where(F.col("score").isNotNull()).select(*by, "score")
    if state is not None:
        counts = counts.unionByName(state.select(*by, "docked", "valid")).groupBy(*by).agg(
            F.sum("docked").alias("docked"), F.sum("valid").alias("valid")
        )
        pool = pool.unionByName(state.select(*by, F.explode("top").alias("score")))
    tops = top_n_by_group(pool, by, ["score"], keep).groupBy(*by).agg(F.array_sort(F.collect_list("score")).alias("top"))
    return join_keys(counts, tops, list(by), "left").select(
        *by, "docked", "valid", F.coalesce("top", F.array().cast("array<double>")).alias("top")
    )


def round_offset_curve(progress: DataFrame, scores: DataFrame, by: Sequence[str] = ("experiment_id",)) -> DataFrame:
    """Progress inside a round, moved right by the valid rows of all earlier rounds."""
    sizes = valid_scores(scores).groupBy(*by, "al_round").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("al_round").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "al_round", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    moved = progress.join(offsets, [*by, "al_round"])
    return moved.withColumn("x", F.col("docked") + F.col("_offset")).drop("_offset")


def decile_split(labelled: DataFrame, frac: float = 0.1, seed: int = 42) -> DataFrame:
    """Validation rows drawn from every score decile: max(1, floor(frac * rows)) by seeded hash.

    Both ranks are distributed ones, so no decile is sorted in a single task.
    """
    ranked = rank_within(labelled, [], ["score", "id"], "_r")
    n = ranked.count()
    deciles = ranked.withColumn("decile", F.floor((F.col("_r") - 1) * 10 / F.lit(max(n, 1))).cast("int")).drop("_r")
    drawn = rank_within(deciles.withColumn("_u", uniform(F.col("id"), seed)), ["decile"], ["_u", "id"], "_pick")
    sizes = deciles.groupBy("decile").agg(F.count(F.lit(1)).alias("_size"))
    quota = F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(float(frac))))
    return (
        drawn.join(sizes, "decile").withColumn("is_val", F.col("_pick") <= quota)
        .select(*labelled.columns, "decile", "is_val")
    )


def kfold(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Shuffled folds whose sizes differ by one at most."""
    ranked = rank_within(rows.withColumn("_u", uniform(F.col("id"), seed)), [], ["_u", "id"], "_r")
    return ranked.select(*rows.columns, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int").alias("fold"))


def cumulative_share_cut(sizes: DataFrame, key: str, weight: str, cut: float = 0.95) -> DataFrame:
    """The first groups, largest first, that together reach the wanted share of the total.

    The running sum follows the same two levels as a distributed rank: inside range partitions,
    then over one total per partition.
    """
    ordered = sizes.withColumn("_w", -F.col(weight))
    placed = cut_lineage(
        ordered.repartitionByRange("_w", key).sortWithinPartitions("_w", key)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    earlier = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    starts = parts.select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("_run", F.sum(weight).over(inside)).join(starts, "_part")
    cum = F.col("_before") + F.col("_run")
    return out.where((cum - F.col(weight)) / F.col("_total") < cut).select(
        key, weight, (cum / F.col("_total")).alias("cum_share")
    )


def first_n_per_file(lines: DataFrame, file_col: str, order: Sequence[str], n: int = 1000) -> DataFrame:
    return top_n_by_group(lines, [file_col], order, n).drop("rank")
