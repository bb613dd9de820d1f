"""2-D density, coverage and score maps over shared bins.

Maps hold at most bins x bins rows. Edges are two pairs of numbers on the driver, so binning is
plain arithmetic in generated code; everything after the first aggregate is map-sized.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayloom.functions.binning import bin_clipped, bin_inside
from assayloom.operators.ranking import exact_percentiles, union_all

EPS = 1e-9
MARGIN = 0.02


@dataclass(frozen=True)
class Edges:
    x0: float
    wx: float
    y0: float
    wy: float
    bins: int

    def inside(self) -> tuple[Column, Column]:
        return (
            bin_inside(F.col("x"), self.x0, self.wx, self.bins).alias("ix"),
            bin_inside(F.col("y"), self.y0, self.wy, self.bins).alias("iy"),
        )

    def clipped(self) -> tuple[Column, Column]:
        return (
            bin_clipped(F.col("x"), self.x0, self.wx, self.bins).alias("ix"),
            bin_clipped(F.col("y"), self.y0, self.wy, self.bins).alias("iy"),
        )


def shared_edges(points: Sequence[DataFrame], bins: int, margin: float = MARGIN) -> DataFrame:
    """Origin and bin width per axis over all point sets, widened by a share of the span."""
    spans = union_all([
        p.agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"))
        for p in points
    ]).agg(F.min("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"), F.min("y_lo").alias("y_lo"), F.max("y_hi").alias("y_hi"))
    pad = lambda a: (F.col(f"{a}_hi") - F.col(f"{a}_lo")) * F.lit(margin)
    width = lambda a: ((F.col(f"{a}_hi") + pad(a)) - (F.col(f"{a}_lo") - pad(a))) / F.lit(float(bins))
    return spans.select(
        (F.col("x_lo") - pad("x")).alias("x0"), width("x").alias("wx"),
        (F.col("y_lo") - pad("y")).alias("y0"), width("y").alias("wy"),
    )


def edges_of(points: Sequence[DataFrame], bins: int) -> Edges:
    row = shared_edges(points, bins).first()
    return Edges(row["x0"], row["wx"], row["y0"], row["wy"], bins)


def hist2d(points: DataFrame, edges: Edges, by: Sequence[str] = ()) -> DataFrame:
    return (
        points.select(*by, *edges.inside()).where(F.col("ix").isNotNull() & F.col("iy").isNotNull())
        .groupBy(*by, "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    )


def bins_with_picks(bg: DataFrame, picks: DataFrame) -> DataFrame:
    """Every background bin with its number of picks, 0 where none fell."""
    return bg.withColumnRenamed("n", "n_bg").join(
        picks.withColumnRenamed("n", "n_pick"), ["ix", "iy"], "left"
    ).withColumn("n_pick", F.coalesce("n_pick", F.lit(0)))


def map_pair(background: DataFrame, picks: DataFrame, edges: Edges) -> DataFrame:
    """Background and pick counts per bin in one aggregate, with each set's total over all bins."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    points = background.select(*edges.inside(), one.alias("_bg"), none.alias("_pick")).unionByName(
        picks.select(*edges.inside(), none.alias("_bg"), one.alias("_pick"))
    )
    both = points.where(F.col("ix").isNotNull() & F.col("iy").isNotNull()).groupBy("ix", "iy").agg(
        F.sum("_bg").alias("n_bg"), F.sum("_pick").alias("n_pick")
    )
    all_bins = Window.partitionBy()
    return both.withColumn("bg_total", F.sum("n_bg").over(all_bins)).withColumn(
        "pick_total", F.sum("n_pick").over(all_bins)
    )


def log2_ratio() -> Column:
    pick = F.col("n_pick") / F.greatest(F.col("pick_total"), F.lit(1)) + F.lit(EPS)
    bg = F.col("n_bg") / F.greatest(F.col("bg_total"), F.lit(1)) + F.lit(EPS)
    return F.log2(pick / bg)


def density_ratio(background: DataFrame, picks: DataFrame, edges: Edges, min_bg: int = 3) -> DataFrame:
    """log2 of pick share over background share per bin; NULL where the background is too thin."""
    return map_pair(background, picks, edges).where(F.col("n_bg") > 0).select(
        "ix", "iy", "n_bg", "n_pick", F.when(F.col("n_bg") >= min_bg, log2_ratio()).alias("log2r")
    )


def coverage_fraction(background: DataFrame, picks: DataFrame, edges: Edges, min_bg: int = 3) -> DataFrame:
    """Picks over all points per kept bin, with the value expected from the two totals."""
    share = F.col("n_pick") / (F.col("n_pick") + F.col("n_bg"))
    expected = F.col("pick_total") / (F.col("pick_total") + F.col("bg_total"))
    return map_pair(background, picks, edges).where(F.col("n_bg") >= min_bg).select(
        "ix", "iy", share.alias("cover"), expected.alias("expected")
    )


def log_density(background: DataFrame, picks: DataFrame, edges: Edges) -> DataFrame:
    """log10(count + 1) of both sets over the bins that the background occupies."""
    return map_pair(background, picks, edges).where(F.col("n_bg") > 0).select(
        "ix", "iy", F.log10(F.col("n_bg") + 1).alias("log_bg"), F.log10(F.col("n_pick") + 1).alias("log_pick")
    )


def ratio_summary(ratios: DataFrame) -> DataFrame:
    """Spread of a ratio map. Input is one row per bin, so the exact built-in percentile is safe."""
    r = F.col("log2r")
    return ratios.where(r.isNotNull()).agg(
        F.count(F.lit(1)).alias("bins"), F.avg(r).alias("mean"), F.percentile(r, F.lit(0.5)).alias("median"),
        F.stddev_pop(r).alias("std"),
        (F.percentile(r, F.lit(0.75)) - F.percentile(r, F.lit(0.25))).alias("iqr"),
        F.count_if(r < -2).alias("n_under2"), F.count_if((r >= -2) & (r < 0)).alias("n_below"),
        F.count_if((r >= 0) & (r < 2)).alias("n_above"), F.count_if(r >= 2).alias("n_over2"),
    )


def ratio_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """b minus a: spread, inter-quartile range, and the shares of strongly under- and over-sampled bins."""
    r = F.col("log2r")

    def one(ratios: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1))
        return ratios.where(r.isNotNull()).agg(
            F.lit(name).alias("side"), F.stddev_pop(r).alias("std"),
            (F.percentile(r, F.lit(0.75)) - F.percentile(r, F.lit(0.25))).alias("iqr"),
            (F.count_if(r < -2).cast("double") * 100 / n).alias("under"),
            (F.count_if(r > 2).cast("double") * 100 / n).alias("over"),
        )

    sides = one(a, "a").unionByName(one(b, "b"))
    delta = lambda c: (
        F.max(F.when(F.col("side") == "b", F.col(c))) - F.max(F.when(F.col("side") == "a", F.col(c)))
    ).alias(f"d_{c}")
    return sides.agg(*[delta(c) for c in ("std", "iqr", "under", "over")])


def bins_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of two ratio maps over the bins valid in both."""
    left = a.where(F.col("log2r").isNotNull()).select("ix", "iy", F.col("log2r").alias("_a"))
    right = b.where(F.col("log2r").isNotNull()).select("ix", "iy", F.col("log2r").alias("_b"))
    return left.join(right, ["ix", "iy"]).select("ix", "iy", (F.col("_a") - F.col("_b")).alias("diff"))


def density_by_round(background: DataFrame, picks: DataFrame, edges: Edges, min_bg: int = 3) -> DataFrame:
    """One ratio map per round against one background.

    Kept background bins are repeated per round by exploding the array of round totals, which a
    scalar subquery supplies; both are map-sized.
    """
    all_bins = Window.partitionBy()
    bg = hist2d(background, edges).withColumn("bg_total", F.sum("n").over(all_bins)).where(F.col("n") >= min_bg)
    pk = hist2d(picks, edges, ["al_round"])
    totals = pk.groupBy("al_round").agg(F.sum("n").alias("pick_total"))
    rounds = totals.agg(F.collect_list(F.struct("al_round", "pick_total"))).scalar()
    grid = bg.select("ix", "iy", F.col("n").alias("n_bg"), "bg_total", F.inline(rounds))
    full = grid.join(pk.withColumnRenamed("n", "n_pick"), ["al_round", "ix", "iy"], "left").withColumn(
        "n_pick", F.coalesce("n_pick", F.lit(0))
    )
    return full.select("al_round", "ix", "iy", log2_ratio().alias("log2r"))


def bin_score_stats(points: DataFrame, edges: Edges, min_count: int = 2) -> DataFrame:
    """Mean, best and count per bin; mean and best are NULL in thin bins."""
    return _thin_to_null(
        points.select(*edges.clipped(), "score").groupBy("ix", "iy").agg(
            F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.min("score").alias("best")
        ), min_count
    ).select("ix", "iy", "mean", "best", "n")


def bin_stats_all_slot(points: DataFrame, edges: Edges, min_count: int = 2, all_slot: int = -1) -> DataFrame:
    """The same per round and over all rounds.

    Bins are aggregated per round once; the all-rounds map adds those up instead of reading again.
    """
    per_round = points.select("al_round", *edges.clipped(), "score").groupBy("al_round", "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("_sum"), F.min("score").alias("best")
    )
    slots = per_round.groupingSets(
        [[F.col("al_round"), F.col("ix"), F.col("iy")], [F.col("ix"), F.col("iy")]], "al_round", "ix", "iy"
    ).agg(
        F.grouping("al_round").alias("_all"), F.sum("n").alias("n"), F.sum("_sum").alias("_sum"),
        F.min("best").alias("best"),
    )
    slot = F.when(F.col("_all") == 1, F.lit(all_slot)).otherwise(F.col("al_round")).alias("slot")
    return _thin_to_null(slots.withColumn("mean", F.col("_sum") / F.col("n")), min_count).select(
        slot, "ix", "iy", "mean", "best", "n"
    )


def _thin_to_null(stats: DataFrame, min_count: int) -> DataFrame:
    keep = F.col("n") >= min_count
    return stats.withColumn("mean", F.when(keep, F.col("mean"))).withColumn("best", F.when(keep, F.col("best")))


def colour_limits(points: DataFrame, slots: DataFrame, ratios: DataFrame, diffs: DataFrame) -> DataFrame:
    """The numbers that fix the colour scales of the maps, as (name, value) rows."""
    def named(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")

    scores = points.where(F.col("score").isNotNull())
    # the minimum rides along in the first of the two passes that bracket the percentile
    both = exact_percentiles(scores, [], "score", {"p95": 0.95}, also={"low": F.min("score")})
    ends = F.array(*[
        F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"))
        for name, value in (("score_min", F.floor("low")), ("score_max", F.col("p95")))
    ])
    widest = F.max(F.abs("diff"))
    return union_all([
        both.select(F.inline(ends)),
        named(slots, "count_max", F.floor(F.percentile("n", F.lit(0.99)))),
        named(ratios.where(F.col("log2r").isNotNull()), "ratio_max",
              F.least(F.lit(4.0), F.percentile(F.abs("log2r"), F.lit(0.995)))),
        named(diffs, "diff_max", F.when(widest > 0, F.least(F.lit(3.0), widest)).otherwise(F.lit(1.0))),
    ])


def contour_levels(bg: DataFrame) -> DataFrame:
    """Median, 80th and 95th percentile of the occupied background bins."""
    levels = F.percentile("n", F.array(F.lit(0.5), F.lit(0.8), F.lit(0.95)))
    return bg.where(F.col("n") > 0).agg(levels.alias("_l")).select(
        F.col("_l")[0].alias("p50"), F.col("_l")[1].alias("p80"), F.col("_l")[2].alias("p95")
    )


def grid_json(cells: DataFrame, bins: int, value: str) -> DataFrame:
    """One JSON row array per iy over all ix, missing cells null, three decimals, no negative zero.

    A row is bounded by the bin count. The rows of the map stay separate, ordered by iy.
    """
    filled = cells.groupBy("iy").agg(
        F.map_from_entries(F.collect_list(F.struct("ix", (F.round(value, 3) + F.lit(0.0)).alias("v")))).alias("_m")
    )
    spark = cells.sparkSession
    rows = spark.range(bins).select(F.col("id").cast("int").alias("iy"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.try_element_at(F.col("_m"), i))
    empty = F.array_repeat(F.lit(None).cast("double"), bins)
    return rows.join(filled, "iy", "left").select(
        "iy", F.to_json(F.when(F.col("_m").isNull(), empty).otherwise(dense), {"ignoreNullFields": "false"}).alias("json")
    )
