"""Exact ranks, n-th best values, percentiles and top-k that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayloom.runtime import SPLIT_BYTES, cut_lineage, estimated_bytes, join_keys, small_side

SALTS = 64
SKETCH_ACCURACY = 10_000
# An ordered limit sends k rows per input split to one task; this many are fine there.
SINGLE_PASS_ROWS = 2_000_000
# A bracket of at most this many rows is ordered at once, a larger one is bracketed again.
BAND_ROWS = 20_000_000
_GRID = 512
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_n_by_group(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first n rows of every group.

    Two ranked steps. The salt is the input split, so each split keeps at most n rows per group
    before the shuffle (window group limit), and a group that fills a third of the table is cut
    to n rows in up to 64 tasks before one task sees 64 * n.
    """
    order = [_col(o) for o in order]
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n).drop("_rn", "_salt")
    whole = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)


def nth_best(
    df: DataFrame, by: Sequence[str], value: str, ns: Sequence[int] = (1, 10, 100, 1000), prefix: str = "best"
) -> DataFrame:
    """Per group the n-th smallest value for each n, NULL where the group is shorter."""
    top = top_n_by_group(df.where(F.col(value).isNotNull()).select(*by, value), by, [value], max(ns))
    return top.groupBy(*by).agg(
        *[F.min(F.when(F.col("rank") == n, F.col(value))).alias(f"{prefix}{n}") for n in ns]
    )


def rank_within(df: DataFrame, by: Sequence[str], order: Sequence[str], rank: str = "rank") -> DataFrame:
    """The exact 1-based rank of every row in its group, for groups of any size; NULL keys are a group.

    Rows are range-partitioned on (group, order), numbered inside each partition, and shifted by
    the row counts of the partitions before. Only one row per partition and group meets in a
    window; those rows are counted and, where few, broadcast, so the ranked rows are not shuffled
    again. The sorted rows are checkpointed since range bounds are sampled: both reads of them
    must see the same placement, also after an executor is lost.
    """
    keys = [*by, *order]
    placed = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_len"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = cut_lineage(runs.select(
        *by, "_part", "_first", F.coalesce(F.sum("_len").over(earlier), F.lit(0)).alias("_before")
    ))
    return join_keys(placed, small_side(starts), [*by, "_part"]).select(
        *df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(rank)
    )


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, ps: dict[str, float], also: dict[str, Column] | None = None
) -> DataFrame:
    """Linear-interpolation percentiles per group, exact, plus the group size n; NULL keys are a group.

    `also` adds plain aggregates of the same rows; they ride along in the first pass.

    The built-in exact percentile holds every distinct value of a group in one task. Here a
    bounded sketch first brackets each wanted rank; the second pass keeps values only inside a
    bracket and folds all others onto the edge below them, so the counts that meet per group are
    about one in a thousand of its rows. The sketch, one row per group, is counted and, where
    small, broadcast: no raw row is shuffled by its group. Counts at both edges prove that every
    wanted rank lies in its bracket; where one does not, all brackets are widened and counted again.
    """
    v = F.col(value).cast("double")
    also = also or {}
    sound = df.where(v.isNotNull() & ~F.isnan(v))
    slack = 4.0 / SKETCH_ACCURACY
    while True:
        found = cut_lineage(_bracketed(sound, by, v, ps, also, slack))
        if slack >= 1 or found.where(~F.col("_held")).isEmpty():
            break
        slack *= 16
    out = []
    for name, p in ps.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (at - F.floor(at)) * (hi - lo)).alias(name))
    return found.select(*by, "n", *also, *out)


def _bracketed(
    sound: DataFrame, by: Sequence[str], v: Column, ps: dict[str, float], also: dict[str, Column], slack: float
) -> DataFrame:
    """Per group: n, the values at both sides of each wanted rank, and whether the brackets held all of them."""
    probes = [q for p in ps.values() for q in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = cut_lineage(sound.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(v, probes, SKETCH_ACCURACY).alias("_edges"),
        *[agg.alias(name) for name, agg in also.items()],
    ))
    rows = sound.select(*by, v.alias("_v"))
    if by:
        marked = join_keys(rows, small_side(sketch), list(by))
        n, edge = F.col("_n"), lambda i: F.col("_edges")[i]
    else:
        only = sketch.first()
        marked = rows.select("_v", *[F.lit(only[name]).alias(name) for name in also])
        n, edge = F.lit(only["_n"]), lambda i: F.lit(only["_edges"][i] if only["_edges"] else None)
    folded = []
    for i in range(len(ps)):
        lo, hi = edge(2 * i), edge(2 * i + 1)
        folded.append(
            F.when(F.col("_v") > hi, hi).when(F.col("_v") >= lo, F.col("_v")).cast("double")
        )
    snapped = F.greatest(*folded) if len(folded) > 1 else folded[0]
    below = [F.count_if(F.col("_v") < edge(2 * i)).alias(f"_under_{i}") for i in range(len(ps))]
    upto_edge = [F.count_if(F.col("_v") <= edge(2 * i + 1)).alias(f"_upto_{i}") for i in range(len(ps))]
    counts = marked.groupBy(*by, n.alias("_n"), snapped.alias("_s")).agg(
        F.count(F.lit(1)).alias("_c"), *below, *upto_edge, *[F.first(name).alias(name) for name in also]
    )
    upto = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.col("_s").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = counts.withColumn("_cum", F.sum("_c").over(upto))
    picks, held = [], F.lit(True)
    for i, (name, p) in enumerate(ps.items()):
        at = F.lit(float(p)) * (F.col("_n") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(at), F.col("_s"))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_s"))).alias(f"_hi_{name}"))
        n_max = F.lit(float(p)) * (F.max("_n") - 1)
        held = held & (F.sum(f"_under_{i}") <= F.floor(n_max)) & (F.sum(f"_upto_{i}") > F.ceil(n_max))
    return running.groupBy(*by).agg(
        F.max("_n").alias("n"), F.coalesce(held, F.lit(True)).alias("_held"), *[F.first(name).alias(name) for name in also], *picks
    )


def smallest_k(
    df: DataFrame, key: str, ties: Sequence[str], k: int, single_pass_rows: int = SINGLE_PASS_ROWS,
    sound: bool = False,
) -> DataFrame:
    """The k rows with the smallest key (ties by the other columns); NULL and NaN keys never count.

    `sound` says that no key is NULL or NaN. A filter on a computed key would compute it twice.

    Where k rows from every input split still fit one task, this is one ordered limit. Beyond
    that a sketch brackets the k-th key: rows below the bracket are taken where they are, and only
    the bracket is ordered.
    """
    rows = df if sound else df.where(F.col(key).isNotNull() & ~F.isnan(F.col(key).cast("double")))
    if k * (1 + estimated_bytes(rows) // SPLIT_BYTES) <= single_pass_rows:
        return rows.orderBy(key, *ties).limit(k)
    k_col = F.col(key)
    probes = [i / _GRID for i in range(_GRID + 1)]
    n, grid = rows.agg(F.count(F.lit(1)), F.percentile_approx(k_col, probes, SKETCH_ACCURACY)).first()
    if n <= k:
        return rows
    at = k * _GRID // n
    lo, hi = grid[max(0, at - 1)], grid[min(_GRID, at + 2)]
    below, band = rows.agg(F.count_if(k_col < lo), F.count_if((k_col >= lo) & (k_col <= hi))).first()
    if not below <= k <= below + band:
        return _first_by_rank(rows, [key, *ties], k)
    inner, left = rows.where((k_col >= lo) & (k_col <= hi)), k - below
    if lo == hi and ties and dict(rows.dtypes)[ties[0]] in _NUMERIC:
        # One key fills the bracket, so the tie column decides.
        edge = smallest_k(inner, ties[0], ties[1:], left, single_pass_rows)
    elif band <= BAND_ROWS:
        edge = inner.orderBy(key, *ties).limit(left)
    elif band == n or lo == hi:
        edge = _first_by_rank(inner, [key, *ties], left)
    else:
        edge = smallest_k(inner, key, ties, left, single_pass_rows, sound=True)
    return rows.where(k_col < lo).unionByName(edge)


def _first_by_rank(rows: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The first k rows by their exact rank: no task ever holds more than its own range."""
    return rank_within(rows, [], order, "_r").where(F.col("_r") <= k).drop("_r")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
