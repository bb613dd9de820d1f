"""Repeatable draws. Randomness is a hash of (id, seed, round), so a rerun or a lost task draws the same rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.functions.bits import is_nonzero
from assayloom.functions.hashing import gumbel, uniform
from assayloom.operators.filters import negative_logit
from assayloom.operators.ranking import rank_within, smallest_k
from assayloom.runtime import cut_lineage, small_side


def hash_sample(rows: DataFrame, k: int, seed: int, id_col: str = "id") -> DataFrame:
    """k rows without replacement, every row equally likely, for a library of any size."""
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    key = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return smallest_k(rows.withColumn("_key", key), "_key", [id_col], k, sound=True).drop("_key")


def sample_excluding(rows: DataFrame, excluded: DataFrame, k: int, seed: int, id_col: str = "id") -> DataFrame:
    return hash_sample(rows.join(excluded.select(id_col).distinct(), id_col, "left_anti"), k, seed, id_col)


def fit_split(rows: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """Marks n rows, drawn by hash, for fitting; the rest are only transformed."""
    ranked = rank_within(rows.withColumn("_u", uniform(F.col(id_col), seed)), [], ["_u", id_col], "_r")
    return ranked.select(*rows.columns, (F.col("_r") <= n).alias("is_fit"))


def greedy(eligible: DataFrame, k: int) -> DataFrame:
    """The k lowest predictions, ties by id."""
    return smallest_k(eligible, "predicted", ["id"], k).withColumn("source", F.lit("greedy_select"))


def thompson(eligible: DataFrame, k: int, temperature: float, seed: int, rnd: int) -> DataFrame:
    """k rows without replacement with weight exp(-prediction / T). Predictions are finite (`eligible`).

    The k largest Gumbel-perturbed logits follow the law of k successive weighted draws, so one
    pass does it: no normaliser, no running removal.
    """
    if temperature <= 0:
        return greedy(eligible, k)
    key = -(negative_logit(F.col("predicted"), temperature) + gumbel(F.col("id"), seed, rnd))
    drawn = smallest_k(eligible.withColumn("_key", key), "_key", ["id"], k, sound=True)
    return drawn.drop("_key").withColumn("source", F.lit("thompson_sample"))


def block_per_partition(
    rows: DataFrame, parts: int, block: int, seed: int, first_id: int, last_id: int, id_col: str = "id"
) -> DataFrame:
    """One random contiguous id block of at most `block` ids from each of `parts` equal id ranges.

    The last range takes the remainder. The filter is on the id alone, so a store sorted by id
    skips every row group outside the blocks.
    """
    span = last_id - first_id + 1
    width = max(1, span // parts)
    row = F.col(id_col) - F.lit(first_id)
    part = F.least(F.floor(row / width), F.lit(parts - 1))
    held = F.when(part == parts - 1, F.lit(span - (parts - 1) * width)).otherwise(F.lit(width))
    slack = F.greatest(F.lit(0), held - F.lit(block))
    offset = F.floor(uniform(part, seed) * (slack + 1))
    local = row - part * width
    return rows.withColumn("part", part.cast("int")).where((local >= offset) & (local < offset + block))

#: Room for rounding where the triangle inequality rules a row out.
_SLACK = 1e-9


def farthest_first(vectors: np.ndarray, start: int, take: int) -> tuple[list[int], int]:
    """Rows picked one after the other, each the farthest (Tanimoto) from all before, ties to the first; and how many distances
    to rows were computed.

    Every row keeps its distance to the nearest pick, an upper bound that only falls. As the distance is a metric, a row that is
    nearer to its pick than half the way from there to the new pick cannot be nearer to the new one: it is not looked at.
    """
    # One row per word: a pick then runs along contiguous memory without a block-sized copy.
    by_word = np.ascontiguousarray(vectors.T)
    weight = np.bitwise_count(by_word).sum(axis=0, dtype=np.int64)
    n = len(weight)

    def distances(at: int, rows) -> np.ndarray:
        shared = np.zeros(len(weight[rows]), dtype=np.int64)
        for word in by_word:
            shared += np.bitwise_count(word[rows] & word[at])
        return 1.0 - shared / (weight[rows] + weight[at] - shared)

    gap, nearest = distances(start, slice(None)), np.zeros(n, dtype=np.int64)
    chosen, looked = [start], n
    gap[start] = -1.0
    while len(chosen) < min(take, n):
        at = int(gap.argmax())
        half = distances(at, np.array(chosen)) / 2 - _SLACK
        rows = np.flatnonzero(gap > half[nearest])
        looked += len(rows)
        found = distances(at, rows)
        nearer = found < gap[rows]
        gap[rows[nearer]], nearest[rows[nearer]] = found[nearer], len(chosen)
        chosen.append(at)
        gap[at] = -1.0
    return chosen[:take], looked


def _pick_far_apart(key, table):
    """The picks of one cell, from the row with the smallest start on, up to the cell's quota."""
    ids = table.column("id").to_numpy()
    words = table.column("fp").combine_chunks().values.to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(ids, kind="stable")
    start = int(np.argmin(table.column("start").to_numpy()[order]))
    take = min(table.column("quota")[0].as_py(), len(ids))
    chosen, _ = farthest_first(words.reshape(len(ids), -1)[order], start, take)
    kept = table.take(pa.array(order[chosen])).select(["part", "quota", "id", "fp"])
    return kept.append_column("pick", pa.array(np.arange(take), pa.int32()))


def _narrowed(rows: DataFrame, block: int, seed: int) -> DataFrame:
    """(part, quota, id, fp, pick): each part's quota of mutually distant rows, out of all its rows.

    A part of more than `block` rows is cut into cells of about that many by a hash of the id, every
    cell gives its quota, and the picks are narrowed again until one cell holds what is left. A cell starts with
    its row of the smallest hash.
    """
    level = 0
    while True:
        sizes = cut_lineage(rows.groupBy("part").agg(
            F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(block), 4 * F.max("quota"))).cast("int").alias("_cells")
        ))
        last = sizes.where(F.col("_cells") > 1).isEmpty()
        cell = F.floor(uniform(F.col("id"), seed + 1, level) * F.col("_cells")).cast("int")
        cells = rows.join(small_side(sizes), "part").select(
            "part", "quota", "id", "fp", uniform(F.col("id"), seed, level).alias("start"), cell.alias("_cell")
        )
        picked = cells.groupBy("part", "_cell").applyInArrow(
            _pick_far_apart, "part int, quota int, id long, fp array<long>, pick int"
        )
        if last:
            return picked
        rows, level = cut_lineage(picked), level + 1


def maxmin_global(fps: DataFrame, k: int, block: int, seed: int) -> DataFrame:
    """Exactly k mutually distant rows of the whole table (all, if it has fewer): id, pick.

    Every row takes part: cells of at most about `block` rows give k picks each, and the picks meet again.
    """
    rows = fps.where(is_nonzero(F.col("fp"))).select(F.lit(0).alias("part"), F.lit(k).alias("quota"), "id", "fp")
    return _narrowed(rows, block, seed).select("id", "pick")


def maxmin_partitioned(
    fps: DataFrame, k: int, parts: int, block: int, seed: int, first_id: int, last_id: int
) -> DataFrame:
    """Exactly k rows, mutually distant within each of `parts` equal id ranges: id, part, pick.

    Every row takes part. The remainder of k / parts goes to the first ranges. What ranges with too few rows leave open is
    drawn from the rest of the table and returned under part -1; only a table of fewer than k rows gives fewer.
    A task holds one cell of about `block` vectors, never a whole range.
    """
    rows = fps.where(is_nonzero(F.col("fp")))
    width = max(1, (last_id - first_id + 1) // parts)
    part = F.least(F.floor((F.col("id") - F.lit(first_id)) / width), F.lit(parts - 1)).cast("int")
    quota = F.when(part < k % parts, F.lit(k // parts + 1)).otherwise(F.lit(k // parts))
    ranged = rows.select(part.alias("part"), quota.cast("int").alias("quota"), "id", "fp").where("quota > 0")
    picked = cut_lineage(_narrowed(ranged, block, seed).select("id", "part", "pick"))
    open_ = k - picked.count()
    if open_ <= 0:
        return picked
    rest = rows.join(picked.select("id"), "id", "left_anti")
    more = maxmin_global(rest, open_, block, seed).select("id", F.lit(-1).alias("part"), "pick")
    return picked.unionByName(more)


def subset_points(xy: DataFrame, m: int, seed: int, id_cols: Sequence[str] = ("id",)) -> DataFrame:
    """m points for display, drawn by hash of all id columns."""
    digest = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))))
    key = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double")
    return smallest_k(xy.withColumn("_key", key), "_key", list(id_cols), m, sound=True).drop("_key")
