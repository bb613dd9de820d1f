"""Laws of the samplers, and the diverse seed against a plain loop."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import sampling as P


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(2000).select("id", (-(F.col("id") % 97) / 10.0).alias("predicted"))


def test_draws_exactly_k_repeatably_under_any_partitioning(pool):
    first = ids(P.thompson(pool, 150, 0.5, 1, 2))
    assert len(first) == len(set(first)) == 150
    assert first == ids(P.thompson(pool.repartition(13), 150, 0.5, 1, 2))
    assert first != ids(P.thompson(pool, 150, 0.5, 1, 3))


def test_more_than_there_is(pool):
    assert len(ids(P.thompson(pool, 5000, 1.0, 1, 0))) == 2000


def test_zero_temperature_is_greedy(pool):
    got = P.thompson(pool, 10, 0.0, 1, 0)
    assert ids(got) == ids(P.greedy(pool, 10))
    assert {r["source"] for r in got.collect()} == {"greedy_select"}


def test_first_draw_follows_the_softmax(spark):
    """One row of five drawn under 3000 seeds, each seed a block of ids of its own."""
    scores, t = [-1.0, -1.5, -2.0, -2.5, -3.0], 0.8
    from assayloom.functions.hashing import gumbel

    rows = spark.range(15_000).withColumn("i", (F.col("id") % 5).cast("int")).withColumn(
        "predicted", F.element_at(F.array(*[F.lit(s) for s in scores]), F.col("i") + 1)
    )
    keyed = rows.withColumn("key", -F.col("predicted") / t + gumbel(F.col("id"), 11))
    won = keyed.groupBy(F.floor(F.col("id") / 5)).agg(F.max_by("i", "key").alias("i")).collect()
    seen = Counter(r["i"] for r in won)
    weights = [math.exp(-s / t) for s in scores]
    for i, w in enumerate(weights):
        assert seen[i] / 3000 == pytest.approx(w / sum(weights), abs=0.03)


def test_sample_excludes(spark):
    rows = spark.range(1000)
    got = ids(P.sample_excluding(rows, spark.range(0, 900), 60, 5))
    assert len(got) == 60 and min(got) >= 900


def test_blocks_are_bounded_and_contiguous(spark):
    got = P.block_per_partition(spark.range(1, 1004), 7, 20, 3, 1, 1003).toPandas()
    assert sorted(got.part.unique()) == list(range(7))
    for _, block in got.groupby("part"):
        assert len(block) == 20 and block.id.max() - block.id.min() == 19


def test_diverse_seed_equals_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    bits = rng.random((180, 128)) < 0.2
    bits[5] = False
    words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    fps = spark.createDataFrame([(i, [int(w) for w in row]) for i, row in enumerate(words)], "id long, fp array<bigint>")
    got = P.maxmin_partitioned(fps.repartition(5), 24, 3, 1000, 4, 0, 179).toPandas()
    assert len(got) == 24 and 5 not in set(got.id)
    for part, picks in got.sort_values("pick").groupby("part"):
        mine = [i for i in range(part * 60, part * 60 + 60) if bits[i].any()]
        chosen = [picks.id.iloc[0]]
        while len(chosen) < 8:
            def gap(i):
                return min(1 - (bits[i] & bits[c]).sum() / (bits[i] | bits[c]).sum() for c in chosen)
            rest = [i for i in mine if i not in chosen]
            chosen.append(max(rest, key=lambda i: (gap(i), -i)))
        assert picks.id.tolist() == chosen


def test_diverse_picks_read_every_row_and_give_exactly_k(spark):
    rng = np.random.default_rng(3)
    words = np.packbits(rng.random((500, 128)) < 0.3, axis=1, bitorder="little").view("<i8")
    fps = spark.createDataFrame([(i, [int(w) for w in row]) for i, row in enumerate(words)], "id long, fp array<bigint>")
    for k, parts in ((100, 24), (10, 24), (500, 7), (499, 3)):
        got = P.maxmin_partitioned(fps, k, parts, 30, 1, 0, 499).toPandas()
        assert len(got) == k == got.id.nunique()
    # all of them in one range: the others' share is drawn from the rest
    got = P.maxmin_partitioned(fps, 60, 4, 30, 1, 0, 1999).toPandas()
    assert len(got) == 60 == got.id.nunique() and (got.part == -1).sum() == 45
    assert P.maxmin_partitioned(fps, 600, 4, 30, 1, 0, 499).count() == 500
    # one row unlike all others is found wherever it lies
    odd = fps.withColumn("fp", F.when(F.col("id") == 333, F.expr("array(shiftleft(1L, 62), 0L)")).otherwise(F.expr("transform(fp, w -> (w & 1023) | 1)")))
    for block in (20, 1000):
        got = {r.id for r in P.maxmin_global(odd, 5, block, 7).collect()}
        assert len(got) == 5 and 333 in got


def test_farthest_first_is_exact_and_looks_at_few_rows():
    rng = np.random.default_rng(4)
    # families of like rows: the triangle inequality rules most of them out
    heads = rng.integers(0, 2**63, (30, 16), dtype=np.uint64)
    rows = heads[rng.integers(0, 30, 3000)]
    rows[np.arange(3000), rng.integers(0, 16, 3000)] ^= np.uint64(1) << rng.integers(0, 63, 3000).astype(np.uint64)
    chosen, looked = P.farthest_first(rows, 7, 60)
    counts = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    gap, plain = np.full(3000, np.inf), [7]
    while len(plain) < 60:
        shared = np.bitwise_count(rows & rows[plain[-1]]).sum(axis=1, dtype=np.int64)
        gap = np.minimum(gap, 1.0 - shared / (counts + counts[plain[-1]] - shared))
        gap[plain] = -1.0
        plain.append(int(gap.argmax()))
    assert chosen == plain and looked < 0.55 * 60 * 3000
    same, _ = P.farthest_first(np.full((5, 2), 3, np.uint64), 2, 9)
    assert sorted(same) == [0, 1, 2, 3, 4] and same[0] == 2


def test_composed_picks_spread_nearly_as_far_as_a_single_pass(spark):
    rng = np.random.default_rng(8)
    words = np.packbits(rng.random((1200, 256)) < rng.uniform(0.05, 0.4, (1200, 1)), axis=1, bitorder="little").view("<i8")
    fps = spark.createDataFrame([(i, [int(w) for w in row]) for i, row in enumerate(words)], "id long, fp array<bigint>")

    def spread(block):
        got = [r.id for r in P.maxmin_global(fps, 20, block, 3).collect()]
        bits = np.unpackbits(words[got].view(np.uint8), axis=1).astype(int)
        shared, n = bits @ bits.T, bits.sum(axis=1)
        gaps = 1 - shared / (n[:, None] + n[None, :] - shared)
        return len(got), gaps[np.triu_indices(20, 1)].min()

    (n, whole), (m, composed) = spread(2000), spread(100)
    assert n == m == 20 and composed >= 0.95 * whole
