"""Blocked similarity against brute force, with copies, empty vectors and many small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.functions.bits import popcount, tanimoto, unpack_positions, pack_positions
from assayloom.operators.similarity import max_similarity, max_similarity_self

WORDS = 4


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    bits = rng.random((n, WORDS * 64)) < rng.uniform(0.02, 0.6, size=(n, 1))
    bits[: n // 3] = bits[0]
    bits[n // 2] = False
    return bits


def frame(spark, bits, start=0):
    words = np.packbits(bits, axis=1, bitorder="little").view("<i8")
    return spark.createDataFrame([(start + i, [int(w) for w in row]) for i, row in enumerate(words)], "id long, fp array<bigint>")


def brute(q, r, skip_diagonal=False):
    q, r = q.astype(float), r.astype(float)
    shared = q @ r.T
    either = q.sum(1)[:, None] + r.sum(1)[None, :] - shared
    sim = np.where(either > 0, shared / np.where(either > 0, either, 1), 0.0)
    if skip_diagonal:
        np.fill_diagonal(sim, 0.0)
    return sim.max(axis=1)


@pytest.mark.parametrize("block_rows,slice_rows", [(4096, 32768), (16, 24)])
def test_max_similarity(spark, block_rows, slice_rows):
    q, r = vectors(120, 1), vectors(90, 2)
    got = max_similarity(frame(spark, q), frame(spark, r, 1000), block_rows, slice_rows).toPandas().sort_values("id")
    assert got["max_sim"].to_numpy() == pytest.approx(brute(q, r), abs=1e-9)


@pytest.mark.parametrize("block_rows,slice_rows", [(4096, 32768), (16, 24)])
def test_max_similarity_self(spark, block_rows, slice_rows):
    bits = vectors(120, 3)
    got = max_similarity_self(frame(spark, bits), block_rows, slice_rows).toPandas().sort_values("id")
    want = brute(bits, bits, skip_diagonal=True)
    assert got["max_sim"].to_numpy() == pytest.approx(want, abs=1e-9)
    assert (got["max_sim"].to_numpy()[:40] == 1.0).all()


def test_plans_do_not_grow_with_the_rows(spark):
    def size(n):
        bits = vectors(n, 8)
        df = max_similarity(frame(spark, bits), frame(spark, bits, 10_000), 8, 8)
        return len(df._jdf.queryExecution().optimizedPlan().toString())

    assert size(400) < 1.1 * size(60)


def test_no_references(spark):
    got = max_similarity(frame(spark, vectors(10, 4)), frame(spark, vectors(3, 5)).limit(0)).toPandas()
    assert (got["max_sim"] == 0.0).all() and len(got) == 10


def test_tanimoto_laws(spark):
    a = frame(spark, vectors(60, 6))
    b = a.select((F.col("id") - 1).alias("id"), F.col("fp").alias("other"))
    both = a.join(b, "id").select(
        tanimoto(F.col("fp"), F.col("other")).alias("ab"), tanimoto(F.col("other"), F.col("fp")).alias("ba"),
        tanimoto(F.col("fp"), F.col("fp")).alias("aa"), popcount(F.col("fp")).alias("n"),
    ).toPandas()
    assert (both.ab == both.ba).all() and both.ab.between(0, 1).all()
    assert (both.aa[both.n > 0] == 1.0).all() and (both.aa[both.n == 0] == 0.0).all()


def test_pack_and_unpack_are_inverse(spark):
    a = frame(spark, vectors(50, 7)).unionByName(spark.createDataFrame([(999, None)], "id long, fp array<bigint>"))
    back = pack_positions(unpack_positions(a, WORDS * 64), WORDS * 64).withColumnRenamed("fp", "again")
    rows = a.join(back, "id").collect()
    assert len(rows) == 51 and all(r["fp"] == r["again"] for r in rows)
