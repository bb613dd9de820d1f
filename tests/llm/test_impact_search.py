"""Exact top-k against brute force: ties, negatives, large values, odd vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import impact_search as S


def brute(vectors, queries, k):
    out = set()
    for q, a in queries.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def run(spark, vectors, queries, k=10, **kw):
    v = spark.createDataFrame(list(vectors.items()), "vec_id long, vector array<long>")
    q = spark.createDataFrame(list(queries.items()), "query_id long, query array<long>")
    return {tuple(r) for r in S.search(S.build_index(v, kw.pop("block_rows", 40)), q, k, **kw).collect()}


@pytest.mark.parametrize("scale", [3, 300, 2**28])
def test_brute_force(spark, scale):
    rnd = random.Random(scale)
    vectors = {i: [rnd.randint(-scale, scale) for _ in range(12)] for i in range(170)}
    vectors |= {i: vectors[3] for i in range(200, 230)} | {300: [0] * 12, 301: [1], 302: []}
    queries = {i: v for i, v in vectors.items() if i % 20 == 0} | {9000: [5] * 12}
    assert run(spark, vectors, queries, query_rows=4) == brute(vectors, queries, 10)


def test_fewer_rows_than_k_and_none(spark):
    vectors = {1: [1, 2], 2: [3, 4], 3: [0, 0]}
    assert run(spark, vectors, {1: [1, 2]}) == brute(vectors, {1: [1, 2]}, 10)
    v = spark.createDataFrame([], "vec_id long, vector array<long>")
    q = spark.createDataFrame([], "query_id long, query array<long>")
    assert S.search(S.build_index(v), q).count() == 0
    assert run(spark, vectors, {7: None}) == set()


def test_proof_ends_early():
    rng = np.random.default_rng(0)
    whole = rng.integers(-3, 4, (500, 32))
    whole[:12] *= 4000
    ids = np.arange(500)
    segments = []
    impact = np.frexp(np.abs(whole).astype(float))[1]
    for level in sorted(set(impact[whole != 0].tolist()), reverse=True):
        doc, dim = np.nonzero((impact == level) & (whole != 0))
        segments.append((doc, dim, whole[doc, dim]))
    asked = np.abs(rng.integers(1, 9, (1, 32)))
    whole[:12] = np.abs(whole[:12])
    segments = [(d, c, whole[d, c]) for d, c, _ in segments]
    taken = []

    class Watched(list):
        def __iter__(self):
            for s in super().__iter__():
                taken.append(s)
                yield s

    left = S._possible(ids, whole, Watched(segments), np.array([-1]), asked, 4)
    assert len(taken) < len(segments) and len(left[0]) <= S.ENOUGH * 4
    exact = np.argsort(-(whole @ asked[0]), kind="stable")[:4]
    assert set(exact) <= set(left[0].tolist())


def test_whole_numbers(spark):
    rows = spark.createDataFrame([(1, [0.5, -0.0001]), (2, [float("nan"), 1.0]), (3, None), (4, [None, 1.0]), (5, [float("inf")]), (6, [])], "i int, e array<float>")
    got = {r.i: r.v for r in rows.select("i", S.whole_numbers(F.col("e")).alias("v")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_repeated_ids_and_other_columns(spark):
    v = spark.createDataFrame([(1, [1, 2]), (1, [9, 9]), (2, [3, 4]), (None, [5, 5]), (3, None)], "vec_id long, vector array<long>").selectExpr("*", "1 AS block")
    q = spark.createDataFrame([(2, [1, 1]), (7, [1, 0]), (7, [2, 0]), (None, [1, 1])], "query_id long, query array<long>").selectExpr("*", "1 AS chunk")
    got = {tuple(r) for r in S.search(S.build_index(v), q, 5).collect()}
    assert got == {(2, 1, 1, 3), (7, 1, 2, 3), (7, 2, 1, 1)}
