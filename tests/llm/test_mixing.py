"""Mixing: targets by plain reallocation, totals near targets, cuts against a plain ordering."""

import random

import pytest
from pyspark.sql import functions as F

from assayloom.llm import mixing as M
from small_tables import docs_of  # noqa: F401


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": rnd.choice([0, 3, 50, 1000, 90000]) for i in range(rnd.randint(1, 12))} | {None: 70, "Ä": 5, "a\U0001f600": 9, "a￿": 4}
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
    got = {r.source: r.target for r in M.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def corpus(n=900):
    rnd = random.Random(3)
    return [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 20, 80])), rnd.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(n)]


def test_near_targets_and_order_of_cuts(docs_of, monkeypatch):
    monkeypatch.setattr(M, "SLICE_ROWS", 5)
    docs = docs_of(corpus())
    out = M.copies(docs).collect()
    assert len(out) == 900 and all(0 <= r.copies <= 3 for r in out)
    rows, sources = M.plan(docs)
    goals = {r.of: r for r in sources.collect()}
    ranked = {r.doc_id: r["rank"] for r in M._ranked(rows, sources, M.SEED).collect()}
    for source, goal in goals.items():
        own = [r for r in out if r.source == source]
        taken = sum(r.size * r.copies for r in own)
        assert abs(taken - goal.target) <= 80
        if goal.wanted > 0:
            # the same cut by one plain pass over the order
            upto, chosen = 0, set()
            for r in sorted((r for r in own), key=lambda r: (ranked[r.doc_id], r.doc_id)):
                upto += r.size
                if 2 * upto - r.size < 2 * goal.wanted and r.size:
                    chosen.add(r.doc_id)
            assert {r.doc_id for r in own if r.copies > goal.whole} == chosen


def test_runs_agree_and_rows_are_whole(docs_of):
    docs = docs_of(corpus(), extra="size")
    one, two = (sorted(map(str, M.mix(docs.repartition(n)).collect())) for n in (2, 5))
    assert one == two
    counts = {r.doc_id: r.copies for r in M.copies(docs).collect()}
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in counts.items() if n}


def test_odd_tables(docs_of):
    assert M.copies(docs_of(["a"]).where("false")).count() == 0
    none = M.copies(docs_of([None, "", " "])).collect()
    assert [(r.size, r.copies, r.target) for r in none] == [(0, 0, 0.0)] * 3
    odd = M.copies(docs_of([(None, "a b", "x"), (1, "a", "x"), (1, "a", "x"), (2, "c d e", None)])).collect()
    assert len(odd) == 4 and {r.source_size for r in odd} == {4, 3}
    same = {r.copies for r in odd if r.doc_id == 1}
    assert len(same) == 1


def test_names_with_dots(docs_of):
    docs = docs_of([(0, "a b c", "x"), (1, "d", "y")]).selectExpr("*", "7 AS `a.b`")
    out = M.mix(docs)
    assert out.columns == docs.columns and {r[-1] for r in out.collect()} == {7}
