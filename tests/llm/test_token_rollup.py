"""Rollups by deltas: a model of plain dictionaries, repeated and broken batches, odd events."""

import random

import pytest

from assayloom.llm import token_rollup as R
from small_tables import docs_of  # noqa: F401
from assayloom.runtime import work_path

EVENTS = "doc_id long, op string, source string, lang string, version string, tokens long, seq long"


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_against_a_model(spark):
    rnd, rollup, model = random.Random(4), R.Rollup(spark, work_path(spark, "rollup-test")), {}
    for batch in range(1, 5):
        events = []
        for seq in range(60):
            op = rnd.choice(["insert", "insert", "revise", "delete"])
            source = rnd.choice(["hot", "hot", "a", None])
            events.append((rnd.randrange(25), op, source, rnd.choice(["en", None]), rnd.choice(["v1", "v2"]), rnd.choice([0, 3, 500, None]), seq))
        last = {}
        for e in events:
            last[e[0], e[4]] = e
        for key, (_, op, source, lang, _, tokens, _) in last.items():
            if op == "insert":
                model[key] = (source, lang, tokens or 0)
            elif key in model and op == "revise":
                model[key] = (*model[key][:2], tokens or 0)
            else:
                model.pop(key, None)
        frame = spark.createDataFrame(events, EVENTS)
        assert rollup.apply(batch, frame) and not rollup.apply(batch, frame)
        want = {}
        for (_, version), (source, lang, tokens) in model.items():
            docs, total = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = docs + 1, total + tokens
        assert totals(rollup) == want


def test_a_broken_batch_is_written_over(spark):
    path = work_path(spark, "rollup-broken")
    rollup = R.Rollup(spark, path)
    one = spark.createDataFrame([(1, "insert", "a", "en", "v", 5, 0)], EVENTS)
    rollup.apply(1, one)
    # rows of a batch whose changes were never committed
    spark.createDataFrame([(1, "x", "en", "v", 99, True, 2)], R._STATE).write.parquet(f"{path}/state/batch-2")
    assert totals(rollup) == {("a", "en", "v"): (1, 5)}
    rollup.apply(2, spark.createDataFrame([(1, "revise", None, None, "v", 7, 0)], EVENTS))
    assert totals(rollup) == {("a", "en", "v"): (1, 7)} and rollup.committed() == [1, 2]
    with pytest.raises(ValueError):
        rollup.apply(0, one)


def test_odd_events(spark):
    rollup = R.Rollup(spark, work_path(spark, "rollup-odd"))
    assert totals(rollup) == {}
    odd = [(None, "insert", "a", "en", "v", 5, 0), (1, "insert", "a", "en", None, 5, 0), (2, "frobnicate", "a", "en", "v", 5, 0),
           (3, "delete", "a", "en", "v", 5, 0), (4, "revise", "a", "en", "v", 5, 0), (5, "insert", "a", "en", "v", 5, 0), (5, "insert", "a", "en", "v", 5, 0)]
    rollup.apply(1, spark.createDataFrame(odd, EVENTS))
    assert totals(rollup) == {("a", "en", "v"): (1, 5)}
    rollup.apply(2, spark.createDataFrame([], EVENTS))
    rollup.apply(3, spark.createDataFrame([(5, "delete", None, None, "v", None, 0)], EVENTS))
    assert totals(rollup) == {}


def test_counted_rows_of_every_kind(spark, docs_of):
    docs = docs_of([(0, None, "s"), (1, "", "s"), (2, "a b, c", None), (3, "w " * 200_000, "s"), (2, "a b, c d", None), (None, "lost", "s")], extra="version")
    rollup = R.Rollup(spark, work_path(spark, "rollup-counted"))
    assert rollup.apply(1, R.counted(docs, "insert", docs["text"]))
    # of the rows of one doc_id the one with the largest count; rows without a doc_id do not count
    assert totals(rollup) == {
        ("s", "en", "words-1"): (3, 200_000), ("s", "en", "pieces-1"): (3, 200_000), (None, "en", "words-1"): (1, 4), (None, "en", "pieces-1"): (1, 5),
    }
    empty = R.Rollup(spark, work_path(spark, "rollup-none"))
    assert empty.apply(1, R.counted(docs.where("false"), "insert", docs["text"])) and totals(empty) == {}
