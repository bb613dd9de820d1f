"""The queue's batches are the same however its feed was cut, replayed or restarted."""

import pytest
from pyspark.sql import functions as F

from assayloom.streaming import queue as Q, results as R

SCHEMA = "id long, note string, prepared boolean"


def feed(spark, folder, parts):
    for ids in parts:
        rows = [(i, f"n{i}", None if i % 11 == 3 else i % 7 != 0) for i in ids]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, t, size):
    Q.queue_micro_batches(
        R.read_results(spark, f"{t}/feed", SCHEMA, 1), size, ["id"], f"{t}/queue", f"{t}/failed", f"{t}/state", f"{t}/ck"
    ).awaitTermination()


def finish(spark, t, size):
    return Q.finish_queue(spark, spark.createDataFrame([], SCHEMA).schema, size, ["id"], f"{t}/queue", f"{t}/state")


def queued(spark, t):
    return {r.id: r.batch_no for r in spark.read.parquet(f"{t}/queue").collect()}


def wanted(ids, size, first=0):
    good = [i for i in ids if i % 11 != 3 and i % 7 != 0]
    return {i: first + n // size for n, i in enumerate(good)}


@pytest.mark.parametrize("cut", [[100], [1] * 6 + [94], [37, 0, 3, 60], [10, 15, 75]])
def test_any_cut_gives_the_same_batches(spark, tmp_path, cut):
    t, at, parts = str(tmp_path), 0, []
    for n in cut:
        parts.append(range(at, at + n))
        at += n
    feed(spark, f"{t}/feed", parts)
    drain(spark, t, 9)
    want = wanted(range(100), 9)
    full = {i: b for i, b in want.items() if list(want.values()).count(b) == 9}
    assert queued(spark, t) == full and len(full) < len(want)  # no short batch before the end
    assert finish(spark, t, 9) == len(want) - len(full) and finish(spark, t, 9) == 0
    assert queued(spark, t) == want
    failed = spark.read.parquet(f"{t}/failed")
    assert {r.id for r in failed.collect()} == set(range(100)) - set(want)
    assert failed.where("prepared").count() == 0


def test_a_restarted_feed_goes_on(spark, tmp_path):
    t = str(tmp_path)
    feed(spark, f"{t}/feed", [range(0, 20)])
    drain(spark, t, 9)
    feed(spark, f"{t}/feed", [range(20, 23), range(23, 60)])
    drain(spark, t, 9)
    finish(spark, t, 9)
    first = wanted(range(60), 9)
    assert queued(spark, t) == first
    # after its end a feed may start again: with a new batch
    feed(spark, f"{t}/feed", [range(60, 90)])
    drain(spark, t, 9)
    finish(spark, t, 9)
    assert queued(spark, t) == first | wanted(range(60, 90), 9, max(first.values()) + 1)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v=2", "v=3"]


def test_a_replay_changes_nothing_and_a_lost_state_raises(spark, tmp_path):
    t = str(tmp_path)
    args = (9, ["id"], f"{t}/queue", f"{t}/state")
    part = lambda a, b: spark.range(a, b).select("id", F.lit("x").alias("note"), F.lit(True).alias("prepared"))
    Q.take_micro_batch(part(0, 13), 0, *args)
    Q.take_micro_batch(part(13, 25), 1, *args)
    once = queued(spark, t)
    for _ in range(2):
        Q.take_micro_batch(part(13, 25), 1, *args)
    assert queued(spark, t) == once == {i: i // 9 for i in range(18)}
    with pytest.raises(RuntimeError, match="state after micro-batch 4"):
        Q.take_micro_batch(part(25, 30), 5, *args)


def test_repeated_rows_and_ties_are_all_queued(spark, tmp_path):
    t = str(tmp_path)
    rows = spark.createDataFrame([(1, "a", True)] * 5 + [(1, "b", True)] * 5 + [(None, None, True)], SCHEMA).repartition(3)
    Q.take_micro_batch(rows, 0, 4, ["id"], f"{t}/queue", f"{t}/state")
    Q.take_micro_batch(rows.limit(0), 1, 4, ["id"], f"{t}/queue", f"{t}/state")
    assert finish(spark, t, 4) == 3
    got = spark.read.parquet(f"{t}/queue").groupBy("batch_no").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 4), (1, 4), (2, 3)]


def test_no_feed(spark, tmp_path):
    assert finish(spark, str(tmp_path), 9) == 0
