"""Running reports cut into many small blocks, and the split quotas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import windows as W


@pytest.fixture(scope="module")
def feed(spark):
    i = F.col("id")
    return spark.range(5003).select(
        i.alias("at"), F.when(i % 3 == 0, "b").otherwise("a").alias("f"),
        F.when(i % 11 != 0, -((i * 7919) % 4001) / 10.0).alias("score"),
    )


def brute(pdf, every, at_end=True):
    out = {}
    for f, part in pdf.sort_values("at").groupby("f"):
        scores = part.score.to_numpy()
        for n in range(1, len(scores) + 1):
            if n % every == 0 or (at_end and n == len(scores)):
                v = np.sort(scores[:n][~np.isnan(scores[:n])])
                out[f, n] = (len(v), n - len(v), *[v[k - 1] if len(v) >= k else None for k in (1, 10, 100, 1000)])
    return out


def as_dict(df):
    return {
        (r["f"], r["docked"]): (r["valid"], r["failed"], r["best1"], r["best10"], r["best100"], r["best1000"])
        for r in df.collect()
    }


@pytest.mark.parametrize("block_rows", [None, 250, 100])
def test_checkpoints(feed, block_rows):
    got = as_dict(W.progress_checkpoints(feed, ["f"], ["at"], 100, block_rows=block_rows))
    assert got == brute(feed.toPandas(), 100)


def test_checkpoints_continue_from_a_state(feed):
    first, second = feed.where("at < 1777"), feed.where("at >= 1777")
    state = W.feed_state(first, ["f"])
    got = as_dict(W.progress_checkpoints(first, ["f"], ["at"], 100, at_end=False))
    got |= as_dict(W.progress_checkpoints(second, ["f"], ["at"], 100, block_rows=200, state=state, at_end=False))
    assert got == brute(feed.toPandas(), 100, at_end=False)
    both, whole = W.feed_state(second, ["f"], state).collect(), W.feed_state(feed, ["f"]).collect()
    assert sorted(both) == sorted(whole)


def test_cumulative_best_never_worsens(spark, folder):
    from assayloom.catalog.views import Views

    rows = W.cumulative_best_n(Views(spark, folder).scores).orderBy("experiment_id", "al_round").toPandas()
    for _, part in rows.groupby("experiment_id"):
        assert (part.best1.diff().dropna() <= 0).all() and part.cum_docked.is_monotonic_increasing


def test_split_takes_a_tenth_of_every_decile(spark):
    rows = spark.range(1237).select("id", (-(F.col("id") % 50) / 7.0).alias("score"))
    got = W.decile_split(rows, 0.1, 3).toPandas()
    assert len(got) == 1237 and sorted(got.decile.unique()) == list(range(10))
    for _, part in got.groupby("decile"):
        assert part.is_val.sum() == max(1, int(len(part) * 0.1))
    again = W.decile_split(rows.repartition(9), 0.1, 3).toPandas()
    assert set(got[got.is_val].id) == set(again[again.is_val].id)


def test_tiny_decile_still_gives_one(spark):
    got = W.decile_split(spark.range(10).select("id", (-F.col("id")).cast("double").alias("score"))).toPandas()
    assert got.is_val.all() and len(got) == 10


def test_folds_are_even(spark):
    sizes = W.kfold(spark.range(503), 5, 1).groupBy("fold").count().toPandas()["count"]
    assert sizes.sum() == 503 and sizes.max() - sizes.min() <= 1


def test_share_cut(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 15), ("d", 5)], "k string, n long")
    got = W.cumulative_share_cut(sizes, "k", "n", 0.95).toPandas().sort_values("cum_share")
    assert got.k.tolist() == ["a", "b", "c"] and got.cum_share.tolist() == pytest.approx([0.5, 0.8, 0.95])
