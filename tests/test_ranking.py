"""Exact ranks and percentiles on skewed data: one value or one group holds a third of the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import ranking as R

N = 60_000


@pytest.fixture(scope="module")
def skewed(spark):
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(N).repartition(7).select(
        "id", F.when(hot, 0).otherwise(i % 5 + 1).cast("int").alias("g"),
        F.when(i % 4 == 1, -2.5).otherwise(-((i * 7919) % 10007) / 1000.0).alias("score"),
    )


@pytest.fixture(scope="module")
def local(skewed):
    return skewed.toPandas()


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("accuracy", [10_000, 40])
def test_percentiles_equal_linear_interpolation(skewed, local, by, accuracy, monkeypatch):
    """Also with a sketch so coarse that its first brackets miss."""
    monkeypatch.setattr(R, "SKETCH_ACCURACY", accuracy)
    ps = {"p10": 0.1, "p50": 0.5, "p75": 0.75, "p999": 0.999, "p0": 0.0, "p100": 1.0}
    got = {(r["g"] if by else None): r for r in R.exact_percentiles(skewed, by, "score", ps).collect()}
    groups = local.groupby("g") if by else [(None, local)]
    for key, part in groups:
        assert got[key]["n"] == len(part)
        for name, p in ps.items():
            assert got[key][name] == pytest.approx(np.percentile(part.score, 100 * p), abs=1e-12)


def test_percentiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    row = R.exact_percentiles(df, [], "v", {"m": 0.5}).first()
    assert (row["n"], row["m"]) == (2, 2.0)


def test_rank_within_is_a_dense_rank_of_each_group(skewed, local):
    got = R.rank_within(skewed, ["g"], ["score", "id"]).toPandas().sort_values("id").reset_index(drop=True)
    want = local.sort_values(["score", "id"]).groupby("g").cumcount() + 1
    want = want.reindex(local.index)
    assert (got["rank"].to_numpy() == want.loc[local.sort_values("id").index].to_numpy()).all()


def test_rank_without_groups(skewed, local):
    got = R.rank_within(skewed, [], ["score", "id"]).toPandas()
    assert sorted(got["rank"]) == list(range(1, N + 1))
    ordered = got.sort_values("rank")
    assert (ordered["id"].to_numpy() == local.sort_values(["score", "id"])["id"].to_numpy()).all()


def test_top_n_by_group(skewed, local):
    got = R.top_n_by_group(skewed, ["g"], ["score", "id"], 25).toPandas()
    for g, part in local.groupby("g"):
        want = part.sort_values(["score", "id"]).head(25)["id"].tolist()
        assert got[got.g == g].sort_values("rank")["id"].tolist() == want


def test_top_n_limits_rows_before_the_shuffle(skewed):
    plan = R.top_n_by_group(skewed, ["g"], ["score"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("k", [1, 999, 25_000, N, N + 5])
@pytest.mark.parametrize("single_pass,band", [(0, 20_000_000), (0, 50), (10**9, 0)])
def test_smallest_k_every_way(skewed, local, k, single_pass, band, monkeypatch):
    monkeypatch.setattr(R, "BAND_ROWS", band)
    got = R.smallest_k(skewed, "score", ["id"], k, single_pass_rows=single_pass).toPandas()
    want = local.sort_values(["score", "id"]).head(k)
    assert sorted(got["id"]) == sorted(want["id"])


def test_nth_best_is_null_in_short_groups(spark):
    df = spark.createDataFrame([(1, -1.0), (1, -3.0), (1, None), (2, -2.0)], "g int, score double")
    rows = {r["g"]: r for r in R.nth_best(df, ["g"], "score", (1, 2)).collect()}
    assert (rows[1]["best1"], rows[1]["best2"]) == (-3.0, -1.0)
    assert (rows[2]["best1"], rows[2]["best2"]) == (-2.0, None)


def test_null_keys_are_a_group(spark):
    rows = spark.range(300).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS g", "id", "cast(id AS double) AS score")
    ranked = R.rank_within(rows, ["g"], ["id"])
    assert ranked.count() == 300 and ranked.where("g IS NULL").agg({"rank": "max"}).first()[0] == 100
    got = {r["g"]: (r["n"], r["mid"]) for r in R.exact_percentiles(rows, ["g"], "score", {"mid": 0.5}).collect()}
    assert got == {None: (100, 148.5), 1: (100, 149.5), 2: (100, 150.5)}


def test_no_raw_row_is_shuffled_by_its_group(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).selectExpr("id % 3 AS g", "id", "cast(id AS double) AS score")
        sound = rows.where("score IS NOT NULL")
        plan = R._bracketed(sound, ["g"], rows["score"], {"mid": 0.5}, {}, 0.01)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        ranked = R.rank_within(rows, ["g"], ["id"])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in ranked and "hashpartitioning" not in ranked
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
