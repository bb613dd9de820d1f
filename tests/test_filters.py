"""Small predicates on the values that break them."""

import pytest
from pyspark.sql import functions as F

from assayloom.functions import binning as B
from assayloom.operators import aggregates as A, filters as X, ingest as I, joins as J


def test_missing_properties_in_a_half_open_range(spark):
    rows = spark.createDataFrame(
        [(1, "C", None, 1.0), (2, "C", 1.0, None), (3, "", None, None), (4, None, None, None), (5, "C", 1.0, 1.0), (6, "C", None, None)],
        "id long, smiles string, mw double, logp double",
    )
    assert sorted(r["id"] for r in X.missing_properties(rows).collect()) == [1, 2, 6]
    assert sorted(r["id"] for r in X.missing_properties(rows, 2, 6).collect()) == [2]


def test_eligible_leaves_out_unknown_used_and_unfinished(spark):
    pred = spark.createDataFrame(
        [(1, -1.0), (2, None), (3, float("nan")), (4, float("inf")), (5, -5.0), (6, -6.0), (7, -7.0), (8, -8.0)],
        "id long, predicted double",
    )
    scores = spark.createDataFrame([(5, "T", "e", 0, -1.0), (1, "T", "other", 0, -1.0)],
                                   "compound_id long, target string, experiment_id string, al_round int, score double")
    batches = spark.createDataFrame([(6, "T", "e", 1), (6, "T", "e", 1)], "compound_id long, target string, experiment_id string, round int")
    got = J.eligible(pred, spark.range(8), scores, batches, "T", "e")
    assert sorted(r["id"] for r in got.collect()) == [1, 7]


def test_threshold_is_strict(spark):
    rows = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (None,)], "score double")
    assert [r[0] for r in X.trainable(rows).collect()] == [-1.0]
    assert [r[0] for r in rows.select(X.threshold_null(F.col("score"), 0.0)).collect()] == [-1.0, None, None, None]


@pytest.mark.parametrize("v,inside,clipped", [(-0.1, None, 0), (0.0, 0, 0), (0.999, 0, 0), (1.0, 1, 1), (4.0, 3, 3), (4.1, None, 3)])
def test_last_bin_is_closed(spark, v, inside, clipped):
    row = spark.range(1).select(B.bin_inside(F.lit(v), 0.0, 1.0, 4), B.bin_clipped(F.lit(v), 0.0, 1.0, 4)).first()
    assert (row[0], row[1]) == (inside, clipped)


def test_hit_rate_is_strict_and_zero_first_round_has_no_fold(spark):
    rows = spark.createDataFrame([(0, -12.0), (0, -11.0), (1, -12.5), (1, -12.0)], "al_round int, score double")
    rates = A.hit_rates(rows, thresholds=(-12.0,))
    assert {r["al_round"]: r["pct"] for r in rates.collect()} == {0: 0.0, 1: 50.0}
    assert A.fold_enrichment(rates).first()["fold"] is None


def test_entropy_of_equal_groups(spark):
    row = A.entropy(spark.range(64).select((F.col("id") % 8).alias("group_key"))).first()
    assert row["entropy_bits"] == pytest.approx(3.0) and row["n_single"] == 0 and row["n_unique"] == 8


def test_id_ranges_cover_every_id_once(spark):
    rows = I.id_ranges(spark.range(1, 104), 10).orderBy("k").collect()
    covered = [i for r in rows for i in range(r["start_id"], r["end_id"] + 1)]
    assert covered == list(range(1, 104)) and len(rows) == 10


def test_chunks_skip_done(spark):
    done = spark.createDataFrame([(11,)], "start_id long")
    got = sorted(tuple(r) for r in I.half_open_chunks(spark.range(1, 26), 10, done).collect())
    assert got == [(1, 11), (21, 31)]
