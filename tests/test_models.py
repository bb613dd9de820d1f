"""Models against the mean predictor, searches and rounds that resume."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from assayloom.catalog.models import NBITS, SMALL, campaign, labelled, labels
from assayloom.catalog.views import Views
from assayloom.operators import model as M
from assayloom.plans import campaign as C, reports
from assayloom.runtime import work_path


@pytest.fixture(scope="module")
def views(spark, folder):
    return Views(spark, folder)


def test_model_beats_the_mean(spark, views):
    rows = labelled(views)
    model, metrics = M.train(rows, NBITS, replace(SMALL, max_trees=20))
    row = metrics.first()
    spread = rows.agg(F.stddev_pop("score")).first()[0]
    assert row["val_rmse"] < spread
    assert row["n_train"] + row["n_val"] == rows.count() and row["n_val"] == pytest.approx(rows.count() / 10, abs=10)
    scored = M.score_library(model, views.fps, NBITS)
    assert scored.count() == views.fps.count() and dict(scored.dtypes) == {"id": "bigint", "predicted": "float"}


def test_search_resumes(spark, views):
    path = work_path(spark, "trials-test")
    M.search(labelled(views), NBITS, n_trials=1, folds=2, trials_path=path, max_trees=2)
    first = spark.read.parquet(f"{path}/trial-0").collect()
    again = M.search(labelled(views), NBITS, n_trials=2, folds=2, trials_path=path, max_trees=2)
    rows = {r["trial"]: r for r in again.collect()}
    assert sorted(rows) == [0, 1] and rows[0]["cv_rmse"] == first[0]["cv_rmse"]
    best = M.best_params(again)
    assert best.max_depth in {r["max_depth"] for r in rows.values()}


def test_trials_that_end_together_are_all_kept(spark, monkeypatch):
    """Fits are left out so that the eight trials write at the same time."""
    rows = spark.createDataFrame([(i, [i], float(i)) for i in range(20)], "id long, fp array<long>, score double")
    monkeypatch.setattr(M, "fit_with_patience", lambda fit, held, params, seed: (None, 1, params.learning_rate))
    path = work_path(spark, "trials-parallel")
    M.search(rows, NBITS, n_trials=5, folds=2, trials_path=path, parallelism=4)
    kept = M.search(rows, NBITS, n_trials=8, folds=2, trials_path=path, parallelism=4)
    assert sorted(r["trial"] for r in kept.collect()) == list(range(8))


def test_rungs_cost_fewer_trees():
    assert M.rungs(30, 2000, 3) == [(30, 74), (10, 222), (4, 666), (2, 2000)] or M.rungs(30, 2000, 3)[-1][1] == 2000
    for n, trees, keep in ((30, 2000, 3), (9, 9, 3), (6, 4, 3), (1, 10, 3), (5, 2, 3), (16, 64, 2)):
        plan = M.rungs(n, trees, keep)
        assert plan[0][0] == n and plan[-1][1] == trees
        assert all(b[0] == -(-a[0] // keep) and b[1] <= keep * a[1] + keep for a, b in zip(plan, plan[1:]))
        assert sum(a * b for a, b in plan) <= n * trees
    assert sum(a * b for a, b in M.rungs(30, 2000, 3)) < 0.25 * 30 * 2000


def test_halving_lets_the_best_go_on_and_resumes(spark, monkeypatch):
    """Fits are left out: a trial's error is its learning rate, worse trees only add to it."""
    rows = spark.createDataFrame([(i, [i], float(i)) for i in range(20)], "id long, fp array<long>, score double")
    fits = []

    def fit(train, held, p, seed):
        fits.append((p.learning_rate, p.max_trees))
        return None, 1, p.learning_rate + 1 / p.max_trees

    monkeypatch.setattr(M, "fit_with_patience", fit)
    path = work_path(spark, "halving")
    how = dict(n_trials=9, folds=2, trials_path=path, max_trees=18)
    got = M.search_by_halving(rows, NBITS, **how).collect()
    rate = {t: M.trial_params(t, 42, 18).learning_rate for t in range(9)}
    best = sorted(rate, key=rate.get)
    by_rung = lambda i: {r.trial for r in got if r.rung == i}
    assert [by_rung(i) for i in range(3)] == [set(range(9)), set(best[:3]), {best[0]}]
    assert {r.trial for r in got if r.goes_on and r.rung == 0} == set(best[:3]) and {r.max_trees for r in got} == {2, 6, 18}
    assert len(fits) == 2 * 13
    again = M.search_by_halving(rows, NBITS, **how)
    assert sorted(again.collect()) == sorted(got) and len(fits) == 2 * 13
    assert M.best_params(again).learning_rate == rate[best[0]]
    # a trial lost from the middle is fitted again, and only that one
    import shutil
    shutil.rmtree(f"{path.removeprefix('file:')}/rung-1/trial-{best[1]}")
    assert sorted(M.search_by_halving(rows, NBITS, **how).collect()) == sorted(got) and len(fits) == 2 * 14


def test_trial_ranges():
    for t in range(50):
        p = M.trial_params(t, 1, 10)
        assert 3 <= p.max_depth <= 10 and 0.01 <= p.learning_rate <= 0.3 and 0.5 <= p.subsample <= 1
        assert 0.05 <= p.colsample <= 0.3 and 1 <= p.min_child <= 20
        assert p == M.trial_params(t, 1, 10)


def test_projection_keeps_the_share(views):
    model, keep = M.fit_pca(views.fps, NBITS, k=64, share=0.5)
    parts = model.explainedVariance.toArray()
    assert parts[:keep].sum() >= 0.5 > parts[: keep - 1].sum()
    assert M.project(model, keep, views.fps, NBITS).where(F.size("vector") != keep).count() == 0


def test_campaign_resumes_and_stops(spark, views):
    cfg = campaign(views, seeding="maxmin", batch_size=60, tune_every=2, tune_trials=1, tune_folds=2,
                   params=replace(SMALL, max_trees=3))
    fps, known, answers = views.fps.select("id", "fp"), views.fps.select("id"), labels(views)
    C.run_campaign(spark, cfg, 1, known, fps, answers)
    before = spark.read.parquet(cfg.table("docking_scores")).count()
    table = C.run_campaign(spark, cfg, 2, known, fps, answers).orderBy("round").collect()
    batches = spark.read.parquet(cfg.table("al_batches"))
    assert before == 60 and [r["round"] for r in table] == [0, 1]
    assert batches.count() == batches.select("compound_id").distinct().count() == 120
    assert [r["n_screened_cumulative"] for r in table] == [table[0]["n_valid"], table[0]["n_valid"] + table[1]["n_valid"]]
    assert spark.read.parquet(cfg.table("docking_scores")).count() == 120
    stop = cfg.table("STOP")
    spark.range(1).write.parquet(stop)
    assert C.run_campaign(spark, cfg, 3, known, fps, answers, start=2, stop_file=stop).count() == 2


def test_reports(spark, views):
    scores = views.scores.where("compound_id < 500")
    novelty = reports.novelty_report(scores, views.fps, "T", "exp_0")
    assert novelty["rows"].count() == novelty["by_round"].agg(F.sum("n")).first()[0]
    hits = reports.top_hits(views.scores, views.compounds, "T", "exp_0", 30)
    assert hits.count() == 30
    alerts = reports.alert_report(hits, [("e", "e")])
    assert alerts["by_round"].agg(F.sum("total")).first()[0] == 30
    groups = reports.group_report(hits, lambda text: F.substring(text, 1, 1))
    assert groups["groups"].agg(F.sum("n")).first()[0] == 30 and groups["failed"].first()[0] == 0
    for frame in reports.distribution_report(views.scores, "T", "exp_0").values():
        assert frame.count() > 0
    for frame in reports.comparison_report(views.scores, views.metrics, "T", ["exp_0", "exp_1"]).values():
        assert frame.count() > 0
    for frame in reports.diversity_report(views.background, views.picks, views.picks.where("al_round > 2"), 20).values():
        assert frame.count() > 0
    progress = views.scores.groupBy("experiment_id", "al_round").agg(F.count(F.lit(1)).alias("docked"))
    for frame in reports.discovery_report(views.scores, progress, views.metrics, "T").values():
        assert frame.count() > 0


def test_best_round_waits_for_patience():
    assert M.best_round([5.0, 4.0, 4.5, 3.0, 3.5, 3.6], 10) == (4, False)
    assert M.best_round([5.0, 4.0, 4.5, 4.5, 3.0], 2) == (2, True)
    assert M.best_round([1.0], 5) == (1, False)


def test_early_stop_keeps_the_best_prefix(spark, views):
    p = replace(SMALL, max_trees=12, patience=2, learning_rate=0.9)
    model, metrics = M.train(labelled(views), NBITS, p)
    assert model.getNumTrees < 12 and metrics.first()["val_rmse"] > 0


def test_config_mapping():
    cfg = C.from_config("/r", {
        "target": "T", "experiment_id": "g", "batch_size": 10, "temperature": 0, "hparam_tune_every_n_rounds": 2,
        "optuna_trials": 4, "init_threads": 3, "xgboost": {"max_depth": 4, "device": "x"}, "fp_file": "y",
    }, seeding="random")
    assert (cfg.batch_size, cfg.temperature, cfg.tune_every, cfg.tune_trials, cfg.seed_parts) == (10, 0, 2, 4, 3)
    assert cfg.params.max_depth == 4 and cfg.seeding == "random"


def test_nothing_left_to_draw_is_an_error(spark, views):
    cfg = campaign(views, seeding="random", batch_size=10_000, params=replace(SMALL, max_trees=2))
    fps, known = views.fps.select("id", "fp"), views.fps.select("id")
    C.run_round(spark, cfg, 0, known, fps, labels(views))
    with pytest.raises(ValueError, match="no eligible"):
        C.run_round(spark, cfg, 1, known, fps, labels(views))


def test_first_trees_equal_a_smaller_fit(spark, views, tmp_path):
    rows = M._training_rows(labelled(views), NBITS)
    large, small = (M._regressor(SMALL, 1, n).fit(rows) for n in (6, 3))
    cut = M.first_trees(large, 3)
    assert cut.getNumTrees == 3
    cut.write().overwrite().save(str(tmp_path / "m"))
    again = M.GBTRegressionModel.load(str(tmp_path / "m"))
    for model in (cut, again):
        got, want = ({r["id"]: r["predicted"] for r in m.transform(rows).select("id", "predicted").collect()} for m in (model, small))
        assert got == pytest.approx(want)


def test_training_parts_grow_no_faster_than_the_rows_and_start_low(spark):
    """Every thousand rows were a task of each of some 1,400 jobs, which all report to the driver."""
    rows = spark.range(60_000).select("id", F.array("id").alias("fp"), F.lit(1.0).alias("score"))
    assert M._training_rows(rows, NBITS).rdd.getNumPartitions() <= 32
    parts = {n: M._training_parts(n, 64) for n in (0, 1, 1_000, 5_001, 10**5, 10**6, 10**7, 10**8)}
    assert parts[0] == parts[1] == parts[1_000] == 1 and parts[5_001] == 6
    assert parts[10**6] == 32 and parts[10**8] < 11 * parts[10**7] < 5_000
    assert M._training_parts(10**6, 4096) > 700  # wide rows stay in small parts
