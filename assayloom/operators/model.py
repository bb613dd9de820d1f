"""Surrogate model and projection on spark.ml: boosted trees, random search, scoring, PCA."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from random import Random

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, functions as F

from assayloom.functions.bits import sparse_features
from assayloom.operators.ranking import union_all
from assayloom.operators.windows import decile_split, kfold
from assayloom.runtime import shared_dir, spread, table_complete
from assayloom.schemas import TRAINING_METRICS


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values of the method; max_trees is the ceiling that early stopping works under."""

    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.1
    min_child: int = 1
    max_trees: int = 5000
    patience: int = 50


#: Few rows are dealt to a task each so many, up to so many tasks; beyond that a task holds feature rows of so many bytes.
TRAINING_ROWS_PER_TASK = 1_000
TRAINING_TASKS = 32
TRAINING_BYTES_PER_TASK = 32 << 20


def _training_parts(n: int, nbits: int) -> int:
    """Every level of every tree is two jobs over all parts, and each task reports to the driver, so parts are few and full.

    A set bit takes 12 bytes, and about half of the bits are set. The number does not hang on the cluster, as the draws of a
    fit go by parts.
    """
    full = max(TRAINING_ROWS_PER_TASK, TRAINING_BYTES_PER_TASK // (6 * nbits + 100))
    return max(1, min(-(-n // TRAINING_ROWS_PER_TASK), max(TRAINING_TASKS, -(-n // full))))


def _training_rows(rows: DataFrame, nbits: int) -> DataFrame:
    """Feature rows in as many partitions as their number needs: every tree level is a job over all of them."""
    return sparse_features(rows.repartition(_training_parts(rows.count(), nbits), "id"), nbits).persist()


def _regressor(params: Params, seed: int, trees: int) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="score", predictionCol="predicted", seed=seed,
        maxIter=trees, maxDepth=params.max_depth, stepSize=params.learning_rate,
        subsamplingRate=params.subsample, featureSubsetStrategy=str(params.colsample),
        minInstancesPerNode=params.min_child, cacheNodeIds=True, checkpointInterval=10,
    )


def best_round(errors: list[float], patience: int) -> tuple[int, bool]:
    """The tree count with the lowest error before `patience` trees brought no gain, and whether they did."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_with_patience(fit: DataFrame, held_out: DataFrame, params: Params, seed: int):
    """(model, its tree count to keep, held-out RMSE there).

    The built-in early stop ends at the first tree without gain. Here the ensemble is fitted to a
    size, judged tree by tree on the held-out rows, and doubled until `patience` trees bring nothing;
    a larger fit repeats the smaller one's trees, so the judged prefix stays the same.
    """
    trees = min(params.max_trees, 2 * params.patience)
    while True:
        model = _regressor(params, seed, trees).fit(fit)
        errors = model.evaluateEachIteration(held_out, "squared")
        keep, stopped = best_round(errors, params.patience)
        if stopped or trees == params.max_trees:
            return model, keep, errors[keep - 1] ** 0.5
        trees = min(params.max_trees, 2 * trees)


def first_trees(model: GBTRegressionModel, keep: int) -> GBTRegressionModel:
    """The model of the first `keep` trees with their weights: what a fit of that size would give, without fitting again."""
    if keep >= model.getNumTrees:
        return model
    context = SparkContext._active_spark_context
    ml, trees, weights = context._jvm.org.apache.spark.ml.regression, model._java_obj.trees(), model.treeWeights
    kept = context._gateway.new_array(ml.DecisionTreeRegressionModel, keep)
    shares = context._gateway.new_array(context._jvm.double, keep)
    for i in range(keep):
        kept[i], shares[i] = trees[i], float(weights[i])
    cut = ml.GBTRegressionModel(model.uid, kept, shares)
    cut.setFeaturesCol(model.getFeaturesCol())
    cut.setPredictionCol(model.getPredictionCol())
    return GBTRegressionModel(cut)


def train(labelled: DataFrame, nbits: int, params: Params = Params(), seed: int = 42):
    """Boosted trees on nine tenths, stopped early on the tenth drawn per score decile.

    Returns the model and a one-row metrics table.
    """
    spark = labelled.sparkSession
    shared_dir(spark)
    split = _training_rows(decile_split(labelled.select("id", "fp", "score"), 0.1, seed), nbits)
    fit, held_out = split.where(~F.col("is_val")), split.where("is_val")
    model, keep, val_rmse = fit_with_patience(fit, held_out, params, seed)
    model = first_trees(model, keep)
    n_train, n_val, best = split.agg(
        F.count_if(~F.col("is_val")), F.count_if(F.col("is_val")), F.min("score")
    ).first()
    split.unpersist()
    return model, spark.createDataFrame([(val_rmse, n_train, n_val, best)], TRAINING_METRICS)


def trial_params(trial: int, seed: int, max_trees: int) -> Params:
    """Trial number to parameters, the same in every run, so a search can resume."""
    rng = Random(seed * 1_000_003 + trial)
    # The search ranges.
    return Params(
        max_depth=rng.randint(3, 10),
        learning_rate=0.01 * (0.3 / 0.01) ** rng.random(),
        subsample=rng.uniform(0.5, 1.0),
        colsample=rng.uniform(0.05, 0.3),
        min_child=rng.randint(1, 20),
        max_trees=max_trees,
    )


def search(
    labelled: DataFrame, nbits: int, n_trials: int = 30, folds: int = 5, seed: int = 42,
    trials_path: str | None = None, max_trees: int = 2000, parallelism: int = 4,
) -> DataFrame:
    """Seeded random search by mean RMSE over shuffled folds; one row per trial.

    `parallelism` trials run at a time. With trials_path each finished trial is a committed folder of its own there, so
    trials that end together cannot disturb each other, and a rerun only fits the missing ones.
    """
    rows = _training_rows(kfold(labelled.select("id", "fp", "score"), folds, seed), nbits)
    try:
        return _judged(rows, nbits, range(n_trials), folds, seed, trials_path, max_trees, parallelism)
    finally:
        rows.unpersist()


_TRIALS = "trial int, max_depth int, learning_rate double, subsample double, colsample double, min_child int, max_trees int, cv_rmse double"


def _judged(
    rows: DataFrame, nbits: int, trials: Sequence[int], folds: int, seed: int, path: str | None, max_trees: int, parallelism: int
) -> DataFrame:
    """One row per trial with its mean RMSE over the folds; with a path, trials whose folder there is complete are not fitted."""
    spark = rows.sparkSession
    shared_dir(spark)
    folder = lambda trial: f"{path}/trial-{trial}"
    done = {t for t in trials if path and table_complete(spark, folder(t))}

    def judge(trial: int) -> DataFrame:
        p = trial_params(trial, seed, max_trees)
        errors = [
            fit_with_patience(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f), p, seed)[2]
            for f in range(folds)
        ]
        row = (trial, p.max_depth, p.learning_rate, p.subsample, p.colsample, p.min_child, max_trees, sum(errors) / folds)
        table = spark.createDataFrame([row], _TRIALS)
        if path:
            table.write.mode("overwrite").parquet(folder(trial))
        return table

    # Threads only submit Spark jobs; the fits themselves run on the executors.
    with ThreadPool(parallelism) as pool:
        tables = pool.map(inheritable_thread_target(spark)(judge), [t for t in trials if t not in done])
    if path:
        return spark.read.schema(_TRIALS).parquet(*[folder(t) for t in trials])
    return union_all(tables)


def rungs(n_trials: int, max_trees: int, keep: int) -> list[tuple[int, int]]:
    """(trials, trees) of every rung: one in `keep` trials goes on, with `keep` times the trees, up to max_trees."""
    out, trees = [n_trials], max_trees
    while out[-1] > 1 and trees >= keep:
        out.append(-(-out[-1] // keep))
        trees //= keep
    return [(n, max(1, max_trees // keep ** (len(out) - 1 - i))) for i, n in enumerate(out)]


def search_by_halving(
    labelled: DataFrame, nbits: int, n_trials: int = 30, folds: int = 5, seed: int = 42,
    trials_path: str | None = None, max_trees: int = 2000, keep: int = 3, parallelism: int = 4,
) -> DataFrame:
    """Successive halving of the same seeded trials: rung, the trial's columns as in `search`, and goes_on.

    Every rung judges its trials with few trees; the best of them, one in `keep`, ties to the smaller trial, go on to `keep`
    times the trees. Only the last rung's trials grow max_trees, so bad trials cost few trees. With trials_path a finished
    trial of a rung is a committed folder, so a rerun fits only the missing ones and lets the same trials go on.
    """
    rows = _training_rows(kfold(labelled.select("id", "fp", "score"), folds, seed), nbits)
    left, out = list(range(n_trials)), []
    try:
        plan = rungs(n_trials, max_trees, keep)
        for i, (n, trees) in enumerate(plan):
            path = f"{trials_path}/rung-{i}" if trials_path else None
            judged = _judged(rows, nbits, left, folds, seed, path, trees, parallelism)
            # one row per trial of the rung
            order = [r["trial"] for r in judged.orderBy("cv_rmse", "trial").select("trial").collect()]
            left = sorted(order[: plan[i + 1][0]]) if i + 1 < len(plan) else []
            out.append(judged.select(F.lit(i).alias("rung"), "*", F.col("trial").isin(left).alias("goes_on")))
    finally:
        rows.unpersist()
    return union_all(out)


def best_params(trials: DataFrame, max_trees: int = 5000) -> Params:
    """The best trial of a search; of a search by halving, the best of its last rung."""
    last = [F.col("rung").desc()] if "rung" in trials.columns else []
    r = trials.orderBy(*last, "cv_rmse", "trial").first()
    return Params(r["max_depth"], r["learning_rate"], r["subsample"], r["colsample"], r["min_child"], max_trees)


def score_library(model: GBTRegressionModel, fps: DataFrame, nbits: int) -> DataFrame:
    """(id, predicted) for every row: one narrow pass, no shuffle."""
    return model.transform(sparse_features(spread(fps.select("id", "fp")), nbits)).select(
        "id", F.col("predicted").cast("float").alias("predicted")
    )


def fit_pca(fps: DataFrame, nbits: int, k: int = 300, share: float = 0.95):
    """Fits on the rows given; returns the model, and how many components reach the share (at most k)."""
    k = min(k, nbits)
    model = PCA(k=k, inputCol="features", outputCol="projected").fit(sparse_features(fps.select("id", "fp"), nbits))
    total, keep = 0.0, k
    for i, part in enumerate(model.explainedVariance.toArray()):
        total += float(part)
        if total >= share:
            keep = i + 1
            break
    return model, keep


def project(model, keep: int, fps: DataFrame, nbits: int) -> DataFrame:
    """(id, vector) with the kept components."""
    out = model.transform(sparse_features(fps.select("id", "fp"), nbits))
    return out.select("id", F.slice(vector_to_array("projected"), 1, keep).alias("vector"))

