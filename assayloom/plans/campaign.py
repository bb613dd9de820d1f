"""One screening round, and a run of rounds. Every stage reads and writes tables, so a rerun resumes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayloom import schemas
from assayloom.operators.aggregates import BEST_NS
from assayloom.operators.filters import in_scope, threshold_null, trainable
from assayloom.operators.joins import eligible, labels_with_features, latest_hparams, not_done, only_known
from assayloom.operators.model import Params, best_params, score_library, search, search_by_halving, train
from assayloom.operators.ranking import nth_best
from assayloom.operators.sampling import hash_sample, maxmin_partitioned, thompson
from assayloom.runtime import cut_lineage, table_complete
from assayloom.sinks.tables import (
    append_batch, append_round_metrics, append_scores, batch_exists, read_or_empty, write_predictions,
)
from assayloom.streaming.results import stop_requested


_HPARAMS = T.StructType([
    T.StructField("round", T.IntegerType()), T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
])


@dataclass(frozen=True)
class Campaign:
    """One experiment. Field defaults are the campaign's usual settings; tune_every 0 never tunes.

    tune_keep k > 1 searches by halving, in which one trial in k goes on; 0 grows every trial in full.
    """

    root: str
    target: str
    experiment_id: str
    nbits: int = 4096
    batch_size: int = 24_000
    temperature: float = 1.0
    fail_threshold: float = 0.0
    seed: int = 42
    seeding: str = "maxmin"
    seed_parts: int = 24
    seed_block: int = 500_000
    tune_every: int = 3
    tune_trials: int = 30
    tune_folds: int = 5
    tune_keep: int = 0
    params: Params = field(default_factory=Params)

    def table(self, name: str) -> str:
        return f"{self.root}/{name}"

    def slot(self, name: str, rnd: int) -> str:
        return f"{self.root}/{name}/{self.target}/{self.experiment_id}/round={rnd}"


# The ceiling of trees in a parameter search; the final fit has its own.
SEARCH_TREES = 2000

# The keys of an experiment's config file and the fields they set.
_CONFIG_KEYS = {
    "batch_size": "batch_size", "temperature": "temperature", "fail_threshold": "fail_threshold", "seed": "seed",
    "init_threads": "seed_parts", "subsample_per_worker": "seed_block", "hparam_tune_every_n_rounds": "tune_every",
    "optuna_trials": "tune_trials",
}
_MODEL_KEYS = {
    "max_depth": "max_depth", "learning_rate": "learning_rate", "subsample": "subsample",
    "colsample_bytree": "colsample", "min_child_weight": "min_child",
}


def from_config(root: str, config: dict, **overrides) -> Campaign:
    """A campaign from the mapping of an experiment's config file. Keys of other tools are ignored."""
    fields = {field_: config[key] for key, field_ in _CONFIG_KEYS.items() if key in config}
    model = config.get("xgboost", {})
    params = Params(**{field_: model[key] for key, field_ in _MODEL_KEYS.items() if key in model})
    fields |= {"params": params, **overrides}
    return Campaign(root=root, target=config["target"], experiment_id=config["experiment_id"], **fields)


def label_lookup(batch: DataFrame, labels: DataFrame) -> DataFrame:
    """(compound_id, score) for a batch; a row without a label is a failed attempt."""
    return batch.join(labels.select(F.col("id").alias("compound_id"), "score"), "compound_id", "left")


def _scores(spark: SparkSession, cfg: Campaign) -> DataFrame:
    return in_scope(read_or_empty(spark, cfg.table("docking_scores"), schemas.SCORES), cfg.target, cfg.experiment_id)


def _batches(spark: SparkSession, cfg: Campaign) -> DataFrame:
    return read_or_empty(spark, cfg.table("al_batches"), schemas.BATCHES)


def seed_batch(spark: SparkSession, cfg: Campaign, compounds: DataFrame, fps: DataFrame) -> None:
    if batch_exists(spark, cfg.table("al_batches"), cfg.target, cfg.experiment_id, 0):
        return
    known = only_known(fps, compounds)
    if cfg.seeding == "random":
        ids, source = hash_sample(known.select("id"), cfg.batch_size, cfg.seed), "random_init"
    else:
        first, last = known.agg(F.min("id"), F.max("id")).first()
        ids = maxmin_partitioned(known, cfg.batch_size, cfg.seed_parts, cfg.seed_block, cfg.seed, first, last)
        source = "diversity_init"
    append_batch(ids, cfg.table("al_batches"), cfg.target, cfg.experiment_id, 0, source)


def select_batch(spark: SparkSession, cfg: Campaign, rnd: int, compounds: DataFrame, fps: DataFrame) -> None:
    """Scores the library with the last model and draws the round's batch; fails where nothing is left to draw."""
    if batch_exists(spark, cfg.table("al_batches"), cfg.target, cfg.experiment_id, rnd):
        return
    model = GBTRegressionModel.load(cfg.slot("models", rnd - 1))
    path = cfg.slot("predictions", rnd)
    if not table_complete(spark, path):
        write_predictions(score_library(model, fps, cfg.nbits), path)
    pred = spark.read.schema("id long, predicted float").parquet(path)
    # Drawing a large batch reads the pool several times; its joins run once.
    pool = cut_lineage(
        eligible(pred, compounds, _scores(spark, cfg), _batches(spark, cfg), cfg.target, cfg.experiment_id)
    )
    if pool.limit(1).isEmpty():
        raise ValueError(f"no eligible rows for round {rnd} of {cfg.experiment_id}")
    drawn = thompson(pool, cfg.batch_size, cfg.temperature, cfg.seed, rnd)
    source = "thompson_sample" if cfg.temperature > 0 else "greedy_select"
    append_batch(drawn, cfg.table("al_batches"), cfg.target, cfg.experiment_id, rnd, source)


def label_batch(spark: SparkSession, cfg: Campaign, rnd: int, labels: DataFrame) -> None:
    todo = not_done(_batches(spark, cfg), _scores(spark, cfg), cfg.target, cfg.experiment_id, rnd)
    if todo.limit(1).isEmpty():
        return
    scored = label_lookup(todo, labels).select(
        "compound_id", threshold_null(F.col("score"), cfg.fail_threshold).alias("score"),
        F.current_timestamp().alias("docked_at"), F.lit(cfg.target).alias("target"),
        F.lit(cfg.experiment_id).alias("experiment_id"), F.lit(rnd).alias("al_round"),
    )
    # A second go at a round writes beside the first; a go that broke off has committed nothing and is written again.
    before = _scores(spark, cfg).where(F.col("al_round") == rnd).count()
    append_scores(scored, cfg.table("docking_scores"), f"round-{rnd}-{before}")


def train_round(spark: SparkSession, cfg: Campaign, rnd: int, fps: DataFrame) -> None:
    """Fits on everything labelled so far; parameters are tuned now, or the latest tuned, or the defaults."""
    path = cfg.slot("models", rnd)
    # The trees are the last part of a model to be written.
    if table_complete(spark, f"{path}/data") and table_complete(spark, cfg.slot("train_metrics", rnd)):
        return
    labelled = labels_with_features(trainable(_scores(spark, cfg), cfg.fail_threshold), fps)
    hp_path = cfg.table(f"hparams/{cfg.target}/{cfg.experiment_id}")
    if cfg.tune_every and rnd % cfg.tune_every == 0:
        how = (cfg.nbits, cfg.tune_trials, cfg.tune_folds, cfg.seed, cfg.slot("trials", rnd), min(SEARCH_TREES, cfg.params.max_trees))
        trials = search_by_halving(labelled, *how, cfg.tune_keep) if cfg.tune_keep > 1 else search(labelled, *how)
        found = {k: float(v) for k, v in asdict(best_params(trials, cfg.params.max_trees)).items()}
        spark.createDataFrame([(rnd, found)], "round int, params map<string,double>").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("round").parquet(hp_path)
    saved = latest_hparams(
        read_or_empty(spark, hp_path, _HPARAMS), rnd
    ).first()["params"]
    params = cfg.params if saved is None else Params(**{
        k: (int(v) if k in ("max_depth", "min_child", "max_trees", "patience") else v) for k, v in saved.items()
    })
    model, metrics = train(labelled, cfg.nbits, params, cfg.seed)
    model.write().overwrite().save(path)
    metrics.write.mode("overwrite").parquet(cfg.slot("train_metrics", rnd))


def summarise_round(spark: SparkSession, cfg: Campaign, rnd: int) -> None:
    scores = _scores(spark, cfg)
    this = scores.where(F.col("al_round") == rnd)
    head = this.groupBy("target", "experiment_id", F.col("al_round").alias("round")).agg(
        F.count("score").alias("n_valid"), F.count_if(F.col("score").isNull()).alias("n_failed"), F.avg("score").alias("mean")
    )
    best = nth_best(this, ["target", "experiment_id", "al_round"], "score", BEST_NS).withColumnRenamed("al_round", "round")
    so_far = scores.where(F.col("score").isNotNull() & (F.col("al_round") <= rnd)).groupBy("target", "experiment_id").agg(
        F.count(F.lit(1)).alias("n_screened_cumulative")
    )
    fit = spark.read.schema(schemas.TRAINING_METRICS).parquet(cfg.slot("train_metrics", rnd)).select(
        "val_rmse", "n_train", F.lit(rnd).alias("round")
    )
    keys = ["target", "experiment_id"]
    row = head.join(best, [*keys, "round"], "left").join(so_far, keys, "left").join(fit, "round", "left")
    append_round_metrics(
        row.withColumn("timestamp", F.current_timestamp()).select(*schemas.ROUND_METRICS.names), cfg.table("round_metrics")
    )


def run_round(
    spark: SparkSession, cfg: Campaign, rnd: int, compounds: DataFrame, fps: DataFrame, labels: DataFrame
) -> DataFrame:
    """Select (or seed), label, train, summarise; returns the round's metrics row."""
    if rnd == 0:
        seed_batch(spark, cfg, compounds, fps)
    else:
        select_batch(spark, cfg, rnd, compounds, fps)
    label_batch(spark, cfg, rnd, labels)
    train_round(spark, cfg, rnd, fps)
    summarise_round(spark, cfg, rnd)
    return metrics(spark, cfg).where(F.col("round") == rnd)


def run_campaign(
    spark: SparkSession, cfg: Campaign, rounds: int, compounds: DataFrame, fps: DataFrame, labels: DataFrame,
    start: int = 0, stop_file: str | None = None,
) -> DataFrame:
    """`rounds` rounds from `start`. The stop file is looked for before each, so a round in work ends first."""
    for rnd in range(start, start + rounds):
        if stop_requested(spark, stop_file):
            break
        run_round(spark, cfg, rnd, compounds, fps, labels)
    return metrics(spark, cfg)


def metrics(spark: SparkSession, cfg: Campaign) -> DataFrame:
    return in_scope(
        read_or_empty(spark, cfg.table("round_metrics"), schemas.ROUND_METRICS), cfg.target, cfg.experiment_id
    )
