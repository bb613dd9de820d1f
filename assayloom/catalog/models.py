"""Model jobs and whole rounds. SQL cannot fit models, so the queries report what it can check; tests hold the rest to laws."""

from pyspark.sql import Window, functions as F

from assayloom.catalog.registry import query
from assayloom.catalog.windowed import u01
from assayloom.operators import model as M
from assayloom.operators.sampling import fit_split
from assayloom.plans import campaign as C
from assayloom.runtime import work_path

NBITS = 64
SMALL = M.Params(max_depth=4, learning_rate=0.3, colsample=0.5, max_trees=8)
# Early stopping acts well below this ceiling.
PATIENT = M.Params(max_depth=4, learning_rate=0.3, colsample=0.5, max_trees=60, patience=6)


def labels(v):
    """A score that depends on the first components of each vector."""
    first = F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda a, x: a + x)
    return v.table("embeddings").select(F.col("vec_id").alias("id"), (F.lit(-5.0) - first).alias("score"))


def labelled(v):
    return v.fps.select("id", "fp").join(labels(v), "id")


@query("job_train", """
    WITH k AS (SELECT vec_id AS id, -5.0::DOUBLE - list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)) AS score FROM embeddings),
    d AS (SELECT (row_number() OVER (ORDER BY score, id) - 1) * 10 // (SELECT count(*) FROM k) AS decile FROM k),
    v AS (SELECT sum(greatest(1, floor(n * 0.1::DOUBLE))) AS n_val FROM (SELECT count(*) AS n FROM d GROUP BY decile))
    SELECT cast(count(*) - max(n_val) AS bigint) AS n_train, cast(max(n_val) AS bigint) AS n_val, round(min(score), 6) AS best, true AS beats_mean, true AS stopped_early
    FROM k, v""")
def _(v):
    rows = labelled(v)
    model, metrics = M.train(rows, NBITS, PATIENT)
    spread = rows.agg(F.stddev_pop("score")).first()[0]
    return metrics.select(
        F.col("n_train").cast("long").alias("n_train"), F.col("n_val").cast("long").alias("n_val"),
        F.round("best_docking_score", 6).alias("best"), (F.col("val_rmse") < spread).alias("beats_mean"),
        F.lit(model.getNumTrees < PATIENT.max_trees).alias("stopped_early"),
    )


@query("job_hpo", """
    SELECT cast(rung AS int) AS rung, cast(count(DISTINCT trial) AS bigint) AS trials, cast(any_value(trees) AS int) AS trees,
           cast(any_value(goes) AS bigint) AS goes_on, any_value(n) AS n_rows, cast(0 AS bigint) AS wrong
    FROM (VALUES (0, 6, 1, 2), (1, 2, 4, 0)) AS r(rung, held, trees, goes), range(6) AS t(trial),
         (SELECT count(*) AS n FROM embeddings WHERE embedding IS NOT NULL) WHERE trial < held GROUP BY rung""")
def _(v):
    """Six trials of one tree, two of four. `wrong` replays from the stored errors who goes on and who is judged next."""
    out, rows = work_path(v.spark, "trials"), labelled(v)
    M.search_by_halving(rows, NBITS, n_trials=6, folds=2, trials_path=out, max_trees=4)
    stored = v.spark.read.option("basePath", out).parquet(f"{out}/rung-0", f"{out}/rung-1", recursiveFileLookup=True)
    stored = stored.select("trial", "max_trees", "cv_rmse", F.regexp_extract(F.col("_metadata.file_path"), r"rung-(\d+)", 1).cast("int").alias("rung"))
    order = Window.partitionBy("rung").orderBy("cv_rmse", "trial")
    sound = stored.where((F.col("cv_rmse") > 0) & ~F.isnan("cv_rmse"))
    ranked = sound.withColumn("next", (F.row_number().over(order) <= 2) & (F.col("rung") == 0))
    judged = stored.where("rung = 1").select("trial", F.lit(True).alias("seen"))
    checked = ranked.join(judged, "trial", "left").withColumn("seen", F.col("seen").isNotNull() & (F.col("rung") == 0))
    per = checked.groupBy("rung").agg(
        F.count("*").alias("trials"), F.max("max_trees").alias("trees"), F.count_if("seen").alias("goes_on"),
        F.count_if(F.col("seen") != F.col("next")).alias("wrong"),
    )
    return per.withColumn("n_rows", F.lit(rows.count()).cast("long"))


#: One split, on all rows and bits: what SQL can replay.
STUMP = M.Params(max_depth=1, subsample=1.0, colsample=1.0, max_trees=1)


@query("job_score_library", f"""
    WITH k AS (SELECT vec_id AS id, -5.0::DOUBLE - list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)) AS score FROM embeddings),
    d AS (SELECT *, (row_number() OVER (ORDER BY score, id) - 1) * 10 // (SELECT count(*) FROM k) AS decile FROM k),
    s AS (SELECT id, score, row_number() OVER (PARTITION BY decile ORDER BY {u01('id', 42)}, id)
            > greatest(1, floor(count(*) OVER (PARTITION BY decile) * 0.1::DOUBLE)) AS fit FROM d),
    g AS (SELECT i, b, count(*) AS n, sum(score) AS total FROM s JOIN v_fpbits f ON f.id = s.id WHERE fit GROUP BY i, b),
    best AS (SELECT i FROM g GROUP BY i HAVING count(*) = 2 ORDER BY sum(total * total / n) DESC, i LIMIT 1)
    SELECT f.id, round(cast(g.total / g.n AS FLOAT)::DOUBLE, 4) AS predicted FROM v_fpbits f JOIN best USING (i) JOIN g ON g.i = f.i AND g.b = f.b""")
def _(v):
    """Trained on nine tenths, applied to all; the oracle draws the same tenth and finds the same split."""
    model, _ = M.train(labelled(v), NBITS, STUMP)
    return M.score_library(model, v.fps, NBITS).select("id", F.round(F.col("predicted").cast("double"), 4).alias("predicted"))


@query("job_pca", "SELECT id, cast(count(*) FILTER (b) AS double) AS squared_length FROM v_fpbits GROUP BY id")
def _(v):
    """Fitted on a sample, applied to all. With every component kept, a projection keeps the length of its vector."""
    fit = fit_split(v.fps.select("id", "fp"), 300, 42).where("is_fit")
    model, keep = M.fit_pca(fit, NBITS, k=NBITS, share=2.0)
    projected = M.project(model, keep, v.fps, NBITS)
    length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return projected.select("id", F.round(length, 6).alias("squared_length"))


@query("job_label_lookup", """
    SELECT compound_id, score FROM (SELECT compound_id FROM v_batches WHERE round = 1) b LEFT JOIN (
      SELECT l_orderkey AS id, min(-l_extendedprice) AS score FROM lineitem GROUP BY 1) l ON b.compound_id = l.id""")
def _(v):
    table = v.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(-F.col("l_extendedprice")).alias("score"))
    return C.label_lookup(v.batches.where("round = 1").select("compound_id"), table)


def campaign(v, **how) -> C.Campaign:
    base = dict(
        root=work_path(v.spark, "campaign"), target="T", experiment_id="exp_0", nbits=NBITS, batch_size=100,
        seed_parts=4, seed_block=1000, tune_every=0, params=SMALL,
    )
    return C.Campaign(**{**base, **how})


@query("job_round", """
    SELECT cast(r.range AS int) AS round, least(100, n) AS n_valid, cast(0 AS bigint) AS n_failed, least(100 * (r.range + 1), n) AS n_screened_cumulative,
           true AS best_below_mean FROM range(2) r, (SELECT count(*) AS n FROM embeddings)""")
def _(v):
    """A diverse first batch, parameters tuned, then a batch drawn by the model."""
    cfg = campaign(v, seeding="maxmin", tune_every=2, tune_trials=2, tune_folds=2)
    known = v.fps.select("id")
    table = C.run_campaign(v.spark, cfg, 2, known, v.fps.select("id", "fp"), labels(v))
    return table.select(
        "round", F.col("n_valid").cast("long").alias("n_valid"), F.col("n_failed").cast("long").alias("n_failed"),
        F.col("n_screened_cumulative").cast("long").alias("n_screened_cumulative"), (F.col("best1") < F.col("mean")).alias("best_below_mean"),
    )
