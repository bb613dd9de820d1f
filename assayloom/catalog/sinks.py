"""Writers, checked by reading back what they wrote, and the ingest jobs built on them."""

from pyspark.sql import functions as F

from assayloom import schemas
from assayloom.catalog.registry import query
from assayloom.catalog.sources import lang_of, write_line_files
from assayloom.catalog.summaries import FLAGS, flags
from assayloom.functions.text import fixed
from assayloom.operators import aggregates as A, ingest as I
from assayloom.plans import ingest as PI
from assayloom.runtime import work_path
from assayloom.sinks import tables as K
from assayloom.sinks.keyed import insert_first, read_keyed
from assayloom.sources import tables as T


@query("sink_batch_append", "SELECT o_orderkey AS compound_id, 'T' AS target, 'exp_0' AS experiment_id, 4 AS round, 'random_init' AS source "
       "FROM orders WHERE o_orderstatus = 'F'")
def _(v):
    out = work_path(v.spark, "batches")
    orders = v.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    K.append_batch(orders.where("o_orderstatus = 'F'"), out, "T", "exp_0", 4, "random_init")
    K.append_batch(orders.where("o_orderstatus = 'O'"), out, "T", "exp_0", 4, "random_init")
    return v.spark.read.schema(schemas.BATCHES).parquet(out)


@query("sink_scores_append", "SELECT compound_id, target, experiment_id, al_round, score FROM v_scores")
def _(v):
    out = work_path(v.spark, "scores")
    K.append_scores(v.scores, out, "first")
    K.append_scores(v.scores, out, "first")
    return v.spark.read.schema(schemas.SCORES).parquet(out).drop("docked_at", "batch")


WINNERS = """
    SELECT zinc_id, id, tranche FROM (SELECT *, row_number() OVER (PARTITION BY zinc_id ORDER BY run, tranche, id) AS rn FROM (
      SELECT *, CASE WHEN tranche LIKE 'en/%' THEN 0 ELSE 1 END AS run FROM v_compounds)) WHERE rn = 1"""


@query("sink_insert_ignore", WINNERS)
def _(v):
    out = work_path(v.spark, "library")
    rows = v.compounds.select("zinc_id", "id", "tranche")
    schema = rows.schema
    insert_first(rows.where("tranche like 'en/%'"), out, "zinc_id", ["tranche", "id"], schema)
    insert_first(rows, out, "zinc_id", ["tranche", "id"], schema)
    insert_first(rows, out, "zinc_id", ["tranche", "id"], schema)
    return read_keyed(v.spark, out, schema)


def staged(lines):
    """Stand-in chemistry: hexadecimal digests as strings, with rules that reject some."""
    return I.validate(
        lines,
        normalise=lambda raw: F.when(~raw.startswith("0"), F.upper(raw)),
        mw=lambda s: F.ascii(s).cast("double"),
        logp=lambda s: F.ascii(F.substring(s, 2, 1)) / F.lit(100.0),
        parsable=lambda s: ~s.startswith("1"),
        crash=lambda raw: F.when(raw.startswith("2"), F.concat(F.lit("bad token "), F.substring(raw, 1, 2))),
    )


def ingested(v, folder_label: str) -> str:
    line = F.concat(F.md5("text"), F.lit(" Z"), (F.col("doc_id") % 701).cast("string"))
    folder, root = write_line_files(v, folder_label, line), work_path(v.spark, "ingest")
    PI.ingest_folder(v.spark, folder, staged, root, "run-1")
    PI.ingest_folder(v.spark, folder, staged, root, "run-2")
    return root


LINES = """
    l AS (SELECT md5(text) AS raw, concat('Z', doc_id % 701) AS zinc_id, lang, doc_id FROM documents),
    c AS (SELECT *, CASE WHEN raw LIKE '2%' THEN concat('Crash: bad token ', substr(raw, 1, 2)) WHEN raw LIKE '0%' THEN 'Protonation Failed'
                         WHEN raw LIKE '1%' THEN 'RDKit Mol Conversion Failed' END AS error_msg FROM l)"""


@query("job_ingest", f"""
    WITH {LINES}, g AS (SELECT *, row_number() OVER (PARTITION BY zinc_id ORDER BY lang, doc_id) AS rn FROM c WHERE error_msg IS NULL)
    SELECT row_number() OVER (ORDER BY lang, doc_id) AS id, zinc_id, upper(raw) AS smiles, lang, ascii(upper(raw))::DOUBLE AS mw,
           ascii(substr(upper(raw), 2, 1)) / 100.0::DOUBLE AS logp
    FROM g WHERE rn = 1""")
def _(v):
    root = ingested(v, "smi-library")
    library = read_keyed(v.spark, f"{root}/compounds", schemas.COMPOUNDS)
    return library.select("id", "zinc_id", "smiles", lang_of(F.concat("tranche", F.lit("/"))).alias("lang"), "mw", "logp")


@query("sink_quarantine", f"WITH {LINES} SELECT zinc_id, raw AS original_smiles, error_msg, lang FROM c WHERE error_msg IS NOT NULL")
def _(v):
    root = ingested(v, "smi-errors")
    errors = v.spark.read.schema(schemas.INGESTION_ERRORS).parquet(f"{root}/ingestion_errors")
    return errors.select("zinc_id", "original_smiles", "error_msg", lang_of(F.concat("tranche", F.lit("/"))).alias("lang"))


BACKFILLED = """
    SELECT id, zinc_id, CASE WHEN hit THEN length(smiles)::DOUBLE ELSE mw END AS mw, CASE WHEN hit THEN length(smiles) / 10.0::DOUBLE ELSE logp END AS logp
    FROM (SELECT *, (mw IS NULL OR logp IS NULL) AND smiles <> '' AS hit FROM v_compounds)"""


def updates(v):
    return PI.computed_updates(v.compounds, lambda s: F.length(s).cast("double"), lambda s: F.length(s) / F.lit(10.0))


@query("sink_update_from", BACKFILLED)
def _(v):
    out = work_path(v.spark, "backfill")
    v.compounds.write.partitionBy("tranche").parquet(out)
    K.update_from(updates(v), out, v.compounds.schema)
    return v.spark.read.schema(schemas.COMPOUNDS).parquet(out).select("id", "zinc_id", "mw", "logp")


@query("job_backfill", BACKFILLED)
def _(v):
    return I.backfill(v.compounds, updates(v)).select("id", "zinc_id", "mw", "logp")


@query("sink_fp_table", "SELECT id, lo, hi FROM v_fp2")
def _(v):
    from assayloom.catalog.rows import _halves

    out = work_path(v.spark, "fps")
    K.write_fingerprints(v.fps.select("id", "fp"), out)
    return _halves(v.spark.read.schema(schemas.FINGERPRINTS).parquet(out), "id")


@query("sink_predictions", "SELECT id, predicted, 'T' AS target FROM v_pred")
def _(v):
    out = work_path(v.spark, "pred")
    K.write_predictions(v.pred, out, target="T")
    K.write_predictions(v.pred.limit(0), out, target="T")
    return v.spark.read.schema("id long, predicted double, target string").parquet(out)


@query("sink_report_csv", """
    SELECT group_key, count(*) AS count, printf('%.3f', min(score)) AS best_score, printf('%.3f', max(score)) AS worst_score,
           array_to_string(list_sort(list(DISTINCT al_round)), '|') AS rounds FROM v_keys GROUP BY 1""")
def _(v):
    out = work_path(v.spark, "report")
    K.write_group_report(A.group_key_stats(v.keys), out)
    return v.spark.read.csv(
        out, header=True, schema="group_key string, count long, best_score string, worst_score string, rounds string"
    )


@query("sink_alert_report", f"""
    WITH {FLAGS} SELECT f.compound_id, printf('%.3f', -length(f.text) / 1000.0::DOUBLE) AS score, CASE WHEN alerts IS NULL THEN 0 ELSE 1 END AS flagged,
           coalesce(array_to_string(alerts, '; '), '') AS alert_names FROM f""")
def _(v):
    out = work_path(v.spark, "alert-report")
    K.write_alert_report(flags(v).withColumn("score", -F.length("text") / F.lit(1000.0)), out)
    schema = "compound_id long, score string, flagged int, alert_names string"
    return v.spark.read.csv(out, header=True, schema=schema).fillna("", ["alert_names"])


@query("sink_round_metrics", """
    SELECT 'T' AS target, experiment_id, cast(al_round AS int) AS round, count(score) AS n_valid, count(*) - count(score) AS n_failed,
           min(score) AS best1, round(avg(score), 6) AS mean, NULL::DOUBLE AS val_rmse FROM v_scores GROUP BY 1, 2, 3""")
def _(v):
    out = work_path(v.spark, "round-metrics")
    rows = v.scores.groupBy("target", "experiment_id", F.col("al_round").alias("round")).agg(
        F.count("score").alias("n_valid"), F.count_if(F.col("score").isNull()).alias("n_failed"),
        F.min("score").alias("best1"), F.round(F.avg("score"), 6).alias("mean"), F.lit(None).cast("double").alias("val_rmse"),
    )
    K.append_round_metrics(rows, out)
    K.append_round_metrics(rows, out)
    return v.spark.read.schema(schemas.ROUND_METRICS).parquet(out).select(*rows.columns)


@query("sink_progress_snapshot", """
    SELECT al_round, count(*) AS docked, count(score) AS valid, min(score) AS best1 FROM v_scores GROUP BY 1""")
def _(v):
    base = work_path(v.spark, "snapshot")
    rows = v.scores.groupBy("al_round").agg(
        F.count(F.lit(1)).alias("docked"), F.count("score").alias("valid"), F.min("score").alias("best1")
    )
    K.write_progress_snapshot(rows.limit(1), f"{base}/history", f"{base}/latest", 0)
    K.write_progress_snapshot(rows, f"{base}/history", f"{base}/latest", 1)
    return v.spark.read.schema("al_round int, docked long, valid long, best1 double").json(f"{base}/latest")


@query("ddl_add_column_default", """
    SELECT compound_id, coalesce(CASE WHEN compound_id % 2 = 0 THEN experiment_id END, 'maxmin_init') AS experiment_id FROM v_batches""")
def _(v):
    out = work_path(v.spark, "evolved")
    rows = v.batches.select("compound_id", "experiment_id")
    rows.where("compound_id % 2 = 1").select("compound_id").write.parquet(f"{out}/old")
    rows.where("compound_id % 2 = 0").write.parquet(f"{out}/new")
    wide = v.spark.read.schema("compound_id long, experiment_id string").parquet(f"{out}/old", f"{out}/new")
    return T.with_default_experiment(wide)
