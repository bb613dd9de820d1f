"""Score summaries."""

from pyspark.sql import functions as F

from assayloom.catalog.registry import query, rounded
from assayloom.catalog.views import CATALOGUE
from assayloom.operators import aggregates as A, features as E, similarity as Q
from assayloom.runtime import work_path

SCOPE = "target = 'T' AND experiment_id = 'exp_0'"
NTH = ", ".join(f"max(score) FILTER (rn = {n}) AS best{n}" for n in (1, 10, 100, 1000))
THRESHOLDS = (-1.0, -2.0, -4.0, -6.0)


@query("agg_round_summary", f"""
    SELECT count(score) AS n_valid, count(*) FILTER (score IS NULL) AS n_failed, min(score) AS best, round(avg(score), 6) AS mean
    FROM v_scores WHERE {SCOPE} AND al_round = 3""")
def _(v):
    return rounded(A.round_summary(v.scores, "T", "exp_0", 3), "mean")


@query("agg_n_screened", """
    SELECT target, experiment_id, al_round, n, cast(sum(n) OVER (PARTITION BY target, experiment_id ORDER BY al_round) AS BIGINT) AS n_cumulative
    FROM (SELECT target, experiment_id, al_round, count(score) AS n FROM v_scores WHERE score IS NOT NULL GROUP BY 1, 2, 3)""")
def _(v):
    return A.n_screened(v.scores)


@query("agg_best_n", f"""
    SELECT al_round, {NTH} FROM (SELECT al_round, score, row_number() OVER (ORDER BY score) AS rn FROM v_scores
      WHERE {SCOPE} AND al_round = 3 AND score IS NOT NULL) GROUP BY al_round""")
def _(v):
    return A.best_n(v.scores, "T", "exp_0", 3)


PCTS = ", ".join(f"round(quantile_cont(score, {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))


@query("agg_round_percentiles", f"""
    SELECT experiment_id, al_round, count(*) AS n, {PCTS}, round(avg(score), 6) AS mean, min(score) AS best1
    FROM v_scores WHERE score IS NOT NULL GROUP BY 1, 2""")
def _(v):
    return rounded(A.round_percentiles(v.scores), "p10", "p25", "p50", "p75", "p90", "mean")


@query("agg_hit_rates", "SELECT al_round, threshold, round(100.0::DOUBLE * count(*) FILTER (score < threshold) / count(*), 6) AS pct FROM v_scores, "
       "(SELECT unnest([-1.0::DOUBLE, -2.0, -4.0, -6.0]) AS threshold) WHERE score IS NOT NULL GROUP BY 1, 2")
def _(v):
    return rounded(A.hit_rates(v.scores, thresholds=THRESHOLDS), "pct")


@query("agg_fold_enrichment", """
    WITH r AS (SELECT al_round, threshold, 100.0::DOUBLE * count(*) FILTER (score < threshold) / count(*) AS pct FROM v_scores,
      (SELECT unnest([-1.0::DOUBLE, -2.0, -4.0, -6.0]) AS threshold) WHERE score IS NOT NULL GROUP BY 1, 2)
    SELECT threshold, round(min_by(pct, al_round), 6) AS first_pct, round(max_by(pct, al_round), 6) AS last_pct,
           round(CASE WHEN min_by(pct, al_round) > 0 THEN max_by(pct, al_round) / min_by(pct, al_round) END, 6) AS fold
    FROM r GROUP BY threshold""")
def _(v):
    return rounded(A.fold_enrichment(A.hit_rates(v.scores, thresholds=THRESHOLDS)), "first_pct", "last_pct", "fold")


@query("agg_distribution_shift", f"SELECT al_round, {PCTS}, min(score) AS best FROM v_scores WHERE score IS NOT NULL GROUP BY 1")
def _(v):
    return rounded(A.distribution_shift(v.scores), "p10", "p25", "p50", "p75", "p90")


@query("agg_scores_by_round", "SELECT al_round, score, count(*) AS copies FROM v_scores WHERE score IS NOT NULL GROUP BY 1, 2")
def _(v):
    return A.scores_by_round(v.scores)


@query("agg_watch_progress", f"""
    WITH q AS (SELECT round AS al_round, count(*) AS queued FROM v_batches WHERE {SCOPE} GROUP BY 1),
    d AS (SELECT al_round, count(*) AS docked, count(score) AS valid, avg(score) AS mean FROM v_scores WHERE {SCOPE} GROUP BY 1),
    b AS (SELECT al_round, {NTH} FROM (SELECT al_round, score, row_number() OVER (PARTITION BY al_round ORDER BY score) AS rn
          FROM v_scores WHERE {SCOPE} AND score IS NOT NULL) GROUP BY 1)
    SELECT coalesce(q.al_round, d.al_round) AS al_round, coalesce(queued, 0) AS queued, coalesce(docked, 0) AS docked,
           coalesce(valid, 0) AS valid, round(mean, 6) AS mean, best1, best10, best100, best1000,
           round(CASE WHEN queued > 0 THEN coalesce(docked, 0) * 100.0::DOUBLE / queued END, 6) AS pct
    FROM q FULL JOIN d ON q.al_round = d.al_round LEFT JOIN b ON d.al_round = b.al_round""")
def _(v):
    return rounded(A.watch_progress(v.batches, v.scores, "T", "exp_0"), "mean", "pct").orderBy("al_round")


FLAGS = """
    f AS (SELECT d.doc_id AS compound_id, cast(d.doc_id % 6 AS int) AS al_round, d.text,
                 list(c.name ORDER BY c.pos) FILTER (regexp_matches(d.text, c.pattern)) AS alerts
          FROM documents d, v_catalog c GROUP BY d.doc_id, d.text)"""


def flags(v):
    docs = v.table("documents").select(
        F.col("doc_id").alias("compound_id"), (F.col("doc_id") % 6).cast("int").alias("al_round"), "text"
    )
    path = work_path(v.spark, "catalogue")
    v.spark.createDataFrame([(i, *c) for i, c in enumerate(CATALOGUE)], "pos int, name string, pattern string").write.parquet(path)
    return E.pattern_flags(docs, E.read_catalogue(v.spark.read.parquet(path)))


@query("job_pattern_flags", f"WITH {FLAGS} SELECT compound_id, al_round, coalesce(array_to_string(alerts, '; '), '') AS alert_names, alerts IS NOT NULL AS flagged FROM f")
def _(v):
    return flags(v).select("compound_id", "al_round", "alert_names", "flagged")


@query("agg_flag_rate_by_round", f"""
    WITH {FLAGS} SELECT al_round, count(*) AS total, count(alerts) AS n_flagged,
      round(count(alerts) * 100.0::DOUBLE / count(*), 6) AS pct_flagged, round(100.0::DOUBLE - count(alerts) * 100.0::DOUBLE / count(*), 6) AS pct_clean
    FROM f GROUP BY 1""")
def _(v):
    return rounded(A.flag_rate_by_round(flags(v)), "pct_flagged", "pct_clean")


@query("agg_alert_counts", f"WITH {FLAGS} SELECT alert, count(*) AS n FROM (SELECT unnest(alerts) AS alert FROM f) GROUP BY 1 ORDER BY n DESC, alert LIMIT 15")
def _(v):
    return A.alert_counts(flags(v))


STATS = """SELECT group_key, count(*) AS n, min(score) AS best, max(score) AS worst, list_sort(list(DISTINCT al_round)) AS rounds
           FROM v_keys GROUP BY 1"""


@query("agg_group_key_stats", STATS)
def _(v):
    return A.group_key_stats(v.keys)


@query("topk_group_rank", f"{STATS} ORDER BY n DESC, best, group_key LIMIT 20")
def _(v):
    return A.group_rank(A.group_key_stats(v.keys))


@query("agg_entropy", """
    SELECT cast(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, count(*) FILTER (n = 1) AS n_single,
           round(count(*) FILTER (n = 1) * 100.0::DOUBLE / count(*), 6) AS pct_single, round(-sum(n / t * log2(n / t)), 6) AS entropy_bits
    FROM (SELECT md5(text) AS k, count(*) AS n, (SELECT count(*) FROM documents) AS t FROM documents GROUP BY 1)""")
def _(v):
    keyed = v.table("documents").select(F.md5("text").alias("group_key"))
    return rounded(A.entropy(keyed), "pct_single", "entropy_bits")


@query("agg_novelty_summary", """
    WITH s AS (SELECT cast(q.id % 6 AS int) AS al_round, max((bit_count(q.lo & r.lo) + bit_count(q.hi & r.hi))::DOUBLE
           / greatest(1, bit_count(q.lo | r.lo) + bit_count(q.hi | r.hi))) AS max_sim
      FROM v_fp2 q, v_fp2 r WHERE q.label <> 0 AND r.label = 0 GROUP BY q.id)
    SELECT al_round, count(*) AS n, round(median(max_sim), 6) AS median, round(avg(max_sim), 6) AS mean,
           round(100.0::DOUBLE * count(*) FILTER (max_sim > 0.4) / count(*), 6) AS pct04,
           round(100.0::DOUBLE * count(*) FILTER (max_sim > 0.6) / count(*), 6) AS pct06 FROM s GROUP BY 1""")
def _(v):
    fps = v.fps
    sims = Q.max_similarity(fps.where("label <> 0"), fps.where("label = 0"))
    by_round = sims.select((F.col("id") % 6).cast("int").alias("al_round"), "max_sim")
    return rounded(A.novelty_summary(by_round), "median", "mean", "pct04", "pct06")


TABLE = """
    WITH s AS (SELECT experiment_id, al_round, count(*) AS n, quantile_cont(score, 0.5) AS median, min(score) AS best1, avg(score) AS mean,
        100.0::DOUBLE * count(*) FILTER (score < -14) / count(*) AS pct14, 100.0::DOUBLE * count(*) FILTER (score < -15) / count(*) AS pct15
      FROM v_scores WHERE score IS NOT NULL GROUP BY 1, 2)
    SELECT s.experiment_id, s.al_round, n, round(median, 6) AS median, s.best1, round(mean, 6) AS mean, round(pct14, 6) AS pct14,
           round(pct15, 6) AS pct15, val_rmse, m.best1 AS log_best1
    FROM s LEFT JOIN v_metrics m ON s.experiment_id = m.experiment_id AND s.al_round = m.round"""


@query("agg_experiment_table", TABLE)
def _(v):
    return rounded(A.experiment_table(v.scores, v.metrics), "median", "mean", "pct14", "pct15")


@query("agg_experiment_side_by_side", """
    SELECT al_round, min(score) FILTER (experiment_id = 'exp_0') AS exp_0, min(score) FILTER (experiment_id = 'exp_1') AS exp_1
    FROM v_scores WHERE score IS NOT NULL GROUP BY 1""")
def _(v):
    return A.side_by_side(A.experiment_table(v.scores, v.metrics), "best1", ["exp_0", "exp_1"])


@query("agg_slot_summary", """
    SELECT CASE WHEN grouping(al_round) = 1 THEN -1 ELSE al_round END AS slot, count(*) AS n, min(score) AS best, round(avg(score), 6) AS mean
    FROM v_scores WHERE score IS NOT NULL GROUP BY ROLLUP (al_round)""")
def _(v):
    return rounded(A.slot_summary(v.scores), "mean")


@query("agg_hist1d", """
    SELECT cast(least(floor((l_discount - 0.01::DOUBLE) / ((0.09::DOUBLE - 0.01::DOUBLE) / 25)), 24) AS int) AS bin, count(*) AS n
    FROM lineitem WHERE l_discount BETWEEN 0.01::DOUBLE AND 0.01::DOUBLE + ((0.09::DOUBLE - 0.01::DOUBLE) / 25) * 25 GROUP BY 1""")
def _(v):
    return A.hist1d(v.table("lineitem"), "l_discount", 0.01, 0.09, 25)


@query("agg_preflight", "SELECT count(id) AS n, max(id) AS max_id, max(id) - count(id) AS gaps FROM (SELECT event_id * 2 AS id FROM events)")
def _(v):
    return A.preflight(v.table("events").select((F.col("event_id") * 2).alias("id")))


@query("agg_valid_fill", """
    SELECT count(*) FILTER (vec_id IN (SELECT doc_id FROM labels)) AS n_valid, count(*) AS n,
           round(count(*) FILTER (vec_id IN (SELECT doc_id FROM labels)) * 100.0::DOUBLE / count(*), 6) AS pct FROM embeddings""")
def _(v):
    return rounded(A.valid_fill(v.fps, v.table("labels").select(F.col("doc_id").alias("id"))), "pct")


@query("agg_library_counts", """
    SELECT 'molecules' AS what, count(*) AS n FROM v_compounds
    UNION ALL SELECT CASE WHEN n % 2 = 0 THEN 'tranches_completed' ELSE 'tranches_processing' END, count(*)
      FROM (SELECT tranche, count(*) AS n FROM v_compounds GROUP BY 1) GROUP BY 1""")
def _(v):
    per = v.compounds.groupBy("tranche").agg(F.count(F.lit(1)).alias("n"))
    status = per.select("tranche", F.when(F.col("n") % 2 == 0, "completed").otherwise("processing").alias("status"))
    return A.library_counts(v.compounds, status)


@query("agg_job_totals", """
    SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'null_input' ELSE 'success' END AS outcome, count(*) AS n
    FROM events GROUP BY 1""")
def _(v):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "failed").when(kind == "view", "null_input").otherwise("success")
    return A.job_totals(v.table("events").select(outcome.alias("outcome")))


@query("agg_failure_taxonomy", """
    WITH a AS (SELECT event_id AS compound_id, CASE WHEN user_id % 2 = 0 THEN 'prep' ELSE 'dock' END AS stage, event_type AS category
               FROM events WHERE event_type IN ('error', 'view')),
    r AS (SELECT *, row_number() OVER (PARTITION BY stage, category ORDER BY compound_id) AS rn FROM a)
    SELECT stage, category, count(*) AS n,
           list(compound_id ORDER BY compound_id) FILTER (rn <= CASE stage WHEN 'prep' THEN 5 ELSE 3 END) AS examples FROM r GROUP BY 1, 2""")
def _(v):
    failed = F.col("event_type").isin("error", "view")
    return A.failure_taxonomy(v.table("events").select(
        F.col("event_id").alias("compound_id"), F.when(F.col("user_id") % 2 == 0, "prep").otherwise("dock").alias("stage"),
        F.when(failed, F.col("event_type")).alias("category"),
    ))


@query("agg_score_range", "SELECT count(score) AS n_valid, min(score) AS min, round(avg(score), 6) AS mean, max(score) AS max FROM v_scores")
def _(v):
    return rounded(A.score_range(v.scores), "mean")


@query("agg_rmse", """
    SELECT round(sqrt(avg((p.predicted - s.score) ** 2)), 6) AS rmse, count(p.predicted - s.score) AS n
    FROM v_pred p JOIN v_scores s ON p.id = s.compound_id""")
def _(v):
    pairs = v.pred.join(v.scores.select(F.col("compound_id").alias("id"), "score"), "id")
    return rounded(A.rmse(pairs), "rmse")


@query("agg_selection_quality", """
    SELECT min(predicted) AS min, max(predicted) AS max, round(avg(predicted), 6) AS mean, count(*) AS n
    FROM v_batches b JOIN v_pred p ON b.compound_id = p.id WHERE b.round = 2""")
def _(v):
    return rounded(A.selection_quality(v.batches.where("round = 2").select(F.col("compound_id").alias("id")), v.pred), "mean")


@query("agg_round_distribution_topk", """
    SELECT al_round, count(*) AS n FROM (SELECT al_round FROM v_scores WHERE score IS NOT NULL ORDER BY score, compound_id LIMIT 50) GROUP BY 1""")
def _(v):
    return A.round_distribution_topk(v.scores, 50)


@query("agg_batch_by_source", "SELECT experiment_id, round, source, count(*) AS n FROM v_batches GROUP BY 1, 2, 3")
def _(v):
    return A.batch_by_source(v.batches)


@query("job_group_key", """
    SELECT doc_id AS id, md5(trim(regexp_replace(regexp_replace(lower(text), '[0-9()\\[\\]=#%@+\\\\/.,;:|-]', '', 'g'), '\\s+', ' ', 'g'))) AS key_digest
    FROM documents""")
def _(v):
    rows = E.with_group_key(v.table("documents").select(F.col("doc_id").alias("id"), "text"))
    return rows.select("id", F.md5("group_key").alias("key_digest"))
