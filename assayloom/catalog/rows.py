"""Filters, joins and set operations."""

from pyspark.sql import functions as F

from assayloom.catalog.registry import query, rounded
from assayloom.functions.text import shorten
from assayloom.operators import aggregates as A, density as D, filters as X, joins as J, sets as S, similarity as Q

SCOPE = "target = 'T' AND experiment_id = 'exp_0'"


@query("flt_scope", f"SELECT compound_id, al_round, score FROM v_scores WHERE {SCOPE} AND al_round = 2")
def _(v):
    return X.in_scope(v.scores, "T", "exp_0", 2).select("compound_id", "al_round", "score")


@query("flt_valid_score", "SELECT compound_id, experiment_id, al_round, score FROM v_scores WHERE score IS NOT NULL")
def _(v):
    return X.valid_scores(v.scores).select("compound_id", "experiment_id", "al_round", "score")


@query("flt_trainable", "SELECT compound_id, score FROM v_scores WHERE score < -0.5")
def _(v):
    return X.trainable(v.scores, -0.5).select("compound_id", "score")


@query("prj_threshold_null", "SELECT compound_id, CASE WHEN score < -1.0 THEN score END AS score FROM v_scores")
def _(v):
    return v.scores.select("compound_id", X.threshold_null(F.col("score"), -1.0).alias("score"))


ELIGIBLE = f"""
    SELECT p.id, p.predicted FROM v_pred p
    WHERE predicted IS NOT NULL AND NOT isnan(predicted) AND abs(predicted) < 'inf'::DOUBLE
      AND id IN (SELECT o_orderkey FROM orders)
      AND id NOT IN (SELECT compound_id FROM v_scores WHERE {SCOPE} UNION SELECT compound_id FROM v_batches WHERE {SCOPE})
"""


def eligible(v):
    known = v.table("orders").select(F.col("o_orderkey").alias("id"))
    return J.eligible(v.pred, known, v.scores, v.batches, "T", "exp_0")


@query("flt_eligible", ELIGIBLE)
def _(v):
    return eligible(v)


@query("flt_missing_props", """
    SELECT id, zinc_id, mw, logp FROM v_compounds
    WHERE (mw IS NULL OR logp IS NULL) AND smiles IS NOT NULL AND smiles <> ''""")
def _(v):
    return X.missing_properties(v.compounds).select("id", "zinc_id", "mw", "logp")


@query("flt_nonzero_fp", "SELECT id, label FROM v_fpbits GROUP BY id, label HAVING bool_or(b)")
def _(v):
    return X.nonzero_fingerprints(v.fps).select("id", "label")


@query("flt_todo", """
    SELECT DISTINCT tranche FROM v_compounds WHERE tranche NOT IN
      (SELECT concat(lang, '/', source) FROM documents GROUP BY 1 HAVING count(*) % 2 = 0)""")
def _(v):
    per = v.compounds.groupBy("tranche").agg(F.count(F.lit(1)).alias("n"))
    status = per.select("tranche", F.when(F.col("n") % 2 == 0, "completed").otherwise("processing").alias("status"))
    return X.todo(v.compounds.select("tranche").distinct(), status, "tranche")


@query("prj_neg_logit", "SELECT id, round(-predicted / 0.7::DOUBLE, 6) AS logit FROM v_pred")
def _(v):
    return rounded(v.pred.select("id", X.negative_logit(F.col("predicted"), 0.7).alias("logit")), "logit")


@query("flt_top_valid_overshoot", f"""
    SELECT s.compound_id, c.zinc_id, s.score FROM v_scores s JOIN v_compounds c ON s.compound_id = c.id
    WHERE {SCOPE} AND score IS NOT NULL AND c.mw IS NOT NULL ORDER BY score, compound_id LIMIT 40""")
def _(v):
    hits = J.scores_with_compounds(v.scores, v.compounds.where("mw is not null"), "T", "exp_0")
    return X.top_parsable(hits, 40, F.col("smiles").isNotNull()).select("compound_id", "zinc_id", "score")


@query("jn_batch_compound", f"""
    SELECT c.id, c.smiles FROM v_batches b JOIN v_compounds c ON b.compound_id = c.id WHERE {SCOPE} AND round = 1""")
def _(v):
    return J.batch_with_compounds(v.batches, v.compounds, "T", "exp_0", 1)


@query("jn_score_compound", f"""
    SELECT s.compound_id, c.zinc_id, c.smiles, s.score, s.al_round FROM v_scores s JOIN v_compounds c ON s.compound_id = c.id
    WHERE {SCOPE} AND score IS NOT NULL""")
def _(v):
    return J.scores_with_compounds(v.scores, v.compounds, "T", "exp_0")


@query("jn_label_features", """
    SELECT f.id, f.lo, f.hi, s.score FROM v_scores s JOIN v_fp2 f ON s.compound_id = f.id WHERE s.score < 0""")
def _(v):
    joined = J.labels_with_features(X.trainable(v.scores).select("compound_id", "score"), v.fps)
    return _halves(joined, "id", "score")


def _halves(df, *cols):
    word = F.col("fp")[0]
    return df.select(*cols, word.bitwiseAND(0xFFFFFFFF).alias("lo"), F.shiftrightunsigned(word, 32).alias("hi"))


@query("jn_fp_lookup", "SELECT f.id, f.lo, f.hi FROM v_fp2 f JOIN labels l ON f.id = l.doc_id WHERE l.toxic = 1")
def _(v):
    ids = v.table("labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return _halves(J.fingerprints_of(ids, v.fps), "id")


@query("jn_anti_done", f"""
    SELECT compound_id FROM v_batches WHERE {SCOPE} AND round = 0 AND compound_id NOT IN
      (SELECT compound_id FROM v_scores WHERE {SCOPE} AND al_round = 0)""")
def _(v):
    return J.not_done(v.batches, v.scores, "T", "exp_0", 0)


@query("jn_anti_used", f"""
    SELECT id, predicted FROM v_pred WHERE id NOT IN (SELECT compound_id FROM v_scores WHERE {SCOPE}
      UNION SELECT compound_id FROM v_batches WHERE {SCOPE})""")
def _(v):
    return J.not_used(v.pred, v.scores, v.batches, "T", "exp_0")


@query("jn_semi_valid", "SELECT id, lo, hi FROM v_fp2 WHERE id IN (SELECT doc_id FROM labels)")
def _(v):
    known = v.table("labels").select(F.col("doc_id").alias("id"))
    return _halves(J.only_known(v.fps, known), "id")


@query("jn_full_progress", """
    SELECT coalesce(q.al_round, d.al_round) AS al_round, coalesce(queued, 0) AS queued, coalesce(docked, 0) AS docked,
           coalesce(valid, 0) AS valid, best1, CASE WHEN coalesce(queued, 0) > 0 THEN coalesce(docked, 0) * 100.0::DOUBLE / queued END AS pct
    FROM (SELECT round AS al_round, count(*) AS queued FROM v_batches GROUP BY 1) q
    FULL JOIN (SELECT l_linenumber AS al_round, count(*) AS docked, count(score) AS valid, min(score) AS best1
               FROM (SELECT l_linenumber, CASE WHEN l_returnflag <> 'R' THEN -l_extendedprice END AS score FROM lineitem) GROUP BY 1) d
      ON q.al_round = d.al_round""")
def _(v):
    # two tables whose rounds differ by themselves
    queued = v.batches.groupBy(F.col("round").alias("al_round")).agg(F.count(F.lit(1)).alias("queued"))
    score = F.when(F.col("l_returnflag") != "R", -F.col("l_extendedprice")).alias("score")
    done = v.table("lineitem").select(F.col("l_linenumber").cast("int").alias("al_round"), score).groupBy("al_round").agg(
        F.count(F.lit(1)).alias("docked"), F.count("score").alias("valid"), F.min("score").alias("best1")
    )
    return A.full_progress(queued, done)


@query("jn_bins", "SELECT ix, iy, n_bg, n_pick FROM v_maps WHERE n_bg > 0")
def _(v):
    from assayloom.catalog.maps import edges

    e = edges(v)
    return D.bins_with_picks(D.hist2d(v.background, e), D.hist2d(v.picks, e))


@query("jn_bins_diff", "SELECT ix, iy, round(log2r_a - log2r_b, 6) AS diff FROM v_ratio WHERE log2r_a IS NOT NULL AND log2r_b IS NOT NULL")
def _(v):
    from assayloom.catalog.maps import ratio_pair

    return rounded(D.bins_diff(*ratio_pair(v)), "diff")


@query("jn_all_pairs_max", """
    SELECT q.id, round(max((bit_count(q.lo & r.lo) + bit_count(q.hi & r.hi))::DOUBLE
           / greatest(1, bit_count(q.lo | r.lo) + bit_count(q.hi | r.hi))), 9) AS max_sim
    FROM v_fp2 q, v_fp2 r WHERE q.label <> 0 AND r.label = 0 GROUP BY q.id""")
def _(v):
    fps = v.fps
    return rounded(Q.max_similarity(fps.where("label <> 0"), fps.where("label = 0")), "max_sim", digits=9)


@query("jn_all_pairs_self", """
    SELECT a.id, round(max((bit_count(a.lo & b.lo) + bit_count(a.hi & b.hi))::DOUBLE
           / greatest(1, bit_count(a.lo | b.lo) + bit_count(a.hi | b.hi))), 9) AS max_sim
    FROM v_fp2 a JOIN v_fp2 b ON a.id <> b.id GROUP BY a.id""")
def _(v):
    return rounded(Q.max_similarity_self(v.fps), "max_sim", digits=9)


@query("jn_asof_hparams", """
    SELECT r.experiment_id, r.round, (SELECT m.val_rmse FROM v_metrics m WHERE m.experiment_id = r.experiment_id
             AND m.round <= r.round AND m.round % 3 = 1 ORDER BY m.round DESC LIMIT 1) AS val_rmse
    FROM v_metrics r""")
def _(v):
    m = v.metrics
    return J.as_of_rounds(m, m.where("round % 3 = 1"), ["experiment_id"], "val_rmse")


@query("set_used_union", f"""
    SELECT compound_id AS id FROM v_scores WHERE {SCOPE} UNION SELECT compound_id FROM v_batches WHERE {SCOPE}""")
def _(v):
    return J.used_ids(v.scores, v.batches, "T", "exp_0")


@query("set_rounds_union", "SELECT al_round FROM v_scores UNION SELECT round FROM v_batches UNION SELECT round FROM v_metrics")
def _(v):
    return S.rounds_union((v.scores, "al_round"), (v.batches, "round"), (v.metrics, "round"))


@query("set_overlap_ids", """
    WITH s AS (SELECT l_orderkey AS compound_id, l_returnflag AS experiment_id, l_linenumber AS al_round FROM lineitem),
    a AS (SELECT compound_id, min(al_round) AS al_round FROM s WHERE experiment_id = 'A' GROUP BY 1)
    SELECT al_round, count(*) FILTER (compound_id IN (SELECT compound_id FROM s WHERE experiment_id = 'N')) AS n_shared,
           count(*) AS n_a, round(count(*)::DOUBLE * (SELECT count(DISTINCT compound_id) FROM s WHERE experiment_id = 'N')::DOUBLE / (SELECT count(*) FROM orders), 6) AS expected
    FROM a GROUP BY ROLLUP (al_round)""")
def _(v):
    s = v.table("lineitem").select(
        F.col("l_orderkey").alias("compound_id"), F.col("l_returnflag").alias("experiment_id"),
        F.col("l_linenumber").alias("al_round"),
    )
    return rounded(S.overlap_ids(s, "A", "N", v.table("orders").count()), "expected")


@query("set_overlap_keys", """
    WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS compound_id, l_returnflag AS side, l_partkey AS group_key, -l_extendedprice AS score
               FROM lineitem WHERE l_returnflag IN ('A', 'N')),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY score, compound_id) AS rn FROM k),
    w AS (SELECT 'all' AS within, side, group_key FROM r UNION ALL SELECT 'top500', side, group_key FROM r WHERE rn <= 500
          UNION ALL SELECT 'top50', side, group_key FROM r WHERE rn <= 50),
    g AS (SELECT within, group_key, bool_or(side = 'A') AS a, bool_or(side = 'N') AS b FROM w GROUP BY 1, 2)
    SELECT within, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_shared, count(*) AS n_union
    FROM g GROUP BY within""")
def _(v):
    keyed = v.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("compound_id"), F.col("l_returnflag").alias("side"),
        F.col("l_partkey").alias("group_key"), (-F.col("l_extendedprice")).alias("score"),
    )
    return S.overlap_keys(keyed, "side", "A", "N", top=(500, 50))
