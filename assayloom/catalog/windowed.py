"""Windows, ranks and running reports."""

from pyspark.sql import functions as F

from assayloom.catalog.registry import query, rounded
from assayloom.operators import joins as J, ranking as R, sampling as P, windows as W
from assayloom.catalog.rows import ELIGIBLE, eligible

NTH = ", ".join(f"max(score) FILTER (rn = {n}) AS best{n}" for n in (1, 10, 100, 1000))
SCOPE = "target = 'T' AND experiment_id = 'exp_0'"


def u01(key: str, seed: int, rnd: int = 0) -> str:
    """The oracle's uniform number for an id expression."""
    return f"((cast('0x' || substr(md5(concat({key}, '-{seed}-{rnd}')), 1, 12) AS bigint) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


@query("win_best_n_by_round", f"""
    SELECT experiment_id, al_round, {NTH} FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, al_round ORDER BY score) AS rn
      FROM v_scores WHERE score IS NOT NULL) GROUP BY 1, 2""")
def _(v):
    return R.nth_best(v.scores, ["experiment_id", "al_round"], "score")


@query("win_delta_best1", """
    SELECT experiment_id, round, best1, best1 - lag(best1) OVER (PARTITION BY experiment_id ORDER BY round) AS delta FROM v_metrics""")
def _(v):
    return W.delta_best1(v.metrics)


@query("win_cumulative_best_n", """
    WITH r AS (SELECT DISTINCT experiment_id, al_round FROM v_scores WHERE score IS NOT NULL),
    c AS (SELECT r.experiment_id, r.al_round, s.score, row_number() OVER (PARTITION BY r.experiment_id, r.al_round ORDER BY s.score) AS rn
      FROM r JOIN v_scores s ON s.experiment_id = r.experiment_id AND s.al_round <= r.al_round AND s.score IS NOT NULL)
    SELECT experiment_id, al_round, count(*) AS cum_docked, """ + NTH + " FROM c GROUP BY 1, 2")
def _(v):
    return W.cumulative_best_n(v.scores)


CHECKPOINTS = """
    WITH a AS (SELECT experiment_id, score, row_number() OVER (PARTITION BY experiment_id ORDER BY docked_at, compound_id) AS i FROM v_scores),
    t AS (SELECT experiment_id, max(i) AS total FROM a GROUP BY 1),
    p AS (SELECT a.experiment_id, i AS docked FROM a JOIN t ON a.experiment_id = t.experiment_id WHERE i % 500 = 0 OR i = total),
    c AS (SELECT p.experiment_id, p.docked, a.score, row_number() OVER (PARTITION BY p.experiment_id, p.docked ORDER BY a.score NULLS LAST) AS rn
      FROM p JOIN a ON a.experiment_id = p.experiment_id AND a.i <= p.docked)
    SELECT experiment_id, docked, count(score) AS valid, docked - count(score) AS failed, """ + NTH + " FROM c GROUP BY 1, 2"


def checkpoints(v, **how):
    return W.progress_checkpoints(v.scores, ["experiment_id"], ["docked_at", "compound_id"], **how)


@query("win_progress_checkpoints", CHECKPOINTS)
def _(v):
    return checkpoints(v)


@query("win_round_offset_curve", """
    WITH s AS (SELECT experiment_id, al_round, count(*) AS n FROM v_scores WHERE score IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT experiment_id, al_round, count(*) // 2 AS docked, min(score) AS best1 FROM v_scores GROUP BY 1, 2)
    SELECT p.experiment_id, p.al_round, p.docked, p.best1, p.docked + coalesce((SELECT cast(sum(n) AS BIGINT) FROM s
      WHERE s.experiment_id = p.experiment_id AND s.al_round < p.al_round), 0) AS x FROM p""")
def _(v):
    progress = v.scores.groupBy("experiment_id", "al_round").agg(
        F.floor(F.count(F.lit(1)) / 2).alias("docked"), F.min("score").alias("best1")
    )
    return W.round_offset_curve(progress, v.scores)


@query("win_decile_split", f"""
    WITH k AS (SELECT o_orderkey AS id, -o_totalprice AS score FROM orders),
    d AS (SELECT *, cast((row_number() OVER (ORDER BY score, id) - 1) * 10 // (SELECT count(*) FROM k) AS int) AS decile FROM k),
    p AS (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY {u01('id', 42)}, id) AS pick, count(*) OVER (PARTITION BY decile) AS size FROM d)
    SELECT id, score, decile, pick <= greatest(1, floor(size * 0.1::DOUBLE)) AS is_val FROM p""")
def _(v):
    return W.decile_split(v.table("orders").select(F.col("o_orderkey").alias("id"), (-F.col("o_totalprice")).alias("score")))


@query("win_kfold", f"""
    SELECT o_orderkey AS id, cast((row_number() OVER (ORDER BY {u01('o_orderkey', 42)}, o_orderkey) - 1) % 5 AS int) AS fold FROM orders""")
def _(v):
    return W.kfold(v.table("orders").select(F.col("o_orderkey").alias("id")), 5, 42)


@query("win_cumvar_cut", """
    WITH g AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1),
    c AS (SELECT *, sum(n) OVER (ORDER BY n DESC, part ROWS UNBOUNDED PRECEDING) AS cum, (SELECT sum(n) FROM g) AS total FROM g)
    SELECT part, n, round(cum / total, 9) AS cum_share FROM c WHERE (cum - n) / total < 0.95""")
def _(v):
    sizes = v.table("lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(W.cumulative_share_cut(sizes, "part", "n"), "cum_share", digits=9)


@query("win_first_n_per_file", """
    SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10""")
def _(v):
    return W.first_n_per_file(v.table("documents").select("source", "doc_id"), "source", ["doc_id"], 10)


@query("topk_hits", f"""
    SELECT s.compound_id, c.zinc_id, c.smiles, s.score, s.al_round FROM v_scores s JOIN v_compounds c ON s.compound_id = c.id
    WHERE {SCOPE} AND score IS NOT NULL ORDER BY score, compound_id LIMIT 50""")
def _(v):
    return J.scores_with_compounds(v.scores, v.compounds, "T", "exp_0", 50)


@query("limit_first_by_id", "SELECT compound_id FROM v_batches WHERE target = 'T' AND experiment_id = 'exp_0' AND round = 1 ORDER BY compound_id LIMIT 25")
def _(v):
    return v.batches.where(f"{SCOPE} AND round = 1").select("compound_id").orderBy("compound_id").limit(25)


@query("topk_greedy", f"SELECT id, predicted, 'greedy_select' AS source FROM ({ELIGIBLE}) ORDER BY predicted, id LIMIT 200")
def _(v):
    return P.greedy(eligible(v), 200)


@query("sample_thompson", f"""
    SELECT id, predicted, 'thompson_sample' AS source FROM ({ELIGIBLE})
    ORDER BY -(-predicted / 1.0::DOUBLE - ln(-ln({u01('id', 42, 3)}))), id LIMIT 200""")
def _(v):
    return P.thompson(eligible(v), 200, 1.0, 42, 3)
