"""The screening tables as views over the given Parquet tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom.functions.bits import sign_word

BINS = 40

# Each view as SQL that both engines read. Later views may use earlier ones.
SHARED_VIEWS = {
    "v_scores": """
        SELECT event_id AS compound_id, 'T' AS target, concat('exp_', cast(user_id % 2 AS varchar(1))) AS experiment_id,
               cast(event_id % 6 AS int) AS al_round,
               CASE WHEN event_type = 'error' THEN NULL ELSE -value / 20 END AS score, ts AS docked_at
        FROM events WHERE event_id % 10 <> 0""",
    "v_batches": """
        SELECT event_id AS compound_id, 'T' AS target, concat('exp_', cast(user_id % 2 AS varchar(1))) AS experiment_id,
               cast(event_id % 6 AS int) AS round,
               CASE WHEN event_id % 6 = 0 THEN 'random_init' ELSE 'thompson_sample' END AS source
        FROM events""",
    "v_pred": """
        SELECT event_id + 5000 AS id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE -value / 25 END AS predicted
        FROM events""",
    "v_compounds": """
        SELECT doc_id AS id, md5(text) AS zinc_id, text AS smiles, concat(lang, '/', source) AS tranche,
               CASE WHEN doc_id % 7 = 0 THEN NULL ELSE cast(n_chars AS double) END AS mw,
               CASE WHEN doc_id % 11 = 0 THEN NULL ELSE cast(n_chars AS double) / 100 END AS logp
        FROM documents""",
    "v_keys": """
        SELECT doc_id AS compound_id, source AS group_key, cast(doc_id % 6 AS int) AS al_round,
               -cast(n_chars AS double) / 1000 AS score
        FROM documents""",
    "v_xy": """
        SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS x, l_quantity AS y, -100 * l_discount AS score,
               l_linenumber AS al_round, l_returnflag = 'R' AS is_pick, l_linestatus AS side
        FROM lineitem""",
    "v_metrics": """
        SELECT concat('exp_', cast(l_suppkey % 2 AS varchar(1))) AS experiment_id, l_linenumber AS round,
               max(l_extendedprice) / 100000 AS val_rmse, min(-l_discount * 100) AS best1
        FROM lineitem GROUP BY 1, 2""",
}

# The pattern catalogue that the flag queries use.
CATALOGUE = [("licence", "(?i)licen[cs]e"), ("email", "[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("digits", "[0-9]{4,}")]

ORACLE_VIEWS = {
    **SHARED_VIEWS,
    "v_fpbits": """
        SELECT vec_id AS id, label, unnest(embedding) > 0 AS b, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings""",
    # Two halves of 32 bits, as bit 63 of a word does not fit a positive bigint.
    "v_fp2": """
        SELECT id, label, cast(sum(CASE WHEN b AND i < 32 THEN 1::BIGINT << i ELSE 0 END) AS BIGINT) AS lo,
               cast(sum(CASE WHEN b AND i >= 32 THEN 1::BIGINT << (i - 32) ELSE 0 END) AS BIGINT) AS hi
        FROM v_fpbits GROUP BY id, label""",
    "v_catalog": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{name}', '{regex}')" for i, (name, regex) in enumerate(CATALOGUE)
    ) + ") AS t(pos, name, pattern)",
    # Edges, histograms and ratio maps of the two-dimensional reports: background and picks.
    "v_edges": f"""
        SELECT x0, (x1 - x0) / {BINS}.0::DOUBLE AS wx, y0, (y1 - y0) / {BINS}.0::DOUBLE AS wy FROM (
          SELECT min(x) - (max(x) - min(x)) * 0.02::DOUBLE AS x0, max(x) + (max(x) - min(x)) * 0.02::DOUBLE AS x1,
                 min(y) - (max(y) - min(y)) * 0.02::DOUBLE AS y0, max(y) + (max(y) - min(y)) * 0.02::DOUBLE AS y1 FROM v_xy)""",
    "v_binned": f"""
        SELECT v.*, cast(greatest(0, least({BINS - 1}, floor((x - x0) / wx))) AS int) AS ix,
               cast(greatest(0, least({BINS - 1}, floor((y - y0) / wy))) AS int) AS iy FROM v_xy v, v_edges""",
    "v_maps": """
        SELECT *, sum(n_bg) OVER () AS bg_total, sum(n_pick) OVER () AS pick_total,
               sum(n_pick_a) OVER () AS pick_total_a, sum(n_pick_b) OVER () AS pick_total_b FROM (
          SELECT ix, iy, count(*) FILTER (NOT is_pick) AS n_bg, count(*) FILTER (is_pick) AS n_pick,
                 count(*) FILTER (is_pick AND al_round <= 2) AS n_pick_a,
                 count(*) FILTER (is_pick AND al_round > 2) AS n_pick_b
          FROM v_binned GROUP BY ix, iy)""",
    "v_ratio": """
        SELECT ix, iy, n_bg, n_pick,
          CASE WHEN n_bg >= 3 THEN log2((n_pick / greatest(pick_total, 1) + 1e-9::DOUBLE) / (n_bg / bg_total + 1e-9::DOUBLE)) END AS log2r,
          CASE WHEN n_bg >= 3 THEN log2((n_pick_a / greatest(pick_total_a, 1) + 1e-9::DOUBLE) / (n_bg / bg_total + 1e-9::DOUBLE)) END AS log2r_a,
          CASE WHEN n_bg >= 3 THEN log2((n_pick_b / greatest(pick_total_b, 1) + 1e-9::DOUBLE) / (n_bg / bg_total + 1e-9::DOUBLE)) END AS log2r_b
        FROM v_maps WHERE n_bg > 0""",
    "v_slots": """
        SELECT CASE WHEN grouping(al_round) = 1 THEN -1 ELSE al_round END AS slot, ix, iy, count(*) AS n,
               CASE WHEN count(*) >= 2 THEN avg(score) END AS mean, CASE WHEN count(*) >= 2 THEN min(score) END AS best
        FROM v_binned GROUP BY GROUPING SETS ((al_round, ix, iy), (ix, iy))""",
}


def with_views(body: str) -> str:
    """Puts the views a query needs, and those they need, in front of it."""
    names = list(ORACLE_VIEWS)
    need: set[str] = set()

    def visit(sql: str) -> None:
        for name in names:
            if name not in need and re.search(rf"\b{name}\b", sql):
                need.add(name)
                visit(ORACLE_VIEWS[name])

    visit(body)
    if not need:
        return body.strip()
    listed = ",\n".join(f"{n} AS ({ORACLE_VIEWS[n].strip()})" for n in names if n in need)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {listed},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {listed},\n{text[5:]}"
    return f"WITH {listed}\n{text}"


class Views:
    """The same views as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _shared(self, name: str, table: str) -> DataFrame:
        sql = SHARED_VIEWS[name].replace(f"FROM {table}", "FROM {src}")
        return self.spark.sql(sql, src=self.table(table))

    @property
    def scores(self) -> DataFrame:
        return self._shared("v_scores", "events")

    @property
    def batches(self) -> DataFrame:
        return self._shared("v_batches", "events")

    @property
    def pred(self) -> DataFrame:
        return self._shared("v_pred", "events")

    @property
    def compounds(self) -> DataFrame:
        return self._shared("v_compounds", "documents")

    @property
    def keys(self) -> DataFrame:
        return self._shared("v_keys", "documents")

    @property
    def xy(self) -> DataFrame:
        return self._shared("v_xy", "lineitem")

    @property
    def metrics(self) -> DataFrame:
        return self._shared("v_metrics", "lineitem")

    @property
    def fps(self) -> DataFrame:
        """One 64-bit word per vector: the signs of its components."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), "label", F.array(sign_word(F.col("embedding"))).alias("fp")
        )

    @property
    def background(self) -> DataFrame:
        return self.xy.where(~F.col("is_pick"))

    @property
    def picks(self) -> DataFrame:
        return self.xy.where("is_pick")
