"""Readers. Files are written by Spark from the given tables first, so the work grows with them."""

from functools import reduce

from pyspark.sql import functions as F

from assayloom.catalog.registry import query
from assayloom.functions.text import tranche_name
from assayloom.operators import ingest as I
from assayloom.runtime import work_path
from assayloom.sources import files as S, tables as T

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


#: Lines that one task sorts and writes.
LINES_PER_TASK = 500_000


def write_line_files(v, label: str, line) -> str:
    """Folders of .smi files, one per language, a header line in each file, lines in doc_id order; the more rows the more files."""
    out = work_path(v.spark, label)
    lines = v.table("documents").select("lang", "doc_id", line.alias("header line"))
    parts = max(4, -(-lines.count() // LINES_PER_TASK))
    lines.repartitionByRange(parts, "doc_id").sortWithinPartitions("lang", "doc_id").drop("doc_id").write.partitionBy("lang").option(
        "extension", "smi"
    ).csv(out, header=True, sep="\u0001", quote="", escape="")
    return out


def lang_of(path):
    return F.regexp_extract(path, r"lang=([^/]+)/", 1)


@query("src_line_files", """
    SELECT concat('c', doc_id, '"\\q') AS raw, md5(text) AS zinc_id, lang FROM documents WHERE doc_id % 50 <> 0""")
def _(v):
    line = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("only"), "doc_id")).otherwise(
        F.concat(F.lit("  c"), "doc_id", F.lit('"\\q'), F.lit("\t "), F.md5("text"), F.lit("  more words "))
    )
    return S.read_lines(v.spark, write_line_files(v, "lines", line)).select("raw", "zinc_id", lang_of(F.col("file")).alias("lang"))


@query("src_tranche_name", "SELECT doc_id, concat(lang, '/', source) AS tranche FROM documents")
def _(v):
    path = F.concat(F.lit("file:/data/library/"), "lang", F.lit("/"), "source", F.lit(".smi"))
    return v.table("documents").select("doc_id", tranche_name(path).alias("tranche"))


@query("src_header_delimited", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(v):
    out = work_path(v.spark, "delimited")
    v.table("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.csv(out, header=True, sep="\t")
    return S.read_delimited(v.spark, out, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string", sep="\t")


@query("src_progress_csv", """
    SELECT cast(event_id % 6 AS int) AS al_round, event_id AS docked, CASE WHEN event_id % 5 <> 0 THEN -value END AS best1,
           -value AS best10, NULL::DOUBLE AS best100, NULL::DOUBLE AS best1000
    FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0""")
def _(v):
    out = work_path(v.spark, "progress")
    e, n = v.table("events"), F.col("event_id")
    text = lambda c: c.cast("string")
    e.select(
        F.when(n % 7 == 0, "x1").otherwise(text(n)).alias("docked"), F.lit("1").alias("valid"), F.lit("0").alias("failed"),
        F.when(n % 5 == 0, F.lit(None)).otherwise(text(-F.col("value"))).alias("best1"),
        F.when(n % 11 == 0, "n/a").otherwise(text(-F.col("value"))).alias("best10"),
        F.lit("").alias("best100"), F.lit(None).cast("string").alias("best1000"),
        F.lit("3").alias("elapsed_s"), F.lit("t").alias("timestamp"), (n % 6).alias("round"),
    ).write.partitionBy("round").csv(out, header=True)
    return S.read_progress(v.spark, f"{out}/*/*.csv", lambda p: F.regexp_extract(p, r"round=(\d+)/", 1).try_cast("int"))


@query("src_metrics_json", """
    SELECT cast(event_id % 97 AS int) AS round, max(value) AS val_rmse, count(*) AS n_train FROM events WHERE event_id % 97 % 3 <> 0 GROUP BY 1""")
def _(v):
    out = work_path(v.spark, "metrics")
    per_round = v.table("events").groupBy((F.col("event_id") % 97).alias("round")).agg(
        F.max("value").alias("val_rmse"), F.count(F.lit(1)).alias("n_train")
    )
    per_round.withColumn("val_rmse", F.when(F.col("round") % 3 != 0, F.col("val_rmse"))).repartition("round").write.partitionBy(
        "round").json(out)
    rows = S.read_metrics_json(v.spark, f"{out}/*/*.json", lambda p: F.regexp_extract(p, r"round=(\d+)/", 1).try_cast("int"))
    return rows.select("round", "val_rmse", "n_train")


@query("src_id_ranges", """
    WITH m AS (SELECT max(o_orderkey) AS mx, greatest(1, max(o_orderkey) // 24) AS w FROM orders)
    SELECT cast(k AS int) AS k, cast(k * w + 1 AS BIGINT) AS start_id, cast(CASE WHEN k = 23 THEN mx ELSE (k + 1) * w END AS BIGINT) AS end_id,
           (SELECT count(*) FROM orders WHERE o_orderkey BETWEEN k * w + 1 AND CASE WHEN k = 23 THEN mx ELSE (k + 1) * w END) AS n
    FROM m, range(24) AS r(k)""")
def _(v):
    ids = v.table("orders").select(F.col("o_orderkey").alias("id"))
    ranges = I.id_ranges(ids, 24)
    width = F.col("end_id") - F.col("start_id") + 1
    first = ranges.where("k = 0").select(width.alias("w")).first()["w"]
    part = F.least(F.floor((F.col("id") - 1) / first), F.lit(23)).cast("int").alias("k")
    sizes = ids.where("id >= 1").groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    return ranges.join(sizes, "k", "left").select("k", "start_id", "end_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("src_half_open_chunks", """
    SELECT s AS start_id, s + 500 AS end_id FROM (SELECT unnest(range(1, (SELECT max(o_orderkey) FROM orders) + 1, 500)) AS s)
    WHERE s NOT IN (SELECT 1 + 500 * c_nationkey FROM customer WHERE c_custkey % 2 = 0)""")
def _(v):
    done = v.table("customer").where("c_custkey % 2 = 0").select((F.lit(1) + 500 * F.col("c_nationkey").cast("long")).alias("start_id"))
    return I.half_open_chunks(v.table("orders"), 500, done, "o_orderkey")


@query("src_result_xml", """
    SELECT p_partkey AS compound_id, CASE WHEN e < 0 THEN e END AS score FROM (
      SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1) THEN NULL WHEN p_partkey % 7 = 2 THEN -p_retailprice - 1
        WHEN p_partkey % 7 = 3 THEN -cast(p_size AS DOUBLE) WHEN p_partkey % 7 = 4 THEN cast(p_size AS DOUBLE) ELSE -p_retailprice END AS e FROM part)""")
def _(v):
    k, price, size = F.col("p_partkey") % 7, F.col("p_retailprice"), F.col("p_size").cast("double")
    tag = lambda name, value: F.concat(F.lit(f"<{name}> "), value.cast("string"), F.lit(f" </{name}>"))
    body = (
        F.when(k == 1, "<other>1</other>")
        .when(k == 2, F.concat(tag("best_energy", -price), F.lit("<g>"), tag("best_energy", -price - 1), F.lit("</g>")))
        .when(k == 3, F.concat(tag("best_energy", F.lit("none")), tag("free_NRG_binding", -size)))
        .when(k == 4, tag("free_NRG_binding", size))
        .when(k == 5, F.concat(tag("best_energy", -price), tag("free_NRG_binding", -price - 5)))
        .otherwise(F.concat(tag("free_NRG_binding", -price), tag("free_NRG_binding", F.lit("0.5"))))
    )
    xml = F.when(k == 0, "<result><best_energy>-1</best").otherwise(F.concat(F.lit("<result>"), body, F.lit("</result>")))
    return v.table("part").select(F.col("p_partkey").alias("compound_id"), S.best_energy(xml).alias("score"))


@query("src_embedding_table", "SELECT id, x, y, score, al_round FROM v_xy")
def _(v):
    out = work_path(v.spark, "xy")
    v.xy.select("id", "x", "y", "score", "al_round").write.parquet(out)
    return T.read_embedding_2d(v.spark, out)


@query("src_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ALL_TABLES))
def _(v):
    tables = T.register_tables(v.spark, v.folder, ALL_TABLES)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)
