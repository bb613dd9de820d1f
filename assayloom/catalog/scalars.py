"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from assayloom.catalog.maps import edges
from assayloom.catalog.registry import query, rounded
from assayloom.catalog.views import BINS
from assayloom.functions import binning as B, bits, text as X
from assayloom.operators import density as D, features as E


@query("fn_popcount", "SELECT id, cast(bit_count(lo) + bit_count(hi) AS int) AS n FROM v_fp2")
def _(v):
    return v.fps.select("id", bits.popcount(F.col("fp")).alias("n"))


@query("fn_tanimoto", """
    SELECT a.id, round((bit_count(a.lo & b.lo) + bit_count(a.hi & b.hi))::DOUBLE / greatest(1, bit_count(a.lo | b.lo) + bit_count(a.hi | b.hi)), 9) AS sim
    FROM v_fp2 a JOIN v_fp2 b ON b.id = a.id + 1""")
def _(v):
    nxt = v.fps.select((F.col("id") - 1).alias("id"), F.col("fp").alias("other"))
    return rounded(v.fps.join(nxt, "id").select("id", bits.tanimoto(F.col("fp"), F.col("other")).alias("sim")), "sim", digits=9)


@query("fn_packbits", "SELECT id, lo, hi FROM v_fp2")
def _(v):
    from assayloom.catalog.rows import _halves

    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", i) > 0)
    rows = v.table("embeddings").select(F.col("vec_id").alias("id"), set_bits.alias("positions"))
    return _halves(bits.pack_positions(rows, 64), "id")


@query("fn_unpackbits", "SELECT id, coalesce(list(cast(i AS int) ORDER BY i) FILTER (b), []::INT[]) AS bits FROM v_fpbits GROUP BY id")
def _(v):
    return bits.unpack_positions(v.fps.select("id", "fp"), 64).withColumnRenamed("positions", "bits")


@query("fn_digitize", "SELECT l_orderkey, l_linenumber, cast(greatest(0, least(29, floor((l_quantity - 5.0::DOUBLE) / 1.25::DOUBLE))) AS int) AS b FROM lineitem")
def _(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", B.bin_clipped(F.col("l_quantity"), 5.0, 1.25, 30).alias("b"))


@query("fn_string", """
    SELECT doc_id, string_split_regex(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+')[2] AS second,
           CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 40), '…') ELSE text END AS short,
           cast(doc_id % 13 AS int) AS round, concat_ws('|', least(doc_id % 5, doc_id % 3), greatest(doc_id % 5, doc_id % 3)) AS joined
    FROM documents""")
def _(v):
    docs = v.table("documents")
    path = F.concat(F.lit("/m/round9/metrics_T_round"), (F.col("doc_id") % 13).cast("string"), F.lit(".json"))
    return docs.select(
        "doc_id", F.get(X.tokens(F.col("text")), 1).alias("second"), X.shorten(F.col("text"), 40).alias("short"),
        X.trailing_round(path).alias("round"),
        X.joined_sorted(F.array(F.col("doc_id") % 5, F.col("doc_id") % 3)).alias("joined"),
    )


@query("fn_format", "SELECT event_id, CASE WHEN event_type = 'error' THEN '-' ELSE printf('%+.2f', -value) END AS score FROM events")
def _(v):
    score = F.when(F.col("event_type") != "error", -F.col("value"))
    return v.table("events").select("event_id", X.fixed(score, 2, signed=True).alias("score"))


@query("fn_math", """
    SELECT event_id, round(log2(value), 6) AS log2, round(log10(value + 1), 6) AS log10, round(exp(-value / 100), 9) AS exp,
           cast(floor(-value) AS BIGINT) AS floor, round(sqrt(value), 6) AS sqrt, greatest(1.0::DOUBLE, least(20.0::DOUBLE, value)) AS clip FROM events""")
def _(v):
    x = F.col("value")
    return v.table("events").select(
        "event_id", F.round(F.log2(x), 6).alias("log2"), F.round(F.log10(x + 1), 6).alias("log10"),
        F.round(F.exp(-x / 100), 9).alias("exp"), F.floor(-x).alias("floor"), F.round(F.sqrt(x), 6).alias("sqrt"),
        F.greatest(F.lit(1.0), F.least(F.lit(20.0), x)).alias("clip"),
    )


@query("fn_date", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, cast(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS elapsed FROM events""")
def _(v):
    ts = F.col("ts").cast("timestamp")
    return v.table("events").select(
        "event_id", X.iso_seconds(ts).alias("iso"), X.elapsed_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), ts).alias("elapsed")
    )


@query("fn_json", "SELECT event_id, cast(json_extract(props, '$.k') AS DOUBLE) AS k, concat('{\"id\":', event_id, ',\"type\":\"', event_type, '\"}') AS obj FROM events")
def _(v):
    return v.table("events").select(
        "event_id", F.from_json("props", "map<string,double>")["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("obj"),
    )


@query("fn_json_grid", f"""
    WITH g AS (SELECT cast(x AS int) AS ix, cast(y AS int) AS iy FROM range({BINS}) a(x), range({BINS}) b(y))
    SELECT g.iy, replace(to_json(list(CASE WHEN s.best IS NOT NULL THEN round(s.best, 3) + 0.0::DOUBLE END ORDER BY g.ix))::VARCHAR, ' ', '') AS json
    FROM g LEFT JOIN v_slots s ON s.slot = -1 AND s.ix = g.ix AND s.iy = g.iy GROUP BY g.iy""")
def _(v):
    return D.grid_json(D.bin_score_stats(v.xy, edges(v)), BINS, "best")


@query("fn_eta_rate", """
    SELECT event_id, CASE WHEN s > 0 THEN event_id / s END AS rate, CASE WHEN event_id > 0 THEN (20000 - event_id) * s / event_id END AS eta
    FROM (SELECT event_id, cast(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT)::DOUBLE AS s FROM events)""")
def _(v):
    elapsed = X.elapsed_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).cast("double")
    n = F.col("event_id")
    return v.table("events").select(
        "event_id", X.rate_per_second(n, elapsed).alias("rate"), X.eta_seconds(n, F.lit(20000), elapsed).alias("eta")
    )


@query("job_fingerprint", """
    WITH g AS (SELECT doc_id AS id, ('0x' || substr(md5(substr(text, cast(i AS int), 4)), 1, 3))::INT AS bit FROM (
        SELECT doc_id, text, unnest(range(1, length(text) - 2)) AS i FROM documents))
    SELECT d.doc_id AS id, 'success' AS outcome, md5(coalesce(string_agg(DISTINCT g.bit::VARCHAR, ',' ORDER BY g.bit::VARCHAR), '')) AS bits
    FROM documents d LEFT JOIN g ON g.id = d.doc_id GROUP BY d.doc_id""")
def _(v):
    fps = E.fingerprints(v.table("documents").select(F.col("doc_id").alias("id"), "text"))
    found = bits.unpack_positions(fps, E.NBITS)
    names = F.array_sort(F.transform("positions", lambda i: i.cast("string")))
    return found.select("id", "outcome", F.md5(F.array_join(names, ",")).alias("bits"))
