"""Mixing sources to target weights: whole copies first, then Pareto order sampling of the remainder.

Each source gets a target number of words. Whole multiples of the source are certain copies of every document. For the
remaining words, documents are ranked by random odds divided by inclusion odds (Pareto order sampling) and taken in that
order until their words make up the remainder. The inclusion odds are those of the remaining share, times the root of a
document's size over the mean size, so longer documents are likelier in. The random odds come from a hash of (doc_id, seed).
The place in the order where the words suffice is found by counting words in ever finer slices of the rank, so that no
source is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayloom.functions.hashing import uniform
from assayloom.llm.registry import query
from assayloom.llm.tables import documents, narrow_side, put

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 11
#: The rank is a whole number of _BITS bits, counted _STEP bits at a time until a slice has at most SLICE_ROWS rows.
_BITS, _STEP = 50, 10
SLICE_ROWS = 20_000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds weight and target to rows (source, source_size), one per source.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times the source's size; the excess
    is shared again by weight. Ordered by (limit / weight), those that stop form a prefix, so one pass finds them.
    """
    every = Window.orderBy(F.lit(0))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
        .withColumn("left", F.sum("source_size").over(every) - (F.sum("limit").over(up_to) - F.col("limit")))
        .withColumn("rest", F.sum("weight").over(every) - (F.sum("weight").over(up_to) - F.col("weight")))
        .withColumn("per_weight", F.col("left").cast("double") / F.col("rest"))
        .withColumn("stops", F.col("per_weight") * F.col("weight") >= F.col("limit"))
    )
    level = F.min(F.when(~F.col("stops"), F.struct((-F.col("left")).alias("n"), F.col("per_weight").alias("p")))).over(every)["p"]
    return rows.withColumn("level", level).select(
        "source", "source_size", "n_docs", "weight",
        F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"),
    )


def _rank(size: Column, doc_id: Column, mean: Column, share: Column, seed: int) -> Column:
    u = uniform(doc_id, seed)
    odds = share / (1 - share) * F.sqrt(size / mean)
    ratio = u / (1 - u) / odds
    return F.when(size > 0, F.floor(ratio / (1 + ratio) * 2**_BITS)).otherwise(2**_BITS - 1).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): the narrow rows (doc_id, source, size), and per source its target, whole copies and last place taken.

    A null text has size 0, a null source is a source of its own, a null doc_id counts as 0 for the draw. Rows that repeat
    a doc_id are taken or left together. Documents without words get the whole copies only. Only doc_id, source and text are
    read.
    """
    sized = put(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        words(F.col("text")).alias("size"),
    ), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = put(
        targets(totals, weights, most).withColumn("whole", F.floor(share))
        .withColumn("share", share - F.col("whole")).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumnRenamed("source", "of"),
        "targets",
    )
    cuts = _cuts(_ranked(sized, goals, seed), goals)
    ended = goals.join(cuts, goals["of"].eqNullSafe(cuts["cut_of"]), "left").drop("cut_of")
    return sized, put(ended, "sources")


def _ranked(sized: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, size, ...) with their source's goals and their place in its order."""
    mean = F.col("source_size") / F.col("n_docs")
    rank = F.when(F.col("wanted") > 0, _rank(F.col("size"), F.coalesce("doc_id", F.lit(0)), mean, F.col("share"), seed))
    side = narrow_side(goals)
    return sized.join(side, sized["source"].eqNullSafe(side["of"])).withColumn("rank", rank)


def _cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source (last_rank, last_id): the last row of the order whose middle lies below the wanted words."""
    rows = put(rows.where("wanted > 0").select("doc_id", "of", "size", "rank", "wanted"), "ranked")
    open_ = goals.where("wanted > 0").select(F.col("of").alias("cut_of"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for shift in range(_BITS - _STEP, -1, -_STEP):
        side = narrow_side(open_)
        inside = rows.join(
            side, rows["of"].eqNullSafe(side["cut_of"]) & (F.shiftright("rank", shift + _STEP) == side["prefix"])
        )
        slices = inside.groupBy("cut_of", "wanted", "before", F.shiftright("rank", shift).alias("slice")).agg(
            F.sum("size").alias("held"), F.count("*").alias("n"),
        )
        order = Window.partitionBy("cut_of").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = (
            slices.withColumn("upto", F.col("before") + F.sum("held").over(order))
            .where(F.col("upto") >= F.col("wanted"))
            .groupBy("cut_of").agg(F.min(F.struct("slice", (F.col("upto") - F.col("held")).alias("before"), "n")).alias("s"))
        )
        open_ = put(found.select("cut_of", F.col("s.slice").alias("prefix"), F.col("s.before").alias("before"), F.col("s.n").alias("n")), "slice")
        if open_.where(F.col("n") > SLICE_ROWS).isEmpty():
            break
    side = narrow_side(open_)
    inside = rows.join(side, rows["of"].eqNullSafe(side["cut_of"]) & (F.shiftright("rank", shift) == side["prefix"]))
    place = F.struct("rank", F.coalesce("doc_id", F.lit(0)).alias("id"))
    order = Window.partitionBy("cut_of").orderBy(place, "size")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = (
        inside.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") < 2 * F.col("wanted"))
        .groupBy("cut_of").agg(F.max(place).alias("last"))
    )
    last = last.withColumnRenamed("cut_of", "l_of")
    cut = open_.alias("o").join(last, F.col("o.cut_of").eqNullSafe(F.col("l_of")), "left")
    return put(cut.select(
        F.col("o.cut_of").alias("cut_of"),
        F.coalesce("last.rank", F.shiftleft("prefix", shift) - 1).alias("last_rank"),
        F.coalesce("last.id", F.lit(2**63 - 1)).alias("last_id"),
    ), "cuts")


def _copies(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds `copies` to rows (doc_id, source, size, ...), with no shuffle of them where the sources are few."""
    ranked = _ranked(rows, sources, seed)
    id_ = F.coalesce("doc_id", F.lit(0))
    taken = (F.col("rank") < F.col("last_rank")) | ((F.col("rank") == F.col("last_rank")) & (id_ <= F.col("last_id")))
    return ranked.withColumn("copies", F.col("whole") + F.coalesce((taken & (F.col("size") > 0)).cast("long"), F.lit(0)))


def copies(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies (how often the mix takes it)."""
    rows, sources = plan(docs, weights, most, seed)
    return _copies(rows, sources, seed).select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as the mix takes it, columns as they are."""
    _, sources = plan(docs, weights, most, seed)
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"),
    )
    taken = _copies(wide, sources, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


@query("op10_mix_sources", r"""
    WITH d AS (SELECT doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size FROM documents),
    w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS lim
        FROM (SELECT source, cast(sum(size) AS bigint) AS source_size, count(*) AS n_docs FROM d GROUP BY source)),
    l AS (SELECT *, sum(source_size) OVER () - (sum(lim) OVER o - lim) AS left_, sum(weight) OVER () - (sum(weight) OVER o - weight) AS rest
        FROM w WINDOW o AS (ORDER BY lim::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, left_::DOUBLE / rest AS per_weight, left_::DOUBLE / rest * weight >= lim AS stops FROM l),
    t AS (SELECT *, CASE WHEN stops THEN lim::DOUBLE
        ELSE (SELECT per_weight FROM p WHERE NOT stops ORDER BY left_ DESC LIMIT 1) * weight END AS target FROM p),
    g AS (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS share, target - floor(ratio) * source_size AS wanted
        FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t)),
    r AS (SELECT d.*, source_size, target, whole, wanted, (u / (1 - u)) / (share / (1 - share) * sqrt(size / (source_size::DOUBLE / n_docs))) AS q
        FROM (SELECT *, (cast('0x' || substr(md5(concat_ws('-', doc_id, '11', '0')), 1, 12) AS bigint) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM d) d
        JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 THEN floor(q / (1 + q) * 1125899906842624) ELSE 1125899906842623 END, doc_id
        ROWS UNBOUNDED PRECEDING) AS upto FROM r),
    n AS (SELECT *, cast(whole AS bigint) + CASE WHEN wanted > 0 AND size > 0 AND 2 * upto - size < 2 * wanted THEN 1 ELSE 0 END AS copies FROM c)
    SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source FROM n""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source",
    )
