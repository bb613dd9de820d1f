"""Personal data: fixed shapes, and contextual extraction bootstrapped from them.

Entities of known shape are the seeds, each with its whole text. The words before them are lexical patterns; seeds, and
tokens that look like identifiers, are instances. Patterns and instances score each other over a few rounds: a pattern is as good as the share of its instances
that are believed, an instance as good as the best pattern that holds it. Patterns above a threshold then mark every
identifier they surround, also those of no known shape. Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import documents, narrow_side, put

#: Fixed kinds in their order, with linear forms of their patterns: what can match in one way only is matched possessively.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: A further seed: long runs of hexadecimal digits are secrets. What patterns find beyond the seeds is of the seed's kind.
SECRET = r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])"
#: What may be an identifier: at least eight characters with a digit among them.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{8,}+"
#: What ends a context: another instance, or what is as good as one. Its words are no pattern.
_OTHER = rf"\S*@\S*|[0-9]++(?:\.[0-9]++){{3}}|[0-9]{{4,}}+|{TOKEN}"
#: Rounds, the least number of different instances of a pattern, the confidence from which it is believed, and the doubt
#: that is added to its instances.
ROUNDS, LEAST_SUPPORT, LEAST_CONFIDENCE, DOUBT = 3, 3, 0.7, 1.0


def _context(gap: Column) -> Column:
    """Up to two words before an instance, with what touches it, since the instance before: the lexical pattern."""
    words = F.regexp_extract(gap, r"(?<!\S)((?:\S++\s++){0,2}+\S*+)\z", 1)
    return F.lower(F.ltrim(F.element_at(F.split(words, _OTHER, -1), -1)))


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<start, stop, hit, context>> of all matches, in code points; `hint` is a cheap necessary condition."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "array<struct<start:bigint,stop:bigint,hit:string,context:string>>"
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.length(x["h"])
        one = F.struct(
            a.alias("start"), b.alias("stop"), x["h"].alias("hit"), _context(x["g"]).alias("context"),
        )
        return F.struct(b.alias("at"), F.array_append(acc["out"], one).alias("out"))

    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(F.regexp_like(text, F.lit(hint)), found).otherwise(F.array().cast(kind))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = F.split(hit, r"\.")
        return F.forall(part, lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(4)).cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(hit))
    if kind == "card":
        return n.between(14, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _kind_spans(matches: Column, place: int, kind: str) -> Column:
    good = F.filter(matches, lambda m: _valid(kind, m["hit"]))
    return F.transform(good, lambda m: F.struct(
        m["start"].alias("start"), F.lit(place).alias("place"), m["stop"].alias("stop"), F.lit(kind).alias("kind"),
        m["context"].alias("context"), m["hit"].alias("hit"),
    ))


def base_spans(text: Column) -> Column:
    """array<struct<start, place, stop, kind, context, hit>> of the fixed kinds, by start, then kind as listed."""
    hints = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    each = []
    for place, kind in enumerate(KINDS):
        each.append(_kind_spans(_matches(text, patterns[kind], hints[kind]), place, kind))
    return F.sort_array(F.flatten(F.array(*each)))


def _span(start: Column, place: Column, stop: Column, kind: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), place.alias("place"), stop.cast("long").alias("stop"), kind.alias("kind"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def seen_in(docs: DataFrame) -> DataFrame:
    """Written rows (row, doc_id, base, tokens): base spans, and instances as (start, stop, context, token, seed, inside).

    Instances are the base spans, whole and with their kind as seed, and the identifier tokens that touch none of them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("found", base_spans(F.col("text")))
    known = F.transform(
        "found",
        lambda b: F.struct(
            b["start"].alias("start"), b["stop"].alias("stop"), b["context"].alias("context"), b["hit"].alias("token"),
            b["kind"].alias("seed"), F.lit(True).alias("inside"),
        ),
    )
    outside = F.filter(
        _matches(F.col("text"), TOKEN, "[0-9]"), lambda m: ~F.exists("found", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
    )
    tokens = F.transform(
        outside,
        lambda m: F.struct(
            m["start"].alias("start"), m["stop"].alias("stop"), m["context"].alias("context"), m["hit"].alias("token"),
            F.when(F.regexp_like(m["hit"], F.lit(SECRET)), F.lit("secret")).alias("seed"), F.lit(False).alias("inside"),
        ),
    )
    base = F.transform("found", lambda b: _span(b["start"], b["place"], b["stop"], b["kind"]))
    # the row number is fixed by writing
    return put(
        rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), F.concat(known, tokens).alias("tokens")),
        "pii-rows",
    )


def learn_patterns(
    rows: DataFrame, rounds: int = ROUNDS, support: int = LEAST_SUPPORT, least: float = LEAST_CONFIDENCE, doubt: float = DOUBT,
) -> DataFrame:
    """(context, kind, confidence) of the believed patterns, from rows of `seen_in`."""
    tokens = rows.select(F.explode("tokens").alias("t")).select("t.context", F.lower("t.token").alias("token"), "t.seed")
    edges = tokens.where("trim(context) <> ''").groupBy("context", "token").agg(F.max("seed").alias("seed"))
    wide = edges.groupBy("context").agg(F.count("*").alias("n"), F.count("seed").alias("seeds")).where(F.col("n") >= support)
    # a pattern that no seed stands in can only be reached through instances that other patterns hold too
    edges = put(edges.join(wide.select("context", "n"), "context"), "pii-edges")
    kinds = edges.where("seed IS NOT NULL").groupBy("token").agg(F.max("seed").alias("kind"))
    belief = kinds.withColumn("belief", F.lit(1.0))
    for _ in range(rounds):
        patterns = put(
            edges.join(belief, "token").groupBy("context", "kind", "n").agg(F.sum("belief").alias("held"))
            .withColumn("confidence", F.col("held") / (F.col("n") + doubt)), "pii-patterns",
        )
        found = edges.join(patterns.where(F.col("confidence") >= least / 2).select("context", "kind", "confidence"), "context")
        spread = found.groupBy("token", "kind").agg(F.max("confidence").alias("belief"))
        belief = put(
            kinds.withColumn("belief", F.lit(1.0)).unionByName(spread).groupBy("token", "kind").agg(F.max("belief").alias("belief")),
            "pii-belief",
        )
    best = patterns.where(F.col("confidence") >= least).groupBy("context").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    return put(best.select("context", F.col("b.kind").alias("kind"), F.col("b.confidence").alias("confidence")), "pii-believed")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the fixed kinds), spans (those and the found ones).

    A null text counts as empty. A found span overlaps no base span; its kind is `secret` or a fixed kind, whose shape it need
    not have. Seeds of the kind secret are found spans too. Other columns are not read.
    """
    rows = seen_in(docs)
    believed = learn_patterns(rows)
    tokens = rows.select("row", F.explode("tokens").alias("t")).select("row", "t.*").where("NOT inside")
    sure = tokens.where("seed IS NOT NULL").select("row", "start", "stop", F.col("seed").alias("kind"))
    new = tokens.where("seed IS NULL").join(narrow_side(believed), "context").select("row", "start", "stop", "kind")
    order = [*KINDS, "secret"]
    place = reduce(lambda c, i: c.when(F.col("kind") == order[i], i), range(1, len(order)), F.when(F.col("kind") == order[0], 0))
    extra = sure.union(new).groupBy("row").agg(F.collect_list(_span(F.col("start"), place, F.col("stop"), F.col("kind"))).alias("extra"))
    side = narrow_side(put(extra.withColumnRenamed("row", "e_row"), "pii-extra"))
    out = rows.join(side, rows["row"] == side["e_row"], "left")
    return out.select(
        "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("extra", F.filter("base", lambda s: F.lit(False))))).alias("spans"),
    )


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find(documents(spark, sf_dir)).select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
