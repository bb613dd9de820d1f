"""Prefix trie of conversations from composable fingerprints.

Conversations may open with turns of another one: c starts with the first h turns of its base conversation and goes on with
its own turns after the first h. No rebuilt text is ever made. A turn weighs in at its place as value x base^place modulo a
prime, in four lanes; the fingerprint of a prefix is the sum, so fingerprints of adjoining pieces compose: a rebuilt prefix is
the base's head plus the own prefix without its own head, moved by h places (a factor). Prefix sums come from one running sum
per conversation, cut in blocks, so that a conversation of any length is spread.

Equal depth and fingerprint make a group. It is true if all its members have the same parent fingerprint and the same last
turn, by the turn's stored reference; turns with one hash are compared by their whole role and text. Where a group or a hash
fails this, its rows are grouped by their whole path of references instead.

A node is named by its smallest member. A conversation names a run of nodes down to its own end, so sums over subtrees need no
walk: a node's subtree holds whole runs of all its members but the smallest, and the rest of that one's run. They are sums
over the members of a group, combined before the shuffle, and copies of one conversation are spread like anything else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import put
from assayloom.operators.ranking import rank_within
from assayloom.runtime import join_keys

#: The lanes' primes (the largest below 2^31) and bases.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525117, 22695477, 1220703125)
#: Turns summed in one window; ids of one text segment of the digest of ends.
BLOCK, SEGMENT = 4096, 65536
#: Largest head and the number of conversations that share a base.
HEADS, FAMILY = 6, 100
_LANES = range(len(PRIMES))


def turn_hashes(role: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), role, text), F.xxhash64(F.lit(2), role, text)


def _values(h1: Column, h2: Column) -> list[Column]:
    """A value below the prime for each lane: two halves of each hash."""
    halves = [f(h) for h in (h1, h2) for f in (lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)), lambda x: F.shiftrightunsigned(x, 33))]
    return [F.pmod(h, F.lit(p)) for h, p in zip(halves, PRIMES)]


def _power(lane: int, place: Column) -> Column:
    """base^place modulo the prime, from tables of 256 powers for each byte of the place."""
    p, out = PRIMES[lane], F.lit(1).cast("long")
    for byte in range(4):
        step = pow(BASES[lane], 256**byte, p)
        table = F.split(F.lit(",".join(str(pow(step, i, p)) for i in range(256))), ",").cast("array<long>")
        digit = F.shiftright(place, 8 * byte).bitwiseAND(F.lit(255)).cast("int")
        out = F.pmod(out * F.get(table, digit), F.lit(p))
    return out


def _moved(lane: int, value: Column, back: Column) -> Column:
    """A value moved `back` places to the front (0 to HEADS - 1)."""
    p = PRIMES[lane]
    table = F.array(*[F.lit(pow(BASES[lane], -i, p)).cast("long") for i in range(HEADS)])
    return F.pmod(value * F.get(table, back.cast("int")), F.lit(p))


def _lane(lane: int, value: Column) -> Column:
    return F.pmod(value, F.lit(PRIMES[lane]))


def _packed(lanes: list[Column]) -> list[Column]:
    """Four lanes as two numbers."""
    return [F.shiftleft(a, 31).bitwiseOR(b) for a, b in (lanes[:2], lanes[2:])]


def stored_turns(conversations: DataFrame, hashes: Callable = turn_hashes) -> DataFrame:
    """Written (conv_id, pos, h1, h2, variant, len, sums, own, chars): the turns in order, from 1, with their prefix sums.

    (h1, h2, variant) is a turn's reference: equal exactly if role and text are equal. `sums` are the lanes up to and with the
    turn, `own` its part in them, `chars` the code points up to and with it.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    h1, h2 = hashes(F.col("role"), F.col("text"))
    hashed = rank_within(rows, ["conv_id"], ["turn", "role", "text"], "pos").withColumn("h1", h1).withColumn("h2", h2)
    whole = F.struct("role", "text")
    mixed = put(hashed.groupBy("h1", "h2").agg(F.min(whole).alias("a"), F.max(whole).alias("b")).where("a != b").select("h1", "h2"), "mixed-turns")
    if mixed.isEmpty():
        known = hashed.withColumn("variant", F.lit(0))
    else:
        texts = hashed.join(mixed, ["h1", "h2"], "left_semi").select("h1", "h2", "role", "text").distinct()
        order = Window.partitionBy("h1", "h2").orderBy("role", "text")
        known = hashed.join(texts.withColumn("n", F.row_number().over(order)), ["h1", "h2", "role", "text"], "left").withColumn(
            "variant", F.coalesce("n", F.lit(0))
        )
    values = _values(F.col("h1"), F.col("h2"))
    turns = known.select(
        "conv_id", "pos", "h1", "h2", "variant", F.length("text").cast("long").alias("len"),
        *[F.pmod(values[i] * _power(i, F.col("pos")), F.lit(PRIMES[i])).alias(f"c{i}") for i in _LANES],
    ).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    turns = put(turns, "hashed-turns")
    sums = [F.sum(f"c{i}").alias(f"t{i}") for i in _LANES] + [F.sum("len").alias("t_len")]
    totals = put(turns.groupBy("conv_id", "block").agg(*sums), "turn-blocks")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "conv_id", "block",
        *[_lane(i, F.sum(_lane(i, F.col(f"t{i}"))).over(earlier)).alias(f"o{i}") for i in _LANES], F.sum("t_len").over(earlier).alias("o_len"),
    ).where("block > 0")
    if totals.where("block > 0").isEmpty():
        placed = turns.select("*", *[F.lit(0).cast("long").alias(f"o{i}") for i in _LANES], F.lit(0).cast("long").alias("o_len"))
    else:
        placed = turns.join(offsets, ["conv_id", "block"], "left").fillna(0, [*[f"o{i}" for i in _LANES], "o_len"])
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return put(placed.select(
        "conv_id", "pos", "h1", "h2", "variant", "len",
        *[_lane(i, F.col(f"o{i}") + F.sum(f"c{i}").over(upto)).alias(f"s{i}") for i in _LANES], *[f"c{i}" for i in _LANES],
        (F.col("o_len") + F.sum("len").over(upto)).alias("chars"),
    ), "turns")


def _plans(turns: DataFrame) -> DataFrame:
    """Per conversation: n own turns, head (its base's first turns, at most h), back (places moved), and what the head adds."""
    first = F.when(F.col("pos") < HEADS, F.struct("pos", "h1", "h2", "variant", "len", *[f"s{i}" for i in _LANES], *[f"c{i}" for i in _LANES], "chars"))
    known = put(turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("chars").alias("own_chars"), F.sort_array(F.collect_list(first)).alias("opening"),
    ), "conversations")
    bases = known.select(F.col("conv_id").alias("base"), F.col("opening").alias("base_opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    plans = known.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(bases, "base", "left")
    head = F.coalesce(F.slice("base_opening", F.lit(1), F.col("h")), F.array().cast(known.schema["opening"].dataType))
    plans = plans.withColumn("head", head).withColumn("held", F.size("head"))
    end = F.get("head", F.col("held") - 1)  # null without a head
    own = F.get("opening", F.least(F.col("h"), F.col("n").cast("int")) - 1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    plans = plans.select(
        "conv_id", "n", "h", "head", "held", (F.col("h") - F.col("held")).alias("back"),
        *[zero(end[f"s{i}"]).alias(f"b{i}") for i in _LANES], *[zero(own[f"s{i}"]).alias(f"d{i}") for i in _LANES],
        zero(end["chars"]).alias("b_chars"), zero(own["chars"]).alias("d_chars"), "own_chars",
    )
    return put(plans.withColumn("depths", F.col("held") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).withColumn(
        "all_chars", F.col("b_chars") + F.col("own_chars") - F.col("d_chars")
    ), "plans")


def _prefixes(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, depth, fingerprint, the parent's, its last turn, sizes."""
    nought = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    roots = plans.select(
        "conv_id", nought.alias("depth"), nought.alias("f1"), nought.alias("f2"), none.alias("g1"), none.alias("g2"), none.alias("h1"),
        none.alias("h2"), F.lit(None).cast("int").alias("variant"), nought.alias("len"), nought.alias("chars"), "depths",
    )
    heads = plans.where("held > 0").select("conv_id", "depths", F.explode("head").alias("t")).select("conv_id", "depths", "t.*")
    heads = heads.select(
        "conv_id", F.col("pos").alias("depth"), *_named(["f1", "f2"], [F.col(f"s{i}") for i in _LANES]),
        *_named(["g1", "g2"], [_lane(i, F.col(f"s{i}") - F.col(f"c{i}")) for i in _LANES]), "h1", "h2", "variant", "len", "chars", "depths",
    )
    rest = turns.join(plans.drop("head", "n", "own_chars"), "conv_id").where("pos > h")
    here = [_lane(i, F.col(f"b{i}") + _moved(i, _lane(i, F.col(f"s{i}") - F.col(f"d{i}")), F.col("back"))) for i in _LANES]
    above = [_lane(i, F.col(f"b{i}") + _moved(i, _lane(i, F.col(f"s{i}") - F.col(f"c{i}") - F.col(f"d{i}")), F.col("back"))) for i in _LANES]
    tails = rest.select(
        "conv_id", (F.col("pos") - F.col("back")).alias("depth"), *_named(["f1", "f2"], here), *_named(["g1", "g2"], above), "h1", "h2", "variant",
        "len", (F.col("b_chars") + F.col("chars") - F.col("d_chars")).alias("chars"), "depths",
    )
    return put(roots.unionByName(heads).unionByName(tails), "prefixes")


def _named(names: list[str], lanes: list[Column]) -> list[Column]:
    return [c.alias(n) for n, c in zip(names, _packed(lanes))]


def _groups(prefixes: DataFrame, key: list[str]) -> DataFrame:
    """Per group: its smallest member, its members, whether any goes on, sizes, and whether all agree on parent and last turn."""
    last = F.struct("g1", "g2", "h1", "h2", "variant")
    return prefixes.groupBy(*key).agg(
        F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.max(F.col("depths") > F.col("depth")).alias("inner"),
        F.max("len").alias("len"), F.max("chars").alias("chars"), F.min(last).alias("last"), F.max(last).alias("other"),
        *([F.first("px").alias("px")] if "x" in key else []),
    )


def _by_path(prefixes: DataFrame, wrong: DataFrame) -> DataFrame:
    """Adds x and px, the paths of references of a prefix and its parent, from the first depth on whose group is mixed."""
    from_ = prefixes.join(wrong.select("depth", "f1", "f2"), ["depth", "f1", "f2"], "left_semi").groupBy("conv_id").agg(F.min("depth").alias("first"))
    from_ = put(from_, "mixed-from")
    steps = F.struct("depth", "h1", "h2", "variant")
    paths = put(prefixes.join(from_, "conv_id").where("depth > 0").groupBy("conv_id").agg(
        F.first("first").alias("first"), F.sort_array(F.collect_list(steps)).alias("path")
    ), "mixed-paths")
    upto = lambda d: F.when(d >= F.col("first"), F.slice("path", F.lit(1), d.cast("int")))
    depth = F.col("depth")
    return put(prefixes.join(paths, "conv_id", "left").select(
        *prefixes.columns, upto(depth).alias("x"), upto(F.greatest(depth - 1, F.lit(0))).alias("px"),
    ), "prefixes-by-path")


def _ends(prefixes: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """(conv, depth, ends_sha256) of nodes where conversations end: the ids, sorted, hashed segment by segment."""
    ends = join_keys(prefixes.where("depth = depths").select(*key, "conv_id"), nodes.select(*key, "conv"), key).select("conv", "depth", "conv_id")

    def pack(batches):
        now, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in (*now, ids[0])] + [pa.array([",".join(map(str, ids))])],
                names=["conv", "depth", "first", "ids"],
            )

        for b in batches:
            for *node, i in zip(*[b.column(c).to_pylist() for c in ("conv", "depth", "conv_id")]):
                if now != node or len(ids) >= SEGMENT:
                    if ids:
                        yield out()
                    now, ids = node, []
                ids.append(i)
        if ids:
            yield out()

    sorted_ = ends.repartitionByRange("conv", "depth", "conv_id").sortWithinPartitions("conv", "depth", "conv_id")
    segments = put(sorted_.mapInArrow(pack, "conv long, depth long, first long, ids string"), "end-segments")

    def digest(batches):
        now, sha = None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64()) for v in now] + [pa.array([sha.hexdigest()])], names=["conv", "depth", "ends_sha256"],
            )

        for b in batches:
            for *node, ids in zip(*[b.column(c).to_pylist() for c in ("conv", "depth", "ids")]):
                if now != node:
                    if now:
                        yield out()
                    now, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
        if now:
            yield out()

    # a node's digest is sequential by its definition; its ids come as few segments, and one is held at a time
    dealt = segments.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first")
    return put(dealt.mapInArrow(digest, "conv long, depth long, ends_sha256 string"), "ends")


def prefix_trie(conversations: DataFrame, hashes: Callable = turn_hashes) -> DataFrame:
    """Nodes of the trie of rebuilt conversations; see the module for what they are.

    conversations: conv_id, turn, role, text. Turns go by turn (null first), then role, then text; rows that repeat all of them
    are turns of their own. Null roles and texts are empty; rows without a conv_id take no part; other columns are not read.
    An empty table has no node. Returned per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    turns = stored_turns(conversations, hashes)
    plans = _plans(turns)
    prefixes, key = _prefixes(turns, plans), ["depth", "f1", "f2"]
    groups = put(_groups(prefixes, key), "groups")
    wrong = groups.where("last != other")
    if not wrong.isEmpty():
        prefixes, key = _by_path(prefixes, wrong), [*key, "x"]
        groups = put(_groups(prefixes, key), "groups")
    # the run of nodes that a conversation names, and whether its end is a leaf
    runs = put(groups.groupBy("conv").agg(
        F.min("depth").alias("top"), (F.max("chars") - F.min(F.col("chars") - F.col("len"))).alias("run_chars"),
        F.max_by((~F.col("inner")).cast("long"), "depth").alias("leaf"),
    ), "runs")
    members = plans.select("conv_id", "all_chars").join(runs, F.col("conv_id") == F.col("conv"), "left").select(
        "conv_id", "all_chars", F.coalesce("run_chars", F.lit(0)).alias("run_chars"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
    )
    summed = prefixes.select(*key, "conv_id").join(members, "conv_id").groupBy(*key).agg(
        F.sum("leaf").alias("n_leaves"), F.sum("all_chars").alias("all_chars"), F.sum("run_chars").alias("run_chars"),
        F.min(F.struct("conv_id", "all_chars", "run_chars")).alias("own"),
    )
    nodes = join_keys(groups, summed.select(*key, "n_leaves", "all_chars", F.col("run_chars").alias("runs_chars"), "own"), key)
    before = F.col("chars") - F.col("len")
    twice = F.col("all_chars") - F.col("n_convs") * before
    once = F.col("runs_chars") - F.col("own.run_chars") + F.col("own.all_chars") - before
    nodes = put(nodes.select(
        *key, "conv", "n_convs", "n_leaves", (twice - once).alias("saved_tokens"), "last.g1", "last.g2", *(["px"] if "x" in key else []),
    ), "nodes")
    # only the first node of a run has a parent of another name
    tops = nodes.join(runs.select("conv", F.col("top").alias("depth")), ["conv", "depth"], "left_semi").where("depth > 0")
    above = {"f1": "g1", "f2": "g2", "x": "px"}
    wanted = tops.select((F.col("depth") - 1).alias("depth"), *[F.col(above[k]).alias(k) for k in key[1:]], F.col("conv").alias("child"))
    named = join_keys(wanted, nodes.select(*key, "conv"), key).select(
        F.col("child").alias("conv"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("above"),
    )
    linked = nodes.join(named, ["conv", "depth"], "left").withColumn(
        "parent", F.when(F.col("depth") > 0, F.coalesce("above", "conv"))
    )
    linked = put(linked, "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    ends = _ends(prefixes, nodes, key)
    out = linked.join(children, ["conv", "depth"], "left").join(ends, ["conv", "depth"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


@query("op12_prefix_trie", r"""
    WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
            {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS w FROM conversations WHERE conv_id IS NOT NULL),
    s AS (SELECT DISTINCT conv_id, cast(conv_id AS varchar) AS digits FROM t),
    bytes AS (SELECT conv_id, digits, 1 AS i, 4294967295::BIGINT AS crc FROM s
        UNION ALL SELECT conv_id, digits, i + 1, list_reduce([xor(crc, ascii(digits[i])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END) FROM bytes WHERE i <= length(digits)),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295::BIGINT) % 6 AS h FROM bytes WHERE i = length(digits) + 1),
    own AS (SELECT conv_id, list(w ORDER BY pos) AS ws FROM t GROUP BY 1),
    r AS (SELECT c.conv_id, list_concat(coalesce(b.ws[1 : h], []), o.ws[h + 1 : len(o.ws)]) AS ws
        FROM c JOIN own o ON o.conv_id = c.conv_id LEFT JOIN own b ON b.conv_id = c.base),
    p AS (SELECT conv_id, ws, d FROM r, (SELECT unnest(range(0, 1 + (SELECT max(len(ws)) FROM r))) AS d) WHERE d <= len(ws)),
    k AS (SELECT ws[1 : d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(CASE WHEN len(ws) = d THEN cast(conv_id AS varchar) END, ',' ORDER BY conv_id), '') AS ends
        FROM p GROUP BY 1, 2),
    ch AS (SELECT path[1 : depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM k WHERE depth > 0 GROUP BY 1, 2),
    n AS (SELECT k.*, coalesce(ch.n, 0) AS n_children, CASE WHEN k.depth > 0 THEN (k.n_convs - 1) * length(path[k.depth].text) ELSE 0 END AS saved
        FROM k LEFT JOIN ch USING (path, depth)),
    up AS (SELECT path[1 : j] AS path, cast(sum(saved) AS bigint) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
        FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM n) GROUP BY 1)
    SELECT n.conv_id, cast(n.depth AS bigint) AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, up.leaves AS n_leaves,
        up.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
    FROM n JOIN up USING (path) LEFT JOIN n q ON n.depth > 0 AND q.path = n.path[1 : n.depth - 1]""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
