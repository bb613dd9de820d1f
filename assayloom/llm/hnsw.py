"""Approximate nearest neighbours by cosine: one navigable small-world graph per shard, shard results merged.

Equal vectors are folded to one with its smallest ids, and the folded vectors are dealt to shards by hash. A shard's graph has
layers: its vectors are put in an order, the first few of which stand in the higher layers, so a layer is a prefix of the order
and a flat array of neighbour numbers, -1 where there is none. Vectors enter in batches. A batch walks down from the top
layer, looks for its nearest entered vectors with a beam, adds the nearest of its own batch, and keeps links that lead in
different directions; a vector with too many links back chooses again among them.

A search walks down the same way, all queries of a group at once, then scores the beam's vectors in double precision. Every
shard answers every query, and only its k best leave the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import put


@dataclass(frozen=True)
class Graph:
    """links: neighbours of a vector above the ground layer (twice as many on it); build, search: beam widths; together: nodes
    that a beam opens at once; batch: vectors that enter at once."""

    links: int = 16
    build: int = 96
    search: int = 160
    together: int = 4
    batch: int = 256


#: Vectors of a shard, queries that meet a shard at once, and queries that walk together.
SHARD_ROWS, QUERY_ROWS, WALK = 16_384, 2_048, 256
_NONE = np.float32(-np.inf)


def usable(vector: Column) -> Column:
    """The vector in doubles; null if it is null, zero, empty, or holds null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & F.exists(doubles, lambda x: x != 0), doubles)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors over powers of two, so that squares neither overflow nor vanish; directions keep every bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))[1])


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)


def _beam(x: np.ndarray, links: np.ndarray, asked: np.ndarray, entry: np.ndarray, width: int, together: int):
    """For each asked vector the `width` nearest nodes found from its entry, nearest first: (nodes, similarities); -1 is none."""
    rows = np.arange(len(asked))
    seen = np.zeros((len(asked), len(x)), bool)
    nodes = np.full((len(asked), width), -1, np.int32)
    near = np.full((len(asked), width), _NONE)
    fresh = np.zeros((len(asked), width), bool)
    nodes[:, 0], fresh[:, 0], seen[rows, entry] = entry, True, True
    near[:, 0] = np.einsum("ad,ad->a", asked, x[entry])
    together = min(together, width)
    while len(rows):
        held = np.where(fresh[rows], near[rows], _NONE)
        pick = np.argpartition(-held, together - 1, axis=1)[:, :together]
        opened = np.take_along_axis(held, pick, 1) > _NONE
        at = np.where(opened, np.take_along_axis(nodes[rows], pick, 1), -1)
        fresh[rows[:, None], pick] = False
        found = np.where(opened[:, :, None], links[at], -1).reshape(len(rows), -1)
        found[seen[rows[:, None], found]] = -1
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        keep = (found >= 0).any(axis=0)
        found = found[:, keep]
        if found.shape[1]:
            real = found >= 0
            i, j = np.nonzero(real)
            seen[rows[i], found[i, j]] = True
            similar = np.where(real, np.einsum("ad,acd->ac", asked[rows], x[found]), _NONE)
            near_all = np.concatenate([near[rows], similar], axis=1)
            best = np.argpartition(-near_all, width - 1, axis=1)[:, :width]
            near[rows] = np.take_along_axis(near_all, best, 1)
            nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], found], axis=1), best, 1)
            fresh[rows] = np.take_along_axis(np.concatenate([fresh[rows], real], axis=1), best, 1)
        rows = rows[fresh[rows].any(axis=1)]
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)


def _spread_out(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Of each row's nodes (nearest first, -1 none) up to `most` that are nearer to the row than to any chosen before.

    With fill, free places go to the nearest of the others.
    """
    n, width = nodes.shape
    vectors, closest = x[nodes], np.full((n, width), _NONE)
    chosen, taken = np.zeros((n, width), bool), np.zeros(n, np.int64)
    for j in range(width):
        take = (nodes[:, j] >= 0) & (closest[:, j] < near[:, j]) & (taken < most)
        chosen[:, j], taken = take, taken + take
        rows = np.flatnonzero(take)
        if len(rows) and j + 1 < width:
            similar = np.einsum("rcd,rd->rc", vectors[rows, j + 1:], vectors[rows, j])
            closest[rows, j + 1:] = np.maximum(closest[rows, j + 1:], similar)
    rank = np.where(nodes < 0, 2 * width, np.where(chosen, 0, width if fill else 2 * width)) + np.arange(width)
    first = np.argsort(rank, axis=1)[:, :most]
    out = np.where(np.take_along_axis(rank, first, 1) < 2 * width, np.take_along_axis(nodes, first, 1), -1)
    return out if out.shape[1] == most else np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _link_back(x: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Adds the links from chosen nodes back to the new ones; a node without room chooses again."""
    width = links.shape[1]
    i, j = np.nonzero(chosen >= 0)
    to, back = chosen[i, j], new[i]
    # a node that chose the new one itself has this link already
    other = ~(links[to] == back[:, None]).any(axis=1)
    to, back = to[other], back[other]
    near = np.einsum("ad,ad->a", x[to], x[back])
    by = np.lexsort((-near, to))
    to, back = to[by], back[by]
    heads = np.flatnonzero(np.diff(to, prepend=-1))
    place = np.arange(len(to)) - np.repeat(heads, np.diff(np.append(heads, len(to))))
    degree = (links >= 0).sum(axis=1)
    full = np.zeros(len(links), bool)
    full[to[degree[to] + place >= width]] = True
    free = ~full[to]
    links[to[free], degree[to[free]] + place[free]] = back[free]
    rows = np.flatnonzero(full)
    if not len(rows):
        return
    number = np.full(len(links), -1)
    number[rows] = np.arange(len(rows))
    over = full[to] & (place < width)
    wide = np.full((len(rows), 2 * width), -1, np.int32)
    wide[:, :width] = links[rows]
    wide[number[to[over]], width + place[over]] = back[over]
    near = np.where(wide >= 0, np.einsum("rd,rcd->rc", x[rows], x[wide]), _NONE)
    order = np.argsort(-near, axis=1, kind="stable")
    links[rows] = _spread_out(x, np.take_along_axis(wide, order, 1), np.take_along_axis(near, order, 1), width, False)


def _entries(x: np.ndarray, layers: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """The nearest node found in the layers, top first."""
    entry = np.zeros(len(asked), np.int64)
    for links in layers:
        entry = _beam(x[: len(links)], links, asked, entry, 4, 1)[0][:, 0].astype(np.int64)
    return entry


def _layer(x: np.ndarray, above: list[np.ndarray], most: int, shape: Graph) -> np.ndarray:
    """Links of a layer that holds all of x, entered in order."""
    n = len(x)
    links = np.full((n, most), -1, np.int32)
    at = 0
    while at < n:
        size = min(shape.batch, max(1, at), n - at)
        new = np.arange(at, at + size)
        own = x[new] @ x[new].T
        np.fill_diagonal(own, _NONE)
        few = min(shape.links, size - 1)
        beside = np.argsort(-own, axis=1)[:, :few]
        nodes, near = beside + at, np.take_along_axis(own, beside, 1)
        if at:
            entry = _entries(x, above, x[new])
            entry[entry >= at] = 0
            found, similar = _beam(x[:at], links[:at], x[new], entry, min(shape.build, at), shape.together)
            nodes, near = np.concatenate([found, nodes], axis=1), np.concatenate([similar, near], axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        nodes, near = np.take_along_axis(nodes, order, 1).astype(np.int32), np.take_along_axis(near, order, 1)
        if nodes.shape[1]:
            chosen = _spread_out(x, nodes, near, min(shape.links, most), True)
            links[new, : chosen.shape[1]] = chosen
            _link_back(x, links, new, chosen)
        at += size
    return links


def build_graph(vectors: np.ndarray, shape: Graph) -> list[np.ndarray]:
    """Layers of links, top first; each layer holds a prefix of the vectors."""
    x, sizes = _units(vectors), [len(vectors)]
    while sizes[-1] > 2 * shape.links:
        sizes.append(-(-sizes[-1] // shape.links))
    layers: list[np.ndarray] = []
    for n in reversed(sizes):
        layers.append(_layer(x[:n], layers, shape.links * (2 if n == sizes[0] else 1), shape))
    return layers


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A list column as a matrix: shorter vectors filled up with zeros, longer ones cut."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
    sizes = np.diff(ends, prepend=0)
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def build_index(vectors: DataFrame, most: int = 10, shape: Graph = Graph(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Written index of vectors (vec_id, vector): a row per shard with its ids, vectors and layers as flat arrays.

    For searches of up to `most` neighbours. Unusable vectors (see `usable`) and rows without a vec_id take no part; rows that
    share a vec_id count once, with the smallest vector; shorter vectors are filled up with zeros; other columns are not read.
    Of equal vectors the `most` + 1 smallest ids are kept, since no answer can hold another one.
    """
    once = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("vector")).alias("vector")).where(
        "vec_id IS NOT NULL AND vector IS NOT NULL"
    ).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = once.withColumn("n", first).where(F.col("n") <= most + 1)
    folded = put(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "folded-vectors")
    shards = max(1, -(-folded.count() // shard_rows))
    hashed = F.xxhash64("vector", F.element_at("ids", 1))
    dealt = folded.select("ids", "vector", hashed.alias("order"), F.pmod(hashed, F.lit(shards)).cast("int").alias("shard"))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("order")
        held = _matrix(rows.column("vector"))
        layers = build_graph(held, shape)
        ids = rows.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table({
            "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), "width": pa.array([held.shape[1]], pa.int32()),
            "ids": pa.array([ids.flatten().to_numpy().astype("<i8").tobytes()], pa.binary()),
            "held": pa.array([ids.value_lengths().to_numpy().astype("<i4").tobytes()], pa.binary()),
            "vectors": pa.array([held.astype("<f8").tobytes()], pa.binary()),
            "sizes": pa.array([[len(layer) for layer in layers]], pa.list_(pa.int32())),
            "links": pa.array([[layer.astype("<i4").tobytes() for layer in layers]], pa.list_(pa.binary())),
        })

    kinds = "shard int, width int, ids binary, held binary, vectors binary, sizes array<int>, links array<binary>"
    return put(dealt.groupBy("shard").applyInArrow(build, kinds), "graph-index")


def search_shard(row: dict, query_ids: np.ndarray, asked: np.ndarray, norms: np.ndarray, k: int, shape: Graph) -> tuple:
    """The k best of one shard for each query: (query ids, vec_ids, scores). asked: scaled vectors, norms: their lengths."""
    held = np.frombuffer(row["held"], "<i4")
    n, width = len(held), row["width"]
    vectors = scaled(np.frombuffer(row["vectors"], "<f8").reshape(n, width))
    lengths = np.sqrt((vectors * vectors).sum(axis=1))
    x = (vectors / lengths[:, None]).astype(np.float32)
    layers = [np.frombuffer(b, "<i4").reshape(m, -1) for m, b in zip(row["sizes"], row["links"])]
    ends = np.cumsum(held)
    ids = np.full((n, int(held.max(initial=1))), np.iinfo(np.int64).max)
    there = np.arange(ids.shape[1]) < held[:, None]
    ids[there] = np.frombuffer(row["ids"], "<i8", int(ends[-1]))
    out = []
    for at in range(0, len(asked), WALK):
        own, a, norm = query_ids[at: at + WALK], asked[at: at + WALK], norms[at: at + WALK]
        q = (a / norm[:, None]).astype(np.float32)
        nodes, _ = _beam(x, layers[-1], q, _entries(x, layers[:-1], q), max(1, min(max(shape.search, k + 1), n)), shape.together)
        real = nodes >= 0
        dots = (vectors[nodes] * a[:, None, :]).sum(axis=2)
        scores = np.where(real, dots / (lengths[nodes] * norm[:, None]), -np.inf)
        found = ids[nodes]
        ok = there[nodes] & real[:, :, None] & (found != own[:, None, None])
        i, j, c = np.nonzero(ok)
        s, v = scores[i, j], found[i, j, c]
        by = np.lexsort((v, -s, i))
        i, s, v = i[by], s[by], v[by]
        heads = np.searchsorted(i, np.arange(len(own)))
        best = np.arange(len(i)) - heads[i] < k
        out.append((own[i[best]], v[best], s[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(
    index: DataFrame, queries: DataFrame, k: int = 5, shape: Graph = Graph(), query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found by cosine for each query (query_id, query).

    Ties go to the smaller vec_id; a query's own vec_id is no answer; all rows are returned where there are fewer than k.
    Unusable queries have no answers; rows that share a query_id count once, with the smallest vector.
    """
    asked = put(queries.select(F.col("query_id").cast("long").alias("query_id"), usable(F.col("query")).alias("query")).where(
        "query_id IS NOT NULL AND query IS NOT NULL"
    ).groupBy("query_id").agg(F.min("query").alias("query")), "queries")
    chunks = max(1, -(-asked.count() // query_rows))
    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    shards = index.select(F.col("shard").alias("c_shard")).distinct()
    met = asked.withColumn("c_chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    cells = met.join(shards.withColumn("c_chunk", F.explode(every)), "c_chunk")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            whole = scaled(_matrix(right.column("query")))
            norms = np.sqrt((whole * whole).sum(axis=1))
            fitted = np.zeros((len(whole), row["width"]))
            both = min(whole.shape[1], row["width"])
            fitted[:, :both] = whole[:, :both]
            columns = search_shard(row, right.column("query_id").to_numpy(), fitted, norms, k, shape)
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    found = index.withColumn("chunk", F.explode(every)).groupBy("shard", "chunk").cogroup(
        cells.groupBy("c_shard", "c_chunk")
    ).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op11_hnsw")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return search(build_index(rows, 5), queries, 5)
