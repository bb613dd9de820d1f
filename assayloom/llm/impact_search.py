"""Exact top-k by inner product with an impact-ordered index, score at a time.

Vectors of whole numbers are dealt to blocks. In a block, the postings (row, dimension, value) are cut into segments by
impact, the number of bits of the value. A search takes the segments by falling impact and adds up scores. After each
segment the values still to come bound what any score can change; rows that cannot reach the k-th best any more are out.
It stops only when this proof leaves few rows, and these are scored exactly from their whole vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import put

#: Vectors of a block, queries that meet a block at once, and queries scored together.
BLOCK_ROWS, QUERY_ROWS, TOGETHER = 2048, 2048, 128
#: The proof is enough when so many times k rows are left for every query.
ENOUGH = 3


def whole_numbers(vector: Column) -> Column:
    """floor(1024 x) of each component; null for vectors that are null or hold null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(x * 1024)))


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Written index rows (block, impact, ids, postings) of vectors (vec_id, vector of longs).

    impact -1 holds a block's ids and whole vectors. Rows that share a vec_id count once, with the smallest vector. Shorter
    vectors are filled up with zeros.
    """
    once = vectors.where("vec_id IS NOT NULL AND vector IS NOT NULL").groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("vector").alias("vector"))
    once = put(once, "vectors")
    blocks = max(1, -(-once.count() // block_rows))

    def cut(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        width = max((len(v) for v in rows["vector"]), default=0)
        values = np.zeros((len(rows), width), np.int64)
        for i, v in enumerate(rows["vector"]):
            values[i, : len(v)] = v
        impact = np.frexp(np.abs(values).astype(np.float64))[1]
        ids = rows["vec_id"].to_numpy(np.int64).tobytes()
        out = [(key[0], -1, ids, values.tobytes(), width)]
        for level in np.unique(impact[values != 0]):
            doc, dim = np.nonzero((impact == level) & (values != 0))
            held = doc.astype(np.int32).tobytes() + dim.astype(np.int32).tobytes() + values[doc, dim].tobytes()
            out.append((key[0], int(level), b"", held, width))
        return pd.DataFrame(out, columns=["block", "impact", "ids", "held", "width"])

    dealt = once.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return put(dealt.groupBy("block").applyInPandas(cut, "block int, impact int, ids binary, held binary, width int"), "impact-index")


def _postings(held: bytes):
    n = len(held) // 16
    return np.frombuffer(held, np.int32, n), np.frombuffer(held, np.int32, n, 4 * n), np.frombuffer(held, np.int64, n, 8 * n)


def _fit(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def search_block(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block for each query, the query's own row excepted."""
    head = index[index["impact"] < 0].iloc[0]
    ids, width = np.frombuffer(head["ids"], np.int64), int(head["width"])
    whole = np.frombuffer(head["held"], np.int64).reshape(len(ids), width)
    segments = [_postings(r["held"]) for _, r in index[index["impact"] >= 0].sort_values("impact", ascending=False).iterrows()]
    out = []
    for at in range(0, len(queries), TOGETHER):
        own = queries["query_id"].to_numpy(np.int64)[at: at + TOGETHER]
        asked = _fit(queries["query"].tolist()[at: at + TOGETHER], width)
        for q, rows in enumerate(_possible(ids, whole, segments, own, asked, k)):
            # whole numbers of any size: plain integers where 64 bits might not do
            big = float(np.abs(whole[rows]).max(initial=0)) * float(np.abs(asked[q]).sum()) >= 2**62
            kind = object if big else np.int64
            scores = whole[rows].astype(kind) @ asked[q].astype(kind)
            best = sorted(zip((-scores).tolist(), ids[rows].tolist()))[:k]
            out += [(own[q], i, -s) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def _possible(ids, whole, segments, own, asked, k) -> list[np.ndarray]:
    """For each query the rows that can be among its k best, found segment by segment."""
    n, width = whole.shape
    weights = np.abs(asked).astype(np.float64)
    scores = np.zeros((len(own), n))
    barred = own[:, None] == ids[None, :]
    most = np.zeros((len(segments) + 1, width))  # the largest values still to come, by dimension
    for i in range(len(segments) - 1, -1, -1):
        most[i] = most[i + 1]
        np.maximum.at(most[i], segments[i][1], np.abs(segments[i][2]))
    free = n - barred.sum(axis=1)
    left = ~barred
    for i, (doc, dim, value) in enumerate(segments):
        dense = np.zeros((n, width))
        dense[doc, dim] = value
        scores += asked.astype(np.float64) @ dense.T
        if n <= k + 1:
            break
        # what is still to come, and room for rounding where sums leave 53 bits
        slack = weights @ most[i + 1]
        slack = slack + 1e-12 * (weights @ most[0]) * (weights @ most[0] > 2**50)
        open_ = np.where(barred, -np.inf, scores)
        kth = np.partition(open_, n - k, axis=1)[:, n - k]
        left = (open_ + slack[:, None] >= (kth - slack)[:, None]) & ~barred
        if (left.sum(axis=1) <= np.minimum(free, ENOUGH * k)).all():
            break
    return [np.flatnonzero(row) for row in left]


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query (query_id, query) in the index.

    Ties go to the smaller vec_id; a query's own vec_id is no answer; all rows are returned where there are fewer than k.
    """
    asked = put(queries.where("query_id IS NOT NULL AND query IS NOT NULL").groupBy("query_id").agg(F.min("query").alias("query")), "queries")
    chunks = max(1, -(-asked.count() // query_rows))
    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    blocks = index.select(F.col("block").alias("c_block")).distinct()
    # a block meets the queries chunk by chunk: cells (block, chunk)
    segments = index.withColumn("chunk", F.explode(every))
    met = asked.withColumn("c_chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    cells = met.join(blocks.withColumn("c_chunk", F.explode(every)), "c_chunk")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return search_block(left, right, k)

    found = segments.groupBy("block", "chunk").cogroup(cells.groupBy("c_block", "c_chunk")).applyInPandas(
        meet, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op6_impact_topk", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS bigint) AS score
        FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, cast(n AS integer) AS rank, vec_id, score FROM r WHERE n <= 10""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", whole_numbers(F.col("embedding")).alias("vector"))
    rows = put(rows, "whole-vectors")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return search(build_index(rows), queries)
