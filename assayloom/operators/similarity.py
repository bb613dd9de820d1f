"""Highest Tanimoto similarity of every row to a reference set, exact, without materialising pairs.

Rows meet in cells: a slice of the queries against a block of the references. A cell does one
matrix product and emits one number per query, so n x m pairs leave as n x (reference blocks)
rows. Copies are folded before, both sides are hash-sliced, so a vector shared by a third of the
rows is compared once. Cells whose popcounts cannot beat a similarity already found are skipped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayloom.functions.bits import popcount
from assayloom.runtime import cut_lineage

BLOCK_ROWS = 4_096
SLICE_ROWS = 32_768
LEAST_SLICE_ROWS = 1_024
CLASS_BASE = 1.25
_TILE = 1_024


def _bits(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    words = table.column(column).combine_chunks().values.to_numpy(zero_copy_only=False)
    bytes_ = words.reshape(table.num_rows, -1).astype("<i8").view(np.uint8)
    bits = np.unpackbits(bytes_, axis=1, bitorder="little").astype(np.float32)
    return bits, bits.sum(axis=1)


def _compare(skip_same: bool):
    """Per-cell helper: tiled matrix products and a running maximum."""

    def compare(queries: pa.Table, refs: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or refs.num_rows == 0:
            return pa.table({"fp": pa.array([], pa.list_(pa.int64())), "sim": pa.array([], pa.float64())})
        ref_bits, ref_n = _bits(refs, "ref_fp")
        best = np.zeros(queries.num_rows)
        for start in range(0, queries.num_rows, _TILE):
            part, n = _bits(queries.slice(start, _TILE), "fp")
            shared = part @ ref_bits.T
            sim = shared.astype(np.float64) / (n[:, None] + ref_n[None, :] - shared)
            if skip_same:
                sim[(shared == n[:, None]) & (shared == ref_n[None, :])] = 0.0
            best[start:start + len(part)] = sim.max(axis=1)
        return pa.table({"fp": queries.column("fp").combine_chunks(), "sim": pa.array(best)})

    return compare


def _classes(distinct: DataFrame, salt: str, rows: int, merge: bool, side: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with their popcount class and hash piece, and a table (cls, pieces) that says into how many a class is cut.

    There are at most log(bits) / log(base) classes, a few dozen rows. With merge all vectors form one class, for when there
    is nothing to skip.
    """
    cls, pieces = f"{side}_cls", f"{side}_pieces"
    n_bits = popcount(F.col("fp"))
    of = (F.pmod(n_bits, F.lit(1)) if merge else F.floor(F.log(n_bits) / math.log(CLASS_BASE))).cast("int")
    marked = distinct.withColumn(cls, of)
    sizes = cut_lineage(marked.groupBy(cls).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(pieces)))
    piece = F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(pieces)).cast("int")
    return marked.join(F.broadcast(sizes), cls).withColumn(f"{side}_piece", piece).drop(pieces), sizes


def _cells(q_sizes: DataFrame, r_sizes: DataFrame) -> DataFrame:
    """One row per pair of classes: q_cls, q_pieces, r_cls, r_pieces, most, near (the class nearest to the queries').

    No similarity of the two classes can exceed `most`: fewest bits over most bits. A few dozen classes a side make the table.
    """
    refs = [(r["r_cls"], r["r_pieces"]) for r in r_sizes.collect()]
    rows = []
    for q in q_sizes.collect():
        nearest = min(refs, key=lambda r: (abs(r[0] - q["q_cls"]), r[0]))[0]
        for cls, pieces in refs:
            apart = abs(cls - q["q_cls"])
            most = 1.0 if not apart else min(1.0, CLASS_BASE ** (1 - apart) + 1e-9)
            rows.append((q["q_cls"], q["q_pieces"], cls, pieces, most, cls == nearest))
    kinds = "q_cls int, q_pieces int, r_cls int, r_pieces int, most double, near boolean"
    return cut_lineage(q_sizes.sparkSession.createDataFrame(rows, kinds))


_CELL = ["q_cls", "q_piece", "r_cls", "r_piece"]


def _run_cells(queries: DataFrame, refs: DataFrame, cells: DataFrame, skip_same: bool) -> DataFrame:
    """queries (fp, q_cls, q_piece, r_cls, r_piece) meet the references of their cells; (fp, sim) per query and cell."""
    # One copy of a reference block per query slice that can meet it.
    met = refs.join(F.broadcast(cells.select("q_cls", "q_pieces", "r_cls")), "r_cls")
    spread = met.select(
        F.col("fp").alias("ref_fp"), "q_cls", "r_cls", "r_piece", F.explode(F.sequence(F.lit(0), F.col("q_pieces") - 1)).alias("q_piece"),
    )
    compare = _compare(skip_same)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return compare(left, right)

    return queries.select("fp", *_CELL).groupBy(*_CELL).cogroup(spread.groupBy(*_CELL)).applyInArrow(cell, "fp array<bigint>, sim double")


def _best_by_vector(queries: DataFrame, refs: DataFrame, block_rows: int, slice_rows: int | None, skip_same: bool) -> DataFrame:
    """queries and refs are distinct non-zero vectors; returns (fp, sim).

    Both sets, and the first pass, are read several times: they are checkpointed instead of being
    shuffled or multiplied again. Which slices meet which blocks is a table, so plans do not grow with the rows.
    """
    same = refs is queries
    queries = cut_lineage(queries)
    refs = queries if same else cut_lineage(refs)
    n_queries, n_refs = queries.count(), refs.count()
    if not n_queries or not n_refs:
        return queries.select("fp", F.lit(0.0).alias("sim"))
    if slice_rows is None:
        # Small query sets are cut finer, so that all cores have a cell.
        cores = queries.sparkSession.sparkContext.defaultParallelism
        slice_rows = min(SLICE_ROWS, max(LEAST_SLICE_ROWS, n_queries // (2 * cores)))
    one_block = n_refs <= block_rows
    refs, blocks = _classes(refs, "r", block_rows, one_block, "r")
    queries, slices = _classes(queries, "q", slice_rows, one_block, "q")
    cells = _cells(slices, blocks)
    # First pass: one block of the nearest class gives every query a lower bound.
    near = cells.where("near")
    seeded = queries.join(F.broadcast(near.select("q_cls", "r_cls")), "q_cls").withColumn("r_piece", F.lit(0))
    seeds = _run_cells(seeded, refs.where("r_piece = 0"), near, skip_same)
    if one_block:
        return seeds
    seeds = cut_lineage(seeds)
    # Second pass: only the blocks whose bound is above it.
    rest = queries.join(seeds, "fp").join(F.broadcast(cells), "q_cls").where(F.col("most") > F.col("sim")).withColumn(
        "r_piece", F.explode(F.sequence(F.lit(0), F.col("r_pieces") - 1))
    ).where("NOT (near AND r_piece = 0)")
    return seeds.unionByName(_run_cells(rest, refs, cells, skip_same)).groupBy("fp").agg(F.max("sim").alias("sim"))


def max_similarity(
    queries: DataFrame, refs: DataFrame, block_rows: int = BLOCK_ROWS, slice_rows: int | None = None
) -> DataFrame:
    """(id, max_sim): the highest similarity of each query row to any reference row."""
    has_bits = popcount(F.col("fp")) > 0
    q = queries.select("fp").where(has_bits).distinct()
    r = refs.select("fp").where(has_bits).distinct()
    best = _best_by_vector(q, r, block_rows, slice_rows, skip_same=False)
    return queries.join(best, "fp", "left").select("id", F.coalesce("sim", F.lit(0.0)).alias("max_sim"))


def max_similarity_self(fps: DataFrame, block_rows: int = BLOCK_ROWS, slice_rows: int | None = None) -> DataFrame:
    """(id, max_sim) to any other row. A copy counts, so a vector held twice scores 1."""
    copies = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("copies"))
    distinct = copies.where(popcount(F.col("fp")) > 0)
    vectors = distinct.select("fp")
    best = _best_by_vector(vectors, vectors, block_rows, slice_rows, skip_same=True)
    folded = distinct.join(best, "fp", "left").select(
        "fp", F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.coalesce("sim", F.lit(0.0))).alias("sim")
    )
    return fps.join(folded, "fp", "left").select("id", F.coalesce("sim", F.lit(0.0)).alias("max_sim"))
