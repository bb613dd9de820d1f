"""Fixed-width bit vectors held as arrays of 64-bit words: bit p is bit p % 64 of word p // 64."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

WORD = 64


def popcount(fp: Column) -> Column:
    return F.aggregate(fp, F.lit(0), lambda acc, w: acc + F.bit_count(w))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over all set bits; 0 when neither vector has a bit."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, n: s + n)
    return F.when(either > 0, shared.cast("double") / either).otherwise(F.lit(0.0))


def is_nonzero(fp: Column) -> Column:
    return F.exists(fp, lambda w: w != 0)


def sign_word(values: Column, n: int = WORD) -> Column:
    """The signs of up to 64 numbers as one word: bit i is set where values[i] > 0."""
    one = F.lit(1).cast("long")
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(n - 1)),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(
            F.when(F.get(values, i) > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))
        ),
    )


def _packer(nbits: int):
    words = nbits // WORD

    def pack_batches(batches):
        for batch in batches:
            positions = batch.column(1)
            counts = pc.list_value_length(positions).fill_null(0).to_numpy(zero_copy_only=False)
            flat = positions.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(np.arange(batch.num_rows), counts)
            out = np.zeros((batch.num_rows, words), dtype=np.uint64)
            np.bitwise_or.at(out, (rows, flat >> 6), np.left_shift(np.uint64(1), (flat & 63).astype(np.uint64)))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * words
            packed = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(out.view(np.int64).ravel()), mask=positions.is_null()
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["id", "fp"])

    return pack_batches


def pack_positions(rows: DataFrame, nbits: int) -> DataFrame:
    """(id, positions) to (id, fp); a NULL list stays NULL.

    Catalyst has no keyed update of an array, so packing there costs words x positions per row;
    one numpy scatter per Arrow batch costs the number of positions.
    """
    typed = rows.select(F.col("id").cast("long"), F.col("positions").cast("array<int>"))
    return typed.mapInArrow(_packer(nbits), "id long, fp array<bigint>")


def _set_bits(fp: pa.ListArray, nbits: int) -> tuple[pa.Array, np.ndarray]:
    """List offsets and the ascending set-bit positions of a column of packed vectors."""
    held = np.flatnonzero(fp.is_valid().to_numpy(zero_copy_only=False))
    words = fp.flatten().to_numpy(zero_copy_only=False).reshape(len(held), nbits // WORD)
    row, bit = np.nonzero(np.unpackbits(words.astype("<i8").view(np.uint8), axis=1, bitorder="little"))
    counts = np.zeros(len(fp), dtype=np.int64)
    counts[held] = np.bincount(row, minlength=len(held))
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), bit.astype(np.int32)


def _replace_fp(rows: DataFrame, name: str, dtype: T.DataType, build) -> DataFrame:
    """rows with column fp replaced by build(fp) under another name, one call per Arrow batch.

    Every column is carried through, so select the ones you need before.
    """
    at = rows.columns.index("fp")

    def each(batches):
        for batch in batches:
            columns = [build(batch.column(i)) if i == at else batch.column(i) for i in range(batch.num_columns)]
            names = [name if i == at else n for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [T.StructField(name, dtype) if f.name == "fp" else f for f in rows.schema.fields]
    return rows.mapInArrow(each, T.StructType(fields))


def unpack_positions(rows: DataFrame, nbits: int) -> DataFrame:
    """Replaces fp by `positions`, the ascending positions of its set bits.

    A filter over all positions in Catalyst costs nbits lambda calls per row; this is one numpy
    call per Arrow batch.
    """
    def build(fp):
        offsets, bits = _set_bits(fp, nbits)
        return pa.ListArray.from_arrays(offsets, pa.array(bits), mask=fp.is_null())

    return _replace_fp(rows, "positions", T.ArrayType(T.IntegerType()), build)


def sparse_features(rows: DataFrame, nbits: int) -> DataFrame:
    """Replaces fp by `features`, a sparse ml vector with a one for each set bit."""
    def build(fp):
        offsets, bits = _set_bits(fp, nbits)
        n = len(fp)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, nbits, np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(bits)),
                pa.ListArray.from_arrays(offsets, pa.array(np.ones(len(bits)))),
            ],
            names=["type", "size", "indices", "values"],
        )

    return _replace_fp(rows, "features", VectorUDT(), build)
