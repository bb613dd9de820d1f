"""Per-row features as table jobs: fingerprints, pattern flags and group keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayloom.functions.bits import pack_positions
from assayloom.runtime import spread

NBITS = 4096
GRAM = 4


#: Characters and texts whose grams are taken together.
_CHARS, _TEXTS = 1 << 20, 512


def _gram_ids(points: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct gram, for every place the number of its gram), exact for all code points."""
    n, width, held = len(points) - q + 1, np.uint64(int(points.max()).bit_length()), 0
    keys = np.zeros(n, np.uint64)
    for i in range(q):
        if held + int(width) > 64:
            keys, held = np.unique(keys, return_inverse=True)[1].astype(np.uint64), 32
        keys, held = keys << width | points[i: n + i], held + int(width)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])
    ids = np.empty(n, np.int64)
    ids[order] = np.cumsum(new) - 1
    return order[new], ids


def _positions(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many positions each text has, all positions, ascending per text)."""
    whole, sizes = "".join(texts), np.array([len(t) for t in texts])
    if len(whole) < q:
        return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
    first, ids = _gram_ids(np.frombuffer(whole.encode("utf-32-le"), "<u4").astype(np.uint64), q)
    digests = (md5(whole[a: a + q].encode(), usedforsecurity=False).digest() for a in first.tolist())
    bit = np.fromiter((d[0] << 4 | d[1] >> 4 for d in digests), np.int32, len(first))
    row, end = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    inside = np.flatnonzero(np.arange(len(ids)) + q <= end[: len(ids)])
    seen = np.zeros((len(texts), NBITS), bool)
    seen[row[inside], bit[ids[inside]]] = True
    return seen.sum(axis=1), np.nonzero(seen)[1].astype(np.int32)


def _gram_batch(texts: pa.Array, q: int) -> pa.Array:
    """Positions of a batch, a few texts at a time: digests are taken once per distinct gram of them."""
    held = [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]
    strings = [t.decode("utf-8", "replace") for t in held]
    counts, found, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    ends = np.cumsum([len(t) for t in strings])
    while at < len(strings):
        fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHARS, "right"))
        to = max(at + 1, min(fits, at + _TEXTS))
        n, positions = _positions(strings[at:to], q)
        counts.append(n)
        found.append(positions)
        at = to
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)), mask=texts.is_null())


def gram_positions(text: Column, q: int = GRAM) -> Column:
    """Distinct bit positions, in 0..4095, of the hashed q-grams of a whole text; NULL of NULL.

    A column expression takes a digest and a few calls for every character; over an Arrow batch, grams are numbered by sorting
    and each distinct one is digested once.
    """
    def positions(texts: pa.Array) -> pa.Array:
        return _gram_batch(texts, q)

    return F.arrow_udf(positions, "array<int>")(text)


def fingerprints(rows: DataFrame, text: str = "text", featuriser: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, fp, outcome). The featuriser maps a text column to an array of words; NULL means it failed.

    Default: hashed 4-grams. A chemistry library's featuriser is passed in as a pandas UDF, marked
    asNondeterministic() so that it runs once per row.
    """
    source = F.col(text)
    if featuriser:
        fps = spread(rows.select("id", text)).select("id", featuriser(source).alias("fp"), source.isNull().alias("_null"))
        outcome = F.when(F.col("_null"), "null_input").when(F.col("fp").isNull(), "failed").otherwise("success")
    else:
        fps = pack_positions(spread(rows.select("id", text)).select("id", gram_positions(source).alias("positions")), NBITS)
        outcome = F.when(F.col("fp").isNull(), "null_input").otherwise("success")
    return fps.select("id", "fp", outcome.alias("outcome"))


# A projection with more expressions than this leaves compiled code.
PATTERNS_PER_PROJECTION = 200


def pattern_flags(
    rows: DataFrame, catalogue: Sequence[tuple[str, str]], text: str = "text", parsable: Column | None = None
) -> DataFrame:
    """Adds alerts (array), alert_names ("; "-joined) and flagged.

    Patterns are literals, so each is compiled once per task and rows are never multiplied by the
    catalogue; a large one becomes several projections. Rows that do not parse stay unflagged under the name PARSE_FAIL.
    """
    ok = parsable if parsable is not None else F.col(text).isNotNull()
    hits = [F.when(F.col(text).rlike(regex), F.lit(name)) for name, regex in catalogue]
    out = spread(rows).withColumn("alerts", F.array().cast("array<string>"))
    for at in range(0, len(hits), PATTERNS_PER_PROJECTION):
        some = F.array_compact(F.array(*hits[at: at + PATTERNS_PER_PROJECTION]))
        out = out.withColumn("alerts", F.when(ok, F.concat("alerts", some) if at else some).otherwise(F.col("alerts")))
    names = F.when(ok, F.array_join("alerts", "; ")).otherwise(F.lit("PARSE_FAIL"))
    return out.withColumn("alert_names", names).withColumn("flagged", F.size("alerts") > 0)


def read_catalogue(catalogue: DataFrame) -> list[tuple[str, str]]:
    """The (pos, name, pattern) table in its order as literals for pattern_flags; it holds rules, not data."""
    return [(r["name"], r["pattern"]) for r in catalogue.select("pos", "name", "pattern").orderBy("pos", "name").collect()]


def default_key(text: Column) -> Column:
    """A row's group: its text without digits, brackets and bond marks, lower case, single spaces.

    A row with nothing left gets '' and those rows form a group like any other.
    """
    bare = F.regexp_replace(F.lower(text), r"[0-9()\[\]=#%@+\\/.,;:|-]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def with_group_key(rows: DataFrame, text: str = "text", key: Callable[[Column], Column] = default_key) -> DataFrame:
    """Adds group_key; NULL marks a row whose key could not be derived."""
    return spread(rows).withColumn("group_key", key(F.col(text)))
