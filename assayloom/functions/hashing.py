"""Numbers from a hash of (id, seed, round): the same in every run and under every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TWO_48 = 281474976710656.0


def seed_digest(id_col: Column, seed: int, rnd: int = 0) -> Column:
    return F.md5(F.concat_ws("-", id_col.cast("string"), F.lit(str(seed)), F.lit(str(rnd))))


def uniform(id_col: Column, seed: int, rnd: int = 0) -> Column:
    """A uniform number inside (0, 1), never 0 or 1, from the first 48 bits of the digest."""
    bits = F.conv(F.substring(seed_digest(id_col, seed, rnd), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(_TWO_48)


def gumbel(id_col: Column, seed: int, rnd: int = 0) -> Column:
    """Standard Gumbel noise; argmax of logit + noise is a softmax draw."""
    return -F.log(-F.log(uniform(id_col, seed, rnd)))
