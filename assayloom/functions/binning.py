"""Histogram bins. The last bin is closed on the right."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bin_clipped(v: Column, lo: float | Column, width: float | Column, n: int) -> Column:
    """Bin index with values beyond either end put into the end bins."""
    lo, width = _lit(lo), _lit(width)
    raw = F.floor((v - lo) / width)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)).cast("int")


def bin_inside(v: Column, lo: float | Column, width: float | Column, n: int) -> Column:
    """Bin index, NULL outside [lo, lo + n * width]."""
    lo, width = _lit(lo), _lit(width)
    inside = (v >= lo) & (v <= lo + width * n)
    return F.when(inside, bin_clipped(v, lo, width, n))


def _lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))
