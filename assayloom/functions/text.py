"""String, number-format, date and JSON expressions used by sources and reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def tranche_name(path: Column, suffix: str = ".smi") -> Column:
    """The last two parts of a path without the file suffix."""
    dot = suffix.replace(".", r"\.")
    return F.regexp_extract(path, rf"([^/]+/[^/]+?)(?:{dot})?$", 1)


def tokens(line: Column) -> Column:
    """Split on any run of white space, ignoring it at either end."""
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")


def trailing_round(path: Column) -> Column:
    """The integer after the last "round" in a file stem, NULL where there is none."""
    return F.regexp_extract(path, r"round(\d+)(?:\.[A-Za-z]+)?$", 1).try_cast("int")


def shorten(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def joined_sorted(items: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x.cast("string")), sep)


def fixed(v: Column, decimals: int, signed: bool = False, missing: str = "-") -> Column:
    """Fixed-decimal text; a dash for a missing number."""
    flag = "+" if signed else ""
    return F.coalesce(
        F.when(v.isNotNull(), F.format_string(f"%{flag}.{decimals}f", v.cast("double"))), F.lit(missing)
    )


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def elapsed_seconds(start: Column, end: Column) -> Column:
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def rate_per_second(done: Column, elapsed: Column) -> Column:
    return F.when(elapsed > 0, done / elapsed)


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left at the speed so far; NULL before the first row is done."""
    return F.when(done > 0, (total - done) * elapsed / done)
