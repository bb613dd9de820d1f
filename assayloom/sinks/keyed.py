"""A library with unique keys: the first arrival of a key wins, and a small arrival reads only the buckets it may hit.

Rows lie in one folder per bucket of the key's hash, sorted by key. Beside the library, each insert leaves a run of bitmaps: for
every bucket the positions to which its new keys hash, a Bloom filter of fixed layout. A key whose positions are not all set is
new for sure; only the buckets of the other keys are opened, and only their key column. So the cost of an insert follows the
arrival and the buckets it may hit, not the library.

Order of writes: bitmaps, rows, and a commit, an empty file whose name holds the last number. A crash leaves bitmaps without
rows, which cost a look and lose nothing, or rows without a commit, which the next insert finds by their bitmaps; it then
takes the last number from the rows themselves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from assayloom.operators.ingest import first_per_key
from assayloom.operators.ranking import rank_within
from assayloom.runtime import cut_lineage, delete_path, list_names, path_exists, table_complete, touch

#: Bits of one bitmap, by the functions that make and join them.
_BITS = 32_768
#: Runs of bitmaps that are folded into one.
FOLDED_RUNS = 16
_BITMAPS = "bucket int, page int, bits binary"
#: Bitmaps that one task sorts.
_SORTED_ROWS = 8_192


@dataclass(frozen=True)
class Layout:
    """Buckets, bitmaps of a bucket, and positions of a key; a library keeps the layout it was made with.

    For few needless looks a bucket wants ten bits a key: pages of about keys / buckets / 3,000.
    """

    buckets: int = 32
    pages: int = 1
    hashes: int = 3

    @property
    def name(self) -> str:
        return f"layout={self.buckets}-{self.pages}-{self.hashes}"

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(0), F.col(key)), F.lit(self.buckets)).cast("int")

    def places(self, key: str) -> Column:
        """The pages and bits of a key."""
        at = [F.pmod(F.xxhash64(F.lit(i + 1), F.col(key)), F.lit(self.pages * _BITS)) for i in range(self.hashes)]
        return F.array(*[F.struct(F.floor(p / _BITS).cast("int").alias("page"), F.pmod(p, F.lit(_BITS)).alias("bit")) for p in at])


def read_keyed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The library's rows; none where nothing was ever inserted."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


class _Runs:
    """Bitmaps and commits beside a library, by run number; a folded run stands for all before it."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout):
        self.spark, self.path, self.layout, self.root = spark, path, layout, f"{path}_keys"
        names = list_names(spark, self.root)
        found = lambda kind: sorted(
            int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and table_complete(spark, f"{self.root}/{n}")
        )
        self.folded = max(found("folded"), default=0)
        self.runs = [n for n in found("run") if n > self.folded]
        self.last = max([self.folded, *self.runs])
        #: number of the run and last number of the library, by name
        self.commits = {n: tuple(map(int, n[7:].split("-"))) for n in names if n.startswith("commit=")}
        made = [n for n in names if n.startswith("layout=")]
        if made and made != [layout.name]:
            raise ValueError(f"{path} was made with {made[0]}, not {layout.name}")
        if not made and path_exists(spark, path):
            raise ValueError(f"{path} holds rows without bitmaps of their keys")
        self.made = bool(made)

    def bitmaps(self) -> DataFrame:
        paths = [f"{self.root}/run={n}" for n in self.runs] + [f"{self.root}/folded={self.folded}"] * (self.folded > 0)
        return self.spark.read.schema(_BITMAPS).parquet(*paths)

    def _joined(self) -> DataFrame:
        return self.bitmaps().groupBy("bucket", "page").agg(F.bitmap_or_agg("bits").alias("bits"))

    def may_hold(self, keys: DataFrame, key: str) -> DataFrame:
        """The keys (key, bucket) whose positions are all set."""
        asked = keys.withColumn("_p", F.explode(self.layout.places(key))).select(key, "bucket", "_p.page", "_p.bit")
        met = asked.join(self._joined(), ["bucket", "page"])
        byte = F.conv(F.hex(F.substr("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.get(F.array(*[byte.bitwiseAND(F.lit(1 << i)) for i in range(8)]), F.pmod("bit", F.lit(8)).cast("int")) > 0
        return met.where(is_set).groupBy(key, "bucket").agg(F.count("*").alias("_n")).where(F.col("_n") == self.layout.hashes).drop("_n")

    def add(self, rows: DataFrame, key: str) -> int:
        """Writes the bitmaps of new rows and returns their run's number."""
        n = self.last + 1
        if not self.made:
            touch(self.spark, f"{self.root}/{self.layout.name}")
        places = rows.select("bucket", F.explode(self.layout.places(key)).alias("_p")).select("bucket", "_p.page", "_p.bit")
        made = places.groupBy("bucket", "page").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self._write(made, f"{self.root}/run={n}")
        return n

    def _write(self, bitmaps: DataFrame, path: str) -> None:
        """Sorted by bucket, so that a look at few buckets skips the other pages."""
        few = self.layout.buckets * self.layout.pages <= _SORTED_ROWS
        placed = bitmaps.coalesce(1) if few else bitmaps.repartitionByRange("bucket", "page")
        placed.sortWithinPartitions("bucket", "page").write.mode("overwrite").parquet(path)

    def commit(self, n: int, last_serial: int) -> None:
        touch(self.spark, f"{self.root}/commit={n}-{last_serial}")
        for old in self.commits:
            delete_path(self.spark, f"{self.root}/{old}")

    def fold(self, upto: int) -> None:
        """One run for many, once there are many; the old ones go after the new one is complete."""
        if upto - self.folded < FOLDED_RUNS:
            return
        fresh = _Runs(self.spark, self.path, self.layout)
        self._write(fresh._joined(), f"{self.root}/folded={fresh.last}")
        for old in [f"run={n}" for n in fresh.runs] + [f"folded={fresh.folded}"] * (fresh.folded > 0):
            delete_path(self.spark, f"{self.root}/{old}")

    def last_serial(self, schema: T.StructType, serial: str) -> int:
        """From the last commit if it is the last run's, else from the rows."""
        known = [last for run, last in self.commits.values() if run == self.last]
        if known or not self.last:
            return max(known, default=0)
        return read_keyed(self.spark, self.path, schema).agg(F.max(serial)).first()[0] or 0


def insert_first(
    rows: DataFrame, path: str, key: str, order: Sequence[str], schema: T.StructType, serial: str | None = None,
    layout: Layout = Layout(),
) -> list[int]:
    """Inserts the first arrival of every key that the library does not hold; returns the buckets that were opened.

    With serial, new rows are numbered on from the highest number in the library, in arrival order. Rows without a key are no
    library rows and are left out. Arrivals alike in `order` go by their other columns. One writer at a time.
    """
    spark = rows.sparkSession
    runs = _Runs(spark, path, layout)
    first = first_per_key(rows.where(F.col(key).isNotNull()), key, order).withColumn("bucket", layout.bucket(key))
    opened: list[int] = []
    if runs.last:
        first = cut_lineage(first)
        may = runs.may_hold(first.select(key, "bucket"), key)
        opened = sorted(r["bucket"] for r in may.select("bucket").distinct().collect())
        if opened and path_exists(spark, path):
            library = spark.read.schema(T.StructType([schema[key], T.StructField("bucket", T.IntegerType())])).parquet(path)
            first = first.join(library.where(F.col("bucket").isin(opened)), ["bucket", key], "left_anti")
    if serial:
        first = rank_within(first, [], [*order, key], serial).withColumn(
            serial, F.col(serial) + F.lit(runs.last_serial(schema, serial))
        )
    fresh = cut_lineage(first.select(*schema.names, "bucket"))
    if fresh.isEmpty():
        return opened
    n = runs.add(fresh, key)
    fresh.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("append").partitionBy("bucket").parquet(path)
    runs.commit(n, fresh.agg(F.max(serial)).first()[0] if serial else 0)
    runs.fold(n)
    return opened
