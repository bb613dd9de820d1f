"""State of many feeds, of which a micro-batch rewrites only those buckets that hold feeds with news.

A feed belongs to a bucket by hash. Micro-batch i writes the new state of its own buckets under v=i and a manifest that names
the version of every bucket; buckets without news keep the files they have. A replay reads the manifest before it and
replaces its own writes. What no replay can ask for any more is deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.runtime import delete_path, table_complete

_FEED_STATE = "docked long, valid long, top array<double>"


class FeedStates:
    """The states below one path. `key_kinds` gives the types of the columns that name a feed, as in `a string, b int`."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], key_kinds: str, buckets: int = 64):
        self.spark, self.path, self.by, self.buckets = spark, path, list(by), buckets
        self.schema = f"{key_kinds}, {_FEED_STATE}, bucket int"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def versions(self, i: int) -> dict[int, int]:
        """Version of every bucket after micro-batch i; at most one entry per bucket."""
        if i < 0:
            return {}
        path = f"{self.path}/manifest={i}"
        if not table_complete(self.spark, path):
            raise RuntimeError(f"the state before micro-batch {i + 1} is missing: {path}")
        rows = self.spark.read.schema("bucket int, version int").parquet(path).collect()
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, versions: dict[int, int], buckets: Sequence[int] | None = None) -> DataFrame | None:
        """State of the feeds in the given buckets (all by default); None where there is none yet."""
        wanted = versions if buckets is None else {b: versions[b] for b in buckets if b in versions}
        if not wanted:
            return None
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in sorted(wanted.items())]
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths)
        return rows.select(*self.by, "docked", "valid", "top")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the feeds that rows belong to."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def write(self, i: int, state: DataFrame, touched: Sequence[int]) -> None:
        """New state of the touched buckets, then the manifest, then the clearing of what it replaced before."""
        placed = state.withColumn("bucket", self.bucket()).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={i}")
        before = self.versions(i - 1)
        now = before | {b: i for b in touched}
        rows = self.spark.createDataFrame(sorted(now.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest={i}")
        # a replay of i needs the state before it and no older one
        if i > 1 and table_complete(self.spark, f"{self.path}/manifest={i - 2}"):
            older = self.versions(i - 2)
            for b, v in older.items():
                if before.get(b) != v:
                    delete_path(self.spark, f"{self.path}/v={v}/bucket={b}")
            for v in {i - 2, *older.values()} - set(before.values()) - set(now.values()):
                delete_path(self.spark, f"{self.path}/v={v}")
            delete_path(self.spark, f"{self.path}/manifest={i - 2}")
