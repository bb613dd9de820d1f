"""Tables of a data folder, and id-range reads of a database table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from assayloom import schemas


def read_table(spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """One temporary view per table."""
    out = {name: read_table(spark, folder, name) for name in names}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def read_jdbc_ranges(
    spark: SparkSession, url: str, table: str, last_id: int, parts: int, id_col: str = "id",
    fetch_rows: int = 10_000, **options: str,
) -> DataFrame:
    """A database table in contiguous id ranges, one connection and server-side cursor per range."""
    return (
        spark.read.format("jdbc").options(**options)
        .option("url", url).option("dbtable", table)
        .option("partitionColumn", id_col).option("lowerBound", 1).option("upperBound", last_id + 1)
        .option("numPartitions", parts).option("fetchsize", fetch_rows).load()
    )


def read_embedding_2d(spark: SparkSession, path: str) -> DataFrame:
    """Points with their metadata in one keyed table. A missing file is an error."""
    return spark.read.schema(schemas.EMBEDDING_2D).parquet(path)


def with_default_experiment(rows: DataFrame, default: str = "maxmin_init") -> DataFrame:
    """Rows written before the experiment column existed belong to the default experiment."""
    if "experiment_id" not in rows.columns:
        return rows.withColumn("experiment_id", F.lit(default))
    return rows.withColumn("experiment_id", F.coalesce("experiment_id", F.lit(default)))
