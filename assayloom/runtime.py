"""Session defaults and the shared folder for cut lineage and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass in the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("assayloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ASSAYLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The session's own setting wins. Only where none is set (a local test) does this make a
    temporary folder, and it refuses to do so on a cluster, where executors could not read it.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="assayloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/assayloom-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later plans read these rows back instead of recomputing them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path, so any store works."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders right below a path; none where it does not exist."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hadoop_path)] if fs.exists(hadoop_path) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, made at once or not at all."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop_path, True).close()


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the library's own making."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


#: A side of at most so many narrow rows may be broadcast; its rows are counted first.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast where its counted rows are few; else joins shuffle. df should be cheap to read twice."""
    return F.broadcast(df) if df.count() <= most else df


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join by equal keys in which NULL equals NULL, as in a grouping; the keys come from the left side."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in keys])


def table_complete(spark: SparkSession, path: str) -> bool:
    """True only when a write committed: the folder alone proves nothing after a crash."""
    return path_exists(spark, f"{path}/_SUCCESS")


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size estimate; looks at statistics only and runs nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


SPLIT_BYTES = 128 * 1024 * 1024
_NARROW_BYTES_PER_CORE = 8 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Gives heavy per-row work all cores where the input is small enough to be one or two splits.

    Larger inputs already come in many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) < cores * _NARROW_BYTES_PER_CORE:
        return df.repartition(cores)
    return df
