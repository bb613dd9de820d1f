"""Exact deduplication: keyed state on disk, full bytes compared on every hit.

A stream of narrow rows (digest, doc_id, place) is folded into RocksDB state without expiry: per digest the digest itself,
the stable identifier of the document that stays, the place its content lies in, and the number of rows. A later run with
the same state folder goes on from there. A digest seen more than once is a hit: the whole text of each such row is
compared with the text of the row that stays. Rows that share a digest with another text are grouped once more by text.
Everything is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import documents, narrow_side, put
from assayloom.runtime import table_complete, work_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The number of state stores is fixed when a state is first made: one per so many rows, and one per core at least. A store has
#: a fixed cost of several MB of files, so it does not follow the number of shuffle partitions.
_STORES = "spark.sql.streaming.internal.stateStore.partitions"
ROWS_PER_STORE = 4_000_000
#: Narrow rows folded into the state by one micro-batch.
BYTES_PER_BATCH = 64 * 2**30
#: Copies compared against one replica of the text that stays; a larger group gets more replicas.
COPIES_PER_REPLICA = 128


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def fold_stream(spark: SparkSession, narrow_path: str, schema, state_path: str, held: int) -> DataFrame:
    """Folds all narrow rows not yet seen into the state under state_path; returns the state, one row per digest.

    held is the number of rows that a new state is laid out for.
    """
    stores = max(spark.sparkContext.defaultParallelism, -(-held // ROWS_PER_STORE))
    wanted = {_PROVIDER: _ROCKSDB, _STORES: str(stores)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", BYTES_PER_BATCH).option("recursiveFileLookup", True).parquet(narrow_path)
        state = rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "place")).alias("kept"), F.sum("copies").alias("group_size"),
        )
        run = (
            state.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state_path).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    stored = spark.read.format("statestore").load(state_path)
    kept, total = stored.schema["value"].dataType.names
    return stored.select(
        F.col("key.digest").alias("digest"), F.col(f"value.`{kept}`.doc_id").alias("keep_id"),
        F.col(f"value.`{kept}`.place").alias("keep_place"), F.col(f"value.`{total}`").alias("group_size"),
    )


def decide(docs: DataFrame, digest=sha256, state_path: str | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: doc_id, digest, copies, keep_id, group_size, kept, place, keep_place.

    A null text counts as empty. Rows that repeat a doc_id with the same text are one document, returned once with `copies`
    rows. group_size counts rows. The largest doc_id stays; a null doc_id stays only where its group has no other. Other
    columns are not read. With a state_path, earlier runs' documents count too (then keep_id may be one of theirs), and
    the compared texts are those of `docs`. A batch name makes a run repeatable: its rows enter the state once.
    """
    spark = docs.sparkSession
    narrow = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), digest(F.coalesce("text", F.lit(""))).alias("digest"),
            F.input_file_name().alias("place"),
        )
        .groupBy("doc_id", "digest").agg(F.min("place").alias("place"), F.count("*").alias("copies"))
    )
    root = state_path or work_path(spark, "dedup")
    path = f"{root}/digests/{batch or uuid.uuid4().hex}"
    if not table_complete(spark, path):
        narrow.write.mode("overwrite").parquet(path)
    narrow = spark.read.schema(narrow.schema).parquet(path)
    state = fold_stream(spark, f"{root}/digests", narrow.schema, f"{root}/state", narrow.count())
    decided = put(
        narrow.join(state, "digest").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))), "decided"
    )
    wrong = put(_unequal(docs, decided, digest), "unequal")
    if wrong.isEmpty():
        return decided
    return _by_text(docs, decided, wrong, digest)


def _unequal(docs: DataFrame, decided: DataFrame, digest) -> DataFrame:
    """Digests under which some text differs from the text of the row that stays."""
    hits = put(
        decided.where("group_size > copies").select(
            "doc_id", "digest", "keep_id", "kept", "group_size",
        ), "hits",
    )
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("digest", digest(F.col("text")))
    side = narrow_side(hits)
    found = texts.join(side, (texts["doc_id"].eqNullSafe(side["doc_id"])) & (texts["digest"] == side["digest"])).select(
        texts["doc_id"], texts["text"], texts["digest"], "kept", "group_size",
    )
    replicas = F.floor(F.col("group_size") / COPIES_PER_REPLICA).cast("int") + 1
    stays = found.where("kept").select(
        F.col("digest").alias("d"), F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(1), replicas)).alias("r"),
    )
    members = found.where("not kept").withColumn("salt", F.pmod(F.xxhash64("doc_id"), replicas.cast("long")).cast("int") + 1)
    return (
        members.join(stays, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("r")))
        .where(F.col("text") != F.col("kept_text")).select("digest").distinct()
    )


def _by_text(docs: DataFrame, decided: DataFrame, wrong: DataFrame, digest) -> DataFrame:
    """Groups the documents under the given digests by their texts themselves."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("digest", digest(F.col("text")))
    rows = (
        texts.join(narrow_side(wrong), "digest", "left_semi")
        .groupBy("digest", "text", "doc_id").agg(F.count("*").alias("copies"))
    )
    groups = rows.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    again = rows.join(groups, ["digest", "text"])
    places = decided.select(F.col("doc_id").alias("keep_id"), F.col("place").alias("keep_place"), "digest")
    again = again.join(places, again["keep_id"].eqNullSafe(places["keep_id"]) & (again["digest"] == places["digest"])).select(
        again["doc_id"], again["digest"], again["copies"], again["keep_id"], again["group_size"], "keep_place",
        again["doc_id"].eqNullSafe(again["keep_id"]).alias("kept"), F.lit(None).cast("string").alias("place"),
        F.sha2("text", 256).alias("text_sha256"),
    )
    rest = decided.join(narrow_side(wrong), "digest", "left_anti")
    return rest.unionByName(again, allowMissingColumns=True)


def drop_copies(docs: DataFrame, digest=sha256) -> DataFrame:
    """The rows of docs that stay, all columns as they are; of rows that repeat a kept document one stays, arbitrary in
    columns other than doc_id and text."""
    decided = decide(docs, digest)
    gone = put(decided.where("not kept").select(F.col("doc_id").alias("__gone_id"), F.col("digest").alias("__gone_digest")), "gone")
    side = narrow_side(gone)
    text = F.coalesce(docs["text"], F.lit(""))
    same = docs["doc_id"].cast("long").eqNullSafe(side["__gone_id"]) & (digest(text) == side["__gone_digest"])
    left = docs.join(side, same, "left_anti")
    if decided.where("kept and copies > 1").isEmpty():
        return left
    return left.dropDuplicates(["doc_id", "text"])


@query("op1_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
    FROM d JOIN g ON d.text = g.text""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = decide(documents(spark, sf_dir))
    known = F.col("text_sha256") if "text_sha256" in decided.columns else F.lit(None)
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.coalesce(known, F.col("digest")).alias("text_sha256"))
