"""Token counts as rollups that are kept by deltas.

Every batch of inserts, deletes and revised counts becomes signed changes of the totals by source, language and tokenizer
version. A batch is written under its number: first what each document now contributes, then the changes; it counts once the
changes are committed. A batch that is applied again changes nothing, one that broke off is written over. Totals are sums of
the committed changes and never need the documents again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.llm.registry import query
from assayloom.llm.tables import documents
from assayloom.runtime import path_exists, table_complete, work_path

KEYS = ("source", "lang", "version")
_EVENTS = "doc_id long, op string, source string, lang string, version string, tokens long"
_STATE = "doc_id long, source string, lang string, version string, tokens long, alive boolean, batch long"
_DELTAS = "source string, lang string, version string, docs long, tokens long, batch long"

#: Tokenizer versions and the patterns whose matches they count.
VERSIONS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[A-Za-z0-9\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]",
}


def count_tokens(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


class Rollup:
    """Totals in a folder of the shared store. One writer at a time; batch numbers rise."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def committed(self) -> list[int]:
        """Numbers of the batches that count."""
        root = f"{self.path}/deltas"
        if not path_exists(self.spark, root):
            return []
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        files = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(found)
        numbers = [f.getPath().getName().removeprefix("batch-") for f in files]
        return sorted(int(n) for n in numbers if n.isdigit() and table_complete(self.spark, f"{root}/batch-{n}"))

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{what}/batch-{n}" for n in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def contributions(self) -> DataFrame:
        """What every document contributes now: doc_id, source, lang, version, tokens, alive."""
        row = F.struct("batch", "source", "lang", "tokens", "alive")
        latest = self._read("state", _STATE).groupBy("doc_id", "version").agg(F.max_by(row, "batch").alias("r"))
        return latest.select("doc_id", "version", "r.source", "r.lang", "r.tokens", "r.alive")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens; keys without documents are left out."""
        summed = self._read("deltas", _DELTAS).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs <> 0 OR tokens <> 0")

    def apply(self, batch: int, events: DataFrame) -> bool:
        """Commits a batch of events (doc_id, op, source, lang, version, tokens, optional seq); False if it counted already.

        op is insert (or takes the place of what the document contributed), revise (a new count of a document that is there;
        its source and language stay) or delete. Of several events for a document and version the one with the largest seq
        counts, then the largest tokens. Events without doc_id or version, or of another op, change nothing; a null count is
        0; null sources and languages are keys of their own.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]}")
        seq = F.col("seq") if "seq" in events.columns else F.lit(0)
        row = F.struct(seq.cast("long").alias("seq"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "op", "source", "lang")
        asked = (
            events.where("doc_id IS NOT NULL AND version IS NOT NULL AND op IN ('insert', 'revise', 'delete')")
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"), "version").agg(F.max(row).alias("e"))
        )
        before = self.contributions().select(
            F.col("doc_id").alias("b_id"), F.col("version").alias("b_version"), F.struct("source", "lang", "tokens", "alive").alias("b"),
        )
        both = asked.join(before, (asked["doc_id"] == before["b_id"]) & (asked["version"] == before["b_version"]), "left") if done else \
            asked.withColumn("b", F.lit(None).cast("struct<source:string,lang:string,tokens:bigint,alive:boolean>"))
        was = F.coalesce("b.alive", F.lit(False))
        insert, revise = F.col("e.op") == "insert", F.col("e.op") == "revise"
        after = both.where(insert | was).select(
            "doc_id", "version", F.when(insert, F.col("e.source")).otherwise(F.col("b.source")).alias("source"),
            F.when(insert, F.col("e.lang")).otherwise(F.col("b.lang")).alias("lang"), F.col("e.tokens").alias("tokens"),
            (insert | revise).alias("alive"), was.alias("was"), F.col("b.source").alias("old_source"),
            F.col("b.lang").alias("old_lang"), F.col("b.tokens").alias("old_tokens"),
        )
        path = f"{self.path}/steps/batch-{batch}"
        after.write.mode("overwrite").parquet(path)
        after = self.spark.read.schema(after.schema).parquet(path)
        after.select(
            "doc_id", "source", "lang", "version", "tokens", "alive", F.lit(batch).cast("long").alias("batch"),
        ).write.mode("overwrite").parquet(f"{self.path}/state/batch-{batch}")
        gone = after.where("was").select(
            F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), "version", F.lit(-1).alias("docs"), (-F.col("old_tokens")).alias("tokens"),
        )
        come = after.where("alive").select("source", "lang", "version", F.lit(1).alias("docs"), "tokens")
        signed = gone.union(come).groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        signed.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/deltas/batch-{batch}")
        return True


def counted(docs: DataFrame, op: str, text: Column, versions=VERSIONS) -> DataFrame:
    """Events of one op for every row of docs and every tokenizer version."""
    each = F.array(*[F.struct(F.lit(v).alias("version"), count_tokens(text, p).alias("tokens")) for v, p in versions.items()])
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(op).alias("op"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.explode(each).alias("c"),
    ).select("doc_id", "op", "source", "lang", "c.version", "c.tokens")


def _address_free(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*", "")


@query("op4_token_rollup", r"""
    WITH d AS (SELECT source, lang, coalesce(regexp_replace(text, '[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*', '', 'g'), '') AS text
        FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)),
    c AS (SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM d
        UNION ALL SELECT source, lang, 'pieces-1',
            len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')) FROM d)
    SELECT source, lang, version, count(*) AS docs, cast(sum(tokens) AS bigint) AS tokens FROM c GROUP BY source, lang, version""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in; toxic ones are taken out; texts with addresses are counted again without them."""
    docs = documents(spark, sf_dir)
    rollup = Rollup(spark, work_path(spark, "rollup"))
    rollup.apply(1, counted(docs, "insert", F.col("text")))
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select("doc_id").distinct()
    versions = F.explode(F.array(*[F.lit(v) for v in VERSIONS])).alias("version")
    gone = toxic.select("doc_id", F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("source", "lang")], versions, F.lit(0).alias("tokens"))
    rollup.apply(2, gone)
    rollup.apply(3, counted(docs.where(F.contains("text", F.lit("@"))), "revise", _address_free(F.col("text"))))
    rollup.apply(2, gone)  # a repeated batch changes nothing
    return rollup.totals()
