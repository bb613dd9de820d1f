"""A training corpus from raw documents: five stages, each one operator applied to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayloom.llm import bpe, byte_cnn, exact_dedup, jaccard_join, mixing
from assayloom.llm.tables import documents
from assayloom.runtime import work_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on this corpus's labels, calls good."""
    return byte_cnn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the one with the smallest doc_id."""
    return jaccard_join.keep_one(docs, 5, 80, 100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids (binary, little-endian 32-bit) and the hash of the text they decode to."""
    path = bpe.vocabulary()
    encoded = bpe.encode(docs, path, ["doc_id", "lang", "source"], decoded=True)
    return encoded.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality), ("exact_dedup", exact), ("jaccard_join", near), ("mixing", mixture), ("bpe", tokens),
]

#: A fitted network and BPE are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    root = work_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
