"""The corpus pipeline: each stage against plain Python on the stage before it."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from assayloom.llm import bpe, byte_cnn, mixing
from assayloom.runtime import work_path
from test_jaccard_join import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = {}, spark.read.parquet(f"{FOLDER}/documents.parquet")
    out["input"] = docs
    for name, stage in C.STAGES:
        path = work_path(spark, name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_quality(spark, stages):
    docs = stages["input"]
    model = byte_cnn.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in byte_cnn.score(docs, model, ["doc_id"]).collect() if r.score >= 0.5}
    # two hundred documents have too few labels to reject any for sure
    assert set(texts(stages["quality"])) == want and 0 < len(want) <= docs.count()
    assert stages["quality"].columns == docs.columns


def test_exact(stages):
    keep = {}
    for i, t in texts(stages["quality"]).items():
        keep[t] = max(i, keep.get(t, i))
    assert set(texts(stages["exact_dedup"])) == set(keep.values())


def test_near(stages):
    held = sorted(texts(stages["exact_dedup"]).items())
    groups = brute([t for _, t in held], 5, 80, 100)
    assert set(texts(stages["jaccard_join"])) == {held[i][0] for i, _, root in groups if i == root}


def test_mixture(stages):
    docs = stages["jaccard_join"]
    want = {r.doc_id: r.copies for r in mixing.copies(docs).collect() if r.copies}
    assert Counter(r.doc_id for r in stages["mixing"].collect()) == want
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts(docs).items()}
    assert sum(sizes[i] * n for i, n in want.items()) == pytest.approx(sum(sizes.values()), rel=0.1)


def test_tokens(stages):
    tool = Tokenizer.from_file(bpe.vocabulary())
    held = texts(stages["mixing"])
    rows = stages["bpe"].collect()
    assert len(rows) == stages["mixing"].count()
    for r in rows:
        assert list(memoryview(bytes(r.ids)).cast("I")) == tool.encode(held[r.doc_id], add_special_tokens=False).ids


def test_run_is_the_stages(spark, stages):
    assert Counter((r.doc_id, r.n_tokens) for r in C.run(spark, FOLDER).collect()) == Counter((r.doc_id, r.n_tokens) for r in stages["bpe"].collect())


def test_quality_rejects_what_is_bad(spark):
    """On a folder with enough labels: held-out documents of label 0 go, those of label 1 stay."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = set(texts(C.quality(spark, docs, folder)))
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(byte_cnn.held_out(F.col("doc_id"))).collect()
    bad, good = [{r.doc_id for r in labels if r.quality == q} for q in (0, 1)]
    assert len(kept) < docs.count() and len(bad) > 10
    assert len(bad & kept) <= 0.1 * len(bad) and len(good & kept) >= 0.95 * len(good)
