"""The classifier: held-out accuracy, gradients, whole texts, odd rows and tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import byte_cnn as N
from small_tables import docs_of  # noqa: F401

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in N.op8(spark, FOLDER).collect()}


def test_held_out_accuracy(scored):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{FOLDER}/labels.parquet' WHERE quality IS NOT NULL").fetchall())
    asked = [(r.predicted, labels[i]) for i, r in scored.items() if r.held_out and i in labels]
    assert len(asked) > 80
    assert np.mean([a == b for a, b in asked]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())
    assert len(scored) == 1000


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = N.Network.new(rng)
    batch = [(N.chunks(bytes(rng.integers(32, 120, n, dtype=np.uint8))), n % 2) for n in (40, 700, 1200, 3)]

    def loss():
        total = 0.0
        for own, y in batch:
            z = float(net.logit(net.pooled(own).mean(axis=0, keepdims=True))[0])
            total += np.log1p(np.exp(-z if y else z))
        return total / len(batch)

    names = ("embed", "conv", "conv_bias", "dense", "dense_bias", "out", "out_bias")
    for name, grad in zip(names, N._gradients(net, batch)):
        weights = getattr(net, name)
        at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        was, step = weights[at], 1e-2
        weights[at] = was + step
        up = loss()
        weights[at] = was - step
        down = loss()
        weights[at] = was
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.15, abs=2e-4), name


def test_chunks_cover_all_bytes():
    for n in (0, 1, 511, 512, 513, 992, 993, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        own = N.chunks(data)
        step = N.CHUNK - N.OVERLAP
        back = np.concatenate([own[:-1, :step].ravel(), own[-1]])[:n]
        assert bytes((back % 256).astype(np.uint8)) == data


def test_long_text_is_read_to_its_end(spark, docs_of):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = N.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels, 300, 4)
    good = "The and attion to thanedble the, anea. Eriner thanea of them. "
    a, b = model.scores([(good * 800).encode(), (good * 200 + "THE!! AND!! OF!! ### $$$ " * 2400).encode()])
    assert a > b


def test_rows_without_labels_and_odd_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([None, "", "a", "a", "b " * 90_000, (None, "x", None)], extra="score")
    model = N.train(docs, none)
    assert model == 0.5
    assert [r.score for r in N.score(docs, model, ["doc_id"]).collect()] == [0.5] * 6
    kept = N.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 6
    odd = spark.createDataFrame([(2, 0, 0), (2, 1, 0), (3, None, 0), (None, 1, 0), (4, 7, 0), (0, 1, None)], "doc_id long, quality int, toxic int")
    assert N.train(docs, odd) == pytest.approx(2 / 3)  # one good row, no bad one
    both = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    fitted = N.score(docs, N.train(docs, both), ["doc_id"]).collect()
    assert len(fitted) == 6 and all(0 <= r.score <= 1 for r in fitted)
    assert N.score(docs.where("false"), 0.5, ["doc_id"]).count() == 0


def test_held_out_rows_never_teach(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(N.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = N.train(docs, labels, 40, 2), N.train(docs, flipped, 40, 2)
    assert np.array_equal(one.conv, two.conv) and one.prior == two.prior


def test_names_with_dots_and_repeated_ids(spark, docs_of):
    docs = docs_of([(i % 4, "good words here" if i % 2 else "zz zz zz", "s") for i in range(40)]).selectExpr("*", "7 AS `a.b`")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    out = N.keep_good(docs, labels, 0.0)
    assert out.columns == docs.columns and out.count() == 40 and {r[-1] for r in out.collect()} == {7}
