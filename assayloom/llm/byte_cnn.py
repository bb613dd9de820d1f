"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover all of its bytes. Learned filters run over each chunk, each filter's largest
answer is kept, the answers are averaged over the chunks, and a small dense layer makes one probability of them. The network
is fitted on a bounded, hash-chosen sample of labelled rows; chunks of that sample, not texts, reach the driver. Scoring reads
every byte of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayloom.llm.registry import query
from assayloom.llm.shingles import word_hashes
from assayloom.llm.tables import documents, small_batches

CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 8, 32, 16
#: Bounds of the sample that the network is fitted on: labelled rows of each class, and chunks of each row.
SAMPLE_PER_CLASS, SAMPLE_CHUNKS = 1500, 12
EPOCHS, BATCH, RATE, SEED = 10, 32, 0.01, 5
_BLOCK = 256
_POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def letters(data: bytes) -> np.ndarray:
    """The network's alphabet: a text's bytes, and from 256 on bytes of a word that repeats the word before it."""
    own = np.frombuffer(data, np.uint8)
    words, first, last = word_hashes(own, np.zeros(1, np.int64))
    out = own.astype(np.int16)
    again = np.flatnonzero(words[1:] == words[:-1]) + 1
    if len(again):
        marks = np.zeros(len(own) + 1, np.int16)
        marks[first[again]] += 1
        marks[last[again]] -= 1
        out += 256 * np.cumsum(marks[:-1], dtype=np.int16)
    return out


def chunks(data: bytes) -> np.ndarray:
    """All chunks of a text, one a row; the last one is filled up with zeros. An empty text is one empty chunk."""
    step = CHUNK - OVERLAP
    count = max(1, -(-(len(data) - OVERLAP) // step))
    held = np.zeros((count - 1) * step + CHUNK, np.int16)
    held[: len(data)] = letters(data)
    return np.lib.stride_tricks.sliding_window_view(held, CHUNK)[::step]


@dataclass
class Network:
    """Weights, and the log odds to add since the sample holds both classes alike."""

    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    prior: float = 0.0

    @staticmethod
    def new(rng: np.random.Generator) -> Network:
        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return Network(
            draw(512, EMBED, scale=0.5), draw(WIDTH * EMBED, FILTERS, scale=0.15), np.zeros(FILTERS, np.float32),
            draw(FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=0.2), np.zeros(1, np.float32),
        )

    def windows(self, block: np.ndarray) -> np.ndarray:
        """(chunks, positions, width x embedding) of a block of chunks."""
        held = self.embed[block].reshape(len(block), CHUNK * EMBED)
        return np.lib.stride_tricks.sliding_window_view(held, WIDTH * EMBED, axis=1)[:, :: STRIDE * EMBED]

    def pooled(self, block: np.ndarray, where: bool = False):
        """Each filter's largest answer in each chunk, and at wish the positions it came from."""
        seen = np.ascontiguousarray(self.windows(block)).reshape(-1, WIDTH * EMBED)
        answers = (seen @ self.conv).reshape(len(block), _POSITIONS, FILTERS)
        top = answers.max(axis=1) + self.conv_bias
        return (np.maximum(top, 0), answers.argmax(axis=1), seen) if where else np.maximum(top, 0)

    def logit(self, features: np.ndarray) -> np.ndarray:
        return np.tanh(features @ self.dense + self.dense_bias) @ self.out + self.out_bias[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each text, from all of its bytes."""
        features = np.zeros((len(texts), FILTERS), np.float64)
        counts = np.zeros(len(texts))
        waiting, owners, held = [], [], 0

        def flush():
            nonlocal waiting, owners, held
            if held:
                np.add.at(features, np.concatenate(owners), self.pooled(np.concatenate(waiting)))
            waiting, owners, held = [], [], 0

        for i, data in enumerate(texts):
            own = chunks(data)
            counts[i] = len(own)
            for at in range(0, len(own), _BLOCK):
                part = own[at: at + _BLOCK]
                waiting.append(part)
                owners.append(np.full(len(part), i))
                held += len(part)
                if held >= _BLOCK:
                    flush()
        flush()
        z = self.logit(features / counts[:, None]) + self.prior
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, int]], prior: float, seed: int = SEED) -> Network:
    """Fits a network on (chunks of a document, label) by Adam on the logistic loss; the same rows give the same network."""
    rng = np.random.default_rng(seed)
    net = Network.new(rng)
    names = ("embed", "conv", "conv_bias", "dense", "dense_bias", "out", "out_bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    steps = 0
    total = EPOCHS * max(1, len(rows) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = [rows[i] for i in order[at: at + BATCH]]
            steps += 1
            rate = RATE * max(0.05, 1 - steps / (total + 1))
            for n, g in zip(names, _gradients(net, batch)):
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                a, b = first[n] / (1 - 0.9**steps), second[n] / (1 - 0.999**steps)
                getattr(net, n)[...] -= (rate * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    net.prior = prior
    return net


def _gradients(net: Network, batch):
    block = np.concatenate([c for c, _ in batch])
    sizes = np.array([len(c) for c, _ in batch])
    owner = np.repeat(np.arange(len(batch)), sizes)
    label = np.array([y for _, y in batch], np.float32)
    top, where, seen = net.pooled(block, where=True)
    features = np.zeros((len(batch), FILTERS), np.float32)
    np.add.at(features, owner, top)
    features /= sizes[:, None]
    hidden = np.tanh(features @ net.dense + net.dense_bias)
    z = hidden @ net.out + net.out_bias[0]
    dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(batch)
    d_out, d_out_bias = hidden.T @ dz, np.array([dz.sum()])
    dh = dz[:, None] * net.out * (1 - hidden**2)
    d_dense, d_dense_bias = features.T @ dh, dh.sum(axis=0)
    d_top = ((dh @ net.dense.T) / sizes[:, None])[owner] * (top > 0)
    rows = (np.arange(len(block))[:, None] * _POSITIONS + where).ravel()
    picked = seen[rows].reshape(len(block), FILTERS, WIDTH * EMBED)
    d_conv = np.einsum("cf,cfw->wf", d_top, picked)
    d_seen = (d_top[:, :, None] * net.conv.T[None]).reshape(len(block), FILTERS, WIDTH, EMBED)
    places = where[:, :, None] * STRIDE + np.arange(WIDTH)
    symbols = block[np.arange(len(block))[:, None, None], places]
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, symbols.ravel(), d_seen.reshape(-1, EMBED))
    return d_embed, d_conv, d_top.sum(axis=0), d_dense, d_dense_bias, d_out, d_out_bias


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: crc32 of the id's text leaves 1 modulo 3. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, most_chunks: int = SAMPLE_CHUNKS) -> Network | float:
    """The network fitted on labelled rows that are not held out; a plain probability where a class has no rows.

    Of each class the `per_class` rows with the smallest hash of their id take part, and of each row up to `most_chunks`
    chunks spread evenly over the text. The share of the classes is counted over all labelled rows. Of rows that share
    an id the smallest text counts, so no id brings more than one row. Ids with contradicting labels and labels other than
    0 and 1 are left out.
    """
    known = (
        labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .where("low = high").select("__id", F.col("low").cast("int").alias("label"))
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return (n1 + 1) / (n0 + n1 + 2)
    small_batches(docs.sparkSession)
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.col("text").cast("string").alias("text"))

    def cut(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                own = chunks((t or "").encode("utf-8", "replace"))
                pick = np.unique(np.linspace(0, len(own) - 1, most_chunks).round().astype(int))
                out.append(own[pick].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("label"), pa.array(out, pa.binary())], names=["id", "label", "held"])

    # at most 2 * per_class narrow rows
    sample = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__id", "label").agg(F.min("text").alias("text"))
    held = sample.mapInArrow(cut, "id long, label int, held binary").collect()
    held.sort(key=lambda r: (r["id"], bytes(r["held"])))
    rows = [(np.frombuffer(r["held"], np.int16).reshape(-1, CHUNK), r["label"]) for r in held]
    got = sum(y for _, y in rows), len(rows)
    if not 0 < got[0] < got[1]:
        return (n1 + 1) / (n0 + n1 + 2)
    return fit(rows, float(np.log(n1 / n0) - np.log(got[0] / (got[1] - got[0]))))


def score(docs: DataFrame, model: Network | float, keep: list[str]) -> DataFrame:
    """The columns in `keep` and score, the probability that a row's whole text is good. A null text counts as empty.

    Only the text makes the score. Equal texts have equal scores up to rounding.
    """
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column("__text").to_pylist()]
                values = model.scores(texts) if isinstance(model, Network) else np.full(len(texts), model)
                cols = [part.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(values, pa.float64())], names=[*keep, "score"])

    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{kinds}, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is at least `least`, columns as they are."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                held = pc.struct_field(part.column("row"), "text")
                texts = [(t or "").encode("utf-8", "replace") for t in held.to_pylist()]
                values = model.scores(texts) if isinstance(model, Network) else np.full(len(texts), model)
                yield part.select(["row"]).filter(pa.array(values >= least))

    return wrapped.mapInArrow(run, wrapped.schema).select("row.*")


@query("op8_byte_cnn")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, ["doc_id"])
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
