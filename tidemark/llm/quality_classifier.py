r"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing.  Every word falls in one of 2**15 hashed slots (a fixed bound, whatever the corpus)
and has a sparse ternary index vector drawn from a seed.  A slot's word vector is the sum of the index
vectors of the two words on either side, over every occurrence in all documents.  Each task adds up its
share and emits the filled slots, Spark sums them column by column, and the summed table (2**15 rows of
32 numbers) is centred, scaled to unit length and broadcast.

Pooling.  A document is the mean and the standard deviation of the vectors of all its words.

Network.  One hidden tanh layer and a logistic output in numpy, fitted by Adam on at most
``TRAIN_ROWS`` labelled documents chosen by a hash of doc_id, up to half of them of each label, so that a
rare label is not lost, with weights that restore the labels' shares; a fifth of them is kept apart to choose
the temperature by which the logits are divided, so that scores are calibrated probabilities.

Words are ``[^\x20\x09-\x0D]+``, unchanged.  Only labels whose crc32(doc_id) mod 5 is not 0 are used.
Defined results: null or blank texts pool to zeros and are scored like any other; null labels are
ignored, repeated labels of a document count once, as good if any is; without labels of both kinds
every score is 0.5; repeated rows are each scored; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_words, crc_mod, table
from tidemark.llm.shingles import word_hashes

SLOT_BITS, DIMENSIONS, NONZERO, REACH, SEED = 15, 32, 6, 2, 7
#: Most labelled documents that the network is fitted on, and the share kept apart for the temperature.
TRAIN_ROWS, KEPT_APART = 20_000, 0.2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
#: Words of a text that are added up at a time; bounds a task's memory, not the text.
STRETCH = 1 << 16


def index_vectors() -> np.ndarray:
    rng, out = np.random.default_rng(SEED), np.zeros((1 << SLOT_BITS, DIMENSIONS), np.int8)
    places = rng.random((1 << SLOT_BITS, DIMENSIONS)).argsort(1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.int8), places.shape), 1)
    return out


def slots_of(text: bytes | None) -> np.ndarray:
    words = byte_words(text)
    return (word_hashes(words) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def add_contexts(total: np.ndarray, slots: np.ndarray, vectors: np.ndarray) -> None:
    """total[slot] += the index vectors of the words within REACH, for every word of one text."""
    for begin in range(0, len(slots), STRETCH):
        low, high = max(0, begin - REACH), min(len(slots), begin + STRETCH + REACH)
        near = vectors[slots[low:high]]
        context = np.zeros_like(near)
        for d in range(1, min(REACH, len(near) - 1) + 1):
            context[d:] += near[:-d]
            context[:-d] += near[d:]
        own = slots[begin : begin + STRETCH]
        context = context[begin - low : begin - low + len(own)]
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        total[own[order][first]] += np.add.reduceat(context[order], first, axis=0, dtype=np.int64)


COLUMNS = [f"v{i}" for i in range(DIMENSIONS)]


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, vectors = np.zeros((1 << SLOT_BITS, DIMENSIONS), np.int64), index_vectors()
    for frame in batches:
        for text in frame["text"]:
            add_contexts(total, slots_of(text), vectors)
    filled = np.flatnonzero(total.any(1))
    yield pd.DataFrame({"slot": filled.astype(np.int32)} | {c: total[filled, i] for i, c in enumerate(COLUMNS)})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """docs(text as binary) -> a table of fixed size, one unit vector per slot (zero where nothing was seen)."""
    schema = "slot int, " + ", ".join(f"{c} long" for c in COLUMNS)
    rows = docs.select("text").mapInPandas(_contexts, schema).groupBy("slot").agg(*[F.sum(c).alias(c) for c in COLUMNS]).toArrow()
    out = np.zeros((1 << SLOT_BITS, DIMENSIONS))
    seen = rows["slot"].to_numpy()
    if len(seen):
        v = np.stack([rows[c].to_numpy() for c in COLUMNS], 1).astype(float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = v / np.maximum(size, 1)
        v -= v.mean(0)
        out[seen] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return out.astype(np.float32)


def pooled(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    slots, total, squares = slots_of(text), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    for begin in range(0, len(slots), STRETCH):
        v = vectors[slots[begin : begin + STRETCH]]
        total += v.sum(0)
        squares += np.einsum("ij,ij->j", v, v)
    mean = total / max(1, len(slots))
    return np.concatenate([mean, np.sqrt(np.maximum(squares / max(1, len(slots)) - mean * mean, 0))])


class Network:
    """x -> standardise -> tanh layer -> logit / temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.temperature = 1.0
        order = rng.permutation(len(y))
        apart, fit = np.split(order, [int(len(y) * KEPT_APART)])
        x = (x - self.mean) / self.scale
        p = self.weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(fit)
            for begin in range(0, len(order), BATCH):
                i, step = order[begin : begin + BATCH], step + 1
                hidden = np.tanh(x[i] @ p[0] + p[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - y[i]) * weight[i] / len(i)
                back = np.outer(error, p[2]) * (1 - hidden * hidden)
                rate = RATE * (1 - epoch / EPOCHS)
                for k, g in enumerate((x[i].T @ back, back.sum(0), hidden.T @ error, error.sum(keepdims=True))):
                    g = g + DECAY * p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if len(apart):
            logits, truth = self._logits(x[apart]), y[apart]
            loss = lambda t: float(np.average(np.logaddexp(0, logits / t) - truth * logits / t, weights=weight[apart]))
            self.temperature = min(np.exp(np.linspace(-1, 3, 81)), key=loss)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def _pooler(shared: Broadcast):
    def pool(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([pooled(x, shared.value).tolist() for x in texts])

    return F.pandas_udf(pool, "array<double>")


def _scorer(shared: Broadcast):
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors, network = shared.value
        for texts in batches:
            yield pd.Series(network.probability(np.stack([pooled(x, vectors) for x in texts])) if len(texts) else [], dtype="float64")

    return F.pandas_udf(score, "double")


class Quality:
    """Word vectors, network and temperature learned from docs(doc_id, text) and labels(doc_id, quality)."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        sc = docs.sparkSession.sparkContext
        docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        vectors = word_vectors(docs)
        usable = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
        # about TRAIN_ROWS keys at most, so the sample may be broadcast
        shares = {r["quality"]: min(1.0, 0.95 * TRAIN_ROWS / 2 / r["n"]) for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
        drawn = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000))
        sample = usable.where(F.coalesce(*[F.when(F.col("quality") == k, drawn < int(v * 1_000_000)) for k, v in shares.items()], F.lit(False)))
        rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", _pooler(sc.broadcast(vectors))("text").alias("x")).toPandas().sort_values("doc_id")
        self._score = None
        if rows["quality"].nunique() == 2:
            weight = 1 / rows["quality"].map(shares).to_numpy(float)
            network = Network(np.array(rows["x"].tolist()), rows["quality"].to_numpy(float), weight / weight.mean())
            self._score = _scorer(sc.broadcast((vectors, network)))

    def score(self, text: Column) -> Column:
        return self._score(text.cast("binary")) if self._score else F.lit(0.5)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = Quality(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
