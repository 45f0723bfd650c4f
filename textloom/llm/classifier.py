"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Every token (a word with its case kept, or a run of punctuation; words that
begin with two capitals count as one token) falls into one of a fixed number
of buckets, and every bucket has a sparse ternary index vector made from a
seed. A bucket's word vector is the sum of the index vectors of all tokens
within the window around its occurrences, its own included, over all
documents, and brought to unit length. A document is the mean of its tokens'
vectors. A network with one hidden layer is fitted to labelled documents, and
a temperature fitted on labelled documents held out from that divides its
logits, so that its probabilities are calibrated.

The network is fitted on at most max_labelled labelled documents, chosen by a
seeded hash of their ids; word vectors are counted over all documents.

Cases: a null or blank text gets probability 0.0 and is rejected. Very long
texts are counted and pooled whole. Repeated rows count and score as often as
they occur; of several rows with a labelled id the network is fitted to the one
whose text has the least hash, so at most max_labelled rows reach the driver; of
repeated labels the lowest counts; null labels and ids are left out. A
probability equal to the threshold is kept. If the labels have fewer than two
classes the network isn't fitted, and every text with tokens gets the share of
good labels (0.5 without labels). An empty table gives no rows. Extra columns,
whatever their names, play no part; keep_documents returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical
from .frames import keep_where, narrow, summed_arrays, trim

BUCKETS, DIMENSIONS, WINDOW, SEED = 1 << 15, 48, 2, 7
MAX_LABELLED = 20_000
#: Low, so that few good documents are lost.
THRESHOLD = 0.25
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 0.01, 1e-4


def index_vectors(buckets: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the place of its +1 and of its -1."""
    rng = np.random.default_rng(seed)
    plus = rng.integers(0, dimensions, buckets)
    return plus, (plus + rng.integers(1, dimensions, buckets)) % dimensions


def token_buckets(texts: lexical.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's bucket and text, and the first token of each text."""
    w = lexical.tokens(texts)
    b = (w.hashes() % np.uint64(buckets - 1)).astype(np.int64) + 1
    capital = (w.codes >= 65) & (w.codes <= 90)
    b[capital[w.starts] & capital[np.minimum(w.starts + 1, len(w.codes) - 1)]] = 0
    return b, w.doc, w.first


def count_contexts(texts: DataFrame, buckets: int, dimensions: int, window: int, seed: int) -> np.ndarray:
    """The sums of index vectors around each bucket's occurrences, over all rows of texts."""
    cells = buckets * dimensions

    def make():
        plus, minus = index_vectors(buckets, dimensions, seed)

        def add(where, near):
            at = where * dimensions
            step.total += np.bincount(at + plus[near], minlength=cells)
            step.total -= np.bincount(at + minus[near], minlength=cells)

        def step(columns):
            rows = columns[0]
            for a, b in lexical.chunks(rows):
                bucket, doc, _ = token_buckets(rows[a:b], buckets)
                here, near = [bucket], [bucket]
                for k in range(1, window + 1):
                    same = doc[k:] == doc[:-k]
                    x, y = bucket[k:][same], bucket[:-k][same]
                    here += [x, y]
                    near += [y, x]
                add(np.concatenate(here), np.concatenate(near))

        step.total = np.zeros(cells, np.int64)
        return step

    return summed_arrays(texts, make, cells).reshape(buckets, dimensions)


def word_vectors(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, dimensions: int = DIMENSIONS, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    sums = count_contexts(narrow(docs, text=text_col), buckets, dimensions, window, seed).astype(np.float64)
    return (sums / np.maximum(np.sqrt((sums**2).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


def pooled(texts: lexical.Texts, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean vector and the number of tokens of each text."""
    means, sizes = np.zeros((len(texts), vectors.shape[1]), np.float32), np.zeros(len(texts), np.int64)
    for a, b in lexical.chunks(texts):
        bucket, _, first = token_buckets(texts[a:b], len(vectors))
        sizes[a:b] = n = np.diff(first)
        for i in np.flatnonzero(n):
            means[a + i] = vectors.take(bucket[first[i] : first[i + 1]], 0).sum(0) / n[i]
    return means, sizes


@dataclass
class Network:
    """Standardised inputs, a hidden layer of tanh units, a logit and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    #: Used in place of the network where it isn't fitted.
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = SEED, hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network:
    """Adam on four fifths of the rows; the temperature on the other fifth."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    d = x.shape[1]
    if len(np.unique(y)) < 2:
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    net = Network(x[own].mean(0), x[own].std(0) + 1e-6, rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - net.mean) / net.scale
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // BATCH)):
            h = np.tanh(z[part] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -60, 60)))
            e = (p - y[part]) / len(part)
            back = np.outer(e, params[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((z[part].T @ back + DECAY * params[0], back.sum(0), h.T @ e + DECAY * params[2], np.array([e.sum()]))):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    net.temperature = fit_temperature(net.logits(x[held]), y[held]) if len(held) else 1.0
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 1/20 to 20 of least log loss, by golden section over its logarithm."""

    def loss(s):
        q = logits / np.exp(s)
        return float(np.mean(np.logaddexp(0, q) - y * q))

    low, high, golden = -np.log(20), np.log(20), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def pooled_column(spark: SparkSession, vectors: np.ndarray):
    shared = spark.sparkContext.broadcast(vectors)

    @F.arrow_udf("array<float>")
    def pool(text: pa.Array) -> pa.Array:
        return pa.array(list(pooled(text, shared.value)[0]), pa.list_(pa.float32()))

    return pool


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED, seed: int = SEED) -> tuple[np.ndarray, Network]:
    """Word vectors of docs and a network fitted to labels (doc_id, quality 0/1)."""
    vectors = word_vectors(docs, text_col, seed=seed)
    known = narrow(labels, id="doc_id", good="quality").where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"))
    # At most max_labelled rows of two numbers, so the broadcast has a fixed bound.
    some = known.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max_labelled)
    every = narrow(docs, id=id_col, text=text_col).join(F.broadcast(some), "id")
    own = every.groupBy("id", "good").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    rows = own.select("id", "good", pooled_column(docs.sparkSession, vectors)("text").alias("x")).toPandas().sort_values("id", kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(len(rows), vectors.shape[1])
    return vectors, fit_network(x, (rows["good"].to_numpy() > 0).astype(float), seed)


def scorer(spark: SparkSession, vectors: np.ndarray, net: Network):
    """A column function: text -> calibrated probability of good quality. Its tables have fixed sizes."""
    shared = spark.sparkContext.broadcast((vectors, net))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        table, network = shared.value
        x, sizes = pooled(text, table)
        trim()
        return pa.array(np.where(sizes > 0, np.round(network.probabilities(x), 6), 0.0), pa.float64())

    return score


def classify_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """A row for each row of docs: doc_id, p_good (rounded to 6 places) and keep."""
    score = scorer(docs.sparkSession, *fit(docs, labels, id_col, text_col, max_labelled, seed))
    own = narrow(docs, doc_id=id_col, text=text_col)
    return own.select("doc_id", score("text").alias("p_good")).withColumn("keep", (F.col("p_good") >= threshold) & (F.col("p_good") > 0))


def keep_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """The rows of docs, with their columns, whose probability reaches the threshold."""
    score = scorer(docs.sparkSession, *fit(docs, labels, id_col, text_col, max_labelled, seed))
    return keep_where(docs, lambda column: score(column(text_col)).between(max(threshold, 1e-9), 1.0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
