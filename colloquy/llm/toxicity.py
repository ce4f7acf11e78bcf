"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of hashed words, neighbouring pairs and pairs one word apart,
lower-cased and without punctuation at their ends. FTRL-proximal gives each coordinate its own
learning rate and holds it at zero until its evidence exceeds the L1 penalty, so the fitted model is
a few thousand (index, weight) pairs, whatever the corpus; these are broadcast for scoring.

The classifier is fitted on a bounded sample of labelled rows: about `max_positive` and
`max_negative` of them, chosen by a hash of their ids, and fewer where their features would exceed
`max_bytes`. The L1 penalty is one fixed value, whatever the sample. Scoring covers every whole text.

Defined results: null text is empty, and an empty text's score is that of the bias alone. Labels
that are null take no part; of several labels of one id the largest counts. Repeated rows and ids
are scored row by row. Without any label the score is 0. Other columns are carried along; one that
has the name of the result (`toxicity`, unless another is given) is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, WordHashes, freeing, place_of, share_below, small_batches, windows, written

BITS = 20
#: Offsets of the words of a feature: words, pairs, pairs one word apart.
SHAPES = ((0,), (0, 1), (0, 2))
EDGES = ".,;:!?'\"()[]{}<>|#$%&*+-=_~/\\`^@"
MODEL = "idx int, weight double"
#: The L1 penalty: a coordinate stays at zero until its summed gradients exceed it.
L1 = 6.0


class TrimmedHashes(WordHashes):
    """Hashes of words without punctuation at their ends."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.strip(EDGES))
        return value


def features(text: str, hashes: TrimmedHashes) -> np.ndarray:
    """The distinct feature indexes of a text."""
    words = hashes.array(text.lower().split())
    found = [windows(words, shape) >> np.uint64(64 - BITS) for shape in SHAPES]
    return np.unique(np.concatenate(found)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss with L1 and L2; the last coordinate is the bias."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = L1, l2: float = 0.0, positive: float = 2.0):
        self.alpha, self.beta, self.l2, self.positive = alpha, beta, l2, positive
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.penalty = np.full((1 << BITS) + 1, l1)
        self.penalty[-1] = 0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], self.penalty[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def update(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label) * (self.positive if label else 1)
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, int]], epochs: int) -> Ftrl:
        bias = np.array([1 << BITS])
        for _ in range(epochs):
            for at, label in rows:
                self.update(np.concatenate([at, bias]), label)
        return self


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_positive: int = 6_000, max_negative: int = 12_000, epochs: int = 4, l1: float = L1, max_bytes: int = 256 << 20) -> DataFrame:
    """The model's non-zero weights, from labelled rows for which `learn` holds; index 2^20 is the bias."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.where("toxic is not null and doc_id is not null").where(learn).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    count = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(max_positive / max(1, count.get(1, 0)))).otherwise(F.lit(max_negative / max(1, count.get(0, 0))))
    chosen = labels.where(share_below(F.col("doc_id"), share))

    @freeing
    def featurize(batches: Batches) -> Batches:
        hashes = TrimmedHashes()
        for batch in batches:
            found = [features(t.as_py() or "", hashes).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "features", "label"])

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort([xxhash.xxh64_intdigest(f, seed=5) for f in frame["features"]], kind="stable")
        rows = [(np.frombuffer(frame["features"].iloc[i], np.int32), int(frame["label"].iloc[i])) for i in order]
        model = Ftrl(l1=l1).fit(rows, epochs)
        weights = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(weights)
        return pd.DataFrame({"idx": at.astype(np.int32), "weight": weights[at]})

    # one task learns; what it reads is bounded in rows by the two maxima, and in bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    featured = written(rows.mapInArrow(featurize, "doc_id long, features binary, label int"))
    total = featured.agg(F.sum(F.octet_length("features"))).first()[0] or 0
    within = featured.where(share_below(F.xxhash64("doc_id"), F.lit(max_bytes / max(1, total))))
    return written(within.groupBy(F.lit(0).alias("one")).applyInPandas(fit, MODEL))


class Scorer:
    """Scores batches of texts with a sparse model."""

    def __init__(self, idx: np.ndarray, weight: np.ndarray):
        self.table = np.zeros(1 << BITS, np.float32)
        inside = idx < (1 << BITS)
        self.table[idx[inside]] = weight[inside]
        self.bias = float(weight[~inside].sum())
        self.known = len(idx) > 0
        self.hashes = TrimmedHashes()

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.known:
            return np.zeros(len(texts))
        split = [(t or "").lower().split() for t in texts]
        sizes = [len(w) for w in split]
        words = self.hashes.array([w for s in split for w in s])
        row = np.repeat(np.arange(len(texts)), sizes)
        pairs = []
        for shape in SHAPES:
            at = (windows(words, shape) >> np.uint64(64 - BITS)).astype(np.int64)
            hit = np.flatnonzero(self.table[at])
            hit = hit[row[hit] == row[hit + shape[-1]]]  # windows across two texts don't count
            pairs.append((row[hit] << BITS) | at[hit])
        seen = np.unique(np.concatenate(pairs))
        total = np.bincount(seen >> BITS, self.table[seen & ((1 << BITS) - 1)], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def score(docs: DataFrame, model: DataFrame, name: str = "toxicity") -> DataFrame:
    """`docs` with a column (0 to 1) of that name, from whole texts. The model, bounded by its 2^20 indexes, is broadcast."""
    spark = docs.sparkSession
    docs = docs.drop(name)
    small_batches(spark)
    found = model.toPandas()
    shared = spark.sparkContext.broadcast((found["idx"].to_numpy(np.int64), found["weight"].to_numpy(np.float64)))
    place = place_of(docs, "text")

    @freeing
    def run(batches: Batches) -> Batches:
        scorer = Scorer(*shared.value)
        for batch in batches:
            values = scorer.scores(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
