"""Quality: votes of the nearest labelled documents in a latent semantic space.

A text's terms are its words, the shapes of its tokens (kinds of characters, in order), neighbouring
shapes, and how often its words and word triples come again. Each of these families is weighted by the
square root of its terms' frequencies and has unit length, so that no text's length and no family prevails.
A truncated singular value decomposition of labelled documents' terms gives `DIMENSIONS` latent
directions; any text is a unit vector along them.

The labelled vectors are broadcast. Every document is compared with all of them, in blocks of exact cosine
products, and the labels of its `NEIGHBOURS` nearest ones are averaged by powers of their similarity. As
labels are drawn by class, a vote also weighs as many labels of its class as it stands for.

The labelled documents are a bounded sample: about `per_class` of each label, by a hash of their ids, and
fewer where their terms would exceed `max_bytes`. What is broadcast is bounded by that and by 2^BITS terms.
Every whole text is scored.

Defined results: null text is empty. An empty text, or one without a term in common with any labelled one,
gets the labelled rows' share of label 1; without any label the score is 0. Labels that are null take no
part; of several labels of one id the largest counts. Ties of similarity go to the vectors first in the
order of their hash. Repeated rows and ids are scored row by row. Other columns are carried along; one that
has the name of the result (`quality`, unless another is given) is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, freeing, mixed, place_of, share_below, small_batches, windows, written

BITS, DIMENSIONS = 15, 64
#: Labelled vectors that vote, and the power of their similarity that weighs a vote.
NEIGHBOURS, POWER = 24, 4
#: Documents compared with all labelled vectors at once.
BLOCK = 256
#: Families of terms: words, shapes, pairs of shapes, repetition.
FAMILIES = 4
#: Runs of the same kind of character become one sign, others are written as they are, twice at most.
KINDS = [(re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa"), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"(.)\1+", re.S), lambda m: m[1] * 2)]


def shape(word: str) -> str:
    """The kinds of a word's characters in their order, with the size of the word: `Aa,`, `a$$`."""
    out = word
    for pattern, sign in KINDS:
        out = pattern.sub(sign, out)
    return f"{out[:12]} {min(len(word).bit_length(), 6)}"


class Words(dict):
    """Hashes of words and of their shapes, remembered up to a limit."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = (xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape(word), seed=1))
        return value


def terms(text: str | None, known: Words) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of a text's terms, each family within its own quarter of 2^BITS, and their weights."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    both = np.array(list(map(known.__getitem__, words)), np.uint64)
    own, shapes = both[:, 0], both[:, 1]
    n = len(words)
    threes = windows(own, (0, 1, 2))
    again = np.array([n - len(np.unique(own)), len(np.unique(own)), len(threes) - len(np.unique(threes)), len(np.unique(threes))]) / np.array([n, n, max(1, len(threes)), max(1, len(threes))])
    index, weight = [], []
    for family, values in enumerate((own, shapes, windows(shapes, (0, 1)))):
        if len(values):
            at, times = np.unique(mixed(values) >> np.uint64(64 - BITS + 2), return_counts=True)
            index.append(at.astype(np.int64) + (family << (BITS - 2)))
            weight.append(np.sqrt(times / len(values)))
    index.append(np.arange(4) + (3 << (BITS - 2)))
    weight.append(np.sqrt(again / 2))
    return np.concatenate(index), np.concatenate(weight).astype(np.float32)


@dataclass
class Model:
    """Latent directions of terms, unit vectors of labelled documents, their labels, and how many labels each stands for."""

    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors of the rows, or zero where they have nothing in common with any labelled one."""
        out = np.zeros((len(rows), self.directions.shape[1]), np.float32)
        for r, (at, weight) in enumerate(rows):
            out[r] = weight @ self.directions[at]
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(size > 1e-6, out / np.maximum(size, 1e-6), 0).astype(np.float32)

    def votes(self, vectors: np.ndarray) -> np.ndarray:
        """Scores of unit vectors: each is compared with every labelled one."""
        share = float(self.labels @ self.stands_for / self.stands_for.sum())
        out = np.full(len(vectors), share)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(vectors), BLOCK):
            close = vectors[i : i + BLOCK] @ self.vectors.T
            least = np.partition(close, -k, axis=1)[:, -k]
            for r in np.flatnonzero(vectors[i : i + BLOCK].any(1)):
                near = np.flatnonzero(close[r] >= least[r])
                near = near[np.argsort(-close[r][near], kind="stable")][:k]
                weight = np.maximum(close[r][near], 0) ** POWER * self.stands_for[near]
                if weight.sum() > 0:
                    out[i + r] = float(weight @ self.labels[near] / weight.sum())
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, stands_for: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 4) -> Model:
    """Latent directions by subspace iteration on the labelled rows' terms, and the rows along them."""
    index = np.concatenate([at for at, _ in rows]) if rows else np.empty(0, np.int64)
    weight = np.concatenate([w for _, w in rows]).astype(np.float64) if rows else np.empty(0)
    row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
    used, column = np.unique(index, return_inverse=True)
    by_column = np.argsort(column, kind="stable")

    def product(keys: np.ndarray, others: np.ndarray, values: np.ndarray, dense: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, dense.shape[1]))
        for i in range(0, len(keys), 65_536):
            own = keys[i : i + 65_536]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            out[own[starts]] += np.add.reduceat(dense[others[i : i + 65_536]] * values[i : i + 65_536, None], starts)
        return out

    size = min(dimensions, len(rows), len(used))
    basis = np.linalg.qr(np.random.default_rng(13).standard_normal((len(used), size)))[0] if size else np.zeros((len(used), 0))
    for _ in range(rounds if size else 0):
        along = product(row, column, weight, basis, len(rows))
        basis = np.linalg.qr(product(column[by_column], row[by_column], weight[by_column], along, len(used)))[0]
    directions = np.zeros((1 << BITS, size), np.float32)
    directions[used] = basis
    model = Model(directions, np.zeros((0, size), np.float32), labels.astype(np.float64), stands_for.astype(np.float64))
    model.vectors = model.latent(rows)
    return model


MODEL = "part string, data binary"


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = 2_000, max_bytes: int = 64 << 20) -> DataFrame:
    """The model's parts, from labelled rows for which `learn` holds."""
    small_batches(docs.sparkSession)
    labels = labels.where("quality is not null and doc_id is not null").where(learn).groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label"))
    count = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, F.lit(per_class / max(1, count.get(1, 0)))).otherwise(F.lit(per_class / max(1, count.get(0, 0))))
    chosen = labels.where(share_below(F.col("doc_id"), share))

    @freeing
    def of_texts(batches: Batches) -> Batches:
        known = Words()
        for batch in batches:
            found = [terms(t.as_py(), known) for t in batch.column(1)]
            own = [at.astype(np.int32).tobytes() + w.tobytes() for at, w in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary()), batch.column(2)], ["doc_id", "terms", "label"])

    def learned(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.argsort([xxhash.xxh64_intdigest(t, seed=5) for t in frame["terms"]], kind="stable")]
        rows = [(np.frombuffer(t, np.int32, len(t) // 8).astype(np.int64), np.frombuffer(t, np.float32, offset=len(t) // 2)) for t in frame["terms"]]
        own = frame["label"].to_numpy(np.int64)
        drawn = {c: max(1, int((own == c).sum())) for c in (0, 1)}
        model = fit(rows, own, np.array([count.get(c, 0) / drawn[c] for c in own]))
        parts = {"directions": model.directions, "vectors": model.vectors, "labels": model.labels, "stands_for": model.stands_for}
        return pd.DataFrame({"part": list(parts), "data": [np.ascontiguousarray(a).tobytes() for a in parts.values()]})

    # one task learns; what it reads is bounded in rows by `per_class`, and in bytes
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    drawn = written(rows.mapInArrow(of_texts, "doc_id long, terms binary, label int"))
    total = drawn.agg(F.sum(F.octet_length("terms"))).first()[0] or 0
    within = drawn.where(share_below(F.xxhash64("doc_id"), F.lit(max_bytes / max(1, total))))
    return written(within.groupBy(F.lit(0).alias("one")).applyInPandas(learned, MODEL))


def loaded(model: DataFrame) -> Model | None:
    parts = {r["part"]: bytes(r["data"]) for r in model.collect()}
    if not parts.get("labels"):
        return None
    labels, stands_for = (np.frombuffer(parts[p], np.float64) for p in ("labels", "stands_for"))
    vectors = np.frombuffer(parts["vectors"], np.float32).reshape(len(labels), -1)
    return Model(np.frombuffer(parts["directions"], np.float32).reshape(1 << BITS, -1), vectors, labels, stands_for)


def score(docs: DataFrame, model: DataFrame, name: str = "quality") -> DataFrame:
    """`docs` with a column (0 to 1) of that name, from whole texts."""
    spark = docs.sparkSession
    docs = docs.drop(name)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(loaded(model))
    place = place_of(docs, "text")

    @freeing
    def run(batches: Batches) -> Batches:
        known = Words()
        for batch in batches:
            values = np.zeros(batch.num_rows)
            if shared.value is not None:
                values = shared.value.votes(shared.value.latent([terms(t.as_py(), known) for t in batch.column(place)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
