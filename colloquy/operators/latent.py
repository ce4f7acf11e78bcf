"""Embeddings learned from the posts: hashed TF-IDF and its leading singular directions by a randomised range finder.

A text is a row of 4,096 hashed word features, weighed by (1 + ln tf) * idf and brought to unit length. The
matrix of all texts is never built: each pass over them multiplies blocks of rows with a thin matrix of
4,096 x 72 that is broadcast, and adds the products up. Two passes turn a random start towards the leading
directions, the last one takes the QR of each block and folds the small factors of all blocks into one, so
singular values come from the texts themselves and not from their squares. What the driver holds is of the
thin matrix's size, however many texts there are.

Texts that are null, or hold no word, are refused: they take no part in the fit and get no vector (`refused`
lists them). Repeated rows count as often as they occur. A corpus of lower rank gives vectors of as many dimensions as its
rank; one without words gives none. Sums of doubles depend on partitions in their last digits only, and each
direction points to where its largest entry is positive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions.text import has_tokens, tokens, with_relevance
from ..sources.shared import checkpointed
from ..sources.tables import posts
from .vectors import nearest

#: Features (three digits of a hexadecimal digest), directions kept, directions carried besides, passes before the last.
FEATURES, DIMENSIONS, SPARE, PASSES = 16**3, 64, 8, 2
#: Rows of a dense block, features of a slice of sums, and partial results that one group folds.
BLOCK, SLICE, FAN = 256, 256, 256
#: Directions whose singular value is a smaller share of the largest are rounding errors.
LEAST_SHARE = 1e-9


def feature(word: str) -> int:
    """The feature of a word, 0 to 4,095."""
    return int(hashlib.md5(word.encode()).hexdigest()[:3], 16)


def featured(rows: DataFrame, text: str = "content") -> DataFrame:
    """post_id and features (one for each word, in order) of the rows whose text holds a word. Digests are taken of the distinct words of a batch only."""
    own = rows.where(has_tokens(F.col(text))).select("post_id", tokens(F.col(text)).alias("words"))
    kind = own.schema["post_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            flat = words.flatten().dictionary_encode()
            numbers = np.fromiter(map(feature, flat.dictionary.to_pylist()), np.int16, len(flat.dictionary))
            ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers[flat.indices.to_numpy()], pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["post_id", "features"])

    return own.mapInArrow(run, f"post_id {kind}, features array<smallint>")


def refused(rows: DataFrame, text: str = "content") -> DataFrame:
    """post_id of the rows that get no vector."""
    return rows.where(~has_tokens(F.col(text))).select("post_id")


def document_frequencies(features: DataFrame) -> DataFrame:
    """feature and df, how many rows hold it: 4,096 rows at most."""
    return features.select(F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))


def _blocks(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their rows of weights, at most `BLOCK` dense rows at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(low, BLOCK)
            own = piece.column(piece.schema.get_field_index("features"))
            row = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
            at = row * FEATURES + own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.bincount(at, minlength=len(own) * FEATURES)
            hit = np.flatnonzero(counts)
            row, w = hit // FEATURES, (1 + np.log(counts[hit])) * idf[hit % FEATURES]
            weights = np.zeros(len(own) * FEATURES)
            weights[hit] = w / np.sqrt(np.bincount(row, w * w, minlength=len(own)))[row]
            yield piece, weights.reshape(len(own), FEATURES)


def _folded(rows: DataFrame, fold: Callable[[list[np.ndarray]], np.ndarray], width: int) -> dict[int, np.ndarray]:
    """One matrix for each `part` out of all tasks' (part, task, data): groups of tasks first, then the groups."""

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")
        out = fold([np.frombuffer(x).reshape(-1, width) for x in frame["data"]])
        return pd.DataFrame({"part": frame["part"].iloc[:1], "task": frame["task"].iloc[:1] // FAN, "data": [np.ascontiguousarray(out).tobytes()]})

    schema = "part int, task int, data binary"
    some = rows.groupBy("part", F.floor(F.col("task") / FAN)).applyInPandas(together, schema)
    found = some.groupBy("part").applyInPandas(together, schema).collect()
    return {r["part"]: np.frombuffer(r["data"]).reshape(-1, width) for r in found}


def _record(part: int, matrix: np.ndarray) -> pa.RecordBatch:
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([np.ascontiguousarray(matrix).tobytes()], pa.binary())], ["part", "task", "data"])


def _turned(features: DataFrame, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """AᵀA times the directions: each task adds up its blocks, and slices of features are summed over the tasks."""
    width = directions.shape[1]
    shared = features.sparkSession.sparkContext.broadcast((idf, directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_idf, own = shared.value
        total = np.zeros_like(own)
        for _, rows in _blocks(batches, own_idf):
            total += rows.T @ (rows @ own)
        for low in range(0, FEATURES, SLICE):
            if total[low : low + SLICE].any():
                yield _record(low // SLICE, total[low : low + SLICE])

    parts = _folded(features.select("features").mapInArrow(run, "part int, task int, data binary"), lambda many: np.sum(many, axis=0), width)
    shared.destroy()
    out = np.zeros_like(directions)
    for part, sums in parts.items():
        out[part * SLICE : part * SLICE + len(sums)] = sums
    return out


def _triangle(features: DataFrame, idf: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """R of the QR of A times the directions, out of the QRs of blocks, tasks and groups of tasks."""
    width = directions.shape[1]
    shared = features.sparkSession.sparkContext.broadcast((idf, directions))

    def factor(many: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(many), mode="r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_idf, own = shared.value
        r = np.zeros((0, width))
        for _, rows in _blocks(batches, own_idf):
            r = factor([r, rows @ own])
        if len(r):
            yield _record(0, r)

    parts = _folded(features.select("features").mapInArrow(run, "part int, task int, data binary"), factor, width)
    shared.destroy()
    return parts.get(0, np.zeros((0, width)))


@dataclass
class Latent:
    """What a fit learned: idf of each feature, directions (features x dimensions) and their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    singular: np.ndarray

    @property
    def name(self) -> str:
        return f"latent-{self.directions.shape[1]}"

    def embedded(self, rows: DataFrame, text: str = "content") -> DataFrame:
        """post_id and embedding (floats, unit length) of the rows that aren't refused. Words in none of the
        directions give a vector of zeros, which is similar to nothing."""
        shared = rows.sparkSession.sparkContext.broadcast((self.idf, self.directions))
        own = featured(rows, text)
        kind = own.schema["post_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, directions = shared.value
            for piece, weights in _blocks(batches, idf):
                v = weights @ directions
                length = np.sqrt((v * v).sum(1, keepdims=True))
                v = np.where(length > 1e-12, v / np.maximum(length, 1e-12), 0.0).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], ["post_id", "embedding"])

        return own.mapInArrow(run, f"post_id {kind}, embedding array<float>")

    def branch(self) -> Callable[[DataFrame], DataFrame]:
        """The embedding branch of the ingest stream with this model."""
        return lambda passed: self.embedded(passed).withColumn("model_name", F.lit(self.name))

    def request(self, texts: list[str]) -> list[list[float]]:
        """Vectors of a small list of texts on the driver's session, in order; an empty list, or a text without words, is a ValueError."""
        if not texts:
            raise ValueError("the input must be a list that isn't empty")
        spark = SparkSession.getActiveSession()
        found = {r["post_id"]: list(r["embedding"]) for r in self.embedded(spark.createDataFrame(list(enumerate(texts)), "post_id int, content string")).collect()}
        if empty := [i for i in range(len(texts)) if i not in found]:
            raise ValueError(f"no words in texts {empty}")
        return [found[i] for i in range(len(texts))]

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as one small table: a row for each feature, and one (feature -1) with the singular values."""
        rows = [(-1, 0.0, self.singular.tolist()), *((i, float(w), d.tolist()) for i, (w, d) in enumerate(zip(self.idf, self.directions, strict=True)))]
        spark.createDataFrame(rows, "feature int, idf double, direction array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Latent:
        first, *rest = spark.read.parquet(path).orderBy("feature").collect()
        singular = np.array(first["direction"])
        return Latent(np.array([r["idf"] for r in rest]), np.array([r["direction"] for r in rest]).reshape(FEATURES, len(singular)), singular)


def fit(rows: DataFrame, dimensions: int = DIMENSIONS, passes: int = PASSES, text: str = "content") -> Latent:
    """Learns from all the rows."""
    features = checkpointed(featured(rows, text).select("features"))
    n, df = features.count(), np.zeros(FEATURES)
    for r in document_frequencies(features).collect():
        df[r["feature"]] = r["df"]
    idf = np.log((1 + n) / (1 + df)) + 1
    width = min(dimensions + SPARE, FEATURES)
    if not n:
        return Latent(idf, np.zeros((FEATURES, 0)), np.zeros(0))
    directions = np.linalg.qr(np.random.default_rng(7).standard_normal((FEATURES, width)))[0]
    for _ in range(passes):
        directions = np.linalg.qr(_turned(features, idf, directions))[0]
    _, singular, turn = np.linalg.svd(_triangle(features, idf, directions), full_matrices=False)
    kept = int((singular[:dimensions] > LEAST_SHARE * singular[0]).sum())
    found = directions @ turn[:kept].T
    found *= np.sign(found[np.abs(found).argmax(0), np.arange(kept)])
    return Latent(idf, found, singular[:kept])


@query(
    "hashed_tfidf",
    ", words_of as (select post_id, unnest(toks) as word from tokenized), tf as (select post_id, ('0x' || left(md5(word), 3))::int as feature, count(*) as tf from words_of group by 1, 2), "
    f"df as (select feature, count(*) as df from tf group by 1), n as (select count(distinct post_id) as n from tf), weighed as (select post_id, feature, tf, (1 + ln(tf)) * (ln((1 + n)::double / (1 + df)) + 1) as w from tf join df using (feature), n) "
    "select post_id, count(*) as features, sum(tf)::bigint as words, round(sqrt(sum(w * w)), 5) as length, round(max(w), 5) as heaviest from weighed group by post_id",
)
def hashed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features and words a post has, the length of its row of weights before it is brought to one, and the heaviest weight.
    The frequencies of all features, at most 4,096, are joined by broadcast."""
    own = checkpointed(featured(posts(spark, sf_dir)))
    n = own.select("post_id").distinct().count()
    tf = own.select("post_id", F.explode("features").alias("feature")).groupBy("post_id", "feature").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(document_frequencies(own)), "feature").withColumn("w", (1 + F.log("tf")) * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    return weighed.groupBy("post_id").agg(
        F.count("*").alias("features"), F.sum("tf").alias("words"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 5).alias("length"), F.round(F.max("w"), 5).alias("heaviest")
    )


@query("latent_embeddings")
def latent_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the posts that pass the relevance gate, by a model that learned from all posts."""
    every = posts(spark, sf_dir)
    gated = with_relevance(every).where(F.col("relevance") >= model.GATE_RELEVANCE)
    return fit(every).embedded(gated)


@query("latent_neighbours")
def latent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five posts closest in content to every post whose id is divisible by 100, by learned vectors."""
    every = posts(spark, sf_dir)
    vectors = checkpointed(fit(every).embedded(every))
    return nearest(vectors.where("post_id % 100 = 0"), vectors, 5).select("query_id", "rank", "post_id", F.round("similarity", 6).alias("similarity"))
