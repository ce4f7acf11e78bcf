"""Vectors: embedding stand-in, upsert, nearest posts and novelty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..catalog import query
from ..functions import values
from ..functions.text import with_relevance
from ..sources.tables import embeddings, posts

DIMENSION = 64
#: Asked vectors of a block and vectors of a chunk, about.
BLOCK_VECTORS, CHUNK_VECTORS = 8_192, 16_384


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Offline stand-in for an embedding model: a hashed bag of words of unit length. A real model
    would be loaded where the generator starts, once for each worker."""
    import zlib

    for batch in texts:
        out = []
        for text in batch:
            v = np.zeros(DIMENSION, np.float32)
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                v[h % DIMENSION] += 1 if h & 0x10000 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        yield pd.Series(out)


@query("embed_text_stub")
def embed_text_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of relevant posts only: the gate stands before the model, through which filters don't pass."""
    gated = with_relevance(posts(spark, sf_dir)).where(F.col("relevance") >= model.GATE_RELEVANCE)
    return gated.select("post_id", embed("content").alias("embedding"))


@query("embedding_usage_tokens", "select job_id, count(*) as texts, sum(words)::bigint as tokens from tokenized group by job_id")
def embedding_usage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words charged to each job."""
    from ..functions.text import word_count

    return posts(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("texts"), F.sum(word_count(F.col("content"))).alias("tokens"))


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key; new rows win over old ones of the same version."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_rn", last).where("_rn = 1").drop("_rn", "_new")


@query("embedding_upsert", "select vec_id as post_id, case when vec_id % 2 = 0 then 'v2' else 'v1' end as model_name from embeddings")
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = embeddings(spark, sf_dir).select("post_id", F.lit("v1").alias("model_name"), F.lit(1).alias("version"))
    new = embeddings(spark, sf_dir).where("post_id % 2 = 0").select("post_id", F.lit("v2").alias("model_name"), F.lit(2).alias("version"))
    return upserted(old, new, "post_id", "version").select("post_id", "model_name")


def _closest(asked: pd.DataFrame, chunk: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k most similar vectors of a chunk for each asked one; ties (to six decimals) go to the smaller id."""
    if asked.empty or chunk.empty:
        return pd.DataFrame({"query_id": [], "post_id": [], "similarity": []}).astype({"query_id": "int64", "post_id": "int64", "similarity": "float64"})
    q, v = (np.array(x["embedding"].tolist(), np.float64).reshape(len(x), -1) for x in (asked, chunk))
    q, v = (x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, 1.0) for x in (q, v))
    ids, names = chunk["post_id"].to_numpy(), asked["post_id"].to_numpy()
    found = []
    for low in range(0, len(q), 256):  # a bounded share of the similarities at once
        near = q[low : low + 256] @ v.T
        near[names[low : low + 256, None] == ids[None, :]] = -np.inf
        shown = np.round(near, 6)
        for i, row in enumerate(shown):
            at = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
            at = at[np.isfinite(row[at])]
            at = at[np.lexsort((ids[at], -row[at]))[:k]]
            found.append(pd.DataFrame({"query_id": names[low + i], "post_id": ids[at], "similarity": near[i][at]}))
    return pd.concat(found)


def nearest(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k most similar other posts of each asked one, exactly. Asked ones are dealt to blocks and vectors to chunks
    of bounded size; each pair of a block and a chunk is one product of matrices that keeps k rows for an asked one.
    Vectors of different dimension don't compare; null vectors take no part."""
    asked, vectors = (df.where("embedding is not null").select("post_id", "embedding", F.size("embedding").alias("dim")) for df in (asked, vectors))
    blocks, chunks = max(1, -(-asked.count() // BLOCK_VECTORS)), max(1, -(-vectors.count() // CHUNK_VECTORS))
    left = asked.withColumn("block", F.pmod(F.xxhash64("post_id"), F.lit(blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = vectors.withColumn("chunk", F.pmod(F.xxhash64("post_id", F.lit(1)), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # both may come from one table

    def closest(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        return _closest(one, other, k)

    pairs = left.groupBy("dim", "block", "chunk").cogroup(right.groupBy("dim", "block", "chunk")).applyInPandas(closest, "query_id long, post_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "post_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


@query(
    "similar_posts_topk_hundredths",
    "select query_id, rank, post_id, similarity from (select q.vec_id as query_id, v.vec_id as post_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as similarity, "
    "row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.vec_id)::integer as rank from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0) where rank <= 5",
)
@query(
    "similar_posts_topk",
    "select query_id, rank, post_id, similarity from (select q.vec_id as query_id, v.vec_id as post_id, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) as similarity, "
    "row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) desc, v.vec_id)::integer as rank from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0) where rank <= 5",
)
def similar_posts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of every post whose id is divisible by 100; registered under two names."""
    all_ = embeddings(spark, sf_dir)
    return nearest(all_.where("post_id % 100 = 0"), all_, 5).select("query_id", "rank", "post_id", F.round("similarity", 6).alias("similarity"))


def novelty(vectors: DataFrame) -> DataFrame:
    """Cosine distance from the label's centroid: over 0.4 is novel, under 0.15 an echo."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    rows = vectors.join(centroids, "label").withColumn("distance", 1 - values.cosine(F.col("embedding"), F.col("centroid")))
    kind = F.when(F.col("distance") > model.NOVEL_ABOVE, "novel").when(F.col("distance") < model.ECHO_BELOW, "echo").otherwise("usual")
    return rows.select("post_id", "label", "distance", kind.alias("kind"))


@query(
    "novelty_vs_centroid",
    "select post_id, label, round(distance, 5) as distance, case when distance > 0.4 then 'novel' when distance < 0.15 then 'echo' else 'usual' end as kind from (select vec_id as post_id, e.label, 1 - list_cosine_similarity(embedding::double[], centroid) as distance from embeddings e join "
    "(select label, list(x order by i) as centroid from (select label, i, avg(x::double) as x from (select label, unnest(range(len(embedding))) as i, unnest(embedding) as x from embeddings) group by 1, 2) group by 1) c on e.label = c.label)",
)
def novelty_vs_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty(embeddings(spark, sf_dir)).withColumn("distance", F.round("distance", 5))
