"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are quantised to integers and grouped by length: candidates go to buckets of similar norm
(equal norms are dealt over neighbouring buckets) and there to chunks of bounded size. A first pass
takes each query's k-th best score among a chunk of the longest vectors, which no final score can be
below. With it a query knows the norm that a candidate must have at least. Queries are dealt to blocks
by that norm, so a block and a chunk whose longest vector is too short never meet: such pairs go
before anything is shuffled.

Inside a pair, the chunk knows for each query the cosine that a candidate must reach to count: over
1, the whole chunk is skipped; otherwise it prunes by length (candidates, in order of falling norm,
end where norms alone fail) when the needed cosine is low, or by coordinate (the query's largest
coordinates bound those of any candidate with that cosine) when it is high. What remains is verified
with exact integer products. Each chunk returns at most k rows for a query.

Defined results: vectors that are null or hold a null or a component that is not finite once scaled
take no part. Vectors of different dimension don't compare. A query never meets its own row; repeated
rows of one id are different rows, of which the one in hand is left out. Ties go to the smaller id,
then rows alike. Null ids take no part. Other columns are ignored. Products beyond 2^53 are computed
with Python's integers; scores beyond 64 bits take the nearest 64-bit integer.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .common import Batches, freeing

#: Vectors of a chunk and queries of a block at most, about; norm buckets.
CHUNK, BLOCK, BUCKETS = 16_384, 16_384, 8
#: From this cosine on, coordinates prune better than lengths; so many coordinates are tried.
COORDINATE_FROM, COORDINATES = 0.6, 4
#: What rounding may do to a bound; it must never prune.
SLACK = 1e-6
#: Pairs of a block and a chunk that are broadcast at most (8 bytes each).
BROADCAST_PAIRS = 500_000
COLUMNS = ("query_id", "query_row", "vec_id", "score")
RESULT = "query_id long, query_row long, vec_id long, score long"


def _usable(df: DataFrame, is_query: Column, scale: int) -> DataFrame:
    """vec_id, asked, row, dim, norm and v (quantised components, as doubles) of vectors that take part."""
    wide = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.monotonically_increasing_id().alias("place"), F.col("embedding").cast("array<double>").alias("x"))
    wide = wide.where("vec_id is not null and x is not null")

    @freeing
    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            row = np.repeat(np.arange(len(sizes)), sizes)
            fine = np.ones(len(sizes), bool)
            fine[row[~np.isfinite(values)]] = False
            ends = np.cumsum(sizes)
            with np.errstate(over="ignore", invalid="ignore"):
                norms = np.sqrt(np.bincount(row, values * values, len(sizes)))
            kept = np.flatnonzero(fine)
            vectors = [values[ends[i] - sizes[i] : ends[i]].tobytes() for i in kept.tolist()]
            own = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(sizes[kept]), pa.array(norms[kept]), pa.array(vectors, pa.binary())], ["vec_id", "asked", "place", "dim", "norm", "v"])

    found = wide.mapInArrow(run, "vec_id long, asked boolean, place long, dim long, norm double, v binary")
    return found.withColumn("row", F.xxhash64("vec_id", "place")).drop("place")


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows, whose components are integers; beyond 64 bits the nearest that fits."""
    q, v = (np.abs(m).max(initial=0) for m in (queries, vectors))
    if float(q) * float(v) * max(1, queries.shape[1]) < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in vectors] for x in queries]
    return np.array([[max(-(2**63), min(2**63 - 1, s)) for s in row] for row in exact], dtype=np.int64).reshape(len(queries), len(vectors))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if len(values) and len(values.iloc[0]) else np.zeros((len(values), 0))


def best_of_chunk(queries: pd.DataFrame, chunk: pd.DataFrame, k: int, tally: Counter | None = None) -> pd.DataFrame:
    """Up to k best candidates in the chunk for each query; queries carry floor, their score's lower bound.

    `tally` counts the products taken (verified) and all that there could have been (pairs).
    """
    if queries.empty or chunk.empty:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in COLUMNS})
    out: list[tuple[np.ndarray, ...]] = []
    chunk = chunk.sort_values("norm", ascending=False)
    ids, rows, norms = chunk["vec_id"].to_numpy(), chunk["row"].to_numpy(), chunk["norm"].to_numpy()
    vectors, wanted = _matrix(chunk["v"]), _matrix(queries["v"])
    with np.errstate(invalid="ignore"):
        unit = vectors / np.maximum(norms, 1e-9)[:, None]
    lengths, floors = queries["norm"].to_numpy(), queries["floor"].to_numpy(np.float64)
    names, own_rows = queries["vec_id"].to_numpy(), queries["row"].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(lengths > 0, floors / (lengths * max(norms[0], 1e-9)), -np.inf)
    cosine = np.where(np.isnan(cosine), -np.inf, cosine)
    if tally is not None:
        tally["pairs"] += len(queries) * len(ids)
    for i in np.flatnonzero(cosine <= 1 + SLACK):
        near = np.arange(len(ids))
        if 0 < floors[i] and lengths[i] > 0:
            near = near[: np.searchsorted(-norms, -(floors[i] / lengths[i] * (1 - SLACK) - SLACK), side="right")]
            if cosine[i] >= COORDINATE_FROM and len(near):
                # a unit vector p with p.q >= t has, in coordinate f, q_f t -+ sqrt((1 - q_f^2)(1 - t^2)) as bounds
                q = wanted[i] / lengths[i]
                needed = floors[i] / (lengths[i] * np.maximum(norms[near], 1e-9))
                t = np.minimum(1.0, needed * (1 - SLACK))
                for f in np.argsort(-np.abs(q))[:COORDINATES]:
                    spread = np.sqrt(np.maximum(0, (1 - q[f] ** 2) * (1 - t**2)))
                    low = np.where(q[f] < -t, -1.0, q[f] * t - spread) - SLACK
                    high = np.where(q[f] > t, 1.0, q[f] * t + spread) + SLACK
                    fits = (unit[near, f] >= low) & (unit[near, f] <= high)
                    near, t = near[fits], t[fits]
        near = near[~((ids[near] == names[i]) & (rows[near] == own_rows[i]))]
        if not len(near):
            continue
        if tally is not None:
            tally["verified"] += len(near)
        score = products(wanted[i : i + 1], vectors[near])[0]
        if not np.isnan(floors[i]):
            near, score = near[score >= floors[i]], score[score >= floors[i]]
        first = np.lexsort((ids[near], ~score))[:k]  # ~score falls as the score rises, without overflow
        out.append((np.full(len(first), names[i]), np.full(len(first), own_rows[i]), ids[near][first], score[first]))
    if not out:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in COLUMNS})
    return pd.DataFrame({c: np.concatenate([o[j] for o in out]) for j, c in enumerate(COLUMNS)})


def _dealt(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value exceeds."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: value > c)) if cuts else F.lit(0)


def _spread(value: Column, seed: int) -> Column:
    """`value` moved by less than a millionth of itself, by a hash of the row, so that equal values can be cut apart."""
    return value * (1 + F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1_000_003)) * 1e-12)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows for each row for which `is_query` holds."""
    base = checkpointed(_usable(vectors, is_query, scale))
    counted = base.groupBy("dim").agg(F.count("*").alias("n"), F.percentile_approx(_spread(F.col("norm"), 0), [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("cuts"), F.count_if("asked").alias("q"))
    parts = []
    for size in counted.where("q > 0").collect():  # a row for each dimension
        own = base.where(F.col("dim") == size["dim"]).drop("dim")
        chunks = max(1, -(-size["n"] // (BUCKETS * CHUNK)))
        blocks = max(1, -(-size["q"] // BLOCK))
        chunked = own.drop("asked").withColumn("chunk", _dealt(_spread(F.col("norm"), 0), size["cuts"]) * chunks + F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
        asked = own.where("asked").drop("asked")
        # a chunk of the longest vectors bounds every query's k-th score from below
        some = asked.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("floor", F.lit(None).cast("double"))
        seeds = chunked.where(F.col("chunk") == (BUCKETS - 1) * chunks).drop("chunk").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        floor = _best(some.withColumn("chunk", F.lit(0)), seeds.withColumn("chunk", F.lit(0)), k)
        rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
        floor = floor.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
        parts.append(_best(*_met(asked.join(floor, ["vec_id", "row"], "left"), chunked, blocks), k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(asked: DataFrame, chunked: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates, each copied to those pairs of a block and a chunk in which norms alone allow a result."""
    need = F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.col("floor") / F.col("norm") * (1 - SLACK) - SLACK).otherwise(0.0)
    asked = checkpointed(asked.withColumn("need", need))
    cuts = asked.agg(F.percentile_approx(_spread(F.col("need"), 2), [i / blocks for i in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else []
    asked = asked.withColumn("block", _dealt(_spread(F.col("need"), 2), cuts or []))
    easiest = asked.groupBy("block").agg(F.min("need").alias("need"))
    longest = chunked.groupBy("chunk").agg(F.max("norm").alias("longest"))
    # one row for each block and chunk: numbers of them, not of vectors
    pairs = longest.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(easiest, "block").where("longest >= need").select("block", "chunk")
    pairs = checkpointed(pairs)
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    left, right = asked.drop("need").join(pairs, "block"), chunked.join(pairs, "chunk")
    return tuple(df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # both come from one table


def _best(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """What each chunk of candidates has for each block of queries."""

    def run(queries: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        return best_of_chunk(queries, chunk, k)

    return left.groupBy(F.col("block"), F.col("chunk")).cogroup(right.groupBy(F.col("block"), F.col("chunk"))).applyInPandas(run, RESULT)
