"""Argument clusters by distributed spherical k-means, and an inverted file of vectors over its cells.

Vectors are brought to unit length and then to integers (2^20 is one), so that products and sums are
exact: a run gives the same cells whatever the partitions, and SQL can follow it. The first centroids are
the vectors with the smallest digests of their ids. A round is one pass: every task assigns its vectors to
the nearest centroid and adds them up by cell; the tasks' sums meet in one aggregate of as many rows as
there are cells times dimensions. Only centroids come to the driver and are broadcast: `cells` of them.

Vectors that are null, of length zero or not finite take no part; of several dimensions the most frequent
one counts (the larger one of ties). Ties of similarity go to the smaller cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..sources.shared import shared_base, written
from ..sources.tables import embeddings, posts
from .vectors import BLOCK_VECTORS, CHUNK_VECTORS

#: Integer length of a unit vector. Products of two stay below 2^41, exact in double precision too.
UNIT = 1 << 20
CLUSTERS, ROUNDS = 12, 8

# Spread over categories, and what it does to constructiveness.
SPREAD_HIGH, SPREAD_LOW, MULTIPLIER_HIGH, MULTIPLIER_LOW = 0.6, 0.2, 1.2, 0.7


def units(vectors: DataFrame, *keep: str) -> DataFrame:
    """post_id and q (array of long): the vectors that take part, at unit length, and the columns to keep."""
    own = vectors.where(F.col("embedding").isNotNull()).select("post_id", *keep, F.col("embedding").cast("array<double>").alias("v"))
    own = own.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where(f"norm > 0 and norm < double('infinity')")
    common = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common["d"] if common else 0
    return own.where(F.size("v") == d).select("post_id", *keep, F.transform("v", lambda x: F.round(x / F.col("norm") * UNIT).cast("long")).alias("q"))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def _assigned(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest cell of each row and the integer product with it."""
    products = q @ centroids.T
    cell = products.argmax(1)
    return cell, products[np.arange(len(q)), cell].astype(np.int64)


def fit(rows: DataFrame, cells: int, rounds: int = ROUNDS) -> tuple[np.ndarray, list[float]]:
    """Centroids (integers, cells x dimension; fewer where there are fewer vectors) and the mean similarity before each round."""
    spark = rows.sparkSession
    start = rows.orderBy(F.md5(F.col("post_id").cast("string")), "post_id").limit(cells).collect()
    centroids, history = np.array([r["q"] for r in start], np.float64), []
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(centroids)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            sums, more = np.zeros(own.shape, np.int64), np.zeros((len(own), 2), np.int64)
            for batch in batches:
                if batch.num_rows:
                    q = _matrix(batch, "q")
                    cell, product = _assigned(q, own)
                    np.add.at(sums, cell, q.astype(np.int64))
                    np.add.at(more, cell, np.stack([np.ones_like(product), product >> 10], 1))
            table = np.hstack([sums, more])
            c, i = (a.ravel() for a in np.indices(table.shape))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(table.ravel())], ["cell", "i", "s"])

        found = rows.select("q").mapInArrow(add_up, "cell int, i int, s long").groupBy("cell", "i").agg(F.sum("s").alias("s")).toPandas()
        table = np.zeros((len(centroids), centroids.shape[1] + 2))
        table[found["cell"], found["i"]] = found["s"]
        sums, members = table[:, :-2], table[:, -2]
        history.append(float(table[:, -1].sum() * 1024 / UNIT**2 / members.sum()))
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        moved = np.where(length > 0, np.sign(sums) * np.floor(np.abs(sums) / np.maximum(length, 1) * UNIT + 0.5), centroids)
        shared.unpersist()
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids.astype(np.int64), history


def assigned(rows: DataFrame, centroids: np.ndarray, *keep: str) -> DataFrame:
    """The rows of `units` with their cell and its distance, 1 less the cosine, and the columns to keep."""
    if not len(centroids):
        return rows.select("post_id", *keep, "q", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("double").alias("distance"))
    shared = rows.sparkSession.sparkContext.broadcast(centroids.astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, product = _assigned(_matrix(batch, "q"), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(1 - product / UNIT**2)], ["post_id", *keep, "q", "cell", "distance"])

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(F.col("post_id").cast("long").alias("post_id"), *keep, "q").mapInArrow(run, f"post_id long, {kinds}q array<long>, cell int, distance double")


def argument_clusters(vectors: DataFrame, cells: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """post_id, cell, distance and kind (novel, usual, echo) of each vector, by its nearest centroid."""
    rows = units(vectors)
    kind = F.when(F.col("distance") > model.NOVEL_ABOVE, "novel").when(F.col("distance") < model.ECHO_BELOW, "echo").otherwise("usual")
    return assigned(rows, fit(rows, cells, rounds)[0]).select("post_id", "cell", "distance", kind.alias("kind"))


def cluster_spread(clusters: DataFrame, categories: DataFrame) -> DataFrame:
    """Of each cell: its posts, the categories they come from, the share of all categories, and the multiplier of echo chambers and bridges."""
    by = clusters.join(categories.select("post_id", "category"), "post_id").groupBy("cell").agg(F.count("*").alias("posts"), F.count_distinct("category").alias("categories"))
    spread = F.col("categories") / len(model.CATEGORIES)
    multiplier = F.when(spread > SPREAD_HIGH, MULTIPLIER_HIGH).when(spread < SPREAD_LOW, MULTIPLIER_LOW).otherwise(1.0)
    return by.select("cell", "posts", "categories", F.round(spread, 6).alias("spread"), multiplier.alias("multiplier"))


def _kmeans_sql(cells: int, rounds: int) -> str:
    """The rounds written out, as integer arithmetic."""
    parts = [
        f"sized as (select vec_id as post_id, embedding::double[] as v, sqrt(list_inner_product(embedding::double[], embedding::double[])) as norm from embeddings where embedding is not null)",
        f"u as materialized (select post_id, list_transform(v, lambda x: round(x / norm * {UNIT})) as q from sized where norm > 0 and isfinite(norm))",
        f"c0 as materialized (select (row_number() over (order by md5(post_id::varchar), post_id) - 1)::integer as cell, q as c from u order by md5(post_id::varchar), post_id limit {cells})",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"a{r} as materialized (select post_id, q, cell, product from (select u.post_id, u.q, c.cell, list_inner_product(u.q, c.c) as product, "
            f"row_number() over (partition by u.post_id order by list_inner_product(u.q, c.c) desc, c.cell) as rn from u, c{r} c) where rn = 1)"
        )
        if r < rounds:
            parts.append(f"s{r} as (select cell, i, sum(q[i]) as s from a{r}, unnest(range(1, len(q) + 1)) as t(i) group by cell, i)")
            parts.append(
                f"c{r + 1} as materialized (select cell, list(sign(s) * floor(abs(s) / norm * {UNIT} + 0.5) order by i) as c from (select *, sqrt(sum(s * s) over (partition by cell)) as norm from s{r}) group by cell "
                f"union all select cell, c from c{r} where cell not in (select cell from a{r}))"
            )
    return "with " + ", ".join(parts) + f", clusters as (select post_id, cell, 1 - product / {float(UNIT) ** 2} as distance from a{rounds})"


def _register(name: str, tail: str):
    """A query whose SQL begins with the rounds of k-means rather than with the derived tables."""
    from ..catalog import ORACLES

    def register(f):
        query(name)(f)
        ORACLES[name] = f"{_kmeans_sql(CLUSTERS, ROUNDS)} {tail}"
        return f

    return register


@_register("argument_novelty", "select post_id, cell, round(distance, 6) as distance, case when distance > 0.4 then 'novel' when distance < 0.15 then 'echo' else 'usual' end as kind from clusters")
def argument_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post's argument cluster and how far it lies from its centroid."""
    return argument_clusters(embeddings(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


@_register(
    "argument_spread",
    ", placed as (select cell, ['social', 'news', 'academic', 'policy', 'nonprofit', 'developer', 'blog'][substr(source, 4)::int % 7 + 1] as category from clusters join documents on doc_id = post_id) "
    "select cell, count(*) as posts, count(distinct category) as categories, round(count(distinct category) / 7, 6) as spread, "
    "(case when count(distinct category) / 7 > 0.6 then 1.2 when count(distinct category) / 7 < 0.2 then 0.7 else 1.0 end)::double as multiplier from placed group by cell",
)
def argument_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echo chambers and bridges: over how many categories of sources each argument cluster spreads."""
    return cluster_spread(argument_clusters(embeddings(spark, sf_dir)), posts(spark, sf_dir))


#: Vectors of the sample that cells are fitted on, for each cell; cells of an index at most.
SAMPLE_PER_CELL, MOST_CELLS = 256, 4096
#: A query looks into the cells whose angle is at most this much (radians) wider than that of its nearest one.
MARGIN = 0.42


class CellIndex:
    """An inverted file: all vectors, stored by chunk and cell, and the cells' centroids; `chunks` has of each cell its
    first chunk and how many it is cut into."""

    def __init__(self, folder: str, centroids: np.ndarray, members: dict[int, int], chunks: dict[int, tuple[int, int]]):
        self.folder, self.centroids, self.members, self.chunks = folder, centroids, members, chunks


def chunks_of(members: dict[int, int], size: int = CHUNK_VECTORS) -> dict[int, tuple[int, int]]:
    """First chunk and number of chunks of each cell: small cells share one of about `size` vectors, larger ones are cut."""
    found, chunk, room = {}, -1, 0
    for cell, n in sorted(members.items()):
        if n > room:
            chunk, room = chunk + 1, size
        parts = max(1, -(-n // size))
        found[cell] = (chunk, parts)
        if parts > 1:
            chunk, room = chunk + parts - 1, 0
        room -= n if parts == 1 else 0
    return found


def build_index(vectors: DataFrame, folder: str, cells: int | None = None, rounds: int = ROUNDS) -> CellIndex:
    """Every vector that takes part, written to `folder` by its chunk and cell.

    Cells (about the square root of the vectors, `MOST_CELLS` at most) are fitted on a sample of about
    `SAMPLE_PER_CELL` vectors each, chosen by a hash of their ids. A cell may hold any number of rows: chunks
    are of bounded size, whatever the cells', and there are about as many as the vectors ask for.
    """
    spark = vectors.sparkSession
    rows = written(units(vectors.withColumn("post_id", F.col("post_id").cast("long")).where("post_id is not null"), "embedding"))
    n = rows.count()
    cells = cells or int(min(MOST_CELLS, max(1, n**0.5)))
    share = cells * SAMPLE_PER_CELL / max(1, n)
    sample = rows if share >= 1 else written(rows.where(F.pmod(F.xxhash64(F.lit(77), "post_id"), F.lit(1_000_000_007)) < F.lit(share * 1_000_000_007)).select("post_id", "q"))
    centroids = fit(sample, cells, rounds)[0]
    placed = written(assigned(rows, centroids, "embedding").select("post_id", "embedding", "cell"))
    members = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    chunks = chunks_of(members)
    table = spark.createDataFrame([(cell, *own) for cell, own in chunks.items()], "cell int, first int, parts int")
    chunk = (F.col("first") + F.pmod(F.xxhash64("post_id"), F.col("parts"))).cast("int").alias("chunk")
    dealt = placed.join(F.broadcast(table), "cell").select("post_id", "embedding", chunk, "cell")
    dealt.repartition("chunk").sortWithinPartitions("chunk", "cell").write.parquet(folder)
    return CellIndex(folder, centroids, members, chunks)


def _looking(asked: DataFrame, index: CellIndex, margin: float) -> DataFrame:
    """post_id, embedding and the cells that each query looks into; cells are a few thousand, so all angles are computed."""
    shared = asked.sparkSession.sparkContext.broadcast(index.centroids.astype(np.float64))
    rows = units(asked.withColumn("post_id", F.col("post_id").cast("long")).where("post_id is not null"), "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angles = np.arccos(np.clip(_matrix(batch, "q") @ shared.value.T / UNIT**2, -1, 1))
                near = [np.flatnonzero(a <= a.min() + margin).astype(np.int32) for a in angles]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.list_(pa.int32()))], ["post_id", "embedding", "cells"])

    return rows.select("post_id", "embedding", "q").mapInArrow(run, f"post_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, cells array<int>")


def probed(asked: DataFrame, index: CellIndex, margin: float = MARGIN) -> DataFrame:
    """post_id, embedding and each cell that the query looks into."""
    return _looking(asked, index, margin).select("post_id", "embedding", F.explode("cells").alias("cell"))


def _dealt(looking: DataFrame, index: CellIndex, blocks: int) -> DataFrame:
    """Each query once for each chunk that holds one of its cells, with those of its cells that lie there."""
    shared = looking.sparkSession.sparkContext.broadcast(index.chunks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts = np.full(max(shared.value, default=0) + 1, -1), np.zeros(max(shared.value, default=0) + 1, np.int64)
        for cell, (start, n) in shared.value.items():
            first[cell], parts[cell] = start, n
        step = max(1, 50_000 // max(1, len(set(first.tolist()))))  # queries at once, each of which may go to all chunks
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                lists = batch.column(2)
                row, cells = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                row, cells = row[cells < len(first)], cells[cells < len(first)]
                times = parts[cells]
                chunks = np.repeat(first[cells] - np.cumsum(times) + times, times) + np.arange(times.sum())
                row, cells = np.repeat(row, times), np.repeat(cells, times)
                order = np.lexsort((cells, chunks, row))
                row, chunks, cells = row[order], chunks[order], cells[order]
                starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(chunks, prepend=-1) != 0))
                at = pa.array(row[starts])
                own = pa.ListArray.from_arrays(pa.array([*starts, len(row)], pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(chunks[starts], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), own], ["chunk", "post_id", "embedding", "cells"])

    kind = looking.schema["embedding"].dataType.simpleString()
    dealt = looking.mapInArrow(run, f"chunk int, post_id long, embedding {kind}, cells array<int>")
    return dealt.withColumn("block", F.pmod(F.xxhash64("post_id"), F.lit(blocks)).cast("int"))


def _rows(table: pa.Table) -> np.ndarray:
    """Embeddings at unit length."""
    v = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float64)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1.0)


def _best(row: np.ndarray, ids: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the k best of each row stand, and their places in it; ties (to six decimals) go to the smaller id."""
    order = np.lexsort((ids, -np.round(near, 6), row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[place < k], place[place < k]


def _within(asked: pa.Table, chunk: pa.Table, k: int) -> pa.Table:
    """The k most similar vectors among those of a chunk that lie in each query's cells."""
    names, ids = asked["post_id"].to_numpy(), chunk["post_id"].to_numpy()
    best, near = np.full((len(names), k), -1), np.full((len(names), k), -np.inf)
    if len(names) and len(ids):
        q, v = _rows(asked), _rows(chunk)
        lists = asked["cells"].combine_chunks()
        who, wants = np.repeat(np.arange(len(names)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        by_want, by_cell = np.argsort(wants, kind="stable"), np.argsort(chunk["cell"].to_numpy(), kind="stable")
        who, wants = who[by_want], wants[by_want]
        cells, starts = np.unique(chunk["cell"].to_numpy()[by_cell], return_index=True)
        for cell, start, end in zip(cells, starts, [*starts[1:], len(ids)], strict=True):
            members = by_cell[start:end]
            asking = who[slice(*np.searchsorted(wants, [cell, cell + 1]))]
            for i in range(0, len(asking), 256):  # a bounded share of the similarities at once
                own = asking[i : i + 256]
                found = q[own] @ v[members].T
                found[names[own][:, None] == ids[members]] = -np.inf
                bound = near[own].min(1) - 2e-6  # room for the rounding that orders them
                if len(members) > k:
                    reach = np.flatnonzero(found.max(1) >= bound)
                    bound[reach] = np.maximum(bound[reach], np.partition(found[reach], -k, 1)[:, -k] - 2e-6)
                at, to = np.nonzero((found >= bound[:, None]) & np.isfinite(found))
                if len(at):
                    rows = np.unique(own[at])
                    row, other, value = np.concatenate([np.repeat(rows, k), own[at]]), np.concatenate([best[rows].ravel(), members[to]]), np.concatenate([near[rows].ravel(), found[at, to]])
                    row, other, value = row[other >= 0], other[other >= 0], value[other >= 0]
                    kept, place = _best(row, ids[other], value, k)
                    best[row[kept], place], near[row[kept], place] = other[kept], value[kept]
    row, place = np.nonzero(best >= 0)
    return pa.table({"query_id": pa.array(names[row], pa.int64()), "post_id": pa.array(ids[best[row, place]], pa.int64()), "similarity": pa.array(near[row, place])})


def indexed_nearest(asked: DataFrame, index: CellIndex, k: int, margin: float = MARGIN) -> DataFrame:
    """query_id, rank, post_id and similarity of the k most similar other posts among the probed cells, compared exactly.

    A query goes once to each chunk that holds one of its cells, and each chunk once to every block of queries; their
    vectors are multiplied cell by cell, and only k rows of a query leave a chunk.
    """
    spark = asked.sparkSession
    blocks = max(1, -(-asked.count() // BLOCK_VECTORS))
    left = _dealt(_looking(asked, index, margin), index, blocks)
    stored = spark.read.parquet(index.folder).select("chunk", "cell", "post_id", "embedding").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def closest(one: pa.Table, other: pa.Table) -> pa.Table:
        return _within(one, other, k)

    pairs = left.groupBy("block", "chunk").cogroup(stored.groupBy("block", "chunk")).applyInArrow(closest, "query_id long, post_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 6)), "post_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "post_id", "similarity")


@query("similar_posts_indexed")
def similar_posts_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five neighbours of every post whose id is divisible by 100, by the index over all posts."""
    import uuid

    all_ = embeddings(spark, sf_dir)
    index = build_index(all_, f"{shared_base(spark)}/vector-index-{uuid.uuid4().hex}")
    return indexed_nearest(all_.where("post_id % 100 = 0"), index, 5).withColumn("similarity", F.round("similarity", 6))
