"""Whitening of embeddings by block Lanczos on their covariance, which is never formed.

Each entry c becomes the integer x = floor(scale * c) + shift, so that sums are exact. A pass over all
vectors multiplies the covariance V with a block of directions Q: every task adds up (x - S/n) times
(x - S/n)'Q, where n * x - S is exact, and the tasks' blocks are summed by their entries. The driver holds
only the basis, which is bounded by the dimension and by `basis` columns, never a vector of the table.

Block Lanczos with full reorthogonalisation: each new block is made orthogonal, twice, to all directions
before it. Where directions break down, since the space found so far is invariant, random ones restart it.
Ritz pairs come from the projection on the whole basis; the pairs asked for are accepted when their
residuals are below `tolerance` times the largest eigenvalue, and still are after one random block more, or
when the basis spans the space. A full basis is cut back to its leading Ritz vectors (thick restart).

The trace of V is the mean of the exact deviations, so shares explained need no other eigenvalue.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries take no part. Of
several dimensions the most frequent one is taken, the larger one of ties; other rows take no part.
Entries are held within 2^53 after scaling. Directions without variance (below `FLAT` of the largest
eigenvalue) give no component, so equal or single vectors give no row. Repeated rows count and are
returned as often as they are there; a null id is an id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, freeing, small_batches, written

SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues below this share of the largest one count as none.
FLAT = 1e-11
#: Rows taken at once in a task.
ROWS = 1024


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = 16, basis: int = 512, tolerance: float = 1e-13, seed: int = 11, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric d x d matrix that `times` multiplies with."""
    rng = np.random.default_rng(seed)
    k = min(k, d)
    block, basis = min(block, d), max(basis, k + 2 * block)
    q, vq = np.zeros((d, 0)), np.zeros((d, 0))
    new, probed = _directions(rng.standard_normal((d, block)), q, rng, block), False
    for _ in range(most):
        product = times(new)
        q, vq = np.hstack([q, new]), np.hstack([vq, product])
        projected = q.T @ vq
        values, within = np.linalg.eigh((projected + projected.T) / 2)
        values, within = values[::-1], within[:, ::-1]
        m = q.shape[1]
        residuals = np.linalg.norm((vq @ within - q @ within * values)[:, :k], axis=0)
        good = m >= k and residuals.max() <= tolerance * max(values[0], 0)
        if m == d or good and probed:
            return values[:k], np.linalg.qr(q @ within[:, :k])[0]
        probed = good
        new = _directions(rng.standard_normal((d, block)) if good else product, q, rng, min(block, d - m))
        if m + block > basis:  # thick restart: the leading Ritz vectors, whose products are known and whose residuals lie in the new block
            keep = within[:, : k + block]
            q, vq = q @ keep, vq @ keep
    raise ArithmeticError(f"residuals stay above {tolerance} of the largest eigenvalue after {most} passes")


def _directions(wanted: np.ndarray, q: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """Up to `most` orthonormal directions, orthogonal to q: of `wanted` as far as it reaches, else random ones."""
    scale = np.linalg.norm(wanted, axis=0).max(initial=0)
    found = np.zeros((len(wanted), 0))
    for column in wanted.T:
        if found.shape[1] < most:
            found = _appended(found, column, q, 1e-10 * scale)
    while found.shape[1] < most:  # breakdown
        found = _appended(found, rng.standard_normal(len(wanted)), q, 1e-6)
    return found


def _appended(found: np.ndarray, column: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    for _ in range(2):
        for known in (q, found):
            column = column - known @ (known.T @ column)
    size = np.linalg.norm(column)
    if not size > least:
        return found
    column = column / size
    for known in (q, found):  # once more, at unit length
        column = column - known @ (known.T @ column)
    return np.column_stack([found, column / np.linalg.norm(column)])


def _blocks(batch: pa.RecordBatch, d: int):
    """Row numbers and integer vectors of a batch, some rows at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _spread(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they suffice, else in Python's integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, s)) < 1 << 62:
        return x * n - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def _squares(spread: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exactly, as decimal(38, 0); null beyond."""
    if spread.dtype != object and int(np.abs(spread).max(initial=0)) ** 2 * spread.shape[1] < 1 << 62:
        return pa.array((spread * spread).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
    totals = [sum(int(v) ** 2 for v in row) for row in spread]
    return pa.array([Decimal(t) if t < 10**38 else None for t in totals], pa.decimal128(38, 0))


def _summed(x: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], d: int) -> np.ndarray:
    """The sum over all rows of a matrix that `of_rows` gives for some of them."""

    @freeing
    def run(batches: Batches) -> Batches:
        total = np.zeros(shape)
        for batch in batches:
            for _, rows in _blocks(batch, d):
                total += of_rows(rows)
        i, j = (a.ravel() for a in np.indices(shape))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "j", "value"])

    found = x.select("x").mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toPandas()
    out = np.zeros(shape)
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["value"].to_numpy()
    return out


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part, before the dimension is settled."""
    own = vectors.select("vec_id", F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0)
    own = own.where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)))
    held = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(1 << 53))), F.lit(-float(1 << 53)))).cast("long") + shift)
    return own.select("vec_id", held.alias("x"))


WHITENED = "vec_id long, n long, deviation decimal(38,0), component int, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, vector: str = "embedding", block: int = 16, basis: int = 512, tolerance: float = 1e-13) -> DataFrame:
    """One row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    small_batches(spark)
    x = written(integers(vectors, vector).withColumn("vec_id", F.col("vec_id").cast("long")))
    common = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], WHITENED)
    if common is None:
        return empty
    d, n = common["d"], common["count"]
    x = x.where(F.size("x") == d)

    @freeing
    def add_up(batches: Batches) -> Batches:
        total = np.zeros(d, object)
        for batch in batches:
            for _, rows in _blocks(batch, d):
                for at in range(0, len(rows), 256):  # 256 entries of up to 2^54 stay within 64 bits
                    total = total + rows[at : at + 256].sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    summed = x.select("x").mapInArrow(add_up, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    s = [int(r["s"]) for r in sorted(summed, key=lambda r: r["i"])]

    def centred(rows: np.ndarray) -> np.ndarray:
        return (_spread(rows, n, s) / n).astype(np.float64)

    def times(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def of_rows(rows: np.ndarray) -> np.ndarray:
            c = centred(rows)
            return c.T @ (c @ shared.value)

        product = _summed(x, of_rows, q.shape, d) / n
        shared.unpersist()
        return product

    values, directions = lanczos(times, d, components, block, basis, tolerance)
    k = int(np.count_nonzero(values > FLAT * max(values[0], 0)))
    if k == 0:
        return empty
    values = values[:k]
    shared = spark.sparkContext.broadcast(directions[:, :k] / np.sqrt(values))

    def moments(rows: np.ndarray) -> np.ndarray:
        """Of whitened rows: products of each two components, sums, and the sum of deviations over n squared."""
        c = centred(rows)
        w = c @ shared.value
        out = np.zeros((k + 2, k))
        out[:k], out[k], out[k + 1, 0] = w.T @ w, w.sum(0), (c * c).sum()
        return out

    found = _summed(x, moments, (k + 2, k), d) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = values / found[k + 1, 0]

    @freeing
    def project(batches: Batches) -> Batches:
        for batch in batches:
            for part, rows in _blocks(batch, d):
                spread = _spread(rows, n, s)
                w = (spread / n).astype(np.float64) @ shared.value
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), _squares(spread), lists], ["vec_id", "deviation", "whitened"])

    rows = x.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation decimal(38,0), whitened array<double>")
    rows = rows.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("component", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in explained])
    return rows.withColumn("explained", shares[F.col("component")]).select("vec_id", "n", "deviation", (F.col("component") + 1).alias("component"), "whitened", "explained", F.lit(error).alias("identity_error"))
