import math

import numpy as np
import pytest
from colloquy.llm.whitening import integers, lanczos, whiten


def matrix(values, seed=0):
    u = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return u @ np.diag(values) @ u.T


@pytest.mark.parametrize("values, k, block, basis", [
    (np.linspace(9, 1, 40), 8, 4, 512), (np.linspace(9, 1, 40), 8, 4, 16), ([5.0] * 30, 12, 4, 512), ([7.0, 3.0] + [0.0] * 20, 2, 4, 512),
    ([4.0] * 6 + [2.0] * 6 + list(np.linspace(1, 0.1, 28)), 10, 8, 512), ([1.0], 3, 16, 512), ([1e9, 1e4, 1.0, 0.0], 4, 1, 512), (0.8 ** np.arange(120), 10, 5, 30),
])
def test_lanczos_equals_dense_eigenvalues(values, k, block, basis):
    v = matrix(values)
    passes = []
    found, directions = lanczos(lambda q: (passes.append(1), v @ q)[1], len(v), k, block, basis)
    expected = np.linalg.eigvalsh(v)[::-1][:k]
    assert np.allclose(found, expected, rtol=0, atol=1e-12 * max(1, expected[0]) * len(v))
    assert np.abs(directions.T @ directions - np.eye(len(found))).max() < 1e-12
    assert np.linalg.norm(v @ directions - directions * found, axis=0).max() < 1e-11 * expected[0]


def test_invariant_start_restarts():
    """A matrix of rank one breaks every block down at once; random directions go on."""
    v = np.zeros((50, 50))
    v[0, 0] = 3.0
    found, _ = lanczos(lambda q: v @ q, 50, 4, 2)
    assert abs(found[0] - 3) < 1e-12 and np.abs(found[1:]).max() < 1e-12


def brute(rows, k):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:k] > 1e-11 * e[0]).sum())
    return n, ((n * x.astype(object) - s) ** 2).sum(1), c @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], "vec_id long, embedding array<double>, component int")


@pytest.mark.parametrize("d, n, k", [(12, 400, 5), (40, 300, 32), (6, 50, 32)])
def test_equal_to_dense_whitening(spark, d, n, k):
    rng = np.random.default_rng(d)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((n, d)) * np.linspace(4, 0.5, d) + 3)]
    odd = [(9000, None), (9001, [math.nan] + [0.0] * (d - 1)), (9002, [math.inf] * d), (9003, [None] * d), (9004, []), (9005, [1.0, 2.0])]
    found = whiten(frame(spark, rows + odd), k, block=8).toPandas()
    n_rows, deviations, whitened, explained = brute(rows, k)
    m = whitened.shape[1]
    assert len(found) == n * m and set(found.n) == {n_rows} and set(found.vec_id) == {i for i, _ in rows}
    wide = found.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    sign = np.sign((wide * whitened).sum(0))
    assert np.abs(wide * sign - whitened).max() < 1e-8
    own = found[found.component == 1].sort_values("vec_id")
    assert [int(x) for x in own.deviation] == list(deviations)
    assert np.allclose(found.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-9)
    assert found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9


def test_edges(spark):
    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []
    repeated = whiten(frame(spark, [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [0.0, 2.0])])).collect()
    assert sorted((r.vec_id or -1, r.component) for r in repeated) == [(-1, 1), (1, 1), (1, 1)]
    assert all(abs(r.explained - 1) < 1e-12 for r in repeated)


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(x), float(-x)]) for i, x in enumerate([1e30, 3.0, 5e14, -7.5])]
    held = {r.vec_id: r.x for r in integers(frame(spark, rows)).collect()}
    assert held[0] == [(1 << 53) + 1_000_000, -(1 << 53) + 1_000_000]
    found = whiten(frame(spark, rows))
    n, s = 4, [sum(held[i][j] for i in range(4)) for j in range(2)]
    for r in found.collect():
        assert int(r.deviation) == sum((n * x - t) ** 2 for x, t in zip(held[r.vec_id], s, strict=True))
