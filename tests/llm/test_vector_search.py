import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from colloquy.llm import vector_search
from colloquy.llm.vector_search import best_of_chunk, products, top_k
from pyspark.sql import functions as F


def brute(rows, k=10):
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = []
    for p, (i, v) in enumerate(usable):
        if i % 100 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j) for q, (j, w) in enumerate(usable) if q != p and len(v) == len(w))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, norm int")
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("chunk, spread", [(16_384, 1), (30, 1), (30, 8)])
def test_equal_to_brute_force(spark, monkeypatch, chunk, spread):
    monkeypatch.setattr(vector_search, "CHUNK", chunk)
    monkeypatch.setattr(vector_search, "BLOCK", 3)
    rng = random.Random(chunk + spread)
    rows = []
    for i in range(900):
        base = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.4 else [rng.gauss(0, 1) for _ in range(6)]
        rows.append((i, [x + rng.gauss(0, 0.05) for x in base] if spread == 1 else [x * rng.choice([0.1, 1, spread]) for x in base]))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0, 3.0]), (100, [-1.0, 0.5]), (200, [1e9, 3e9]), (7, [2e9, 1e9]), (300, [])]
    assert run(spark, rows) == brute(rows)
    huge = [(0, [1e306, 1.0]), (8, [1e305, -1e305]), (9, [-1e200, 1e200]), (400, [3e15, 5.0]), (10, [2e15, 7.0]), (11, [1e308, 1.0])]
    assert run(spark, rows + huge) == brute(rows + huge)
    assert run(spark, [(0, [1.0]), (1, None)]) == [] and run(spark, [(1, [1.0])]) == []


@pytest.mark.parametrize("kind", ["lengths", "coordinates", "far"])
def test_pruning_leaves_out_products_and_no_result(kind):
    """A chunk with local thresholds takes fewer products than there are pairs and gives what all products give."""
    rng = np.random.default_rng(4)
    if kind == "lengths":
        vectors = np.floor(1024 * rng.normal(size=(2_000, 16)) * rng.exponential(size=(2_000, 1)))
    else:
        vectors = np.floor(1024 * (np.eye(16)[rng.integers(0, 16, 2_000)] + rng.normal(size=(2_000, 16)) * 0.03))
    norms = np.sqrt((vectors**2).sum(1))
    chunk = pd.DataFrame({"vec_id": np.arange(2_000), "row": np.arange(2_000), "norm": norms, "v": [v.tobytes() for v in vectors]})
    queries = chunk.iloc[:40].copy()
    every = products(vectors[:40], vectors)
    every[np.arange(40), np.arange(40)] = -(2**60)
    queries["floor"] = np.sort(every, 1)[:, -10].astype(float)
    if kind == "far":
        queries["floor"] = queries["norm"] * norms.max() * 1.01
    tally = Counter()
    found = best_of_chunk(queries, chunk, 10, tally)
    assert tally["pairs"] == 40 * 2_000
    if kind == "far":
        assert tally["verified"] == 0 and found.empty
        return
    assert tally["verified"] < 0.5 * tally["pairs"]
    for i in range(40):
        want = sorted((-s, j) for j, s in enumerate(every[i].tolist()) if j != i)[:10]
        own = found[found["query_id"] == i]
        assert list(zip((-own["score"]).tolist(), own["vec_id"].tolist(), strict=True)) == want


def test_equal_lengths_are_dealt_over_all_buckets(spark):
    """Vectors of one length, as embeddings often are, still fill each bucket, and floors exist at every size."""
    rng = random.Random(2)
    rows = [(i, rng.sample([0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0], 8), 0) for i in range(300)]
    base = vector_search._usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, norm int"), F.col("vec_id") % 100 == 0, 1024)
    cuts = base.agg(F.percentile_approx(vector_search._spread(F.col("norm"), 0), [i / 8 for i in range(1, 8)], 10_000)).first()[0]
    sizes = [r["count"] for r in base.groupBy(vector_search._dealt(vector_search._spread(F.col("norm"), 0), cuts)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 80
    assert run(spark, [r[:2] for r in rows]) == brute([r[:2] for r in rows])
