"""Clusters and the index over their cells."""

import duckdb
import numpy as np
import pytest
from colloquy.operators.clusters import UNIT, argument_clusters, assigned, build_index, cluster_spread, fit, indexed_nearest, probed, units
from colloquy.operators.vectors import nearest


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "post_id long, embedding array<double>")


def blobs(n, centres, d=24, noise=0.25, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centres, d))
    return [(i, base[i % centres] + noise * rng.standard_normal(d)) for i in range(n)]


def plain(rows, cells, rounds):
    """Spherical k-means, one vector at a time."""
    import hashlib

    q = {i: [int(np.sign(x) * np.floor(abs(x) / np.sqrt((np.array(v) ** 2).sum()) * UNIT + 0.5)) for x in v] for i, v in rows}
    c = [q[i] for i in sorted(q, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:cells]]
    for _ in range(rounds):
        cell = {i: max(range(len(c)), key=lambda k: (sum(a * b for a, b in zip(q[i], c[k], strict=True)), -k)) for i in q}
        for k in range(len(c)):
            own = [q[i] for i in q if cell[i] == k]
            if own:
                s = np.sum(np.array(own, np.int64), 0).astype(float)
                c[k] = [int(x) for x in np.sign(s) * np.floor(np.abs(s) / np.sqrt((s * s).sum()) * UNIT + 0.5)]
    return c


def test_equal_to_a_plain_loop_whatever_the_partitions(spark):
    rows = blobs(120, 5, d=6)
    expected = plain(rows, 7, 4)
    for parts in (1, 5):
        assert fit(units(frame(spark, rows).repartition(parts)), 7, 4)[0].tolist() == expected


def test_mean_similarity_never_falls(spark):
    rng = np.random.default_rng(3)
    for rows in (blobs(400, 9), [(i, rng.standard_normal(12)) for i in range(400)]):
        history = fit(units(frame(spark, rows)), 8, 12)[1]
        assert len(history) > 1 and all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False))


def test_distances_equal_sql_over_the_written_centroids(spark):
    rows = blobs(150, 6)
    own = units(frame(spark, rows))
    centroids = fit(own, 6)[0]
    found = assigned(own, centroids).toPandas()
    duck = duckdb.connect()
    import pandas as pd

    c = pd.DataFrame({"cell": range(len(centroids)), "c": [list(map(float, x)) for x in centroids]})  # noqa: F841
    v = pd.DataFrame({"post_id": [i for i, _ in rows], "v": [list(map(float, x)) for _, x in rows]})  # noqa: F841
    best = duck.sql("select post_id, min(1 - list_cosine_similarity(v, c)) as distance, arg_max(cell, list_cosine_similarity(v, c)) as cell from v, c group by 1").df().set_index("post_id")
    for r in found.itertuples():
        assert abs(best.loc[r.post_id, "distance"] - r.distance) < 1e-5 and best.loc[r.post_id, "cell"] == r.cell


def test_odd_vectors_and_kinds(spark):
    odd = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [float("inf")] * 24), (904, [1.0]), (905, [])]
    rows = blobs(60, 3, noise=0.01) + [(950, -blobs(1, 3)[0][1])]
    found = {r.post_id: r for r in argument_clusters(frame(spark, rows + odd), 3).collect()}
    assert set(found) == {i for i, _ in rows} and found[0].kind == "echo" and found[950].kind == "novel"
    assert argument_clusters(frame(spark, [])).collect() == []


def test_spread_over_categories(spark):
    clusters = spark.createDataFrame([(i, 0) for i in range(10)] + [(i, 1) for i in range(10, 20)], "post_id long, cell int")
    names = ["social", "news", "academic", "policy", "nonprofit"]
    posts = spark.createDataFrame([(i, names[i % 5] if i < 10 else "blog") for i in range(20)], "post_id long, category string")
    assert {r.cell: (r.posts, r.categories, r.multiplier) for r in cluster_spread(clusters, posts).collect()} == {0: (10, 5, 1.2), 1: (10, 1, 0.7)}


@pytest.mark.parametrize("noise, share", [(0.35, 0.15), (0.6, 0.35)])
def test_index_finds_nearly_all_with_few_products(spark, tmp_path, noise, share):
    """Held against the exact search: recall and the share of all products that it takes."""
    vectors = frame(spark, blobs(3000, 60, noise=noise))
    asked = vectors.where("post_id % 100 = 0")
    index = build_index(vectors, str(tmp_path / "index"))
    assert sum(index.members.values()) == 3000
    exact = {(r.query_id, r.post_id) for r in nearest(asked, vectors, 5).collect()}
    found = indexed_nearest(asked, index, 5).collect()
    assert len({(r.query_id, r.post_id) for r in found} & exact) >= 0.95 * len(exact) == 0.95 * 150
    products = sum(index.members.get(r.cell, 0) for r in probed(asked, index).select("cell").collect())
    assert products <= share * 30 * 3000


def test_index_over_all_cells_is_exact(spark, tmp_path):
    vectors = frame(spark, blobs(500, 7) + [(1000 + i, v) for i, v in blobs(20, 7)])
    asked = vectors.where("post_id % 50 = 0")
    index = build_index(vectors, str(tmp_path / "index"), cells=6)
    keys = ("query_id", "rank", "post_id")
    assert sorted(tuple(r[k] for k in keys) for r in indexed_nearest(asked, index, 4, margin=4.0).collect()) == sorted(tuple(r[k] for k in keys) for r in nearest(asked, vectors, 4).collect())


def test_recall_on_the_given_vectors(spark):
    """Those are spread evenly over all directions, so the margin opens about half of the cells."""
    import os

    from colloquy.registry import QUERIES

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    exact, found = ({(r.query_id, r.post_id) for r in QUERIES[n](spark, folder).collect()} for n in ("similar_posts_topk", "similar_posts_indexed"))
    assert len(exact & found) >= 0.95 * len(exact)


def test_chunks_follow_the_cells(spark, tmp_path, monkeypatch):
    """Small cells share a chunk and large ones are cut, so that a query goes to no more chunks than hold its cells."""
    from colloquy.operators import clusters as C

    assert C.chunks_of({0: 3, 1: 4, 2: 25, 3: 1, 5: 9, 6: 2}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 5: (4, 1), 6: (5, 1)}
    assert C.chunks_of({}) == {}
    rows = blobs(900, 9) + [(5000 + i, blobs(1, 9)[0][1]) for i in range(300)]  # one large group of copies
    vectors = frame(spark, rows)
    asked = vectors.where("post_id % 50 = 0")
    monkeypatch.setattr(C, "chunks_of", lambda members, size=64, plain=C.chunks_of: plain(members, 64))
    index = build_index(vectors, str(tmp_path / "index"))
    stored = spark.read.parquet(index.folder)
    assert stored.count() == 1200 == sum(index.members.values())
    chunks = {r.chunk: r.n for r in stored.groupBy("chunk").agg({"*": "count"}).toDF("chunk", "n").collect()}
    assert len(chunks) <= 2 * 1200 / 64 + 1 and max(chunks.values()) < 128
    dealt = C._dealt(C._looking(asked, index, 0.42), index, 1).collect()
    assert len({(r.post_id, r.chunk) for r in dealt}) == len(dealt) <= 24 * len(chunks)
    keys = ("query_id", "rank", "post_id")
    monkeypatch.setattr(C, "BLOCK_VECTORS", 7)  # several blocks of queries
    found = indexed_nearest(asked, index, 4, margin=4.0).collect()
    assert sorted(tuple(r[k] for k in keys) for r in found) == sorted(tuple(r[k] for k in keys) for r in nearest(asked, vectors, 4).collect())


def test_index_of_odd_and_no_vectors(spark, tmp_path):
    odd = frame(spark, [(900, None), (901, [0.0] * 24), (904, [1.0]), *blobs(3, 1)])
    index = build_index(odd, str(tmp_path / "odd"))
    assert {(r.query_id, r.post_id) for r in indexed_nearest(odd, index, 5).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert indexed_nearest(frame(spark, []), build_index(frame(spark, []), str(tmp_path / "none")), 5).collect() == []
