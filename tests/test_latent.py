"""Learned embeddings against a dense decomposition of the same table."""

import hashlib
import math

import numpy as np
import pytest
from colloquy.functions.text import has_tokens, tokens
from colloquy.operators import latent
from colloquy.sources.store import Store
from colloquy.streaming.ingest import Ingest
from pyspark.sql import functions as F

SCHEMA = "post_id long, content string, other string"


def corpus(n=300, seed=5):
    """Texts of five subjects with words of their own, and words that all share."""
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"s{i % 5}w{rng.integers(40)}" if rng.random() < 0.7 else f"common{rng.integers(60)}" for _ in range(30 + i % 17)), "x") for i in range(n)]


def dense(texts):
    """The rows of weights, computed plainly."""
    tf = np.zeros((len(texts), latent.FEATURES))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            tf[i, int(hashlib.md5(word.encode()).hexdigest()[:3], 16)] += 1
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1
    weights = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    return weights / np.linalg.norm(weights, axis=1, keepdims=True)


def test_singular_values_and_vectors_equal_the_dense_ones(spark):
    rows = corpus()
    table = dense([r[1] for r in rows])
    _, wanted, right = np.linalg.svd(table, full_matrices=False)
    found = latent.fit(spark.createDataFrame(rows, SCHEMA).repartition(7), dimensions=5, passes=6)
    assert np.allclose(found.singular, wanted[:5], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(found.directions * right[:5].T, axis=0)), 1, atol=1e-4)
    assert np.allclose(found.directions.T @ found.directions, np.eye(5), atol=1e-12)
    again = latent.fit(spark.createDataFrame(rows, SCHEMA).repartition(2), dimensions=5, passes=6)
    assert np.allclose(found.directions, again.directions, atol=1e-9)
    vectors = {r.post_id: np.array(r.embedding) for r in found.embedded(spark.createDataFrame(rows, SCHEMA)).collect()}
    projected = table @ found.directions
    projected /= np.linalg.norm(projected, axis=1, keepdims=True)
    assert max(np.abs(vectors[i] - projected[i]).max() for i in range(len(rows))) < 1e-6


def test_folding_is_the_same_over_many_groups_of_tasks(spark, monkeypatch):
    rows = spark.createDataFrame(corpus(120), SCHEMA)
    one = latent.fit(rows.repartition(12), dimensions=4)
    monkeypatch.setattr(latent, "FAN", 3)
    monkeypatch.setattr(latent, "BLOCK", 5)
    many = latent.fit(rows.repartition(12), dimensions=4)
    assert np.allclose(one.singular, many.singular, rtol=1e-9)


def test_near_copies_are_nearest(spark):
    rows = corpus(400)
    copies = [(1000 + i, rows[i][1] + " edited", "y") for i in (0, 100, 200)]
    table = spark.createDataFrame(rows + copies, SCHEMA)
    vectors = latent.checkpointed(latent.fit(table, dimensions=32).embedded(table))
    found = {r.query_id: (r.post_id, r.similarity) for r in latent.nearest(vectors.where("post_id >= 1000"), vectors, 1).collect()}
    assert {q: p for q, (p, _) in found.items()} == {1000: 0, 1100: 100, 1200: 200} and min(s for _, s in found.values()) > 0.97


def test_odd_tables(spark, tmp_path):
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "?!", "a"), (5, "one word", "a"), (5, "one word", "a"), (None, "no id", "a"), (6, "long " * 300_000, "a")], SCHEMA)
    assert sorted(r.post_id for r in latent.refused(odd).collect()) == [1, 2, 3, 4]
    learned = latent.fit(odd)
    assert len(learned.singular) == 3  # the rank of three different texts
    found = learned.embedded(odd).collect()
    assert sorted(str(r.post_id) for r in found) == ["5", "5", "6", "None"]
    assert all(math.isclose(sum(x * x for x in r.embedding), 1, abs_tol=1e-5) for r in found)
    learned.save(spark, str(tmp_path / "m"))
    loaded = latent.Latent.load(spark, str(tmp_path / "m"))
    assert np.array_equal(loaded.directions, learned.directions) and np.array_equal(loaded.singular, learned.singular) and loaded.name == "latent-3"
    empty = latent.fit(odd.where("post_id < 5"))
    assert len(empty.singular) == 0 and [list(r.embedding) for r in empty.embedded(odd.where("post_id = 6")).collect()] == [[]]


def test_words_are_seen_without_splitting(spark):
    texts = [None, "", " ", "?!", "a", "  . x", "-", "\u00a0", "[\\]", "'", "()[]{}#&%$*|/<>@+=", "\u0130", "\n\t^"]
    rows = spark.createDataFrame(list(enumerate(texts)), "post_id int, content string")
    split = {r.post_id for r in rows.where(F.size(tokens(F.col("content"))) > 0).collect()}
    assert split == {r.post_id for r in rows.where(has_tokens(F.col("content"))).collect()} and 0 < len(split) < len(texts)


def test_requests_refuse_empty_input(spark):
    learned = latent.fit(spark.createDataFrame(corpus(60), SCHEMA), dimensions=8)
    two = learned.request(["s1w3 s1w4", "s2w1 common3"])
    assert len(two) == 2 and len(two[0]) == 8
    with pytest.raises(ValueError):
        learned.request([])
    with pytest.raises(ValueError):
        learned.request(["s1w3", " "])


def test_stream_takes_the_learned_model(spark, tmp_path):
    learned = latent.fit(spark.createDataFrame(corpus(60), SCHEMA), dimensions=8)
    store = Store(spark, str(tmp_path))
    store.migrate()
    passed = spark.createDataFrame([(1, "s1w3 s1w4", "x"), (2, "", "x")], SCHEMA)
    name, table, work = Ingest(store, embed_branch=learned.branch()).branches[0]
    store.append(table, work(passed))
    assert [(r.post_id, r.model_name, len(r.embedding)) for r in store.read("post_embeddings").collect()] == [(1, "latent-8", 8)]


def test_digests_are_taken_of_distinct_words_and_the_text_is_lowered_once(spark):
    """Before, each word was digested where it stood, and a filter on the relevance lowered the text for each keyword."""
    from colloquy.functions.text import with_relevance

    rows = [(1, "Same same\nother", "x"), (2, None, "x"), (3, " , ", "x"), (4, "ñandú same", "x")]
    found = {r.post_id: r.features for r in latent.featured(spark.createDataFrame(rows, SCHEMA)).collect()}
    wanted = {1: ["same", "same", "other"], 4: ["ñandú", "same"]}
    assert found == {i: [int(hashlib.md5(w.encode()).hexdigest()[:3], 16) for w in words] for i, words in wanted.items()}
    frame = spark.createDataFrame(rows, SCHEMA)
    assert "md5" not in latent.featured(frame)._jdf.queryExecution().optimizedPlan().toString()
    gated = with_relevance(frame).where("relevance >= 0.4").select("post_id")
    assert gated._jdf.queryExecution().optimizedPlan().toString().count("lower(") <= 2
