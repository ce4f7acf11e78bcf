import random
import zlib

import numpy as np
from colloquy.llm.common import fold
from colloquy.llm.quality import BITS, DIMENSIONS, NEIGHBOURS, POWER, Words, fit, score, shape, terms, train
from pyspark.sql import functions as F


def made_up(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(20, 90))
        bad = i % 4 == 0
        if bad:
            own = rng.choice([lambda w: [x.upper() + "!!" for x in w], lambda w: [x + "$$$" for x in w], lambda w: w[:2] * (len(w) // 2)])(own)
        rows.append((i, " ".join(own), "x"))
        labels.append((i, int(not bad)))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = made_up(800)
    rows += [(5000, None, "x"), (5001, "", "x"), (5001, "  ", "x"), (None, "BUY!! NOW!!", "x"), (5002, "BUY!! NOW!! " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_ string")
    model = train(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, quality int"), fold(F.col("doc_id"), 5) != 0)
    found = score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.quality <= 1 for r in found)
    truth = dict(labels)
    held = [(r.quality >= 0.3, bool(truth[r.doc_id])) for r in found if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert len({r.quality for r in found if r.doc_id in (5000, 5001)}) == 1
    assert next(r.quality for r in found if r.doc_id == 5002) < 0.3


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5)], "doc_id long, Text string, Quality double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.quality for r in score(docs, train(docs, none, F.lit(True))).collect()] == [0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.quality for r in score(docs, train(docs, one, F.lit(True))).collect()] == [1.0]
    assert score(docs.limit(0), train(docs.limit(0), one, F.lit(True))).collect() == []
    kept = score(docs, train(docs, one, F.lit(True)), "quality_").first()
    assert kept.Quality == 0.5 and kept.quality_ == 1.0


def model_of(n=300):
    rows, labels = made_up(n, seed=7)
    known = Words()
    found = [terms(t, known) for _, t, _ in rows]
    own = np.array([y for _, y in labels])
    return found, own, fit(found, own, np.where(own == 1, 3.0, 1.0))


def test_votes_are_those_of_a_plain_loop():
    found, labels, model = model_of()
    vectors = model.latent(found)
    values = model.votes(vectors)
    for i in range(0, len(found), 11):
        close = [float(vectors[i] @ v) for v in model.vectors]
        near = sorted(range(len(close)), key=lambda j: (-close[j], j))[:NEIGHBOURS]
        weight = [max(close[j], 0) ** POWER * model.stands_for[j] for j in near]
        assert abs(values[i] - sum(w * labels[j] for w, j in zip(weight, near, strict=True)) / sum(weight)) < 1e-3


def test_latent_directions_are_those_of_the_dense_decomposition():
    found, _, model = model_of(120)
    dense = np.zeros((len(found), 1 << BITS))
    for r, (at, weight) in enumerate(found):
        np.add.at(dense[r], at, weight)
    used = dense.any(0)
    _, s, _ = np.linalg.svd(dense[:, used], full_matrices=False)
    along = np.linalg.svd(dense[:, used] @ model.directions[used].astype(np.float64), compute_uv=False)
    assert model.directions.shape[1] == DIMENSIONS
    assert np.allclose(along[:5], s[:5], rtol=1e-3) and (along**2).sum() > 0.97 * (s[:DIMENSIONS] ** 2).sum()


def test_blocks_score_like_single_documents():
    found, _, model = model_of()
    together = model.votes(model.latent(found))
    for i in range(0, len(found), 17):
        assert abs(together[i] - model.votes(model.latent([found[i]]))[0]) < 1e-5


def test_shapes():
    assert [shape(w).split()[0] for w in ("Word,", "word$$$", "WORD!!", "a1b22", "|", "|||")] == ["Aa,", "a$$", "A!!", "a0a0", "|", "||"]
