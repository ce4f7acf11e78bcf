import random
import zlib

import numpy as np
from colloquy.llm.common import fold
from colloquy.llm.toxicity import BITS, Ftrl, Scorer, TrimmedHashes, features, score, train
from pyspark.sql import functions as F


def made_up(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        own = rng.choices(words, k=rng.randint(20, 80))
        if toxic:
            own[rng.randrange(len(own))] = rng.choice(["Vile!", "vile", "rotten,"])
        rows.append((i, " ".join(own), "x"))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_edges(spark):
    rows, labels = made_up(900)
    rows += [(5000, None, "x"), (5001, "", "x"), (5001, "", "x"), (None, "vile", "x"), (5002, "good " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity_ string")
    labelled = spark.createDataFrame([*labels, (3, None), (None, 1), (0, 0)], "doc_id long, toxic int")
    model = train(docs, labelled, fold(F.col("doc_id"), 3) != 1)
    found = score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.toxicity <= 1 for r in found)
    held = [(r.toxicity >= 0.7, bool(dict(labels)[r.doc_id])) for r in found if r.doc_id in dict(labels) and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert len({r.toxicity for r in found if r.doc_id in (5000, 5001)}) == 1
    assert next(r.toxicity for r in found if r.doc_id == 5002) < 0.7


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.toxicity for r in score(docs, train(docs, none, F.lit(True))).collect()] == [0.0]
    assert score(docs.limit(0), train(docs, none, F.lit(True))).collect() == []


def test_batches_score_like_single_texts():
    rows, labels = made_up(200, seed=4)
    hashes = TrimmedHashes()
    model = Ftrl(l1=0.5).fit([(features(t, hashes), y) for (_, t, _), (_, y) in zip(rows, labels, strict=True)], 2)
    weights = model.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(weights)
    scorer = Scorer(at, weights[at])
    for (_, text, _), together in zip(rows, scorer.scores([t for _, t, _ in rows]), strict=True):
        alone = weights[features(text, hashes)].sum() + weights[-1]
        assert abs(1 / (1 + np.exp(-alone)) - together) < 1e-4


def test_ftrl_is_the_plain_loop_over_coordinates():
    """Per-coordinate FTRL-proximal written out one number at a time gives the same weights."""
    rng = np.random.default_rng(3)
    rows = [(np.unique(rng.integers(0, 40, 8)).astype(np.int32), int(rng.random() < 0.3)) for _ in range(120)]
    alpha, beta, l1, positive = 2.0, 1.0, 0.7, 2.0
    z, n = {}, {}

    def weight(i):
        if i not in z or (i != 1 << BITS and abs(z[i]) <= l1):
            return 0.0
        shrunk = z[i] if i == 1 << BITS else np.sign(z[i]) * (abs(z[i]) - l1)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha)

    for _ in range(3):
        for own, label in rows:
            at = [*own.tolist(), 1 << BITS]
            w = {i: weight(i) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - label) * (positive if label else 1)
            for i in at:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (np.sqrt(was + g * g) - np.sqrt(was)) / alpha * w[i]
                n[i] = was + g * g
    found = Ftrl(l1=l1).fit(rows, 3).weights(np.arange((1 << BITS) + 1))
    for i in [*range(40), 1 << BITS]:
        assert abs(found[i] - weight(i)) < 1e-9


def test_result_name_and_column_case(spark):
    docs = spark.createDataFrame([(1, "a b", 0.5)], "doc_id long, Text string, toxicity double")
    model = spark.createDataFrame([(1 << BITS, 0.0)], "idx int, weight double")
    found = score(docs, model, "toxicity_").first()
    assert found.toxicity == 0.5 and found.toxicity_ == 0.5
    assert score(docs.limit(0), model).collect() == []
