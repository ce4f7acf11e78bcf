import math
import random
import zlib
from collections import Counter

import numpy as np
from colloquy.llm.common import fold
from colloquy.llm import lm_scoring
from colloquy.llm.lm_scoring import CLASSES, HEAD, PARTS, SEEN, Encoder, Model, classes_of, fit_centroids, moved, prior_expectation, score, spelling, vocabulary
from pyspark.sql import functions as F


def texts(n, seed=3):
    rng = random.Random(seed)
    kinds = ["tion er ing the ou sh".split(), "keit ung sch ein pf zu".split()]
    return [(i, " ".join("".join(rng.choices(kinds[i % 2], k=rng.randint(1, 2))) for _ in range(rng.randint(5, 60)))) for i in range(n)]


def test_base_equals_brute_force_and_model_beats_it(spark):
    rows = texts(300) + [(900, None), (901, ""), (902, "Ünseen WORD"), (903, "the " * 40_000), (5, "the OU"), (None, "the")]
    out = score(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int"), fold(F.col("doc_id"), 5) == 1, head=20).collect()
    split = [(i, [*(t or "").lower().split(), "\n"]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter(w for i, t in split if not held(i) for w in t)
    n = sum(counts.values())
    mass = n + 0.5 * (len(counts) + 1)
    want = sorted((str(i), held(i), len(t), sum(w in counts for w in t), n, round(sum(math.log10((counts[w] + 0.5) / mass) for w in t), 6)) for i, t in split)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    tested = [r for r in out if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)
    assert all(r.score <= 0 for r in out)


def test_no_training_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = score(df, F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert score(df.limit(0), F.lit(True)).collect() == []


def test_spelling_of_a_batch_is_that_of_each_word():
    words = [b"a", b"tion", "über".encode(), b"the"]
    together, sizes = spelling(words)
    alone = [spelling([w])[0] for w in words]
    assert np.array_equal(together, np.concatenate(alone)) and sizes.tolist() == [len(a) for a in alone]
    centroids = fit_centroids(words, np.ones(4))
    assert [int(classes_of([w], centroids)[0]) for w in words] == classes_of(words, centroids).tolist()


def known_of(counts, head):
    top = sorted(counts, key=lambda w: (-counts[w], w))[:head]
    top += [] if b"\n" in top else [b"\n"]
    top.sort(key=lambda w: (-counts[w], w))
    spelled = [w for w in top if w != b"\n"]
    centroids = fit_centroids(spelled, np.array([counts[w] for w in spelled], float))
    rare = [w for w in counts if w not in top]
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for w in rare:
        c = int(classes_of([w], centroids)[0])
        n[c] += counts[w]
        v[c] += 1
    return vocabulary(top, np.array([counts[w] for w in top], float), centroids, n, v)


def test_probabilities_sum_to_one():
    """Over classes, over the parts of a class, and over the words of a part, with one unknown word among the rare."""
    counts = Counter(w for _, t in texts(60) for w in [*t.encode().split(), b"\n"])
    known = known_of(counts, 30)
    model = Model.empty(known, sum(counts.values()))
    model.weights = np.random.default_rng(1).normal(size=model.weights.shape).astype(np.float32)
    ids, sizes = Encoder(known).batch([b"ting keit shou never-seen", b""])[:2]
    assert sizes.tolist() == [5, 1] and ids[4] == ids[5] < HEAD <= ids[3]
    c, part, found = model.features(ids, sizes)
    classes, parts = model.probabilities(c, found)
    assert np.allclose(classes.sum(1), 1, atol=1e-5) and np.allclose(parts.sum(1), 1, atol=1e-5)
    assert np.allclose(model.logs(ids, sizes), np.log10(classes[np.arange(6), c] * parts[np.arange(6), part]), atol=1e-5)
    for k in range(CLASSES):
        for p in set(known.parts[known.classes == k].tolist()):
            assert abs((10 ** known.inside[(known.classes == k) & (known.parts == p)]).sum() - 1) < 1e-9
        rare = [n for w, n in counts.items() if w not in known.words and int(classes_of([w], known.centroids)[0]) == k]
        assert abs(sum(n + 0.5 for n in [*rare, 0]) - 10 ** known.rare[k]) < 1e-6


def test_scores_equal_a_model_fitted_token_by_token(spark):
    """Features counted in dictionaries and softmaxes written out give the same scores as the distributed passes."""
    rows = [(i, t) for i, t in texts(60) if i % 3]
    split = [(i, [*t.encode().split(), b"\n"]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in split if not held(i) for w in t)
    known = known_of(counts, 100_000)
    model = Model.empty(known, sum(counts.values()))
    encoder = Encoder(known)
    observed = np.zeros(model.weights.shape)
    steps = []
    for i, t in split:
        if not held(i):
            ids, sizes = encoder.batch([b" ".join(t[:-1])])[:2]
            c, part, found = model.features(ids, sizes)
            for k in range(len(ids)):
                steps.append((c[k], found[:, k]))
                for j, row in enumerate(found[:, k]):
                    observed[row, c[k] if j < SEEN else part[k]] += 1
    weights = moved(model.weights, observed, prior_expectation(observed, model), lm_scoring.RATES[0])

    def softmax(start, own):
        e = np.exp(start.astype(float) + weights[own].astype(float).sum(0))
        return e / e.sum()

    for rate in lm_scoring.RATES[1:]:
        expected = np.zeros(observed.shape)
        for c, own in steps:
            for rows_, p in ((own[:SEEN], softmax(known.class_prior, own[:SEEN])), (own[SEEN:], softmax(known.part_prior[c], own[SEEN:]))):
                for r in rows_:
                    expected[r] += p
        weights = moved(weights, observed, expected, rate)
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), fold(F.col("doc_id"), 5) == 1, head=100_000).collect()}
    for i, t in split:
        ids, sizes, _, _, inside, rare = encoder.batch([b" ".join(t[:-1])])
        c, part, found = model.features(ids, sizes)
        want = inside[0] + sum(math.log10(0.5 + counts[w]) for w in rare[0])
        for k in range(len(ids)):
            want += math.log10(softmax(known.class_prior, found[:SEEN, k])[c[k]]) + math.log10(softmax(known.part_prior[c[k]], found[SEEN:, k])[part[k]])
        assert abs(got[i] - want) < 1e-3 + 1e-4 * abs(want), i
    assert PARTS == CLASSES


def test_rank_ties_never_leave_the_head_empty(spark):
    """Every word once: more ties at one count than may be broadcast."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = lm_scoring.count_words(df)
    n = counts.where(lm_scoring._frequent(counts, 300)).count()
    assert 200 < n < 400
    assert score(df, F.lit(False), head=300).count() == 40


def test_class_sums_of_short_and_long_words():
    """Sums by place within the words equal sums word by word."""
    words = [b"a", b"x" * 64, b"tion", bytes(range(97, 123)) * 40, "über".encode(), b"ab" * 33, b"the"]
    centroids = np.random.default_rng(5).normal(size=(lm_scoring.TRIPLES, CLASSES - 1)).astype(np.float32)
    triples, sizes = spelling(words)
    want = [centroids[spelling([w])[0]].astype(float).sum(0) for w in words]
    assert np.allclose(lm_scoring._summed(centroids, triples, sizes), want, atol=1e-3)
    assert classes_of(words, centroids).tolist() == [int(np.argmax(w)) + 1 for w in want] and classes_of([], centroids).tolist() == []


def test_expectations_equal_sums_row_by_row():
    counts = Counter(w for _, t in texts(60) for w in [*t.encode().split(), b"\n"])
    known = known_of(counts, 30)
    model = Model.empty(known, sum(counts.values()))
    model.weights = np.random.default_rng(2).normal(size=model.weights.shape).astype(np.float32)
    ids, sizes = Encoder(known).batch([t.encode() for _, t in texts(40)])[:2]
    c, _, found = model.features(ids, sizes)
    want, got = np.zeros(model.weights.shape), np.zeros(model.weights.shape, np.float32)
    for rows, p in zip((found[:SEEN], found[SEEN:]), model.probabilities(c, found), strict=True):
        for r in rows:
            np.add.at(want, r, p)
    model.expect(ids, sizes, got)
    assert np.allclose(got, want, atol=1e-3) and abs(got.sum() - 8 * len(ids)) < 1


def test_hashes_of_rare_words_are_those_of_spark(spark):
    """Counts of rare words are hashed by Spark and their occurrences in tasks; both have to agree."""
    words = [b"", b"a", "über".encode(), b"\xff\xfe", b"the" * 30]
    got = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", F.xxhash64("word").alias("h")).collect()
    assert {bytes(r.word): r.h for r in got} == {w: lm_scoring._hash(w) for w in words}
