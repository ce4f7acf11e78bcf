"""Language-model scoring with a hashed, class-factored maximum-entropy model over words.

P(word | history) = P(class | history) * P(part | class, history) * P(word | part)

A word's class follows from its spelling: its letter triples are hashed, and the nearest of
`CLASSES` - 1 centroids, fitted to the broadcast training words, is its class; the end of a text has
a class of its own. Within a class the broadcast words are cut by frequency into `PARTS` - 1 parts,
frequent words alone in theirs, and all rarer words make part 0. Inside a part a word has its
relative frequency, in part 0 smoothed, (c + 0.5) / (N + 0.5 * (V + 1)), which leaves room for one
unknown word.

Both softmaxes, over classes and over the parts of a class, are maximum-entropy models over hashed
features of the words before. Classes see the word before, the one before that (a skip), the pair of
both, and the spelling classes of that pair and of the first and the third word (a skip-gram); parts see
their class together with the word before and with the classes of the first and the second. Every
feature is a row of weights, one for each outcome; the number of rows grows with the training tokens up
to `MOST_ROWS`, so that they stay broadcastable.

Training covers the whole texts of all training documents, as distributed passes:
1. word counts, pre-aggregated in each task (they grow with the corpus and stay distributed);
2. one tokenizing pass over all documents writes the numbers of their words, which all later passes read;
3. counts of (feature, outcome): what was observed, on which the first gradient update rests, since
   what a model without weights expects follows from them;
4. further gradient updates: each task sums what the model expects over its share of the tokens, and
   blocks of rows meet in an aggregation. The difference of observed and expected is the gradient of
   the likelihood; it moves a weight as far as it exceeds chance.

Scoring reads the numbers again in sparse numpy batches. The `HEAD` most frequent words are broadcast
(a bounded number of bounded length); all rarer words are joined with the distributed counts.

Rare words are joined by 64-bit hashes. Defined results: null text is empty, and an empty text is its
end alone. Without training documents every log is that of an empty model: base 0 for each token, and
uniform classes and parts. Repeated rows and ids are scored row by row. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, freeing, share_below, small_batches, words_of, written

CLASSES, PARTS, HEAD = 32, 32, 120_000
#: Bytes of a broadcast word at most; longer ones are joined like rare ones.
HEAD_BYTES = 64
#: Class 0 is the end of a text. What stands before a text's first word has a number of its own.
END, END_CLASS, BEFORE = b"\n", 0, HEAD + CLASSES
#: Hashed letter triples of spelling; rounds of fitting the centroids.
TRIPLES, ROUNDS = 512, 12
#: Rows of weights for each of the two softmaxes: one for so many training tokens, between these bounds.
TOKENS_PER_ROW, LEAST_ROWS, MOST_ROWS = 2_048, 1 << 13, 1 << 17
#: How far each gradient update goes; observations that a weight's prior is worth; standard deviations that are chance.
RATES, PRIOR, DOUBT = (0.45, 0.5), 1.0, 1.2
#: Tokens handled at once; tokens until sums of single precision are added up in double; rows of weights that travel together.
CHUNK, FLUSH, BLOCK = 16_384, 2_000_000, 256
#: Features of classes, of parts.
SEEN, OF_PARTS = 5, 3


# --- classes from spelling -------------------------------------------------------------------


def spelling(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte triples (bounded by spaces) of all words, one after another, and each word's number of them."""
    joined = np.frombuffer(b"  ".join([b"", *words, b""])[1:-1] if words else b"", np.uint8).astype(np.uint32)
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # each word stands between two spaces; a triple starts at the space before it and at each byte but the last
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(np.concatenate([[0], sizes[:-1] + 2]))
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    code = (joined[at] * np.uint32(0x9E3779B1)) ^ (joined[at + 1] * np.uint32(0x85EBCA6B)) ^ (joined[at + 2] * np.uint32(0xC2B2AE35))
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x2C1B3C6D)) >> np.uint32(23)).astype(np.int64), sizes


def fit_centroids(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Spherical k-means over the words' letter triples, weighted by the square root of their counts."""
    k = CLASSES - 1
    if not words:
        return np.zeros((TRIPLES, k), np.float32)

    def rows(low: int, high: int) -> np.ndarray:
        triples, sizes = spelling(words[low:high])
        n = len(sizes)
        found = np.bincount(np.repeat(np.arange(n), sizes) * TRIPLES + triples, minlength=n * TRIPLES).reshape(n, TRIPLES).astype(np.float32)
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    weight = np.sqrt(counts).astype(np.float32)[:, None]
    first = np.linspace(0, min(len(words), 40 * k) - 1, k).astype(int)
    centres = np.concatenate([rows(i, i + 1) for i in first])
    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        for low in range(0, len(words), 8_192):  # a bounded share of the words at once
            part = rows(low, low + 8_192)
            chosen = np.zeros((len(part), k), np.float32)
            chosen[np.arange(len(part)), (part @ centres.T).argmax(1)] = 1
            sums += (chosen * weight[low : low + 8_192]).T @ part
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-9), centres)
    return np.ascontiguousarray(centres.T, np.float32)


def _summed(centroids: np.ndarray, triples: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each word, the sum of its triples' rows: first, second, third triples of all words and so on, the rest of long words at once."""
    order = np.argsort(-sizes, kind="stable")
    starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    total = np.take(centroids, triples[starts], axis=0)
    for i in range(1, min(64, lengths[0])):
        n = np.searchsorted(-lengths, -i)  # words of more than i triples
        total[:n] += np.take(centroids, triples[starts[:n] + i], axis=0)
    for w in range(np.searchsorted(-lengths, -64)):
        total[w] += centroids[triples[starts[w] + 64 : starts[w] + lengths[w]]].sum(0)
    out = np.empty_like(total)
    out[order] = total
    return out


def classes_of(words: list[bytes], centroids: np.ndarray) -> np.ndarray:
    """The class of each word that is not the end."""
    out = np.empty(len(words), np.int64)
    low = 0
    while low < len(words):
        high, size = low, 0
        while high < len(words) and size < 200_000:  # bytes at once; a single word may have more
            size += len(words[high])
            high += 1
        out[low:high] = _summed(centroids, *spelling(words[low:high])).argmax(1) + 1
        low = high
    return out


# --- the vocabulary --------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """The broadcast words and what the model knows of classes and parts; a word's number is its rank."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    parts: np.ndarray
    inside: np.ndarray  # log10 of a word's share of its part
    centroids: np.ndarray
    rare: np.ndarray  # by class: log10 of the smoothed mass of rare words
    class_prior: np.ndarray
    part_prior: np.ndarray


def vocabulary(words: list[bytes], counts: np.ndarray, centroids: np.ndarray, rare_n: np.ndarray, rare_v: np.ndarray) -> Vocabulary:
    """From the broadcast words in order of rank, and by class the tokens and words that are rarer."""
    classes = np.full(len(words), END_CLASS, np.int64)
    is_end = np.array([w == END for w in words], bool)
    classes[~is_end] = classes_of([w for w in words if w != END], centroids)
    parts = np.ones(len(words), np.int64)
    mass = np.zeros((CLASSES, PARTS))
    for c in range(CLASSES):
        own = np.flatnonzero(classes == c)
        if len(own):
            share = np.cumsum(np.sqrt(counts[own]))
            parts[own] = 1 + np.minimum((share - np.sqrt(counts[own])) / share[-1] * (PARTS - 1), PARTS - 2).astype(np.int64)
    np.add.at(mass, (classes, parts), counts)
    inside = np.log10(counts / mass[classes, parts]) if len(words) else np.empty(0)
    mass[:, 0] = rare_n + 0.5 * (rare_v + 1)
    by_class = mass.sum(1)
    with np.errstate(divide="ignore"):
        part_prior = np.log(mass + 0.01) - np.log(by_class + 0.01 * PARTS)[:, None]
        class_prior = np.log(by_class / by_class.sum())
    return Vocabulary(words, counts, classes, parts, inside, centroids, np.log10(mass[:, 0]), class_prior.astype(np.float32), part_prior.astype(np.float32))


# --- the two softmaxes -----------------------------------------------------------------------


def _hashed(template: int, x: np.ndarray, y: np.ndarray | int, rows: int) -> np.ndarray:
    """Rows of a template's features (x, y)."""
    key = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(y, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(template * 0x165667B19E3779F9 & (2**64 - 1))
    key ^= key >> np.uint64(32)
    return ((key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) & (rows - 1)


@dataclass
class Model:
    """Classes and parts of the numbered words, and the weights; rows of parts follow those of classes."""

    class_of: np.ndarray
    part_of: np.ndarray
    class_prior: np.ndarray
    part_prior: np.ndarray
    weights: np.ndarray  # 2 * rows, outcomes

    @staticmethod
    def empty(known: Vocabulary, tokens: int) -> Model:
        """Without weights, with rows for so many training tokens."""
        rows = 1 << int(np.ceil(np.log2(min(MOST_ROWS, max(LEAST_ROWS, tokens / TOKENS_PER_ROW)))))
        class_of = np.zeros(BEFORE + 1, np.int32)
        class_of[: len(known.words)], class_of[HEAD : HEAD + CLASSES] = known.classes, np.arange(CLASSES)
        part_of = np.zeros_like(class_of)
        part_of[: len(known.words)] = known.parts
        return Model(class_of, part_of, known.class_prior, known.part_prior, np.zeros((2 * rows, CLASSES), np.float32))

    def features(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts put one after another: class and part of each token, and its rows (SEEN + OF_PARTS, tokens)."""
        n, rows = len(ids), len(self.weights) // 2
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before = []
        for back in (1, 2, 3):
            own = np.full(n, BEFORE, np.int64)
            own[back:] = ids[: n - back] if back < n else []
            own[place < back] = BEFORE
            before.append(own)
        one, two, three = before
        c, spelled = self.class_of[ids], [self.class_of[x] for x in before]
        found = [_hashed(t, x, y, rows) for t, x, y in ((1, one, 0), (2, two, 0), (3, one, two), (4, spelled[0], spelled[1]), (5, spelled[0], spelled[2]))]
        # each class has rows of its own for its parts
        found += [rows + c * (rows // CLASSES) + _hashed(t, x, 0, rows // CLASSES) for t, x in ((6, one), (7, spelled[0]), (8, spelled[1]))]
        return c, self.part_of[ids], np.stack(found)

    def probabilities(self, c: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all classes, and of all parts of the tokens' own classes."""
        out = []
        for start, own in ((self.class_prior, found[:SEEN]), (self.part_prior[c], found[SEEN:])):
            # arrays that came with a broadcast have a type object of their own, with which numpy adds rows slowly
            total, one = np.empty((2, len(c), CLASSES), np.float32)
            np.take(self.weights, own[0], axis=0, out=total, mode="clip")  # without "clip" it makes a copy first
            total += start
            for rows in own[1:]:
                np.take(self.weights, rows, axis=0, out=one, mode="clip")
                total += one
            total -= total.max(1, keepdims=True)
            np.exp(total, out=total)
            total /= (total @ np.ones(CLASSES, np.float32))[:, None]
            out.append(total)
        return out[0], out[1]

    def logs(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of P(class) * P(part) of each token."""
        c, part, found = self.features(ids, sizes)
        out = np.empty(len(ids))
        for i in range(0, len(ids), CHUNK):
            own = slice(i, i + CHUNK)
            classes, parts = self.probabilities(c[own], found[:, own])
            at = np.arange(len(classes))
            out[own] = np.log10(np.maximum(classes[at, c[own]], 1e-30)) + np.log10(np.maximum(parts[at, part[own]], 1e-30))
        return out

    def observe(self, ids: np.ndarray, sizes: np.ndarray, into: np.ndarray) -> None:
        """Adds how often each outcome followed each feature."""
        c, part, found = self.features(ids, sizes)
        for own, outcome in ((found[:SEEN], c), (found[SEEN:], part)):
            for rows in own:
                np.add.at(into.reshape(-1), rows * CLASSES + outcome, np.float32(1))

    def expect(self, ids: np.ndarray, sizes: np.ndarray, into: np.ndarray) -> None:
        """Adds how often the model expects each outcome after each feature."""
        c, _, found = self.features(ids, sizes)
        # two neighbouring outcomes are added as one complex number: the same sums from half as many places
        half = CLASSES // 2
        every, flat = np.arange(half), into.view(np.complex64).reshape(-1)
        at = np.empty((CHUNK, half), np.int64)  # one buffer for all chunks
        for i in range(0, len(ids), CHUNK):
            own = slice(i, i + CHUNK)
            for expected, rows in zip(self.probabilities(c[own], found[:, own]), (found[:SEEN, own], found[SEEN:, own]), strict=True):
                place, pairs = at[: len(expected)], expected.view(np.complex64).reshape(-1)
                for r in rows * half:
                    np.add(r[:, None], every, out=place)
                    np.add.at(flat, place.reshape(-1), pairs)


def moved(weights: np.ndarray, observed: np.ndarray, expected: np.ndarray, rate: float) -> np.ndarray:
    """Weights after an update: each moves by a log ratio of what was observed and what is expected, as far as their
    difference, the gradient, exceeds `DOUBT` standard deviations of chance."""
    gradient = observed - expected
    beyond = np.sign(gradient) * np.maximum(np.abs(gradient) - DOUBT * np.sqrt(expected + 0.25), 0)
    return (weights + rate * np.log((expected + beyond + PRIOR) / (expected + PRIOR))).astype(np.float32)


def prior_expectation(observed: np.ndarray, model: Model) -> np.ndarray:
    """What a model without weights expects after each feature, from how often the feature occurs."""
    rows = len(observed) // 2
    priors = np.concatenate([np.repeat(np.exp(model.class_prior)[None], rows, 0), np.repeat(np.exp(model.part_prior), rows // CLASSES, 0)])
    return observed.sum(1, keepdims=True) * priors


# --- passes over the corpus ------------------------------------------------------------------


def count_words(docs: DataFrame) -> DataFrame:
    """word and c over the tokens of all rows of text."""

    @freeing
    def run(batches: Batches) -> Batches:
        counts: Counter[bytes] = Counter()

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(words_of(text.as_py()))
            counts[END] += len(batch)
            if len(counts) > 300_000:
                yield batch_of()
                counts.clear()
        yield batch_of()

    return docs.select("text").mapInArrow(run, "word binary, c long").where("c > 0").groupBy("word").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, most: int) -> Column:
    """Holds for the end and the most frequent words of bounded length, about `most` of them: all above a count
    that a histogram of logarithmic counts (some hundred rows) gives, and at it a share chosen by hash."""
    step, fits = F.floor(F.log2("c") * 32), F.octet_length("word") <= HEAD_BYTES
    left, above, at, share = most, 1 << 30, None, 0.0
    for r in counts.where(fits).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if r["n"] > left:
            at, share = r["step"], left / r["n"]
            break
        left, above = left - r["n"], r["step"]
    chosen = step >= above
    if at is not None:
        chosen |= (step == at) & share_below(F.col("word"), F.lit(share))
    return (fits & chosen) | (F.col("word") == F.lit(END))


def _hash(word: bytes) -> int:
    """Spark's xxhash64 of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (h >> 63 << 64)


class Encoder:
    """Numbers of words, and what of a score does not depend on their neighbours."""

    def __init__(self, known: Vocabulary, limit: int = 200_000):
        self.known, self.limit = known, limit
        self.number = {w: i for i, w in enumerate(known.words)}
        self.rare: dict[bytes, int] = {}

    def _rare(self, words: list[bytes]) -> list[int]:
        """HEAD and the class of each word, remembered up to a limit."""
        new = list(set(words).difference(self.rare))
        if len(self.rare) + len(new) > self.limit:
            self.rare.clear()
            new = list(set(words))
        self.rare.update(zip(new, (classes_of(new, self.known.centroids) + HEAD).tolist(), strict=True))
        self.rare[END] = HEAD + END_CLASS
        return [self.rare[w] for w in words]

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """Numbers of all tokens, one text after another; by text: tokens, sum of log10(c + 0.5) and number of
        broadcast words, sum of log10 within parts (short of c + 0.5 of rare words), rare words."""
        split = [words_of(t) for t in texts]
        for words in split:
            words.append(END)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for own in split for w in own]
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(ids < 0)
        rare = [words[i] for i in at.tolist()]
        ids[at] = self._rare(rare)
        row = np.repeat(np.arange(len(texts)), sizes)
        head = ids < HEAD
        inside = np.empty(len(ids))
        inside[head], inside[at] = self.known.inside[ids[head]], -self.known.rare[ids[at] - HEAD]
        n = len(texts)
        sums = np.bincount(row[head], np.log10(self.known.counts[ids[head]] + 0.5), n)
        ends = np.searchsorted(at, np.cumsum(sizes)).tolist()
        return ids, sizes, sums, np.bincount(row[head], minlength=n), np.bincount(row, inside, n), [rare[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _texts(batches: Batches, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch, its numbers of words in column `at`, one text after another, and each text's size."""
    for batch in batches:
        if len(batch):
            own = [np.frombuffer(x, np.int32) for x in batch.column(at).to_pylist()]
            yield batch, np.concatenate(own).astype(np.int64), np.fromiter(map(len, own), np.int64, len(own))


def gathered(training: DataFrame, model: Model, tokens: int, add: Callable[[Model, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """What `add` sums for each row of weights over all training texts (`ids`).

    Each task gives its sums once, so there are only so many tasks that their sums stay well below what they read.
    """
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = len(model.weights)
    tasks = max(2 * spark.sparkContext.defaultParallelism, tokens // (4 * model.weights.size))

    @freeing
    def run(batches: Batches) -> Batches:
        own, seen = shared.value, 0
        total, now = np.zeros(model_shape), np.zeros(model_shape, np.float32)
        for _, ids, sizes in _texts(batches, 0):
            add(own, ids, sizes, now)
            seen += len(ids)
            if seen > FLUSH:
                total += now
                now[:], seen = 0, 0
        total += now
        for low in range(0, rows, BLOCK):
            if total[low : low + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([low], pa.int32()), pa.array([total[low : low + BLOCK].astype(np.float32).tobytes()], pa.binary())], ["block", "sums"])

    model_shape = model.weights.shape

    def together(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BLOCK * CLASSES)
        for frame in frames:
            for sums in frame["sums"]:
                total += np.frombuffer(sums, np.float32)
        yield pd.DataFrame({"block": [key[0]], "sums": [total.tobytes()]})

    found = np.zeros(model_shape)
    parts = training.select("ids").coalesce(tasks).mapInArrow(run, "block int, sums binary")
    for r in parts.groupBy("block").applyInPandas(together, "block int, sums binary").toLocalIterator():
        found[r["block"] : r["block"] + BLOCK] = np.frombuffer(bytes(r["sums"])).reshape(-1, CLASSES)
    shared.unpersist()
    return found


def fit(training: DataFrame, model: Model, tokens: int) -> Model:
    """The model with weights fitted to the rows of `ids`."""
    if not tokens:
        return model
    observed = gathered(training, model, tokens, Model.observe)
    expected = prior_expectation(observed, model)
    for step, rate in enumerate(RATES):
        if step:
            expected = gathered(training, model, tokens, Model.expect)
        model = replace(model, weights=moved(model.weights, observed, expected, rate))
    return model


def score(docs: DataFrame, held_out: Column, head: int = HEAD - 2_000) -> DataFrame:
    """Scores of every row of doc_id, text; the model learns from those for which `held_out` is false. About `head`
    words are broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), held_out.alias("held_out"))

    counts = written(count_words(docs.where(~F.col("held_out"))))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = _frequent(counts, head)
    top = counts.where(frequent).toPandas()
    top = sorted(zip(map(bytes, top["word"]), top["c"].tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    words, of_words = [w for w, _ in top], np.array([c for _, c in top], np.float64)
    spelled = [i for i, w in enumerate(words) if w != END]
    centroids = fit_centroids([words[i] for i in spelled], of_words[spelled])
    given = spark.sparkContext.broadcast(centroids)

    @freeing
    def by_class(batches: Batches) -> Batches:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            if len(batch):
                own = classes_of(batch.column(0).to_pylist(), given.value)
                np.add.at(n, own, batch.column(1).to_numpy())
                v += np.bincount(own, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(n), pa.array(v)], ["class", "n", "v"])

    rare_n, rare_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.where(~frequent).mapInArrow(by_class, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        rare_n[r["class"]], rare_v[r["class"]] = r["n"], r["v"]
    known = vocabulary(words, of_words, centroids, rare_n, rare_v)
    shared = spark.sparkContext.broadcast(known)

    @freeing
    def encode(batches: Batches) -> Batches:
        encoder = Encoder(shared.value)
        for batch in batches:
            if not len(batch):
                continue
            ids, sizes, sums, seen, inside, rare = encoder.batch(batch.column(1).cast(pa.binary()).to_pylist())
            hashed = [Counter(map(_hash, own)) for own in rare]
            numbers = [x.tobytes() for x in np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes), pa.array(sums.astype(np.float64)), pa.array(seen, pa.int64()), pa.array(inside.astype(np.float64)), pa.array(numbers, pa.binary()), pa.array([list(h) for h in hashed], pa.list_(pa.int64())), pa.array([list(h.values()) for h in hashed], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "row", "n_tokens", "sums", "known", "inside", "ids", "rare", "times"],
            )

    kind = "doc_id long, held_out boolean, row long, n_tokens long, sums double, known long, inside double, ids binary, rare array<long>, times array<long>"
    encoded = written(docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row")).mapInArrow(encode, kind))
    model = fit(encoded.where(~F.col("held_out")), Model.empty(known, tokens), tokens)
    weighed = spark.sparkContext.broadcast(model)

    @freeing
    def scored(batches: Batches) -> Batches:
        for batch, ids, sizes in _texts(batches, 1):
            logs = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weighed.value.logs(ids, sizes), len(sizes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(logs)], ["row", "doc_id", "held_out", "n_tokens", "sums", "known", "inside", "logs"])

    whole = encoded.select("row", "ids", "doc_id", "held_out", "n_tokens", "sums", "known", "inside").mapInArrow(scored, "row long, doc_id long, held_out boolean, n_tokens long, sums double, known long, inside double, logs double")

    tail = counts.where(~frequent).select(F.xxhash64("word").alias("word"), "c").groupBy("word").agg(F.max("c").alias("c"))
    wanted = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = wanted.join(tail, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")).alias("rare_sums"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known")
    )
    full = whole.join(found, "row", "left")
    rare_sums, all_mass = F.coalesce("rare_sums", F.lit(0.0)), float(np.log10(tokens + 0.5 * (distinct + 1)))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("sums") + rare_sums - F.col("n_tokens") * F.lit(all_mass)).alias("base_score"), (F.col("logs") + F.col("inside") + rare_sums).alias("score"),
    )
