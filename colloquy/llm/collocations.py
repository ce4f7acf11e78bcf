"""Phrase collocations: generalised suffix automata per shard, their counts reduced globally.

A shard is some million words of one task's documents. All its pieces of one language go into one
suffix automaton cut off at a depth of a few words: a state is a class of substrings that end at the
same places, with the number of those places, its longest and shortest length, and a suffix link to the
state of the longest suffix that ends elsewhere too. Enumerating the states gives every distinct
substring of the shard with its count, and these are summed by language and phrase.

Four passes over whole texts go by depth: words, pairs, phrases of up to `LONGEST` words. A phrase is no
more frequent than any part of it, so each pass leaves out what holds a word, or a pair, with too few
occurrences in the whole corpus. Tasks know these by a bitmap of fixed size: a collision lets a rare phrase
through to be counted exactly, none is lost. Most phrases of a corpus are rare, and all that is asked of the
passes over pairs and over longer phrases is which ones are not. So these count by a hash of some 40 bits
instead of spelling: a shard's hashes are sorted and packed into some bytes for each, dealt to buckets of
bounded size, and added up there. The last pass spells and counts exactly what they let through.

A phrase of m words falls to a longer one that keeps `kept_percent` of its occurrences. It's enough to
look one word further, as a still longer phrase is no more frequent: along the suffix link of each
phrase, and at its first m words likewise.

Defined results: a null text is empty, a null language is `und`; texts of separators alone count
nothing, and an empty table gives no row. Repeated rows count as often as they are there. White space
other than blanks and tabs is part of a word. Other columns are ignored. Ties are broken by the count,
then by the bytes of the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import STEPS, Batches, freeing, mixed, small_batches, written

LONGEST = 4
#: Words of a shard, about; what is in memory at once is some hundred bytes for each.
SHARD_WORDS = 2_000_000
#: Bits of a bitmap of frequent words or pairs: 4 MB, whatever the corpus.
BITS = 25
COUNTS = "lang string, phrase string, count long"
#: Words of the corpus for each bucket of hashed pairs; a bucket never has more distinct pairs than that, about.
BUCKET_WORDS = 1_000_000
#: What a shard has in one bucket: sorted 32-bit hashes by their four bytes, high ones first, then counts of 16 bits.
PACKED = "bucket long, hashes binary, counts binary"

#: A-Z in lower case, then the marks that end a piece as `STOP`, which is in no word any more, and tabs as blanks.
STOP = b"A"
SPELLED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + STOP * 10 + b" ")
#: Ids of the end of a piece and of words left out; the words that remain begin behind them.
END, OUT = 0, 1


@dataclass
class Automaton:
    """States of a generalised suffix automaton cut off at some depth, in the order of their longest substrings.

    `last` is a place in the sequence at which each state's substrings end, `endpos` how many there are,
    `longest` and `shortest` their lengths, and `link` the state of the longest suffix outside, or -1.
    """

    last: np.ndarray
    endpos: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    link: np.ndarray


def automaton(ids: np.ndarray, depth: int, pair_allowed=None) -> Automaton:
    """The automaton of a sequence of word ids, in which END and OUT part the pieces.

    It grows by depth: a substring of k words is one of k - 1 words and a last word. `pair_allowed`
    takes two arrays of ids and says which pairs a substring may hold.
    """
    places, state_of = np.flatnonzero(ids > OUT), np.full(len(ids), -1, np.int64)
    width = int(ids.max(initial=0)) + 1
    times, at = np.bincount(ids[places], minlength=width), np.zeros(width, np.int64)
    at[ids[places]] = places
    names = np.flatnonzero(times)
    state_of[places] = (np.cumsum(times > 0) - 1)[ids[places]]
    last, endpos, longest, shortest, link = [at[names]], [times[names]], [np.ones(len(names), np.int64)], [np.ones(len(names), np.int64)], [np.full(len(names), -1)]
    total, low = len(names), 0
    for k in range(2, depth + 1):
        ends = places[1:][(np.diff(places) == 1) & (state_of[places[1:] - 1] >= 0) & (state_of[places[1:]] >= 0)]
        if k == 2 and pair_allowed is not None and len(ends):
            ends = ends[pair_allowed(ids[ends - 1], ids[ends])]
        key = state_of[ends - 1] * width + ids[ends]
        order = np.argsort(key)
        new = np.diff(key[order], prepend=-1) != 0
        times = np.diff(np.flatnonzero(new), append=len(key))
        own = ends[order[new]]
        suffix = state_of[own]
        same = times == np.concatenate(endpos)[suffix]  # the suffix of k - 1 words ends nowhere else: one class
        linked = np.concatenate(link)
        short = np.concatenate(shortest)
        last.append(own)
        endpos.append(times)
        longest.append(np.full(len(own), k))
        shortest.append(np.where(same, short[suffix], k))
        link.append(np.where(same, linked[suffix], suffix))
        longest[-2][suffix[same] - low] = 0  # absorbed into the longer one's state
        low, state_of = total, np.full(len(ids), -1, np.int64)
        state_of[ends[order]] = total + np.cumsum(new) - 1
        total += len(own)
        places = ends
    last, endpos, longest, shortest, link = map(np.concatenate, (last, endpos, longest, shortest, link))
    alive = longest > 0
    number = np.cumsum(alive) - 1
    return Automaton(last[alive], endpos[alive], longest[alive], shortest[alive], np.where(link[alive] >= 0, number[link[alive]], -1))


class Shard:
    """Words of documents by language, as ids; what `counts` gives of them."""

    def __init__(self, words: np.ndarray | None, pairs: np.ndarray | None, longer: np.ndarray | None = None):
        self.words, self.pairs, self.longer = words, pairs, longer
        self.ids: dict[str, list[np.ndarray]] = {}
        self.known: dict[str, dict[bytes, int]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.known:
            self.known[lang] = Ids(lang, self.words)
        own = self.known[lang]
        found = (text.translate(SPELLED) + STOP).replace(STOP, b" A ").split()
        self.ids.setdefault(lang, []).append(np.fromiter(map(own.__getitem__, found), np.int32, len(found)))
        self.size += len(found)

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the pairs of words, and how often each occurs; where pairs are known already, of longer phrases of such pairs."""
        found = []
        for lang, parts in self.ids.items():
            ids, own = np.concatenate(parts), self.known[lang].hashes()
            at = np.flatnonzero((ids[:-1] > OUT) & (ids[1:] > OUT))
            if self.pairs is None:
                found.append(pair_hashes(own[ids[at]], own[ids[at + 1]]))
                continue
            at = at[self.known[lang].allowed(self.pairs)(ids[at], ids[at + 1])]
            pairs = np.zeros(len(ids), bool)
            pairs[at] = True
            for k in range(3, LONGEST + 1):
                at = at[:-1] if len(at) and at[-1] + k > len(ids) else at
                at = at[pairs[at + k - 2]]
                found.append(phrase_hashes([own[ids[at + i]] for i in range(k)]))
        return np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)

    def counts(self, shortest: int, longest: int) -> Batches:
        """Rows of lang, phrase and count for the lengths asked for; for words, also a row of no phrase with the count of all."""
        for lang, parts in self.ids.items():
            ids, own = np.concatenate(parts), self.known[lang]
            spelled = pa.array([b"", b"", *own.spelled], pa.binary())
            if shortest == 1:
                yield batch(lang, pa.array([None], pa.binary()), np.array([np.count_nonzero(ids != END)]))
            allowed = None if self.pairs is None else own.allowed(self.pairs)
            states, hashes = automaton(ids, longest, allowed), None if self.longer is None else own.hashes()
            for k in range(shortest, longest + 1):
                has = (states.shortest <= k) & (k <= states.longest)
                at, times = states.last[has], states.endpos[has]
                if k > 2 and self.longer is not None:
                    kept = in_bitmap(self.longer, phrase_hashes([hashes[ids[at - back]] for back in range(k - 1, -1, -1)]))
                    at, times = at[kept], times[kept]
                for i in range(0, len(at), 100_000):
                    ends = at[i : i + 100_000]
                    said = [spelled.take(pa.array(ids[ends - back])) for back in range(k - 1, -1, -1)]
                    yield batch(lang, pc.binary_join_element_wise(*said, b" ") if k > 1 else said[0], times[i : i + 100_000])


def batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "count"])


class Ids(dict):
    """Ids of one language's words; OUT for words that the bitmap doesn't have."""

    def __init__(self, lang: str, words: np.ndarray | None):
        super().__init__({STOP: END})
        self.words, self.seed = None if words is None else memoryview(words.astype("<u8", copy=False)).cast("B"), xxhash.xxh64_intdigest(lang.encode(), seed=42)
        self.spelled: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        if self.words is not None:
            h = self.hash(word)
            if not self.words[(h & MASK) >> 3] >> (h & 7) & 1:
                self[word] = OUT
                return OUT
        self.spelled.append(word)
        self[word] = at = len(self.spelled) + OUT
        return at

    def hash(self, word: bytes) -> int:
        """Spark's xxhash64(lang, word)."""
        return xxhash.xxh64_intdigest(word, self.seed)

    def allowed(self, pairs: np.ndarray):
        hashes = self.hashes()

        def run(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return in_bitmap(pairs, pair_hashes(hashes[left], hashes[right]))

        return run

    def hashes(self) -> np.ndarray:
        """By id; 0 for END and OUT."""
        return np.array([0, 0, *map(self.hash, self.spelled)], np.uint64)


MASK = (1 << BITS) - 1


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of words given by their hashes; the lowest bits are those of `pair_place`."""
    return (left >> np.uint64(8)) ^ ((right >> np.uint64(29)) | (right << np.uint64(35)))


def word_place(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word).bitwiseAND(F.lit(MASK))


def pair_place(lang: Column, left: Column, right: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(lang, left), 8).bitwiseXOR(F.shiftrightunsigned(F.xxhash64(lang, right), 29)).bitwiseAND(F.lit(MASK))


def bitmap(places: DataFrame) -> np.ndarray:
    """2^BITS bits with those of the column `place` set; at most 2^(BITS - 6) rows come to the driver."""
    bits = places.groupBy(F.shiftrightunsigned("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """Of phrases given by the hashes of their first words, their second words and so on."""
    total = np.full(len(words[0]), len(words), np.uint64)
    for step, own in zip(STEPS, words, strict=False):
        total = mixed(total + own * np.uint64(step))
    return total


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes & np.uint64(MASK)
    return (bits[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def packed(hashes: np.ndarray, times: np.ndarray, buckets: int) -> Batches:
    """The hashes and how often each occurs, as rows of `PACKED`."""
    bucket, low = (hashes >> np.uint64(32)) % np.uint64(buckets), hashes & np.uint64(0xFFFFFFFF)
    order = np.lexsort((low, bucket))
    bucket, low, times = bucket[order], low[order].astype(">u4"), times[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    for i in range(0, len(starts), 1_000):
        named, planes, counts = [], [], []
        for a, b in zip(starts[i : i + 1_000], [*starts[i + 1 : i + 1_000], *starts[i + 1_000 : i + 1_001], len(low)], strict=False):
            named.append(int(bucket[a]))
            planes.append(low[a:b].view(np.uint8).reshape(-1, 4).T.tobytes())
            counts.append(np.minimum(times[a:b], 0xFFFF).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array(planes, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "hashes", "counts"])


def unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Those of one row of `PACKED`."""
    low = np.ascontiguousarray(np.frombuffer(hashes, np.uint8).reshape(4, -1).T).view(">u4").ravel().astype(np.uint32)
    return low, np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(2, -1).T).view("<u2").ravel()


def frequent(docs: DataFrame, least: int, words: np.ndarray, pairs: np.ndarray | None, total: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`place` in a bitmap of each pair of allowed words that occurs at least `least` times, and rarely of another of the same
    hash; given the bitmap of `pairs`, of each longer phrase of allowed pairs.

    `total` is the number of words of the corpus. A count of 65,535 in a shard stands for any larger one, which is enough.
    """
    shared, buckets = docs.sparkSession.sparkContext.broadcast((words, pairs)), max(1, -(-total // BUCKET_WORDS))
    least = min(least, 0xFFFF)

    @freeing
    def run(batches: Batches) -> Batches:
        for shard in shards(batches, *shared.value, None, shard_words):
            yield from packed(*shard.hashed(), buckets)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [unpacked(h, c) for h, c in zip(rows["hashes"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
        low = np.concatenate([p[0] for p in parts])
        order = np.argsort(low)
        low, times = low[order], np.concatenate([p[1] for p in parts])[order].astype(np.int64)
        starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-1))
        found = low[starts][np.add.reduceat(times, starts) >= least]
        return pa.table({"place": pa.array((found & MASK).astype(np.int64))})

    return texts_of(docs).mapInArrow(run, PACKED).groupBy("bucket").applyInArrow(add, "place long")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def shards(batches: Batches, words: np.ndarray | None, pairs: np.ndarray | None, longer: np.ndarray | None, shard_words: int) -> Iterator[Shard]:
    """The shards of a task's rows of lang and text, one after another."""
    shard = Shard(words, pairs, longer)
    for rows in batches:
        for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()), strict=True):
            shard.add(lang, text.as_py())
            if shard.size >= shard_words:
                yield shard
                shard = Shard(words, pairs, longer)
    yield shard


def phrase_counts(docs: DataFrame, shortest: int, longest: int, words: np.ndarray | None = None, pairs: np.ndarray | None = None, longer: np.ndarray | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase and f of the phrases whose length lies between the two, as far as the bitmaps allow them; f of no phrase counts all words."""
    shared = docs.sparkSession.sparkContext.broadcast((words, pairs, longer))

    @freeing
    def run(batches: Batches) -> Batches:
        for shard in shards(batches, *shared.value, shard_words):
            yield from shard.counts(shortest, longest)

    return texts_of(docs).mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("count").alias("f"))


def collocations(docs: DataFrame, least: int = 30, kept_percent: int = 80, best: int = 2000, scale: int = 2_000_000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    A phrase of 2 to `LONGEST` words with a >= `least` scores floor(scale * a / (l + r)) at its worst cut.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("lang", "text")
    words = written(phrase_counts(docs, 1, 1, shard_words=shard_words).where(f"phrase is null or f >= {least}"))
    n, words = words.where("phrase is null").select("lang", F.col("f").alias("n")), words.where("phrase is not null")
    word_bits = bitmap(words.select(word_place(F.col("lang"), F.col("phrase")).alias("place")))
    total = int(n.agg(F.sum("n")).first()[0] or 0)
    pair_bits = bitmap(frequent(docs, least, word_bits, None, total, shard_words))
    longer_bits = bitmap(frequent(docs, least, word_bits, pair_bits, total, shard_words))
    phrases = written(phrase_counts(docs, 2, LONGEST, word_bits, pair_bits, longer_bits, shard_words).where(f"f >= {least}"))

    size = F.size(F.split("phrase", " ")).alias("size")
    found = phrases.select("lang", "phrase", F.col("f").alias("a"), size)
    # the suffix link of a phrase leads to its last words; its first words lie inside it as well
    inside = found.where("size > 2").select("lang", "a", F.explode(F.array(F.expr("substring_index(phrase, ' ', 1 - size)"), F.expr("substring_index(phrase, ' ', size - 1)"))).alias("phrase"))
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    own = found.join(most, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as decimal(38,0)) * longer < cast({kept_percent} as decimal(38,0)) * a")

    cuts = own.select("lang", "phrase", "a", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.expr("substring_index(phrase, ' ', k - size)"))
    parts = words.unionByName(phrases.where(F.size(F.split("phrase", " ")) < LONGEST))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast({scale} as decimal(18,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("cut"))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
