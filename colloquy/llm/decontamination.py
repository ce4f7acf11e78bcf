"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions throughout.

Texts become lower-case words of letters and digits. A seed is a mask over neighbouring words: the
words under its marks are hashed, those between them ignored, so that a substituted word there does
not hide a match. Every position of every document and of every benchmark item is hashed under each
mask; equal hashes propose (document, item, offset), and each proposal is verified by laying the
item over the document at that offset: it stands if at least `SHARE` of the item's words agree.

Two masks of four words find every item of seven words or more with up to a fifth of them substituted.
Shorter items are found exactly by whole runs of words: up to four words agree in full, and of five or six
words, one of which may be substituted, either the first or the last ones do. Documents are hashed by runs
of just the lengths that such items need, and not at all where there are none.

Null and empty texts match nothing. Repeated rows of one id and text, and repeated items, give one result each; a null id is a
key like any other. Other columns are ignored. Seeds and hits are broadcast only up to a checked
number of rows, beyond which the same joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .common import fresh

#: Words under a mask, as offsets from its start.
MASKS = ((0, 1, 3, 4), (0, 1, 3, 6))
#: Words from which on the masks find an item; runs of shorter ones by their number of words, as (start, length).
MASKED_FROM = 7
RUNS = {1: [(0, 1)], 2: [(0, 2)], 3: [(0, 3)], 4: [(0, 4)], 5: [(0, 2), (2, 3)], 6: [(0, 3), (3, 3)]}
#: Hundredths of an item's words that must agree.
SHARE = 80
#: Rows of a side that is broadcast at most (some 40 bytes each).
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(hashes: str, at: Column, offsets: tuple[int, ...], number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(F.col(hashes), at + k) for k in offsets])


def _seeds(hashes: str, lengths: list[int] = ()) -> Column:
    """Seed hashes of all positions, mask after mask, then runs of the lengths given; those over the end hash fewer words and match nothing."""
    shapes = [(m, i) for i, m in enumerate(MASKS)] + [(tuple(range(n)), len(MASKS) + n) for n in lengths]

    def of(offsets: tuple[int, ...], number: int) -> Column:
        return F.transform(F.col(hashes), lambda _, i: _seed(hashes, i, offsets, number))

    return F.concat(*[of(*shape) for shape in shapes])


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, matched and n_words (of the item) of each item found in a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("item_words")).distinct()
    items = items.where(F.size("item_words") > 0).withColumn("item", F.xxhash64("item_id", "item_words"))  # ids may be null
    hashed = _hashed(items.withColumnRenamed("item_words", "words")).select("item", "hashes", F.size("hashes").alias("n"))

    masked = hashed.where(F.col("n") >= MASKED_FROM).select("item", "n", F.posexplode(_seeds("hashes")).alias("at", "seed"))
    last = F.when(F.col("at") < F.col("n"), F.lit(MASKS[0][-1])).otherwise(F.lit(MASKS[1][-1]))
    item_seeds = masked.where(F.pmod("at", "n") + last < F.col("n")).select("item", F.pmod("at", "n").alias("item_at"), "seed")
    short = {r["n"] for r in hashed.where(F.col("n") < MASKED_FROM).select("n").distinct().collect()}  # six at most
    for n in sorted(short):
        for start, length in RUNS[n]:
            run = _seed("hashes", F.lit(start), tuple(range(length)), len(MASKS) + length)
            item_seeds = item_seeds.unionByName(hashed.where(F.col("n") == n).select("item", F.lit(start).alias("item_at"), run.alias("seed")))
    lengths = sorted({length for n in short for _, length in RUNS[n]})

    n_seeds = item_seeds.count()
    places = _hashed(docs.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))).select("doc_id", "text_hash", "hashes")
    places = places.select("doc_id", "text_hash", F.size("hashes").alias("n"), F.posexplode(_seeds("hashes", lengths)).alias("at", "seed"))
    hits = checkpointed(places.join(_small(item_seeds, n_seeds), "seed").select("doc_id", "text_hash", "item", (F.pmod("at", "n") - F.col("item_at")).alias("offset")).distinct())

    found = _small(hits, hits.count()).withColumnsRenamed({"doc_id": "hit_id", "text_hash": "hit_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash"))
    laid = docs.join(found, same).withColumn("words", words_of(F.col("text"))).drop("text")
    laid = laid.join(_small(items, n_seeds), "item")
    matched = F.size(F.filter(F.sequence(F.lit(0), F.size("item_words") - 1), lambda i: F.get("words", i + F.col("offset")) == F.get("item_words", i)))
    laid = laid.select("doc_id", "text_hash", "item_id", matched.cast("long").alias("matched"), F.size("item_words").cast("long").alias("n_words"))
    laid = laid.where(F.col("matched") * 100 >= F.col("n_words") * SHARE)
    return laid.groupBy("doc_id", "text_hash", "item_id", "n_words").agg(F.max("matched").alias("matched"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item was found."""
    bad_id, bad_hash = fresh(docs, "bad_id"), fresh(docs, "bad_hash")
    bad = checkpointed(leaks(docs, benchmark).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct())
    bad = _small(bad, bad.count())
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_hash)), "left_anti")
