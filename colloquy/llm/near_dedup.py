"""Near-duplicates by bottom-k sketches from one hash function.

1. A document's distinct five-word shingles are hashed once; the `SKETCH` smallest values are its
   sketch. Documents with equal sets (a 64-bit digest of the whole set) form one class, and only
   classes go on: exact copies cost one aggregation.
2. Inverted lists of retained values generate candidates. Two sets that reach the threshold share at
   least `needed` sketch values (certain for small sets, short of it with a chance below `MISSED` for
   larger ones), so each class enters only the lists of its rarest values, and values that one class
   alone retains make no list at all.
3. Lists of up to `SHORT` classes give all their pairs, longer ones the pairs with their first class.
   The sketch of the union estimates each pair's similarity, clear misses go, and the rest is
   verified on full sets. The links give components.
4. What then remains are long lists that still hold several components. They are cut by set size into
   bands, since sets of very different size never link, and the bands into blocks of bounded total
   size. Each pair of blocks of one band or of neighbouring bands compares its classes of different
   components, verified on full sets; a pair counts in the list of its smallest common value only. A
   link is given unless those before it join its ends, so none is lost, and m near copies give some m
   links, not m^2.

With a `sketch` of at least the largest set's size, a sketch is the whole set, every bound above is
certain and the result is exact; the default loses a link with a chance below 2 * `MISSED`.

Components are found by min-label propagation with pointer jumping, as DataFrames throughout.

Defined results: null and empty texts have no shingles and link with nothing; fewer than five words
make one shingle. Repeated rows and ids give one row each and are copies of each other if their
texts are. A null id is never a component's id unless all its ids are null. Other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .common import Batches, WordHashes, freeing, fresh, small_batches, windows, words_of, written

#: Values a sketch retains; the chance allowed that two linked sketches of full length share fewer than `least_shared`.
SKETCH, MISSED = 40, 1e-8
#: Link if 100 * intersection >= percent * union; what op5_near_dedup takes.
PERCENT = 85
#: Lists up to this length give all pairs. Shingles and classes of a block of a longer list, about.
SHORT, BLOCK_SHINGLES, BLOCK_CLASSES = 8, 150_000, 800
#: Ids broadcast at most when full sets are fetched (8 bytes each); beyond that, the join shuffles.
BROADCAST_IDS = 1_000_000


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a document's five-word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    own = hashes.array(words)
    return np.unique(windows(own, tuple(range(min(5, len(words))))))


@cache
def least_shared(percent: int, sketch: int = SKETCH) -> int:
    """Sketch values that two linked sketches of full length share at least, but for a chance below `MISSED`.

    Each of the `sketch` smallest values of the union is common with a chance of `percent` or more.
    """
    p, below, n = percent / 100, 0.0, 0
    if p >= 1:
        return sketch
    while n <= sketch and (below := below + exp(lgamma(sketch + 1) - lgamma(n + 1) - lgamma(sketch - n + 1) + n * log(p) + (sketch - n) * log(1 - p))) < MISSED:
        n += 1
    return n


def exact_below(percent: int, sketch: int = SKETCH) -> int:
    """From this size on, sets may meet partners whose sketch is cut short."""
    return sketch * percent // 100


def linked(common: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (a + b - common)


def needed(size: int, percent: int = PERCENT, sketch: int = SKETCH) -> int:
    """Sketch values shared at least with any set that a set of this size links with."""
    return -(-percent * size // 100) if size < exact_below(percent, sketch) else least_shared(percent, sketch)


def union_estimate(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> float:
    """Jaccard similarity estimated from the bottom-k sketch of the union of two sorted sets."""
    a, b = a[:sketch], b[:sketch]
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    union = np.concatenate([both[:1], both[1:][~twice]])[:sketch]
    return float(np.count_nonzero(both[1:][twice] <= union[-1])) / len(union)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _sketch(docs: DataFrame, sketch: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (digest of the set, null if empty) and sketch of each row."""

    @freeing
    def run(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            sizes, nodes, sketches = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                found = shingles(words_of(text.as_py()), hashes)
                sizes.append(len(found))
                nodes.append(_node(found))
                sketches.append(found[:sketch].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "node", "sketch"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, sketch array<long>")


def _node(found: np.ndarray) -> int | None:
    if not len(found):
        return None
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64))


def _sets(docs: DataFrame) -> DataFrame:
    """The full set of each wanted row (doc_id, text, node), for the rows whose text makes that node."""

    @freeing
    def run(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            nodes, sets = [], []
            for text, node in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
                found = shingles(words_of(text.as_py()), hashes)
                if _node(found) == node.as_py():
                    nodes.append(node.as_py())
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "members"])

    return docs.mapInArrow(run, "node long, members binary")


def _verified(pairs: DataFrame, percent: int, sketch: int) -> DataFrame:
    """The pairs (a, b, left_set, right_set) that link; those whose union sketch has too few common values are not verified.

    A union of at most `sketch` values is its own sketch, so its estimate is exact; of larger ones, linked pairs
    fall below the floor with a chance below `MISSED`.
    """
    floor = least_shared(percent, sketch) / sketch

    @freeing
    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                keep.append(100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and union_estimate(a, b, sketch) >= floor and linked(overlap(a, b), len(a), len(b), percent))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _across(key: tuple, frame: pd.DataFrame, percent: int, sketch: int) -> pd.DataFrame:
    """Links between components within one pair of blocks of the list key[0]; columns node, comp, side, own, members.

    A pair counts in the list of its smallest common value only, so no other list repeats the work.
    Overlaps of full sets are exact and found for a class and all its partners at once.
    """
    frame = frame.drop_duplicates("node").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in frame["members"]]
    sizes = np.array([len(s) for s in sets])
    nodes, comps, side = frame["node"].to_numpy(), frame["comp"].to_numpy(), frame["side"].to_numpy()
    least = np.array([needed(int(n), percent, sketch) for n in sizes])
    possible = (comps[:, None] != comps[None, :]) & (100 * np.minimum.outer(sizes, sizes) >= percent * np.maximum.outer(sizes, sizes))
    if (side != side[0]).any():
        possible &= side[:, None] != side[None, :]
    possible &= _shared([s[:sketch] for s in sets]) >= np.minimum.outer(least, least)
    possible &= _shared([(v := np.asarray(x, np.int64))[v < key[0]] for x in frame["own"]]) == 0
    possible = np.triu(possible, 1)
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    flag = np.zeros(member.max(initial=0) + 1, np.int64)
    root = {c: c for c in comps}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    links = []
    for i in np.flatnonzero(possible.any(1)):
        own = member[starts[i] : starts[i] + sizes[i]]
        flag[own] = 1
        both = np.add.reduceat(flag[member], starts)
        flag[own] = 0
        for j in np.flatnonzero(possible[i] & (100 * both >= percent * (sizes[i] + sizes - both))):
            p, q = find(comps[i]), find(comps[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((nodes[i], nodes[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _shared(values: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the rows have in common; rows hold a value once."""
    n = len(values)
    row = np.repeat(np.arange(n), [len(v) for v in values])
    _, column, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], column[times[column] > 1]  # a value of one row is in no other
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):  # so many columns at once, to bound the grid
        a, b = np.searchsorted(column, [low, low + 2048])
        grid = np.zeros((n, 2048), np.float32)
        grid[row[a:b], column[a:b] - low] = 1
        out += grid @ grid.T
    return out


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node reachable) for every node of the links (a, b)."""
    edges = checkpointed(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        low = edges.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        near = labels.join(low, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        jump = near.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp")
        moved = checkpointed(jump.select("node", "was", F.least("comp", "next").alias("comp")))
        labels = moved.select("node", "comp")
        if moved.where("comp <> was").isEmpty():
            return labels


def _prefix(size: Column, percent: int, sketch: int) -> Column:
    """How many of a sketch's rarest values must be searched."""
    least = F.when(size < exact_below(percent, sketch), F.ceil(size * percent / 100)).otherwise(least_shared(percent, sketch))
    return F.least(size, F.lit(sketch)) - least + 1


def _blocks(long: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """The classes of the chosen lists dealt to pairs of blocks: value, i and j (which pair), side (which of the two), node and comp.

    Sets in bands further apart than one differ too much in size to link; a list that fits into one block has one band.
    """
    band = F.floor(F.log(F.col("size").cast("double")) / log(100 / min(percent, 99)) + 1e-9).cast("int")
    fits = (F.col("total") <= BLOCK_SHINGLES) & (F.col("m") <= BLOCK_CLASSES)
    banded = long.join(chosen, "value").withColumn("band", F.when(fits, 0).otherwise(band)).drop("total", "m")
    sizes = banded.groupBy("value", "band").agg(F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"))
    own = banded.join(sizes, ["value", "band"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # a block is named by its band and its number there
    near = sizes.select("value", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("to"), F.col("blocks").alias("others"))
    met = own.join(near, ["value", "band"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    this, that = F.struct(F.col("band").alias("band"), F.col("own").alias("block")), F.struct(F.col("to").alias("band"), F.col("other").alias("block"))
    return met.select("value", F.least(this, that).alias("i"), F.greatest(this, that).alias("j"), this.alias("side"), "node", "comp").withColumn("side", F.xxhash64("side"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, sketch: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (xxhash64 of the text) of each row of doc_id, text.

    Sets link from a Jaccard similarity of `percent` in the hundred on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sketched = written(_sketch(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), sketch))
    classes = written(
        sketched.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    )

    retained = classes.select("node", "size", F.explode("sketch").alias("value"))
    frequent = retained.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = retained.join(frequent, "value").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("own"))
    searched = F.greatest(F.lit(0), _prefix(F.col("size"), percent, sketch) - (F.least("size", F.lit(sketch)) - F.size("own"))).cast("int")
    postings = written(shared.select("node", "size", F.transform(F.slice("own", 1, searched), lambda x: x["value"]).alias("own")).where(F.size("own") > 0))
    lists = postings.select("node", "size", F.explode("own").alias("value"))

    heads = lists.groupBy("value").agg(F.count("*").alias("m"), F.min("node").alias("head")).where("m > 1")
    left = written(lists.join(heads, "value"))
    from_long = left.where((F.col("m") > SHORT) & (F.col("node") != F.col("head"))).select(F.col("head").alias("a"), F.col("node").alias("b"))
    few = left.where(F.col("m") <= SHORT).groupBy("value").agg(F.array_sort(F.collect_list("node")).alias("own"))
    from_short = few.select(F.posexplode("own").alias("i", "a"), "own").select("a", F.explode(F.expr("slice(own, i + 2, size(own))")).alias("b"))
    pairs = written(from_long.union(from_short).distinct())

    wanted = pairs.select("a").union(pairs.select("b")).union(left.where(F.col("m") > SHORT).select("node")).distinct().toDF("node").join(classes.select("node", "rep"), "node")
    wanted = written(wanted.select("node", F.col("rep").alias("wanted")))
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted"))).select("text", "node")
    sets = written(_sets(texts).groupBy("node").agg(F.first("members").alias("members")))

    sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("left_set")), "a")
    sided = sided.join(sets.select(F.col("node").alias("b"), F.col("members").alias("right_set")), "b")
    links = written(_verified(sided.select("a", "b", "left_set", "right_set"), percent, sketch))
    found = components(links)

    long = left.where(F.col("m") > SHORT).join(found, "node", "left").select("value", "node", "size", F.coalesce("comp", "node").alias("comp"))
    # lists of the same classes need one look; of one component, none
    alike = long.groupBy("value").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members_hash"), F.count("*").alias("m"), F.sum("size").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    chosen = written(alike.where("low <> high").groupBy("members_hash", "m", "total").agg(F.min("value").alias("value")).select("value", "m", "total"))
    more = None
    if not chosen.isEmpty():
        tasks = _blocks(long, chosen, percent).join(sets.join(postings.select("node", "own"), "node"), "node")

        def across(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return _across(key, frame, percent, sketch)

        more = written(tasks.groupBy("value", "i", "j").applyInPandas(across, "a long, b long"))
    if more is not None and not more.isEmpty():
        found = components(links.union(more))

    ids = found.join(classes.select("node", "rep"), "node")
    least = ids.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = ids.join(least, "comp").select("node", "component_id")
    of_class = classes.join(named, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    full = sketched.select("doc_id", "text_hash", "n_shingles", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return full.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`docs` without near-duplicates: of each component the row with the smallest id stays, once."""
    found = written(near_duplicates(docs, percent))
    own_id, own_hash = fresh(docs, "own_id"), fresh(docs, "own_hash")
    key = [F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)]
    lost = found.where(~F.col("kept")).select(*key).distinct()
    twice = found.where("kept").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_hash))
    if lost.count() <= BROADCAST_IDS:
        lost = F.broadcast(lost)
    left = docs.join(lost, same, "left_anti")
    if twice.isEmpty():
        return left
    digest = fresh(docs, "text_hash")
    again = left.join(twice, same, "left_semi").withColumn(digest, F.xxhash64("text")).dropDuplicates(["doc_id", digest]).drop(digest)
    return left.join(twice, same, "left_anti").unionByName(again)
