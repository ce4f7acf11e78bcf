import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from colloquy.llm import collocations as C
from colloquy.llm.collocations import END, OUT, automaton, collocations


def brute(rows, least=30, best=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {p for p in f if f[p] >= least and len(p[1]) > 1}
    out = []
    for lang in n:
        own = []
        for p in (x[1] for x in frequent if x[0] == lang):
            a = f[lang, p]
            inside = (q for q in (x[1] for x in frequent if x[0] == lang) if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * f[lang, q] >= 80 * a for q in inside):
                continue
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            own.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(own)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(t, x, 1) for x, t in rows], "text string, lang string, rank int")
    return sorted(tuple(r) for r in collocations(df, **options).collect())


@pytest.mark.parametrize("shard_words, least, best", [(2_000_000, 30, 2000), (50, 5, 2000), (200, 3, 7)])
def test_equal_to_brute_force(spark, shard_words, least, best):
    rng = random.Random(shard_words + least)
    words = ["a", "B", "ç", "the", "of", "x y", "q?", "go!", *map(str, range(12))]
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\t", "  "]).join(rng.choices(words, weights=[9] * 8 + [1] * 12, k=rng.randint(0, 30)))) for _ in range(250)]
    rows += [("en", "new york city hall, new york")] * 60 + [("en", None), ("fr", None), ("fr", ""), ("es", " ,.;\n"), ("en", "New York " * 2_000)]
    assert run(spark, rows, least=least, best=best, shard_words=shard_words) == brute(rows, least, best)


def test_empty_table(spark):
    assert run(spark, []) == []


def naive(ids, depth):
    """Substrings by the set of places at which they end."""
    ends = {}
    for i in range(len(ids)):
        for k in range(1, depth + 1):
            own = ids[i - k + 1 : i + 1]
            if i - k + 1 < 0 or END in own or OUT in own:
                break
            ends.setdefault(tuple(own), set()).add(i)
    classes = {}
    for s, e in ends.items():
        classes.setdefault(frozenset(e), set()).add(s)
    return ends, classes


@pytest.mark.parametrize("seed", range(8))
def test_states_are_classes_of_end_places(seed):
    rng = random.Random(seed)
    depth = rng.choice([1, 2, 3, 4])
    ids = [rng.choice([END, OUT, 2, 2, 3, 3, 4, 5, 6]) for _ in range(rng.choice([1, 30, 200]))]
    ends, classes = naive(ids, depth)
    found = automaton(np.array(ids, np.int32), depth)
    spelled = [tuple(ids[e - k + 1 : e + 1]) for e, k in zip(found.last, found.longest, strict=True)]
    assert len(set(spelled)) == len(spelled)
    by_state = {s: i for i, s in enumerate(spelled)}
    assert {frozenset(ends[s]) for s in spelled} == set(classes) and len(spelled) == len(classes)
    for where, members in classes.items():
        longest = max(members, key=len)
        i = by_state[longest]
        assert found.endpos[i] == len(where) and found.shortest[i] == min(map(len, members)) and len(members) == len(longest) - found.shortest[i] + 1
        suffix = longest[len(longest) - found.shortest[i] + 1 :]
        target = max(classes[frozenset(ends[suffix])], key=len) if suffix else None
        assert (found.link[i] == -1) == (not suffix) and (not suffix or spelled[found.link[i]] == target)


def test_bitmap_places_agree_between_tasks_and_spark(spark):
    from pyspark.sql import functions as F

    words = ["a", "é", "new", "york", "\U0001f600"]
    df = spark.createDataFrame([("en", v, w) for v in words for w in words], "lang string, v string, w string")
    bits = C.bitmap(df.where("w <> 'york'").select(C.word_place(F.col("lang"), F.col("w")).alias("place")))
    own = C.Ids("en", bits)
    assert [own[w.encode()] != OUT for w in words] == [w != "york" for w in words]
    full = C.Ids("en", None)
    at = np.array([full[w.encode()] for w in words])
    pairs = C.bitmap(df.where("v = 'new' and w = 'york'").select(C.pair_place(F.col("lang"), F.col("v"), F.col("w")).alias("place")))
    allowed = full.allowed(pairs)
    assert [(v, w) for v in range(5) for w in range(5) if allowed(at[[v]], at[[w]])[0]] == [(2, 3)]


def test_products_beyond_64_bits(spark):
    """The score's arithmetic, with a scale that makes scale * a pass 2^63."""
    rows = [("en", "a b")] * 40
    assert run(spark, rows, scale=10**18 - 1)[0][-1] == (10**18 - 1) * 40 // 80


def test_a_shard_holds_words_and_ends_of_pieces_alone():
    """Neither blanks nor words that the bitmap lacks take room; white space other than blanks and tabs is part of a word."""
    text = "A a.\tB\x1cA  !\r\n é\xa0A\x00 a"
    shard = C.Shard(None, None)
    shard.add("en", text.encode())
    own = shard.known["en"]
    assert own.spelled == [b"a", b"b\x1ca", "é\xa0a\x00".encode()]
    ids = np.concatenate(shard.ids["en"])
    assert ids.tolist() == [2, 2, END, 3, END, END, END, 4, 2, END] and shard.size == len(ids)
    bits = np.zeros(1 << (C.BITS - 6), np.uint64)
    h = own.hash(b"a") & C.MASK
    bits[h >> 6] |= np.uint64(1 << (h & 63))
    few = C.Shard(bits, None)
    few.add("en", text.encode())
    assert np.concatenate(few.ids["en"]).tolist() == [2, 2, END, OUT, END, END, END, OUT, 2, END] and few.known["en"].spelled == [b"a"]


def test_pairs_leave_a_shard_as_packed_hashes():
    """A few bytes for each pair, and every count comes back."""
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, 200_000).astype(np.uint64))
    times = rng.choice([1, 1, 1, 2, 40, 70_000], len(hashes))
    rows = [r for b in C.packed(hashes, times, 7) for r in b.to_pylist()]
    assert sorted(r["bucket"] for r in rows) == list(range(7))
    got = {}
    for r in rows:
        low, counts = C.unpacked(r["hashes"], r["counts"])
        got |= {(r["bucket"], int(x)): int(c) for x, c in zip(low, counts, strict=True)}
    assert got == {(int(h >> np.uint64(32)) % 7, int(h) & 0xFFFFFFFF): min(int(t), 0xFFFF) for h, t in zip(hashes, times, strict=True)}
    assert sum(len(pa.compress(r[k], "lz4", asbytes=True)) for r in rows for k in ("hashes", "counts")) < 4.5 * len(hashes)


def test_hashed_counts_find_the_frequent_pairs_of_all_shards(spark):
    from pyspark.sql import functions as F

    rows = [("en", "new york")] * 29 + [("en", "old york")] * 30 + [("de", "new york")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    every = np.full(1 << (C.BITS - 6), ~np.uint64(0), np.uint64)
    got = {r.place for r in C.frequent(docs, 30, every, None, 3_500_000, shard_words=4).collect()}
    named = spark.createDataFrame([("en", "old", "york"), ("de", "new", "york")], "lang string, v string, w string")
    assert got == {r.place for r in named.select(C.pair_place(F.col("lang"), F.col("v"), F.col("w")).alias("place")).collect()}


def test_rare_phrases_of_frequent_pairs_are_not_spelled():
    """What leaves a shard in the last pass is what the bitmaps let through."""
    every, none = np.full(1 << (C.BITS - 6), ~np.uint64(0), np.uint64), np.zeros(1 << (C.BITS - 6), np.uint64)
    spelled = {}
    for name, longer in (("all", every), ("none", none)):
        shard = C.Shard(every, every, longer)
        shard.add("en", b"a b c d a b, c")
        spelled[name] = {(r["phrase"], r["count"]) for b in shard.counts(2, C.LONGEST) for r in b.to_pylist()}
    assert spelled["none"] == {("a b", 2), ("b c", 1), ("c d", 1), ("d a", 1)}
    assert spelled["all"] - spelled["none"] == {(p, 1) for p in ("a b c", "b c d", "c d a", "d a b", "a b c d", "b c d a", "c d a b")}
    shard = C.Shard(every, every)
    shard.add("en", b"a b c d a b, c")
    own = shard.known["en"]
    found = {p: int(C.phrase_hashes([np.array([own.hash(w.encode())], np.uint64) for w in p.split()])[0]) for p, _ in spelled["all"] - spelled["none"]}
    hashes, times = shard.hashed()
    assert sorted(found.values()) == hashes.tolist() and set(times) == {1}
