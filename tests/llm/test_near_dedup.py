import random
import re

import pytest
from colloquy.llm import near_dedup
from colloquy.llm.near_dedup import near_duplicates


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(s), least[find(i)], doc == least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    base = " ".join(rng.choices(words, k=150))
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:  # near copies of one text, few of each other
            own = base.split()
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        elif kind < 0.5:  # a common passage fills most of the text
            text = passage + " " + " ".join(rng.choices(words, k=rng.randint(5, 40)))
        elif kind < 0.65 and rows:
            own = rng.choice(rows)[1].split()
            if own:
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        elif kind < 0.75 and rows:
            text = rng.choice(rows)[1].upper()
        else:
            text = " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 9, 30, 200])))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("block", [150_000, 700])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rows = corpus(260)
    rows += [(900, ""), (901, ""), (902, " \t"), (903, "one two"), (904, "ONE  two\n"), (905, "one"), (906, "word " * 30_000)]
    got = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute(rows)


def test_repeated_rows_nulls_and_no_rows(spark):
    text = "a b c d e f g h"
    rows = [(3, text), (3, text), (2, None), (1, "other words than these are here"), (5, text), (None, text)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, 3, False), (1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (5, 3, False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_sets_as_sketches_are_exact(spark):
    rows = corpus(200, seed=6)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), sketch=100_000)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == brute(rows)


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 1, 2, 3), (1, "a b c d e f g", 1, 2, 3), (2, "A b c d e f g", 4, 5, 6), (3, "quite another text is this one", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, TEXT string, own_id int, own_hash int, Text_hash int")
    got = near_dedup.one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    assert near_dedup.one_of_each(docs.limit(0)).collect() == []
