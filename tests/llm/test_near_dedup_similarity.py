import random

import corpus_pipeline
import pytest
from colloquy.llm import near_dedup
from colloquy.llm.near_dedup import exact_below, least_shared, near_duplicates, needed, one_of_each


def shingled(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def corpus(n, seed=8):
    """Texts of many lengths, each with copies of which ever more words at the end are others."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    rows = []
    for _ in range(n):
        own = rng.choices(words, k=rng.choice([12, 25, 33, 38, 45, 80, 160]))
        rows.append(" ".join(own))
        for share in rng.sample([0.05, 0.08, 0.09, 0.1, 0.11, 0.12, 0.15], 2):
            k = max(1, round(share * len(own)))
            rows.append(" ".join(own[:-k] + rng.choices(words, k=k)))
    return list(enumerate(rows))


def brute(rows, percent):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, find(i)) for i in range(len(rows)))


@pytest.mark.parametrize("block", [150_000, 700])
def test_components_equal_brute_force_at_both_similarities(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = {p: sorted((r.doc_id, r.component_id) for r in near_duplicates(docs, p).collect()) for p in (80, 85)}
    assert at[80] == brute(rows, 80) and at[85] == brute(rows, 85) and at[80] != at[85]


def test_pipeline_stage_drops_copies_between_80_and_85(spark):
    own = [f"w{i}" for i in range(204)]
    rows = [(1, " ".join(own), "x"), (2, " ".join([*own[:-20], *(f"v{i}" for i in range(20))]), "x"), (3, " ".join(f"u{i}" for i in range(90)), "x")]
    assert 0.8 <= similarity(shingled(rows[0][1]), shingled(rows[1][1])) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in one_of_each(docs).collect()) == [1, 2, 3]


def test_bounds_follow_from_the_similarity():
    assert [least_shared(p) for p in (80, 85)] == [16, 19] and [exact_below(p) for p in (80, 85)] == [32, 34]
    for p in (80, 85):
        for size in range(1, exact_below(p)):
            assert size * 100 // p <= near_dedup.SKETCH and needed(size, p) == -(-size * p // 100)
