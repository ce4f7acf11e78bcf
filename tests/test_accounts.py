"""Accounts linked over platforms, and pseudonyms."""

import datetime as dt
import random

import pyarrow as pa
from colloquy.operators import accounts
from colloquy.operators.accounts import pair_confidence, persons
from colloquy.operators.correlation import correlated, pseudo_id
from colloquy.plans.components import components
from pyspark.sql import functions as F

ROWS = "account string, platform string, content string, collected_at timestamp_ntz, topics array<string>"


def planted(people=12, seed=2):
    """Each person writes under two accounts with words, hours, topics and a style of their own."""
    rng = random.Random(seed)
    rows, vectors = [], []
    for p in range(people):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(40)]
        hours, topics, style = rng.sample(range(24), 2), rng.sample(["gpt", "llm", "bert", "nlp"], 2), [rng.gauss(0, 1) for _ in range(8)]
        for platform in ("red", "blue"):
            for i in range(30):
                at = dt.datetime(2024, 3, 3 + rng.choice([0, 1]), hours[i % 2], rng.randrange(60))
                rows.append((f"{platform}/{p}", platform, " ".join(rng.choices(words, k=30)), at, topics))
                vectors.append((f"{platform}/{p}", [x + rng.gauss(0, 0.1) for x in style]))
    return rows, vectors


def frames(spark, rows, vectors):
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(vectors, "account string, embedding array<double>")


def test_planted_accounts_are_linked_and_no_others(spark):
    rows, vectors = planted()
    rows += [("red/odd", "red", None, None, []), ("blue/odd", "blue", "", None, None), (None, "red", "words", None, ["gpt"]), ("blue/odd", "blue", "x", None, None)]
    posts, own = frames(spark, rows, vectors)
    found = pair_confidence(posts, own).collect()
    linked = {(r.a, r.b) for r in found if r.linked}
    assert linked == {(f"blue/{p}", f"red/{p}") for p in range(12)}
    assert all(r.linked == (r.confidence >= 0.85) for r in found)
    for r in found:
        assert abs(0.4 * r.style + 0.25 * r.temporal + 0.2 * r.topic + 0.15 * r.vocabulary - r.confidence) < 1e-6
    names = {r.account: (r.person, r.pseudo_id) for r in persons(posts, pair_confidence(posts, own)).collect()}
    assert len(names) == 26 and len(set(names.values())) == 14 and all(names[f"red/{p}"] == names[f"blue/{p}"] for p in range(12))


def test_vocabulary_is_tf_idf_of_letters(spark):
    import math
    from collections import Counter

    rows, vectors = planted(4)
    rows.append(("red/long", "red", "z" * 5_000 + " ab ñandú \U0001f600\U0001f600", None, []))
    posts, own = frames(spark, rows, vectors)
    tf = {}
    for account, _, content, _, _ in rows:
        for w in content.split():
            w = f"_{w}_"
            tf.setdefault(account, Counter()).update(w[i : i + 4] for i in range(len(w) - 3))
    df = Counter(g for c in tf.values() for g in c)
    found = {(r.account, r.gram): r.weight for r in accounts.vocabulary(posts).collect()}
    assert set(found) == {(a, g) for a in tf for g in tf[a]}
    for (a, g), weight in found.items():
        assert abs(weight - (1 + math.log(tf[a][g])) * math.log(len(tf) / df[g])) < 1e-9


def test_no_accounts(spark):
    posts, own = frames(spark, [], [])
    assert pair_confidence(posts, own).collect() == [] and persons(posts, pair_confidence(posts, own)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("s0", f"s{i}") for i in range(1, 30)] + [("x", "x"), ("y", "z"), ("z", "y")]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert found == {f"c{i:03}": "c000" for i in range(61)} | {f"s{i}": "s0" for i in range(30)} | {"y": "y", "z": "y"}


def test_a_hundred_thousand_signals_are_as_many_profiles(spark):
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("style"), F.lit("t").alias("topic"), F.lit(0.9).alias("confidence"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("sighted_at"))
    found = correlated(rows)
    assert found.count() == n and found.select("pseudo_id").distinct().count() == n
    assert spark.range(n).select(pseudo_id(F.col("id").cast("string")).alias("p")).distinct().count() == n


def test_grams_are_counted_alike_by_numbers_and_by_signs(spark):
    from collections import Counter

    lines = ["_plain_\n_ñandú_\n_a__b_", "_x_", "__", "_\U0001f600\U0001f600z_\n_ab_", "_nul\0_\n_nul_", ""]
    for text in [*lines, "\n".join(lines)]:
        wanted = Counter(x[i : i + 4] for x in text.split("\n") for i in range(len(x) - 3))
        assert dict(zip(*accounts._counted(text), strict=True)) == wanted


def test_an_account_of_many_posts_is_counted_in_chunks_and_rare_grams_join_by_shuffle(spark, monkeypatch):
    rows, vectors = planted(3)
    posts, own = frames(spark, rows, vectors)
    key = ["account", "gram", "tf", "df", "weight"]
    whole = sorted(map(tuple, accounts.vocabulary(posts).select(key).collect()))
    before = {(r.a, r.b): r.vocabulary for r in pair_confidence(posts, own).collect()}
    batch = pa.RecordBatch.from_pydict({"account": ["a", "a", "a", "b"], "lines": ["_some_\n_words_", "_words_", "_some_\n_more_", "_words_"]})
    counted = [list(accounts._count_accounts(iter([batch])))]
    monkeypatch.setattr(accounts, "CHUNK", 10)
    counted.append(list(accounts._count_accounts(iter([batch]))))
    assert len({frozenset((r["account"], r["gram"], r["tf"]) for b in found for r in b.to_pylist()) for found in counted}) == 1
    monkeypatch.setattr(accounts, "COMMON", 5)
    assert sorted(map(tuple, accounts.vocabulary(posts).select(key).collect())) == whole
    after = {(r.a, r.b): r.vocabulary for r in pair_confidence(posts, own).collect()}
    assert before and set(before) == set(after) and all(abs(before[p] - after[p]) < 1e-12 for p in before)


def test_grams_are_not_shuffled_row_by_row(spark):
    """Before, every gram of every account went through shuffles and checkpoints, and once more for each pair."""
    grams = accounts.vocabulary(frames(spark, *planted(2))[0])
    assert grams.select("account", "gram", "weight").count() > 0
    plan = accounts.packed(grams)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "Exchange hashpartitioning(account" in line]
    assert scans and "MapInPandas" in plan and not any("gram" in line for line in scans)


def test_accounts_with_the_same_grams_alone_have_no_vocabulary_in_common(spark):
    rows = [(f"{p}/1", p, "quite the same words", None, []) for p in ("red", "blue")]
    found = pair_confidence(*frames(spark, rows, [])).collect()
    assert [(r.a, r.b, r.vocabulary) for r in found] == [("blue/1", "red/1", 0.0)]
