import random

from colloquy.llm.decontamination import leaks, without_leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdef", k=3)) for _ in range(40)]
    items = [(i, rng.choices(words, k=rng.choice([1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 12, 40]))) for i in range(45)]
    docs = []
    for i in range(150):
        own = rng.choices(words, k=rng.randint(0, 80))
        if i % 2:
            leak = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(leak) // 3)):
                leak[rng.randrange(len(leak))] = rng.choice(words)
            at = rng.randint(0, len(own))
            own[at:at] = leak
        docs.append((i, own))
    want = set()
    for doc, d in docs:
        for item, w in items:
            best = max((sum(0 <= s + k < len(d) and d[s + k] == x for k, x in enumerate(w)) for s in range(-len(w) + 1, len(d))), default=0)
            if best * 100 >= len(w) * 80:
                want.add((doc, item, best, len(w)))
    rows = [(i, "  ".join(w).upper() + "!", 0) for i, w in docs]
    rows += [rows[1], (None, rows[1][1], 0), (500, None, 0), (501, "", 0), (502, "xyz " * 40_000, 0)]
    bench = [(i, ", ".join(w)) for i, w in items] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    b = spark.createDataFrame([*bench, bench[0]], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.matched, r.n_words) for r in leaks(d, b).collect()]
    assert len(got) == len(set(got))
    assert {g for g in got if g[0] is not None} == want
    assert {g[1:] for g in got if g[0] is None} == {w[1:] for w in want if w[0] == 1}
    left = sorted(r.doc_id for r in without_leaks(d, b).collect() if r.doc_id is not None)
    assert left == sorted(i for i, *_ in rows if i is not None and i not in {w[0] for w in want})


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(d, none).collect() == [] and without_leaks(d, none).count() == 1
    assert leaks(d.limit(0), none).collect() == []


def test_null_item_ids_and_clashing_columns(spark):
    text = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, text, 7, 8), (2, "other words", 7, 8)], "doc_id long, Text string, bad_id int, BAD_HASH int")
    b = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.matched) for r in leaks(d, b).collect()] == [(1, None, 10)]
    left = without_leaks(d, b)
    assert left.columns == d.columns and [r.doc_id for r in left.collect()] == [2]
