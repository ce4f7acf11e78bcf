import random

import corpus_pipeline
import pytest

LANGS = {"en": "tion er ing the ou sh and of to".split(), "de": "keit ung sch ein pf zu und der die".split()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("tables"))

    def words(n, lang):
        return ["".join(rng.choices(LANGS[lang], k=rng.randint(1, 3))) for _ in range(n)]

    items = [(i, " ".join(words(25, "en"))) for i in range(5)]
    docs, labels, toxic, leaked, copies = [], [], set(), set(), set()
    for i in range(600):
        lang = rng.choice(["en", "de"])
        own = words(rng.randint(30, 120), lang)
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(3):
                own[rng.randrange(len(own))] = "vilest"
        elif i % 50 == 7:
            leaked.add(i)
            own[5:5] = items[i % 5][1].split()
        elif i % 40 == 11 and i > 100:
            twin = next(d for d in docs if d[0] % 40 == 12 and d[0] not in copies | toxic | leaked)
            copies.add(i)
            own, lang = [*twin[1].split(), "more"], twin[2]
        docs.append((i, " ".join(own), lang, "s"))
        labels.append((i, int(i in toxic)))
    docs += [(1000, None, None, "s"), (1001, "", "en", "s"), (1002, "12 34 --", "en", "s"), docs[2], docs[2]]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, toxic, leaked, copies


def test_stages_take_effect_one_after_another(spark, made, tmp_path):
    folder, docs, toxic, leaked, copies = made
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = now.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert now.columns == columns
            ids[name] = sorted(r.doc_id for r in now.collect())
    clean = {d[0] for d in docs} - toxic
    assert len(set(ids["toxicity"]) & toxic) <= 2 and len(clean - set(ids["toxicity"])) <= 2
    known = set(ids["language_id"])
    assert not {1000, 1001, 1002} & known and len(set(ids["toxicity"]) - known - {1000, 1001, 1002}) <= 2
    assert not copies & set(ids["near_dedup"]) and ids["near_dedup"].count(2) <= 1
    assert known - copies == set(ids["near_dedup"])
    assert set(ids["near_dedup"]) - leaked == set(ids["decontamination"])
    assert {r.doc_id for r in now.collect()} == set(ids["decontamination"])
    assert sum(r.length for r in now.collect()) == sum({r.doc_id: r.doc_tokens for r in now.collect()}.values())


def test_run_gives_the_last_stage(spark, made):
    found = corpus_pipeline.run(spark, made[0])
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and found.count() > 0


def test_stages_take_empty_tables_and_keep_clashing_columns(spark, made):
    names = ["toxicity", "lang_pred", "lang_score", "Lang_Rejected", "own_id", "own_hash", "bad_id", "bad_hash", "text_hash", "node", "row", "word"]
    docs = spark.read.parquet(f"{made[0]}/documents.parquet").where("doc_id < 40")
    wide = docs.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, wide, made[0])
        rows = found.collect()
        assert rows and stage(spark, wide.limit(0), made[0]).collect() == []
        if name != "packing":
            assert found.columns == wide.columns and all(r[n] == i for r in rows for i, n in enumerate(names))
