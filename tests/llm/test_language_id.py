import random
import zlib

from colloquy.llm.common import fold
from colloquy.llm.language_id import UNKNOWN, identify, train
from pyspark.sql import functions as F

SYLLABLES = {"aa": "tion er ing the ou sh".split(), "bb": "keit ung sch ein pf zu".split(), "cc": "mente ción os ar qu ie".split()}


def rows(n, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(12, 60))), lang))
    return out


def test_held_out_accuracy_and_edges(spark):
    known = rows(400)
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 345 --- ²", "bb"), (1003, "Tioner", None), (1003, "Tioner", None), (None, "keitung", "bb"), (1004, "ting the " * 20_000, "aa")]
    docs = spark.createDataFrame(known + odd, "doc_id long, text string, lang string")
    found = identify(docs.drop("lang").withColumn("lang", F.lit(1)), train(docs, fold(F.col("doc_id"), 4) != 2)).collect()
    assert len(found) == len(known) + len(odd) and all(0 <= r.lang_score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    held = [(by_id[i].lang_pred, lang) for i, _, lang in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    for i in (1000, 1001, 1002):
        assert by_id[i].lang_pred == UNKNOWN and by_id[i].lang_rejected and by_id[i].lang_score == 0
    assert by_id[1003].lang_pred in SYLLABLES and by_id[1004].lang_pred == "aa"


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(docs, train(docs, F.lit(True))).collect()] == [UNKNOWN]
    assert identify(docs.limit(0), {"aa": [b"x" * 100] * 4}).collect() == []


def test_result_names_many_languages_and_column_case(spark):
    rng = random.Random(5)
    known = [(i, " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(20)), f"l{i % 600:03}") for i in range(600)]
    contents = train(spark.createDataFrame(known, "doc_id long, text string, lang string"), F.lit(True))
    assert len(contents) == 600 and all(len(own) == 4 for own in contents.values())
    docs = spark.createDataFrame([(1, "ting the", "mine")], "doc_id long, TEXT string, lang_pred string")
    found = identify(docs, {"aa": [b"ting the ou"] * 4, "bb": [b"keit ung sch"] * 4}, ("lang_pred_", "lang_score", "lang_rejected")).first()
    assert found.lang_pred == "mine" and found.lang_pred_ == "aa"


def test_all_of_a_long_text_may_teach(spark):
    long = "xyz " * 4_000 + "keitung schein " * 400
    contents = train(spark.createDataFrame([(1, long, "aa")], "doc_id long, text string, lang string"), F.lit(True))
    assert any(b"keitung" in own for own in contents["aa"]) and any(b"xyz" in own for own in contents["aa"])
