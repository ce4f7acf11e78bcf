"""Queries take whole texts and all rows."""

import pytest
from colloquy.operators import posts
from colloquy.registry import QUERIES


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    same = "word " * 60
    rows = [(i, f"{same}end {i % 2}", "en", "src1") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [float(i % 7), 1.0, float(i % 5)], i % 3) for i in range(501)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label long").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_long_texts_with_equal_openings_are_told_apart(spark, made):
    found = {r.post_id: r for r in QUERIES["normalise_posts_whole"](spark, made).collect()}
    assert found[1].content == "word " * 60 + "end 1" and found[4].content == "word " * 60 + "end 0"
    assert found[1].content_hash != found[4].content_hash and found[1].content_hash == found[7].content_hash
    assert all("end" in r.payload for r in posts.payloads(spark, made).where("post_id % 3 > 0").collect())


def test_every_post_has_its_decisions(spark, made):
    found = QUERIES["audit_trail_json_all"](spark, made).collect()
    assert sorted(r.post_id for r in found) == list(range(60)) and all(r.decisions.count("decision_type") == 3 for r in found)


def test_every_hundredth_post_asks(spark, made):
    found = QUERIES["similar_posts_topk_hundredths"](spark, made).collect()
    assert sorted((r.query_id, r.rank) for r in found) == [(q, k) for q in range(0, 501, 100) for k in range(1, 6)]
