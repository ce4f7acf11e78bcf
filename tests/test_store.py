import os
from datetime import date

import pytest
from colloquy.api import Api
from colloquy.sources.store import TABLES, Store
from colloquy.sources.tables import posts
from pyspark.sql import functions as F

DATA = os.environ.get("COLLOQUY_TEST_DATA", "/root/testdata/sf0.001")


def test_migrations_run_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.migrate() == [t[0] for t in TABLES] and len(TABLES) == 18
    assert store.migrate() == [] and store.is_connected()
    assert len(store.migrate(fresh=True)) == 18


def test_append_and_replace(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.migrate()
    rows = spark.createDataFrame([("a", "A", "rss", "news", True), ("a", "A", "rss", "news", True), ("b", "B", "api", "blog", False)], "source_name string, display_name string, source_type string, category string, active boolean")
    store.append("data_sources", rows)
    store.append("data_sources", rows)
    assert store.read("data_sources").count() == 2
    store.replace("data_sources", store.read("data_sources").where("active"))
    assert [r.source_name for r in store.read("data_sources").collect()] == ["a"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_pipeline_is_idempotent_and_endpoints_answer(spark, tmp_path):
    store, api = Store(spark, str(tmp_path)), Api(spark, DATA)
    store.migrate()
    batch = posts(spark, DATA).where("post_id < 30")
    api.run_pipeline(store, batch)
    api.run_pipeline(store, batch)
    assert store.read("raw_posts").count() == store.read("sentiment_results").count() == 30
    assert store.read("decision_audit_log").count() == 90
    assert api.latest(500).count() == 100 and api.query(3, category="news").count() == 3
    with pytest.raises(ValueError):
        api.query(500)
    assert api.themes(2).count() <= 2 and api.health().count() == 1 and api.timeseries(2).count() % 2 == 0
    assert "input_hash" not in api.audit(8).columns and "input_hmac" in api.audit(8, "k").columns
    assert api.sources(True).count() < api.sources().count() and api.methodology().count() == 4
    assert api.health().first().status == "running" and {r.assessment_type for r in api.bias().collect()} == {"location_concentration", "platform_sentiment_parity", "negative_dominance"}
    assert len(api.audited_post(8).first().content_snippet) <= 120 and "justification" in api.audit(8).columns
    with pytest.raises(LookupError):
        api.audited_post(-1)
    assert api.city_sentiment("news").count() > 0 and api.summary("news").count() == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_compaction_of_the_store(spark, tmp_path):
    store, api = Store(spark, str(tmp_path)), Api(spark, DATA)
    store.migrate()
    batch = posts(spark, DATA).where("post_id < 40").withColumn("collected_at", F.expr("case when post_id < 25 then timestamp_ntz'2024-03-05 01:00:00' else timestamp_ntz'2024-09-05 01:00:00' end"))
    api.run_pipeline(store, batch)
    store.append("post_embeddings", spark.createDataFrame([(3, [1.0], "m"), (30, [1.0], "m")], "post_id long, embedding array<float>, model_name string"))
    done = api.compact(store, "2024-09-29").collect()
    assert [(str(r.month), r.posts_compacted) for r in done] == [("2024-03-01", 25)]
    assert done[0].rollups_created == store.read("monthly_topic_rollups").count()
    raw = {r.post_id: r.content for r in store.read("raw_posts").collect()}
    assert len(raw) == 40 and all((raw[i] is None) == (i < 25) for i in raw)
    assert [r.post_id for r in store.read("post_embeddings").collect()] == [30]
    assert store.read("data_retention_log").count() == 25
    assert store.read("monthly_source_rollups").agg(F.sum("total")).first()[0] == 25
    assert api.compact(store, "2024-09-29").count() == 0 and store.read("compaction_log").count() == 1
    with pytest.raises(ValueError):
        api.compact(store, "2024-09-29", "2024-13")


def post(post_id, source, external, day="2024-01-05", content="text"):
    return (post_id, source, "news", external, content, "h", "London", "en", None, date.fromisoformat(day).replace(day=1))


def test_membership_reads_buckets_where_they_lie(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=5)
    store.migrate()
    columns = store.schemas["raw_posts"]
    first = spark.createDataFrame([post(i, f"src{i % 3}", f"e{i}", f"2024-0{1 + i % 4}-03") for i in range(40)], columns)
    store.append("raw_posts", first)
    store.append("raw_posts", first)
    store.append("raw_posts", spark.createDataFrame([post(i, f"src{i % 3}", f"e{i}", "2024-06-03") for i in range(30, 50)], columns))
    held = store.read("raw_posts").collect()
    assert sorted(r.post_id for r in held) == list(range(50)) and {str(r.month) for r in held if r.post_id < 40} == {f"2024-0{m}-01" for m in range(1, 5)}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.missing("raw_posts", first)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = [x for x in plan.splitlines() if x.strip()]
    at = next(i for i, x in enumerate(lines) if "Bucketed: true" in x)
    assert "SelectedBucketsCount: 5 out of 5" in lines[at] and "ReadSchema: struct<source_name:string,external_id:string>" in lines[at]
    above = next(i for i in range(at, -1, -1) if "SortMergeJoin" in lines[i])
    side = lines[max(i for i in range(above, at) if lines[i].index(lines[i].lstrip(" :+-")) == lines[above].index("SortMergeJoin") + 3) : at]
    assert side and not any("Exchange" in x for x in side)  # nothing of the store is shuffled
    assert sum("Exchange" in x for x in lines[above:at]) == 1  # the rows that come are, once


def test_null_keys_are_added_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3)
    store.migrate()
    rows = spark.createDataFrame([post(1, None, "a"), post(2, None, "a"), post(3, "s", None), post(4, None, None), post(5, "s", "a")], store.schemas["raw_posts"])
    store.append("raw_posts", rows)
    store.append("raw_posts", rows)
    assert sorted((r.source_name or "", r.external_id or "") for r in store.read("raw_posts").collect()) == [("", ""), ("", "a"), ("s", ""), ("s", "a")]


def test_another_session_opens_the_same_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3)
    store.migrate()
    columns = store.schemas["raw_posts"]
    store.append("raw_posts", spark.createDataFrame([post(1, "s", "a"), post(2, "s", "b", "2024-02-09")], columns))
    spark.sql(f"drop table {store._table('raw_posts')}")  # as if the catalog were new
    again = Store(spark, str(tmp_path), buckets=64)
    assert again.buckets == 3 and again.read("raw_posts").count() == 2
    again.append("raw_posts", spark.createDataFrame([post(1, "s", "a"), post(3, "s", "c", "2024-03-09")], columns))
    assert sorted(r.post_id for r in store.read("raw_posts").collect()) == [1, 2, 3]


def test_replacing_keeps_buckets_and_other_months(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3)
    store.migrate()
    store.append("raw_posts", spark.createDataFrame([post(1, "s", "a"), post(2, "s", "b", "2024-02-09"), post(3, "s", "c", "2024-02-09")], store.schemas["raw_posts"]))
    store.replace_partitions("raw_posts", store.read("raw_posts").where("month = date'2024-02-01'").withColumn("content", F.lit(None).cast("string")))
    assert sorted((r.post_id, r.content) for r in store.read("raw_posts").collect()) == [(1, "text"), (2, None), (3, None)]
    vectors = spark.createDataFrame([(i, [float(i)], "m") for i in range(20)], store.schemas["post_embeddings"])
    store.append("post_embeddings", vectors)
    store.replace("post_embeddings", store.read("post_embeddings").where("post_id % 2 = 0"))
    store.append("post_embeddings", vectors.where("post_id < 4"))
    assert sorted(r.post_id for r in store.read("post_embeddings").collect()) == sorted([*range(0, 20, 2), 1, 3])
    by_id = spark.range(20).withColumnRenamed("id", "post_id").join(store.read("post_embeddings"), "post_id")
    assert by_id.count() == 12


def test_a_store_without_buckets_goes_on(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=0)
    store.migrate()
    rows = spark.createDataFrame([post(1, "s", "a"), post(2, None, "b")], store.schemas["raw_posts"])
    store.append("raw_posts", rows)
    again = Store(spark, str(tmp_path))
    again.append("raw_posts", rows)
    assert again.buckets == 0 and again.read("raw_posts").count() == 2
