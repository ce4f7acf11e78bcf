"""Exact small cases of scorers, checks, insights and formats."""

import datetime as dt
import hashlib
import hmac

import pytest
from colloquy.functions import values
from colloquy.functions.text import with_dqi, with_relevance, with_sentiment
from colloquy.operators import bias, cities, correlation, insights, posts, retention, story, vectors
from colloquy.operators.correlation import profiles
from pyspark.sql import functions as F

CELLS = [
    ("Austin", "s1", "social", 80, 30, 10), ("Austin", "n1", "news", 40, 30, 10), ("Berlin", "p1", "policy", 5, 15, 50), ("Berlin", "s1", "social", 5, 15, 10),
    ("Tokyo", "s1", "social", 65, 17, 8), ("Tokyo", "a1", "academic", 5, 3, 2), ("Delhi", "s1", "social", 4, 0, 0),
]
PLACES = {"Austin": (30.3, -97.7), "Berlin": (52.5, 13.4), "Tokyo": (35.7, 139.7), "Delhi": (28.6, 77.2)}


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(*c, sum(c[3:])) for c in CELLS], "city string, source_name string, category string, positive long, neutral long, negative long, total long")


@pytest.fixture(scope="module")
def city_rows(spark, cells):
    places = spark.createDataFrame([(c, *p) for c, p in PLACES.items()], "city string, lat double, lng double")
    return cells.groupBy("city").agg(*[F.sum(c).alias(c) for c in ("positive", "neutral", "negative", "total")]).join(places, "city")


def test_sentiment_thresholds_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "Good, good day!"), (2, ""), (3, None), (4, "terrible  fraud\n"), (5, "plain words only")], "id int, content string")
    got = {r.id: (r.score, r.token_count, r.indicator, r.positive_words, r.negative_words) for r in with_sentiment(df).collect()}
    assert got[1] == (6, 3, "positive", ["good", "good"], [])
    assert got[2] == got[3] == (0, 0, "neutral", [], [])
    assert got[4] == (-8, 2, "negative", [], ["terrible", "fraud"])
    assert got[5] == (0, 3, "neutral", [], [])


def test_relevance_matches_substrings_once(spark):
    df = spark.createDataFrame([("ChatGPT gpt asked Robert",), ("",), (None,)], "content string")
    got = [(r.matched_keywords, r.relevance, r.is_relevant) for r in with_relevance(df).collect()]
    assert got == [(["gpt", "bert"], 0.1, True), ([], 0.0, False), ([], 0.0, False)]
    strict = with_relevance(df, ["gpt", "bert"], weight=0.6, above=0.99).first()
    assert strict.relevance == 1.0 and strict.is_relevant


def test_dqi_dimensions(spark):
    long = "word " * 49 + "because research shows we should build a solution"
    df = spark.createDataFrame([(long,), ("  ",), ("idiot moron dumb stupid hate",)], "content string")
    a, b, c = with_dqi(df).collect()
    assert (a.participation, a.justification, a.respectfulness, a.constructiveness, a.evidence) == (1.0, 0.5, 1.0, 1.0, 1.0)
    assert b.dqi_total == 0 and b.respectfulness == 0
    assert c.respectfulness == 0


def test_payloads_lose_personal_keys(spark):
    df = spark.createDataFrame([(1, "reddit", '{"id":"x","title":" T ","selftext":"b  c","author":"me"}'), (2, "rss", '{"text":"","body":"B","email":"e"}'), (3, "rss", "{}")], "post_id long, source_type string, payload string")
    got = {r.post_id: r for r in posts.normalised(df).collect()}
    assert got[1].content == "T b c" and got[1].external_id == "x" and "author" not in got[1].payload
    assert got[2].content == "B" and got[2].payload == '{"text":"","body":"B"}'
    assert got[3].content == "" and got[3].content_hash == hashlib.sha256(b"").hexdigest()


def test_hourly_series_fills_gaps_and_drops_the_future(spark):
    now = dt.datetime(2024, 7, 1, 12, 0)
    rows = [("a", now - dt.timedelta(minutes=5), "positive"), ("a", now - dt.timedelta(minutes=125), "negative"), ("b", now + dt.timedelta(hours=2), "positive"), ("c", now - dt.timedelta(hours=60), "neutral")]
    df = spark.createDataFrame(rows, "category string, collected_at timestamp_ntz, indicator string")
    got = posts.hourly(df, 4, "2024-07-01 12:30:00").orderBy("hour").collect()
    assert [(r.category, r.hour.hour, r.total) for r in got] == [("a", 9, 1), ("a", 10, 0), ("a", 11, 1), ("a", 12, 0)]
    assert posts.hourly(df, 500).where("category = 'a'").count() == 48
    with pytest.raises(ValueError):
        posts.hourly(df, "1.5")


def test_listing_checks_its_parameters(spark):
    df = spark.createDataFrame([], "post_id long, content string, source_name string, category string, location string, indicator string, comparative double, collected_at timestamp_ntz")
    for bad in ({"limit": 0}, {"limit": 101}, {"limit": "x"}, {"location": " "}, {"from_": "yesterday"}):
        with pytest.raises(ValueError):
            posts.listed(df, **bad)
    assert posts.listed(df, 5, category="news").count() == 0


def test_themes_ties_volume_and_partition(spark):
    rows = [(i, c, ind, k) for i, (c, ind, k) in enumerate([("news", "positive", ["gpt", "gpt"]), ("blog", "positive", ["gpt"]), ("blog", "neutral", ["gpt", "nlp"]), ("news", "negative", ["gpt", "nlp"])])]
    found = posts.themes(spark.createDataFrame(rows, "post_id int, category string, indicator string, matched_keywords array<string>"))
    assert [(r.keyword, r.volume, r.positive, r.top_category) for r in found.collect()] == [("gpt", 4, 2, "blog")]
    assert posts.partitioned_themes(found, "warm").count() + posts.partitioned_themes(found, "cold").count() == 1
    with pytest.raises(ValueError):
        posts.partitioned_themes(found, "hot")


def test_bias_checks(spark):
    rows = [(1, "x", "a", "negative", -0.5), (2, "x", "a", "negative", -0.3), (3, "x", "b", "negative", 0.2), (4, "y", "b", "neutral", 0.0), (5, "", "b", "negative", 0.1)]
    df = spark.createDataFrame(rows, "post_id int, location string, category string, indicator string, comparative double")
    got = {r.assessment_type: r for r in bias.assessments(df).collect()}
    assert got["location_concentration"].metric_value == 0.75 and got["location_concentration"].severity == "warning"
    assert got["platform_sentiment_parity"].group_value == "a vs b" and abs(got["platform_sentiment_parity"].metric_value - 0.5) < 1e-9
    assert got["negative_dominance"].metric_value == 0.8 and got["negative_dominance"].is_violation
    none = {r.assessment_type: (r.group_value, r.metric_value, r.is_violation) for r in bias.assessments(df.limit(0)).collect()}
    assert none == {"location_concentration": ("none", 0.0, False), "platform_sentiment_parity": ("none", 0.0, False), "negative_dominance": ("negative", 0.0, False)}


def test_insights_of_the_four_cities(cells, city_rows):
    assert tuple(insights.totals(city_rows).select("positive", "neutral", "negative", "total").first()) == (204, 110, 90, 404)
    got = {r.kind: r.city for r in insights.superlatives(city_rows).collect()}
    assert got == {"highest_volume": "Austin", "most_positive": "Tokyo", "most_negative": "Berlin"}
    assert {r.kind: r.city for r in insights.ratio_extremes(city_rows).collect()} == {"highest": "Tokyo", "lowest": "Berlin"}
    assert {r.city: r.category for r in insights.dominant_categories(cells).collect()} == {"Austin": "social", "Berlin": "policy", "Tokyo": "social", "Delhi": "social", "*": "social"}
    assert {r.category: r.volume for r in insights.ribbon(cells).collect()} == {"social": 244, "news": 80, "policy": 70, "academic": 10}
    assert insights.source_concentration(cells).first().city == "Tokyo"
    assert insights.widest_divide(cells).first().city == "Berlin"
    assert {r.region: r.total for r in insights.regions(city_rows).collect()} == {"Americas": 200, "Europe-Africa": 100, "Asia-Pacific": 104}
    shares = insights.breakdown(cells).groupBy("city").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in shares)


def test_rankings_break_ties_by_volume_both_ways(spark):
    rows = spark.createDataFrame([("A", 6, 0, 4, 10), ("B", 12, 0, 8, 20), ("C", 1, 1, 0, 2)], "city string, positive long, neutral long, negative long, total long")
    assert [r.city for r in story.by_net(rows, True).collect()] == ["B", "A"] == [r.city for r in story.by_net(rows, False).collect()]
    assert [r.city for r in story.loudest(rows).collect()] == ["B", "A", "C"]


def test_dirty_cities(spark):
    raw = spark.createDataFrame([("a", "10", "20", "5", "-2", "x"), ("b", "91", "0", "1", "1", "1"), ("c", None, "0", "1", "1", "1"), ("d", "NaN", "0", "1", "1", "1"), ("e", "0", "0", "Infinity", "2.9", None)], "city string, lat string, lng string, positive string, neutral string, negative string")
    got = {r.city: (r.positive, r.neutral, r.negative, r.total, r.dominant) for r in cities.normalised_cities(raw).collect()}
    assert got == {"a": (5, 0, 0, 5, "positive"), "e": (0, 2, 0, 2, "neutral")}


def test_demo_fallback(spark):
    live = spark.createDataFrame([("x", 1)], "city string, n int")
    demo = spark.createDataFrame([("y", 2)], "city string, n int")
    assert [r.city for r in cities.with_demo_fallback(live, demo).collect()] == ["x"]
    assert [r.city for r in cities.with_demo_fallback(live.limit(0), demo).collect()] == ["y"]


def test_formats(spark):
    df = spark.createDataFrame([(0.12345, 1234567.9, -0.256), (None, None, None), (float("nan"), -3.7, 0.0)], "p double, n double, s double")
    got = [tuple(r) for r in df.select(values.percent_text(F.col("p")), values.count_text(F.col("n")), values.net_text(F.col("s"))).collect()]
    assert got == [("12.3%", "1,234,567", "−0.26"), ("—", "—", "—"), ("—", "-3", "+0.00")]
    assert values.rendered("{a} and {b}", {"a": "1", "b": "2"}) == "1 and 2"
    with pytest.raises(KeyError):
        values.rendered("{c}", {})
    assert df.select(values.escaped(F.lit("<a & \"b'>"))).first()[0] == "&lt;a &amp; &quot;b&#39;&gt;"


@pytest.mark.parametrize("key", ["k", "k" * 100])
def test_hmac(spark, key):
    got = spark.range(1).select(values.hmac_sha256(key, F.lit("message"))).first()[0]
    assert got == hmac.new(key.encode(), b"message", "sha256").hexdigest()


def test_profiles_accept_the_threshold_and_keep_the_first_topic(spark):
    rows = [(1, 1, "a", dt.datetime(2024, 1, 2), 0.85, "t2"), (2, 1, "b", dt.datetime(2024, 1, 1), 0.95, "t1"), (3, 1, "a", dt.datetime(2024, 1, 3), 0.84, "t3"), (4, 1, "a", dt.datetime(2024, 1, 3), None, "t3")]
    df = spark.createDataFrame(rows, "event_id int, user_id int, source_id string, sighted_at timestamp_ntz, confidence double, topic string")
    r = profiles(df).first()
    assert (r.sighting_count, r.distinct_platforms, r.correlation_confidence, r.topic_affinity) == (2, 2, 0.95, "t1")
    ids = spark.range(50).select(correlation.pseudo_id(F.col("id").cast("string")).alias("p")).collect()
    assert all(len(x.p.split("-")) == 2 for x in ids) and len({x.p for x in ids}) > 20


def test_rollups_keep_totals_and_merge_empty_locations(spark):
    rows = [("2024-05-03", ["gpt"], "", "positive"), ("2024-05-04", ["gpt"], None, "negative"), ("2024-05-05", [], "X", "neutral")]
    df = spark.createDataFrame([(dt.datetime.fromisoformat(d), k, "news", loc, "en", i, 0.0) for d, k, loc, i in rows], "collected_at timestamp_ntz, matched_keywords array<string>, category string, location string, language string, indicator string, comparative double")
    got = retention.topic_rollup(df).collect()
    assert {(r.topic, r.location, r.total) for r in got} == {("gpt", None, 2), ("general", "X", 1)}
    with pytest.raises(ValueError):
        retention.months_to_compact(df, retention.none_compacted(spark), "2024-09-01", "2024-13")
    assert retention.months_to_compact(df, retention.none_compacted(spark), "2024-09-01", "2024-05").first().month == dt.date(2024, 5, 1)


def test_vectors(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "k int, v string, version int")
    new = spark.createDataFrame([(2, "b", 1), (3, "b", 2)], "k int, v string, version int")
    assert {(r.k, r.v) for r in vectors.upserted(old, new, "k", "version").collect()} == {(1, "a"), (2, "b"), (3, "b")}
    df = spark.createDataFrame([(1, "hello world"), (2, "")], "post_id int, content string").select("post_id", vectors.embed("content").alias("e"))
    got = {r.post_id: r.e for r in df.collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and sum(got[2]) == 0


def test_nearest_in_blocks_equals_one_broadcast(spark, monkeypatch):
    rows = [(i, [float((i * 7) % 5 - 2), float((i * 3) % 7 - 3), 1.0]) for i in range(40)] + [(99, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "post_id long, embedding array<float>")
    whole = sorted(map(tuple, vectors.nearest(df.where("post_id < 9"), df, 3).select("query_id", "rank", "post_id").collect()))
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 4)
    monkeypatch.setattr(vectors, "CHUNK_VECTORS", 7)
    assert whole == sorted(map(tuple, vectors.nearest(df.where("post_id < 9"), df, 3).select("query_id", "rank", "post_id").collect()))
    assert len(whole) == 27


def test_ingest_twice_adds_nothing(spark):
    key = "source_name string, external_id string, n int"
    batch = spark.createDataFrame([("s", "1", 1), ("s", "1", 1), ("s", "2", 2)], key)
    first = posts.new_posts(batch, batch.limit(0))
    assert first.count() == 2 and posts.new_posts(batch, first).count() == 0


def test_formats_take_ties_up(spark):
    df = spark.createDataFrame([(0.125, 0.0625), (-0.125, 0.1245), (0.375, 0.0005), (1.005, 1.0), (0.0, 0.5)], "s double, p double")
    got = [tuple(r) for r in df.select(values.net_text(F.col("s")), values.percent_text(F.col("p"))).collect()]
    assert got == [("+0.13", "6.3%"), (f"{values.MINUS}0.13", "12.5%"), ("+0.38", "0.1%"), ("+1.00", "100.0%"), ("+0.00", "50.0%")]
