"""Assessments and alerts in the store: once for each job, open until resolved."""

import datetime as dt

import pytest
from colloquy.api import Api
from colloquy.operators import bias
from colloquy.sources.store import Store

POST = "post_id long, source_name string, category string, external_id string, content string, content_hash string, location string, language string, collected_at timestamp_ntz, month date"


@pytest.fixture
def store(spark, tmp_path):
    found = Store(spark, str(tmp_path / "store"))
    found.migrate()
    day = dt.datetime(2024, 5, 1)
    found.append("raw_posts", spark.createDataFrame([(i, "src1", "news", f"e{i}", "x", "h", "London" if i < 9 else None, "en", day, day.date()) for i in range(12)], POST))
    found.append("sentiment_results", spark.createDataFrame([(i, -1, -0.5, "negative", [], [], 2) for i in range(12)], found.schemas["sentiment_results"]))
    rows = [(f"{i}-{k}", i, 1 if i < 10 else 2, k, "h", "", None) for i in range(12) for k in ("sentiment", "relevance")]
    found.append("decision_audit_log", spark.createDataFrame(rows, found.schemas["decision_audit_log"]))
    return found


def test_assessments_and_alerts_are_stored_once(spark, store):
    api = Api(spark, "unused")
    for _ in range(2):
        alerts = sorted((r.job_id, r.assessment_type, r.severity) for r in api.assess(store, 1).collect())
        assert alerts == [(1, "location_concentration", "critical"), (1, "negative_dominance", "warning")]
    assert store.read("bias_assessments").count() == 3
    assert bias.stored_posts(store, 1).count() == 10  # each post once, however many decisions


def test_a_resolved_alert_stays_resolved(spark, store):
    api = Api(spark, "unused")
    api.assess(store, 1)
    bias.resolve(store, 1, "negative_dominance", "2024-06-01 00:00:00")
    bias.resolve(store, 1, "negative_dominance", "2024-07-01 00:00:00")
    assert [r.assessment_type for r in api.assess(store, 1).collect()] == ["location_concentration"]
    assert [r.resolved_at for r in store.read("alert_events").where("assessment_type = 'negative_dominance'").collect()] == [dt.datetime(2024, 6, 1)]


def test_a_job_without_posts(spark, store):
    assert Api(spark, "unused").assess(store, 77).collect() == []
    assert store.read("bias_assessments").where("job_id = 77").count() == 3
