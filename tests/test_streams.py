"""Streams over several batches: restarts, repeated batches, dead letters, states that end."""

import datetime as dt
import json
import random

import pytest
from colloquy.operators.correlation import profiles
from colloquy.sources.store import Store
from colloquy.streaming.ingest import Ingest, job_states, replayed, vectors_of
from colloquy.streaming.profiles import SIGHTING, folded, run
from pyspark.sql import functions as F

GPT = "a large language model and an llm with embeddings, gpt, bert, nlp and the transformer: machine learning, deep learning, ai safety"


def line(i, content=GPT, **more):
    at = "2024-05-01T10:00:00"
    return json.dumps({"post_id": i, "source_name": "src1", "source_type": "rss", "category": "news", "location": "London", "language": "en", "collected_at": at, "confidence": 0.9, "payload": json.dumps({"text": content, "email": "a@b"})} | more)


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.fixture
def store(spark, tmp_path):
    found = Store(spark, str(tmp_path / "store"))
    found.migrate()
    return found


def test_a_batch_fans_out_and_repeating_it_adds_nothing(spark, store):
    ingest = Ingest(store, pause=0)
    batch = lines(spark, line(1), line(1), line(2, "nothing of interest"), line(3, confidence=0.5), line(4, confidence=None), "{broken", json.dumps({"post_id": 5}), line(6, payload=None), line(7, payload="[1]"), line(8, "  "))
    for _ in range(2):
        ingest.batch(batch, 0)
        assert sorted(r.post_id for r in store.read("raw_posts").collect()) == [1, 2, 3, 4]
        assert sorted(r.post_id for r in store.read("post_embeddings").collect()) == [1, 3, 4]
        assert sorted(r.event_id for r in store.read("user_platform_sightings").collect()) == [1]
        assert sorted(r.reason for r in store.read("dead_letters").collect()) == ["no id or source", "no payload", "no payload", "no text", "not an envelope"]
        assert store.read("decision_audit_log").count() == 12
    assert all("a@b" not in r.content for r in store.read("raw_posts").collect())


def test_a_failing_branch_is_tried_again_and_then_leaves_dead_letters(spark, store):
    calls = []

    def fails_twice(passed):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no model")
        return vectors_of(passed)

    Ingest(store, embed_branch=fails_twice, pause=0).batch(lines(spark, line(1)), 0)
    assert len(calls) == 3 and store.read("post_embeddings").count() == 1 and store.read("dead_letters").count() == 0

    def always(passed):
        raise OSError("no model")

    Ingest(store, embed_branch=always, tries=2, pause=0).batch(lines(spark, line(2)), 1)
    letter = store.read("dead_letters").first()
    assert (letter.stage, letter.reason, letter.batch_id) == ("embed", "OSError: no model", 1) and store.read("raw_posts").count() == 2
    assert replayed(store, "embed").first().value == line(2)


def test_a_failing_batch_leaves_a_failed_job_and_may_complete_later(spark, store, monkeypatch):
    ingest, append = Ingest(store, pause=0), store.append

    def refuses(name, rows):
        if name == "decision_audit_log":
            raise OSError("disk full")
        append(name, rows)

    monkeypatch.setattr(store, "append", refuses)
    with pytest.raises(OSError):
        ingest.batch(lines(spark, line(1)), 3)
    monkeypatch.undo()
    assert [(r.job_id, r.status) for r in job_states(store).collect()] == [(3, "failed")] and store.read("raw_posts").count() == 0
    ingest.batch(lines(spark, line(1)), 3)
    assert [(r.job_id, r.status, r.posts_collected, r.posts_processed) for r in job_states(store).collect()] == [(3, "completed", 1, 1)]
    assert store.read("raw_posts").count() == store.read("sentiment_results").count() == 1


def test_stream_over_files_with_a_restart(spark, store, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    for i in range(4):
        (folder / f"{i}.txt").write_text("\n".join([line(2 * i), line(2 * i + 1), line(0), "oops"]))
        if i in (1, 3):
            Ingest(store, pause=0).run(str(folder), state)
    assert sorted(r.post_id for r in store.read("raw_posts").collect()) == list(range(8))
    assert {r.status for r in job_states(store).collect()} == {"completed"} and job_states(store).count() == 4
    Ingest(store, pause=0).run(str(folder), str(tmp_path / "state anew"))
    assert store.read("raw_posts").count() == 8 and store.read("dead_letters").count() == 1


def test_keyed_profiles_over_ten_batches_with_a_restart(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        user = rng.randrange(12)
        day = rng.choice([0, 1, 9]) if user == 0 else rng.randrange(10)  # user 0 is silent for a week
        rows.append((i, user, rng.choice("abc"), start + dt.timedelta(days=day, minutes=rng.randrange(1440)), rng.choice([0.8, 0.85, 0.95, None]), f"t{i % 4}"))
    rows += [(1000 + i, 50, "a", start + dt.timedelta(days=9, hours=23), 0.9, "t0") for i in range(3)]
    rows.sort(key=lambda r: r[3])
    source, folder = str(tmp_path / "in"), str(tmp_path / "stream")
    size = -(-len(rows) // 10)

    def add(i):
        spark.createDataFrame(rows[i * size : (i + 1) * size], SIGHTING).coalesce(1).write.mode("append").parquet(source)

    stream = lambda: spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(source)
    for i in range(5):
        add(i)
    run(stream(), folder, silence="2 days")
    for i in range(5, 10):
        add(i)
    found = run(stream(), folder, silence="2 days")
    whole = profiles(spark.createDataFrame(rows, SIGHTING))
    columns = whole.columns
    assert sorted(map(tuple, folded(found).select(columns).collect())) == sorted(map(tuple, whole.collect()))
    ended = found.where("ended and user_id = 0").collect()
    assert len(ended) == 1 and ended[0].last_sighted_at < start + dt.timedelta(days=2)
    assert found.where("user_id = 0").select("episode").distinct().count() == 2


def test_posts_are_scored_once_and_keep_their_own_fields(spark, store, monkeypatch):
    """Before, reading the store again dropped the cached scores, so that they were computed twice; and lines of one id exchanged their contents."""
    from colloquy.streaming import ingest as module

    scored = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        scored.add(1)
        return text

    def with_count(df):
        return df.withColumn("content", counted.asNondeterministic()("content"))

    score = module.with_sentiment
    monkeypatch.setattr(module, "with_sentiment", lambda df: score(with_count(df)))
    batch = lines(spark, *[line(i) for i in range(20)], line(30, "first", location="Tokyo", payload=json.dumps({"text": "first", "id": "a"})), line(30, location="Berlin", payload=json.dumps({"text": "second", "id": "b"})))
    Ingest(store, pause=0).batch(batch, 0)
    found = sorted((r.external_id, r.content, r.location) for r in store.read("raw_posts").where("post_id = 30").collect())
    assert found == [("a", "first", "Tokyo"), ("b", "second", "Berlin")]
    assert store.read("raw_posts").count() == scored.value == 22


def test_what_a_batch_kept_is_removed_with_it(spark, store):
    from colloquy.sources.shared import kept, shared_base

    with kept(spark.range(3)) as rows:
        folder = rows.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
        assert rows.count() == 3 and shared_base(spark)
    import os

    assert not os.path.exists(folder)


def test_a_batch_of_a_user_asks_the_state_store_a_fixed_number_of_times():
    """Before, each platform and each timer was asked for by itself, so that a user cost some 25 ms a batch."""
    from colloquy.streaming.profiles import Episodes
    from pyspark.sql import Row

    class Handle:
        calls, value, timers = 0, None, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.remove(at)

    handle, processor = Handle(), Episodes(1_000)
    processor.init(handle)
    for batch in range(3):
        handle.calls = 0
        rows = [Row(at=batch * 10_000_000 + i * 1_000, event_id=batch * 100 + i, confidence=0.9, topic=f"t{i}", source_id=f"p{batch}{i % 20}") for i in range(50)]
        (found,) = processor.handleInputRows((7,), iter(rows[::-1]), None)
        assert handle.calls <= 4 and handle.timers == {batch * 10_000 + 49 + 1_000}
        assert (found.n, found.topic, found.first, found.last) == (50 * (batch + 1), "t0", 0, rows[-1].at) and len(found.platforms) == 20 * (batch + 1)
