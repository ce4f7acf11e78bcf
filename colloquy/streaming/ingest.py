"""The ingest worker as a stream: payload lines in, scores, vectors and sightings out, in one `foreachBatch`.

A line is a JSON envelope with the raw payload inside. A batch is parsed, normalised and joined against the
store once; new posts are scored in one pass. Those that pass the relevance gate go on to two branches,
vectors and sightings. A branch is tried again with growing pauses; if it keeps failing, its posts become
dead letters and the rest of the batch stands. So do lines that can't be read or hold no text.

Every table is appended to by key, posts last, so a batch that is repeated after a failure, or a stream
that is started anew without its checkpoint, adds nothing. Each batch leaves its states as rows of
`processing_jobs`: running, then completed or failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions.text import with_dqi, with_relevance, with_sentiment
from ..operators import audit
from ..operators.correlation import gated, signal_hash
from ..operators.posts import new_posts, normalised
from ..operators.vectors import embed
from ..sources.shared import kept
from ..sources.store import Store
from ..sources.tables import posts
from .queries import shared

ENVELOPE = "post_id long, source_name string, source_type string, category string, location string, language string, collected_at timestamp_ntz, confidence double, payload string, _broken string"
#: Tries of a branch and the first pause between two of them, in seconds; each pause is twice the one before.
TRIES, PAUSE = 5, 1.0

Branch = Callable[[DataFrame], DataFrame]


def parsed(lines: DataFrame) -> DataFrame:
    """The fields of each line of text (`value`), with `reason` set where it can't be taken in."""
    fields = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = lines.select("value", fields.alias("f")).select("value", "f.*")
    payload = F.try_parse_json("payload")
    reason = (
        F.when(F.col("_broken").isNotNull(), "not an envelope")
        .when(F.col("post_id").isNull() | F.col("source_name").isNull(), "no id or source")
        .when(payload.isNull() | (F.schema_of_variant(payload).startswith("OBJECT") == F.lit(False)), "no payload")
    )
    return rows.withColumn("reason", reason)


def with_content(rows: DataFrame) -> DataFrame:
    """Parsed lines with content, its hash and an external id of their own instead of the payload."""
    named = F.coalesce(F.nullif("external_id", F.lit("")), F.concat(F.lit("post-"), F.col("post_id").cast("string")))
    full = normalised(rows, "value", "source_name", "category", "location", "language", "collected_at", "confidence", "reason")
    return full.select("post_id", "value", "source_name", "source_type", "category", "location", "language", "collected_at", "confidence", "content", "content_hash", named.alias("external_id"), "reason")


def letters(rows: DataFrame, stage: str, reason: Column, batch: int) -> DataFrame:
    """Dead letters of lines (`value`)."""
    return rows.select(F.sha2(F.concat_ws("|", F.lit(stage), "value"), 256).alias("letter_id"), F.lit(stage).alias("stage"), reason.alias("reason"), F.col("value").alias("line"), F.lit(batch).cast("long").alias("batch_id"))


def vectors_of(passed: DataFrame) -> DataFrame:
    return passed.select("post_id", embed("content").alias("embedding"), F.lit("hashed-words").alias("model_name"))


def sightings_of(passed: DataFrame) -> DataFrame:
    """Sightings of sufficient confidence: the signals are the length of the words and the topics."""
    style = F.floor(F.length("content") / F.greatest(F.size(F.split("content", " ")), F.lit(1))).cast("long")
    signal = signal_hash(style, F.col("matched_keywords"))
    return gated(passed).select(
        F.col("post_id").alias("event_id"), F.xxhash64(signal).alias("user_id"), F.col("source_name").alias("source_id"), signal.alias("signal_hash"), "confidence", F.col("collected_at").alias("sighted_at")
    )


class Ingest:
    """A store and what a batch of lines does to it. Branches may be replaced, as by a real model."""

    def __init__(self, store: Store, embed_branch: Branch = vectors_of, correlate_branch: Branch = sightings_of, tries: int = TRIES, pause: float = PAUSE, first_job: int = 0):
        self.store, self.tries, self.pause, self.first_job = store, tries, pause, first_job
        self.branches = [("embed", "post_embeddings", embed_branch), ("correlate", "user_platform_sightings", correlate_branch)]

    def batch(self, lines: DataFrame, number: int) -> None:
        """Takes one batch in; raises after noting it as failed if a table can't be written."""
        self.note(number, "running")
        try:
            collected, processed = self._taken_in(lines, number)
        except Exception:
            self.note(number, "failed")
            raise
        self.note(number, "completed", collected, processed)

    def note(self, number: int, status: str, collected: int | None = None, processed: int | None = None) -> None:
        at = F.current_timestamp().cast("timestamp_ntz")
        row = self.store.spark.range(1).select(
            F.lit(self.first_job + number).cast("long").alias("job_id"), F.lit("stream").alias("triggered_by"), F.lit(status).alias("status"), F.lit(collected).cast("long").alias("posts_collected"),
            F.lit(processed).cast("long").alias("posts_processed"), F.when(F.lit(status == "running"), at).alias("started_at"), F.when(F.lit(status != "running"), at).alias("completed_at"),
        )
        self.store.append("processing_jobs", row)

    def _taken_in(self, lines: DataFrame, number: int) -> tuple[int, int]:
        with kept(with_content(parsed(lines.select("value")))) as rows:
            full = rows.where("reason is null").drop("reason")
            empty = full.where("content = ''")
            self.store.append("dead_letters", letters(rows.where("reason is not null"), "parse", F.col("reason"), number).unionByName(letters(empty, "parse", F.lit("no text"), number)))
            fresh = new_posts(full.where("content <> ''"), self.store.read("raw_posts"))
            job, month = F.lit(self.first_job + number).cast("long"), F.trunc(F.col("collected_at").cast("date"), "month")
            with kept(with_dqi(with_relevance(with_sentiment(fresh))).withColumn("job_id", job).withColumn("month", month)) as scored:
                for name in ("sentiment_results", "relevance_results", "discourse_results"):
                    self.store.append(name, scored)
                self.store.append("decision_audit_log", audit.audited(scored))
                passed = scored.where(F.col("relevance") >= model.GATE_RELEVANCE)
                for name, table, work in self.branches:
                    self._branch(name, table, work, passed, number)
                counts = rows.count(), scored.count()
                self.store.append("raw_posts", scored)  # last: until then a repeated batch takes the same posts in again
                return counts

    def _branch(self, name: str, table: str, work: Branch, passed: DataFrame, number: int) -> None:
        for i in range(self.tries):
            try:
                return self.store.append(table, work(passed))
            except Exception as e:  # noqa: BLE001  whatever a model does, the batch goes on and the posts are kept
                failure = f"{type(e).__name__}: {e}"[:200]
                if i < self.tries - 1:
                    time.sleep(self.pause * 2**i)
        self.store.append("dead_letters", letters(passed, name, F.lit(failure), number))

    def run(self, folder: str, checkpoint: str, files_per_batch: int = 1) -> None:
        """Takes in all files of lines below `folder` that this checkpoint hasn't seen."""
        spark = self.store.spark
        lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
        lines.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def job_states(store: Store) -> DataFrame:
    """The latest state of each job: failed and completed ones are past running; a job repeated after a failure may complete."""
    order = F.struct(F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1).otherwise(0).alias("o"))
    last = F.max_by(F.struct("status", "posts_collected", "posts_processed"), order).alias("l")
    return store.read("processing_jobs").groupBy("job_id").agg(last, F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at")).select("job_id", "l.*", "started_at", "completed_at")


def replayed(store: Store, stage: str) -> DataFrame:
    """Lines of the dead letters of a stage, to be taken in again once the fault is mended."""
    return store.read("dead_letters").where(F.col("stage") == stage).select(F.col("line").alias("value"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts as envelopes, some of them twice, some cut short and some without a payload."""
    d = F.col("post_id")
    own = posts(spark, sf_dir).where("post_id is not null and source_name is not null").select(
        "post_id", "source_name", F.lit("rss").alias("source_type"), "category", "location", "language", "collected_at",
        F.round(F.lit(0.75) + (d % 5) * F.lit(0.05), 2).cast("double").alias("confidence"), F.to_json(F.struct("external_id", "content", F.lit("someone").alias("user"))).alias("payload"),
    )
    whole = F.to_json(F.struct(*own.columns))
    twice, short, bare = F.when(d % 10 == 0, whole), F.when(d % 17 == 0, F.left(whole, F.lit(20))), F.when(d % 19 == 0, F.to_json(F.struct("post_id", "source_name")))
    return own.select(F.explode(F.array(whole, twice, short, bare)).alias("value")).where("value is not null")


def ingested_stream(spark: SparkSession, sf_dir: str) -> Store:
    """A store of its own, filled by the stream of all lines."""
    folder = shared(spark)
    store = Store(spark, f"{folder}/store")
    store.migrate()
    lines_of(spark, sf_dir).repartition(3).write.text(f"{folder}/in")
    Ingest(store).run(f"{folder}/in", f"{folder}/state", files_per_batch=2)
    return store


@query(
    "stream_ingest",
    "select post_id, source_name, external_id, indicator, round(relevance, 6) as relevance, round(dqi_total, 6) as dqi_total, relevance >= 0.40 as embedded, relevance >= 0.40 and post_id % 5 >= 2 as correlated from dqi where trim(content, E' \\t\\n\\r') <> ''",
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as the stream stored them, and which branches they took."""
    store = ingested_stream(spark, sf_dir)
    rows = store.read("raw_posts").select("post_id", "source_name", "external_id")
    for name, columns in (("sentiment_results", ["indicator"]), ("relevance_results", ["relevance"]), ("discourse_results", ["dqi_total"])):
        rows = rows.join(store.read(name).select("post_id", *columns), "post_id")
    embedded = store.read("post_embeddings").select("post_id", F.lit(True).alias("embedded"))
    seen = store.read("user_platform_sightings").select(F.col("event_id").alias("post_id"), F.lit(True).alias("correlated"))
    rows = rows.join(embedded, "post_id", "left").join(seen, "post_id", "left")
    return rows.select("post_id", "source_name", "external_id", "indicator", F.round("relevance", 6).alias("relevance"), F.round("dqi_total", 6).alias("dqi_total"), F.coalesce("embedded", F.lit(False)).alias("embedded"), F.coalesce("correlated", F.lit(False)).alias("correlated"))


@query(
    "stream_dead_letters",
    "select reason, count(*) as n from (select case when post_id % 17 = 0 then 'not an envelope' end as reason from posts union all select case when post_id % 19 = 0 then 'no payload' end from posts "
    "union all select case when trim(coalesce(content, ''), E' \\t\\n\\r') = '' then 'no text' end from posts) where reason is not null group by reason",
)
def stream_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why lines of the stream were not taken in."""
    return ingested_stream(spark, sf_dir).read("dead_letters").groupBy("reason").agg(F.count("*").alias("n"))
