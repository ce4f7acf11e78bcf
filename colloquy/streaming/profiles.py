"""Profiles of users as keyed state that ends: one state for each user, an event-time timer for each silence.

A user's state holds one episode: one value with counts, best confidence, first and last sight, first
topic and the platforms seen, read and written once for a batch. Each batch gives the episode as it stands; when the watermark has
passed `silence` after the last sight, a timer ends the state. A user who comes back begins a new episode.
`folded` puts the last word on each episode, and the episodes of a user, together: the same profile as the
batch query gives. So the state holds users of the last days, however many there ever were.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..catalog import query
from ..operators.correlation import _SIGHTINGS, gated, sightings
from .queries import shared

EPISODE = "user_id long, episode long, sighting_count long, platforms array<string>, correlation_confidence double, first_sighted_at timestamp, first_event long, last_sighted_at timestamp, topic_affinity string, ended boolean"
#: Times are microseconds inside the state and in what it gives.
PROFILE = "episode long, n long, confidence double, first long, first_event long, last long, topic string, platforms array<string>"
SIGHTING = "event_id long, user_id long, source_id string, sighted_at timestamp_ntz, confidence double, topic string"


class Episodes(StatefulProcessor):
    """Folds a user's accepted sightings in any order."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", PROFILE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = [(r.at, r.event_id, r.confidence, r.topic, r.source_id) for r in rows]
        at, event, _, topic, _ = min(found, key=lambda r: r[:2])
        last, best, platforms = max(r[0] for r in found), max(r[2] for r in found), {r[4] for r in found if r[4] is not None}
        state, was = (event, len(found), best, at, event, last, topic, sorted(platforms)), self.profile.get()
        if was is not None:
            earliest, theme = ((was[3], was[4]), was[6]) if (was[3], was[4]) <= (at, event) else ((at, event), topic)
            state = (was[0], was[1] + len(found), max(was[2], best), *earliest, max(was[5], last), theme, sorted(platforms.union(was[7])))
        self.profile.update(state)
        if was is None or was[5] != state[5]:
            if was is not None and self._ends(was) != self._ends(state):
                self.handle.deleteTimer(self._ends(was))
            self.handle.registerTimer(self._ends(state))
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._row(key, self.profile.get(), True)
        self.profile.clear()

    def _ends(self, state) -> int:
        """The moment, in milliseconds, at which the silence after the last sight is over."""
        return state[5] // 1000 + self.silence_ms

    def _row(self, key, state, ended: bool) -> Row:
        return Row(user_id=key[0], **dict(zip([c.split()[0] for c in PROFILE.split(", ")], state, strict=True)), ended=ended)

    def close(self) -> None:
        pass


def episodes(rows: DataFrame, silence: str = "1 day", late: str = "1 hour") -> DataFrame:
    """The stream of episodes of a stream of sightings."""
    silence_ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    on_time = gated(rows).withColumn("sighted_at", F.col("sighted_at").cast("timestamp")).withWatermark("sighted_at", late).withColumn("at", F.unix_micros("sighted_at"))
    found = on_time.groupBy("user_id").transformWithState(statefulProcessor=Episodes(silence_ms), outputStructType=f"user_id long, {PROFILE}, ended boolean", outputMode="Update", timeMode="EventTime")
    return found.select(
        "user_id", "episode", F.col("n").alias("sighting_count"), "platforms", F.col("confidence").alias("correlation_confidence"), F.timestamp_micros("first").alias("first_sighted_at"), "first_event",
        F.timestamp_micros("last").alias("last_sighted_at"), F.col("topic").alias("topic_affinity"), "ended",
    )


def run(rows: DataFrame, folder: str, silence: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Takes in what is there and gives all episodes so far; another call with the same folder goes on where this one ended."""
    spark, key = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the one that keeps timers
    try:

        def sink(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

        stream = episodes(rows, silence, late).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(f"{EPISODE}, batch long").parquet(f"{folder}/out")


def folded(found: DataFrame) -> DataFrame:
    """Profiles from episodes: the last word on each, then all of a user's."""
    last = found.groupBy("user_id", "episode").agg(F.max_by(F.struct("sighting_count", "platforms", "correlation_confidence", "first_sighted_at", "first_event", "last_sighted_at", "topic_affinity"), F.struct("batch", "sighting_count")).alias("e")).select("user_id", "e.*")
    return last.groupBy("user_id").agg(
        F.sum("sighting_count").alias("sighting_count"),
        F.size(F.array_distinct(F.flatten(F.collect_list("platforms")))).cast("long").alias("distinct_platforms"),
        F.max("correlation_confidence").alias("correlation_confidence"),
        F.min("first_sighted_at").cast("timestamp_ntz").alias("first_sighted_at"),
        F.max("last_sighted_at").cast("timestamp_ntz").alias("last_sighted_at"),
        F.min_by("topic_affinity", F.struct("first_sighted_at", "first_event")).alias("topic_affinity"),
    )


def in_order(rows: DataFrame, at: str, folder: str, slices: int) -> None:
    """Writes rows as so many files, earlier ones first, as a log would grow."""
    span = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    if span["low"] is None:
        rows.limit(0).write.parquet(folder)
        return
    step = (span["high"] - span["low"]) / slices
    for i in range(slices):
        part = rows.where(F.col(at) >= F.lit(span["low"] + i * step)) if i else rows
        part = part.where(F.col(at) < F.lit(span["low"] + (i + 1) * step)) if i < slices - 1 else part
        part.coalesce(1).write.mode("append").parquet(folder)


@query("stream_keyed_profiles", f"select user_id, count(*) as sighting_count, count(distinct event_type) as distinct_platforms, max(confidence) as correlation_confidence, min(ts) as first_sighted_at, max(ts) as last_sighted_at, 'topic' || arg_min(event_id, (ts, event_id)) % 3 as topic_affinity from {_SIGHTINGS} where confidence >= 0.85 group by user_id")
def stream_keyed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles by keyed state over a stream of several micro-batches in order of time."""
    folder = shared(spark)
    in_order(sightings(spark, sf_dir).select("event_id", "user_id", "source_id", "sighted_at", "confidence", "topic"), "sighted_at", f"{folder}/in", 4)
    return folded(run(spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder))
