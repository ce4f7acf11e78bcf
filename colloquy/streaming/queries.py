"""Structured Streaming: event-time aggregates, deduplication and stateful profiles over a file stream.

Each query runs its stream to the end of what is there (trigger availableNow) with a checkpoint in
the shared folder, and gives the sink's rows. Complete mode is used where a batch twin is compared:
append mode withholds the last windows behind the watermark.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions.text import indicator
from ..operators.correlation import gated
from ..sources.shared import shared_base

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors see; below spark.checkpoint.dir where that is set."""
    return f"{shared_base(spark)}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream, with an event time that watermarks accept."""
    # a glob of one name: a file stream reads a directory or pattern
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 100).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str, fold=None) -> DataFrame:
    """Runs a stream until its source is exhausted and returns what the sink holds.

    In complete mode each batch replaces the result; in append mode batches add to it. A replayed
    batch overwrites its own folder, so the sink is idempotent.
    """
    spark, folder = df.sparkSession, shared(df.sparkSession)
    out = f"{folder}/out"

    def sink(batch: DataFrame, number: int) -> None:
        batch = fold(batch) if fold else batch
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    stream = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    schema = (fold(spark.createDataFrame([], df.schema)) if fold else df).schema
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    except Exception as e:  # a source without files makes no batch, and so no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


@query("stream_hourly_counts", "select date_trunc('hour', ts)::timestamp as hour, event_type, count(*) as n from events group by 1, 2")
def stream_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    counted = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drained(counted, "complete").select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(
    "stream_session_counts",
    "select user_id, count(*) as sessions, max(n) as longest from (select user_id, s, count(*) as n from (select user_id, sum(starts) over (partition by user_id order by ts, event_id) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as starts from events)) group by 1, 2) group by 1",
)
def stream_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events less than half an hour apart."""
    sessions = events(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return drained(sessions, "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("stream_dedup", "select count(distinct event_id) as n, count(distinct user_id) as users from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though the stream brings all of them twice."""
    twice = events(spark, sf_dir).select("event_id", "user_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    once = drained(twice.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"]), "append")
    return once.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "stream_sentiment_by_type",
    "select event_type, count(*) filter (c > 0.05) as positive, count(*) filter (c between -0.05 and 0.05) as neutral, count(*) filter (c < -0.05) as negative from (select event_type, (value - 50) / 100 as c from events) group by 1",
)
def stream_sentiment_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators by type of event, the centred value as comparative score."""
    labelled = events(spark, sf_dir).withColumn("indicator", indicator((F.col("value") - 50) / 100))
    return drained(labelled.groupBy("event_type").agg(*[F.count_if(F.col("indicator") == i).alias(i) for i in model.INDICATORS]), "complete")


@query("stream_profiles", "select user_id, count(*) as sighting_count, min(ts) as first_sighted_at, max(ts) as last_sighted_at from events where event_id % 13 <> 0 group by user_id")
def stream_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudonymous profiles as keyed state: counts, first and last sight of accepted sightings."""
    rows = events(spark, sf_dir).withColumn("confidence", F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.lit(model.GATE_CONFIDENCE)).cast("double"))
    state = gated(rows).groupBy("user_id").agg(F.count("*").alias("sighting_count"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    found = drained(state, "complete")
    return found.select("user_id", "sighting_count", F.col("first").cast("timestamp_ntz").alias("first_sighted_at"), F.col("last").cast("timestamp_ntz").alias("last_sighted_at"))
