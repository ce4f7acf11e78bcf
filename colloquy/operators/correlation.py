"""Pseudonymous identities: signal hashes, readable ids, profiles across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions.text import with_dqi
from ..plans.scored import with_indicator
from ..sources.tables import posts, table

ADJECTIVES = ["amber", "brisk", "calm", "dusky", "eager", "fabled", "gentle", "hazel", "ivory", "jovial", "keen", "lucid", "mellow", "nimble", "olive", "plucky"]
ANIMALS = ["badger", "crane", "dingo", "egret", "ferret", "gecko", "heron", "ibis", "jackal", "koala", "lemur", "marten", "newt", "otter", "puffin", "quail", "raven"]
SALT = "demonstration-salt"


def signal_hash(style: Column, topics: Column, salt: str = SALT) -> Column:
    """Hash of the JSON of signals and salt."""
    return F.sha2(F.to_json(F.struct(F.struct(style.alias("style"), topics.alias("topics")).alias("signals"), F.lit(salt).alias("salt"))), 256)


def pseudo_id(seed: Column) -> Column:
    """adjective-animal from the first four bytes of the seed's hash, and the next eight bytes: words alone would name different seeds alike."""
    digest = F.sha2(seed, 256)
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")

    def word(words: list[str], at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))

    return F.concat(word(ADJECTIVES, n), F.lit("-"), word(ANIMALS, F.floor(n / len(ADJECTIVES))), F.substring(digest, 9, 16))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of users derived from `events`: one for each event, its type as the source."""
    user = F.col("user_id")
    confidence = F.when(F.col("event_id") % 13 == 0, F.lit(None)).otherwise(F.lit(0.70) + (F.col("event_id") % 4) * F.lit(0.05) + F.lit(0.05)).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("source_id"), F.col("ts").alias("sighted_at"), F.round(confidence, 2).alias("confidence"),
        (user % 5).alias("style"), F.concat(F.lit("topic"), (F.col("event_id") % 3).cast("string")).alias("topic"),
    )


_SIGHTINGS = "(select *, case when event_id % 13 = 0 then null else round(0.70::double + (event_id % 4) * 0.05::double + 0.05::double, 2) end as confidence from events)"


def gated(rows: DataFrame) -> DataFrame:
    """Sightings of sufficient confidence; the threshold itself is accepted, null is not."""
    return rows.where(F.col("confidence") >= model.GATE_CONFIDENCE)


@query("correlation_gate", f"select event_id from {_SIGHTINGS} where confidence >= 0.85")
def correlation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(sightings(spark, sf_dir)).select("event_id")


@query("signal_hash", "select event_id, sha256('{\"signals\":{\"style\":' || user_id % 5 || ',\"topics\":[\"topic' || event_id % 3 || '\"]},\"salt\":\"demonstration-salt\"}') as signal_hash from events")
def signal_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sightings(spark, sf_dir).select("event_id", signal_hash(F.col("style"), F.array("topic")).alias("signal_hash"))


def _words_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("pseudo_ids", f"select user_id, {_words_sql(ADJECTIVES)}[(n % 16 + 1)::int] || '-' || {_words_sql(ANIMALS)}[((n // 16) % 17 + 1)::int] || substr(digest, 9, 16) as pseudo_id from (select user_id, sha256('user-' || user_id) as digest, ('0x' || substr(digest, 1, 8))::bigint as n from (select distinct user_id from events))")
def pseudo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", pseudo_id(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("pseudo_id"))


def profiles(rows: DataFrame) -> DataFrame:
    """A profile for each user from accepted sightings: every count, the best confidence, first and last
    sight, and the topic of the first sighting. Order-independent, so batches and streams agree."""
    return gated(rows).groupBy("user_id").agg(
        F.count("*").alias("sighting_count"),
        F.count_distinct("source_id").alias("distinct_platforms"),
        F.max("confidence").alias("correlation_confidence"),
        F.min("sighted_at").alias("first_sighted_at"),
        F.max("sighted_at").alias("last_sighted_at"),
        F.min_by("topic", F.struct("sighted_at", "event_id")).alias("topic_affinity"),
    )


@query("pseudo_user_profiles", f"select user_id, count(*) as sighting_count, count(distinct event_type) as distinct_platforms, max(confidence) as correlation_confidence, min(ts) as first_sighted_at, max(ts) as last_sighted_at, 'topic' || arg_min(event_id, (ts, event_id)) % 3 as topic_affinity from {_SIGHTINGS} where confidence >= 0.85 group by user_id")
def pseudo_user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles(sightings(spark, sf_dir))


def correlated(rows: DataFrame, salt: str = SALT) -> DataFrame:
    """A profile for each signal hash, named by it and the salt: users of the same signals share one, others never do.

    Every accepted sighting counts as a platform; the first one gives the topics. The aggregate folds in any
    order and has a map-side part, so a pseudonym of very many sightings is no hot task.
    """
    signal = signal_hash(F.col("style"), F.array("topic"), salt)
    folded = gated(rows).withColumn("signal_hash", signal).groupBy("signal_hash").agg(
        F.count("*").alias("platform_count"),
        F.max("confidence").alias("correlation_confidence"),
        F.min("sighted_at").alias("first_sighted_at"),
        F.max("sighted_at").alias("last_sighted_at"),
        F.min_by("topic", F.struct("sighted_at", "event_id")).alias("topic_affinity"),
    )
    return folded.withColumn("pseudo_id", pseudo_id(F.concat("signal_hash", F.lit(salt)))).drop("signal_hash")


_SIGNAL = f"sha256(sha256('{{\"signals\":{{\"style\":' || user_id % 5 || ',\"topics\":[\"topic' || event_id % 3 || '\"]}},\"salt\":\"{SALT}\"}}') || '{SALT}')"


@query(
    "pseudo_profiles",
    f"select pseudo_id, count(*) as platform_count, max(confidence) as correlation_confidence, min(ts) as first_sighted_at, max(ts) as last_sighted_at, 'topic' || arg_min(event_id, (ts, event_id)) % 3 as topic_affinity "
    f"from (select *, {_words_sql(ADJECTIVES)}[(n % 16 + 1)::int] || '-' || {_words_sql(ANIMALS)}[((n // 16) % 17 + 1)::int] || substr(digest, 9, 16) as pseudo_id from (select *, {_SIGNAL} as digest, ('0x' || substr(digest, 1, 8))::bigint as n from {_SIGHTINGS} where confidence >= 0.85)) group by pseudo_id",
)
def pseudo_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlated(sightings(spark, sf_dir))


@query("correlation_confidence", "select user_id, round(0.40 * least(1.0, n / 100.0) + 0.25 * hours / 24.0 + 0.20 * types / 5.0 + 0.15 * (user_id % 10) / 10.0, 6)::double as confidence from (select user_id, count(*) as n, count(distinct extract('hour' from ts)) as hours, count(distinct event_type) as types from events group by 1)")
def correlation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of style, time, topic and vocabulary signals."""
    signals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(F.hour("ts")).alias("hours"), F.count_distinct("event_type").alias("types"))
    score = F.lit(0.40) * F.least(F.lit(1.0), F.col("n") / 100) + F.lit(0.25) * F.col("hours") / 24 + F.lit(0.20) * F.col("types") / 5 + F.lit(0.15) * (F.col("user_id") % 10) / 10
    return signals.select("user_id", F.round(score.cast("double"), 6).alias("confidence"))


@query("user_profile", "select post_id % 50 as user_id, count(*) as posts, count(distinct category) as categories, count(*) filter (indicator = 'positive') as positive, count(*) filter (indicator = 'negative') as negative, round(avg(dqi_total), 6) as avg_dqi from dqi group by 1")
def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's posts over categories, their sentiment and deliberative quality."""
    rows = with_dqi(with_indicator(spark, sf_dir)).withColumn("user_id", F.col("post_id") % 50)
    return rows.groupBy("user_id").agg(
        F.count("*").alias("posts"), F.count_distinct("category").alias("categories"), F.count_if(F.col("indicator") == "positive").alias("positive"),
        F.count_if(F.col("indicator") == "negative").alias("negative"), F.round(F.avg("dqi_total"), 6).alias("avg_dqi"),
    )


def schedule(found: DataFrame, window_ms: int = 120_000) -> DataFrame:
    """Queue and start offset of each active source of a known kind, spread evenly over the window. The
    registry is a small table: ranking it in one task is what it takes."""
    from pyspark.sql import Window

    queues = F.create_map(*[F.lit(x) for pair in model.QUEUE_OF_TYPE.items() for x in pair])
    rows = found.where("active").withColumn("queue", F.try_element_at(queues, F.col("source_type"))).where("queue is not null")
    n = rows.agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("source_name")) - 1
    return rows.withColumn("i", place).join(F.broadcast(n)).select("source_name", "queue", (F.col("i") * F.floor(F.lit(window_ms) / F.col("n"))).cast("bigint").alias("start_ms"))


@query("schedule_plan", "select source_name, case source_type when 'rss' then 'collect.rss' else 'collect.reddit' end as queue, ((row_number() over (order by source_name) - 1) * (120000 // count(*) over ()))::bigint as start_ms from sources where active and source_type in ('rss', 'reddit')")
def schedule_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import sources

    return schedule(sources(spark, sf_dir))


@query("schedulers_stale", "select source_name from sources where not (active and source_type in ('rss', 'reddit'))")
def schedulers_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedulers that exist (one for every source) but whose source isn't scheduled any more."""
    from ..sources.tables import sources

    existing = sources(spark, sf_dir)
    return existing.select("source_name").join(schedule(existing).select("source_name"), "source_name", "left_anti")


@query("accepted_requests")
def accepted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that a limit of one per user and minute accepts. Only accepted ones restart the clock, so
    it is a fold over a user's rows in order; long histories pass through as a stream of batches."""
    import pandas as pd

    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")

    def fold(frames):
        user, last = None, None
        for frame in frames:
            keep = []
            for u, at in zip(frame["user_id"], frame["at"], strict=True):
                if u != user:
                    user, last = u, None
                keep.append(last is None or at - last >= 60_000_000)
                if keep[-1]:
                    last = at
            yield frame.loc[pd.Series(keep, index=frame.index, dtype=bool), ["user_id", "event_id"]]

    return ordered.mapInPandas(fold, "user_id long, event_id long")
