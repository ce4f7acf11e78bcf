"""Retention: months to compact, monthly rollups, what compaction removes, and reads over both tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions.text import with_relevance
from ..plans.scored import counts, with_indicator
from ..sources.shared import checkpointed
from ..sources.store import Store
from ..sources.tables import embeddings, posts

#: "Today" of the demonstration: the hot window ends within the newest day of the derived posts, so both tiers hold rows at every size.
TODAY = "2024-09-29"
CUTOFF_SQL = f"(date '{TODAY}' - interval {model.RETENTION_DAYS} day)"


def month(moment: str = "collected_at"):
    return F.trunc(F.col(moment).cast("date"), "month")


def cutoff(today: str):
    return F.date_sub(F.lit(today).cast("date"), model.RETENTION_DAYS)


def months_to_compact(rows: DataFrame, compacted: DataFrame, today: str, asked: str | None = None) -> DataFrame:
    """The month asked for (YYYY-MM), or months with content older than the hot window that aren't compacted yet."""
    if asked is not None:
        import re

        if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", asked):
            raise ValueError(f"not a month: {asked!r}")
        return rows.sparkSession.sql("select cast(:m as date) as month", {"m": f"{asked}-01"})
    old = rows.where((F.col("collected_at") < cutoff(today)) & F.col("content").isNotNull())
    return old.select(month().alias("month")).distinct().join(compacted.select("month"), "month", "left_anti")


def none_compacted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "month date")


@query("months_to_compact", f"select distinct date_trunc('month', collected_at)::date as month from posts where collected_at < {CUTOFF_SQL} and content is not null")
def months_to_compact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return months_to_compact(posts(spark, sf_dir), none_compacted(spark), TODAY)


def topic_rollup(rows: DataFrame) -> DataFrame:
    """Posts by month, first keyword (else 'general'), category, location and language.

    Empty and null locations are one group.
    """
    topic = F.coalesce(F.get("matched_keywords", F.lit(0)), F.lit("general"))
    keyed = rows.select(month().alias("month"), topic.alias("topic"), "category", F.nullif("location", F.lit("")).alias("location"), "language", "indicator", "comparative")
    return keyed.groupBy("month", "topic", "category", "location", "language").agg(*counts(), F.round(F.avg("comparative"), 6).alias("avg_comparative"))


_COUNTS = "count(*) filter (indicator = 'positive') as positive, count(*) filter (indicator = 'neutral') as neutral, count(*) filter (indicator = 'negative') as negative, count(*) as total"


@query("rollup_topic_monthly", f"select date_trunc('month', collected_at)::date as month, coalesce(matched_keywords[1], 'general') as topic, category, nullif(location, '') as location, language, {_COUNTS}, round(avg(comparative), 6) as avg_comparative from relevance group by 1, 2, 3, 4, 5")
def rollup_topic_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_rollup(with_relevance(with_indicator(spark, sf_dir)))


@query("rollup_source_monthly", f"select date_trunc('month', collected_at)::date as month, source_name, {_COUNTS}, round(avg(comparative), 6) as avg_comparative from sentiment group by 1, 2")
def rollup_source_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_rollup(with_indicator(spark, sf_dir))


@query("rollup_topic_cube", "select date_trunc('month', collected_at)::date as month, category, nullif(location, '') as location, grouping_id(month, category, location)::bigint as level, count(*) as total from (select *, date_trunc('month', collected_at)::date as month from (select collected_at, category, nullif(location, '') as location from posts)) group by cube (month, category, location)".replace("select date_trunc('month', collected_at)::date as month, category, nullif(location, '') as location, grouping", "select month, category, location, grouping", 1))
def rollup_topic_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Super-aggregates of every subset of month, category and location; level tells a total from a null."""
    rows = posts(spark, sf_dir).select(month().alias("month"), "category", F.nullif("location", F.lit("")).alias("location"))
    return rows.cube("month", "category", "location").agg(F.grouping_id().alias("level"), F.count("*").alias("total"))


def affected(rows: DataFrame, today: str) -> DataFrame:
    """Posts of compacted months that still have content; every step of compaction uses this set."""
    due = months_to_compact(rows, none_compacted(rows.sparkSession), today)
    return rows.withColumn("month", month()).join(F.broadcast(due), "month", "left_semi").where("content is not null")


_DUE = f"select distinct date_trunc('month', collected_at) from posts where collected_at < {CUTOFF_SQL} and content is not null"
_AFFECTED = f"date_trunc('month', collected_at) in ({_DUE}) and content is not null"


@query("retention_null_content", f"select post_id, case when {_AFFECTED} then null else length(content) end::integer as content_length from posts")
def retention_null_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts after compaction: the content of affected months is null, all else is kept."""
    rows = posts(spark, sf_dir)
    due = months_to_compact(rows, none_compacted(spark), TODAY).withColumn("due", F.lit(True))
    marked = rows.withColumn("month", month()).join(F.broadcast(due), "month", "left")
    return marked.select("post_id", F.when(F.col("due").isNull(), F.length("content")).alias("content_length"))


@query("retention_drop_embeddings", f"select vec_id as post_id from embeddings where vec_id not in (select post_id from posts where {_AFFECTED})")
def retention_drop_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings that stay: those of unaffected posts."""
    return embeddings(spark, sf_dir).select("post_id").join(affected(posts(spark, sf_dir), TODAY).select("post_id"), "post_id", "left_anti")


@query("retention_log_rows", f"select post_id, 'compacted' as action, 'month ' || strftime(collected_at, '%Y-%m') || ' beyond retention' as reason from posts where {_AFFECTED}")
def retention_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = affected(posts(spark, sf_dir), TODAY)
    return rows.select("post_id", F.lit("compacted").alias("action"), F.concat(F.lit("month "), F.date_format("month", "yyyy-MM"), F.lit(" beyond retention")).alias("reason"))


_LOG = f"select date_trunc('month', collected_at)::date as month, count(*) as posts_compacted, count(distinct (coalesce(matched_keywords[1], 'general'), category, nullif(location, ''), language)) as rollups_created from relevance where {_AFFECTED} group by 1"


@query("compaction_log", _LOG)
def compaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each month the posts it compacted and the rollup rows that it really made."""
    rows = with_relevance(with_indicator(spark, sf_dir))
    made = topic_rollup(affected(rows, TODAY).drop("month"))
    return made.groupBy("month").agg(F.sum("total").alias("posts_compacted"), F.count("*").alias("rollups_created"))


@query("compaction_totals", f"select count(*) as months, sum(posts_compacted)::bigint as posts_compacted, sum(rollups_created)::bigint as rollups_created from ({_LOG})")
def compaction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction_log(spark, sf_dir).agg(F.count("*").alias("months"), F.sum("posts_compacted").alias("posts_compacted"), F.sum("rollups_created").alias("rollups_created"))


@query("tiered_history", f"select date_trunc('month', collected_at)::date as month, case when collected_at < {CUTOFF_SQL} then 'rollup' else 'detail' end as tier, category, count(*) as total from posts group by 1, 2, 3")
def tiered_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail inside the hot window, rollups before it, and which of the two each row came from."""
    rows = with_indicator(spark, sf_dir)
    hot = rows.where(F.col("collected_at") >= cutoff(TODAY)).groupBy(month().alias("month"), "category").agg(F.count("*").alias("total")).withColumn("tier", F.lit("detail"))
    cold = topic_rollup(with_relevance(rows.where(F.col("collected_at") < cutoff(TODAY)))).groupBy("month", "category").agg(F.sum("total").alias("total")).withColumn("tier", F.lit("rollup"))
    return hot.unionByName(cold).select("month", "tier", "category", "total")


def source_rollup(rows: DataFrame) -> DataFrame:
    """Posts by month and source."""
    return rows.groupBy(month().alias("month"), "source_name").agg(*counts(), F.round(F.avg("comparative"), 6).alias("avg_comparative"))


def compact(store: Store, today: str, asked: str | None = None) -> DataFrame:
    """Compacts the months due, or the one asked for, in the store: rollups are added, embeddings of its posts deleted, the
    posts logged, their content made null; gives the log's rows of this run.

    Steps come in an order that a repeated run completes after a failure: months stay due until their content is
    null, rows are added by key, and the log is drawn from the rollups that are stored and not logged yet. Posts that
    arrive for a month after it was logged are left as they are.
    """
    raw = store.read("raw_posts")
    logged = store.read("compaction_log")
    due = checkpointed(months_to_compact(raw, logged, today, asked))  # a row for each month
    held = raw.join(F.broadcast(due), "month", "left_semi")
    content = held.where("content is not null")
    scores = store.read("sentiment_results").select("post_id", "indicator", "comparative").join(store.read("relevance_results").select("post_id", "matched_keywords"), "post_id")
    scored = content.drop("month").join(scores, "post_id")
    store.append("monthly_topic_rollups", topic_rollup(scored))
    store.append("monthly_source_rollups", source_rollup(scored))
    reason = F.concat(F.lit("month "), F.date_format("month", "yyyy-MM"), F.lit(" beyond retention"))
    store.append("data_retention_log", content.select("post_id", F.lit("compacted").alias("action"), reason.alias("reason"), F.lit(today).cast("timestamp_ntz").alias("performed_at")))
    store.replace("post_embeddings", store.read("post_embeddings").join(held.select("post_id"), "post_id", "left_anti"))
    store.replace_partitions("raw_posts", held.withColumn("content", F.lit(None).cast("string")))
    made = store.read("monthly_topic_rollups").groupBy("month").agg(F.sum("total").alias("posts_compacted"), F.count("*").alias("rollups_created"))
    new = checkpointed(made.join(logged.select("month"), "month", "left_anti"))
    store.append("compaction_log", new)
    return new
