"""The service's answers as functions: parameters are checked here, a lazy DataFrame comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values
from .functions.text import with_relevance
from .operators import audit, bias, cities, posts, retention
from .plans.scored import counts, scored_posts, with_indicator
from .sources.store import Store
from .sources.tables import AS_OF, sources


class Api:
    """Answers over one directory of tables; `as_of` stands for the clock."""

    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF):
        self.spark, self.sf_dir, self.as_of = spark, sf_dir, as_of

    def health(self) -> DataFrame:
        """One row: state, newest job, open alerts."""
        alerts = bias.latest_assessments(with_indicator(self.spark, self.sf_dir), audit.jobs(self.spark, self.sf_dir)).where("is_violation")
        return bias.health(audit.jobs(self.spark, self.sf_dir), alerts.withColumn("resolved_at", F.lit(None).cast("timestamp_ntz")))

    def city_sentiment(self, platform: str | None = None, from_: str | None = None, to: str | None = None) -> DataFrame:
        rows = posts.filtered(with_indicator(self.spark, self.sf_dir), category=platform, from_=from_, to=to)
        return cities.nested(cities.by_city_source(rows))

    def summary(self, platform: str | None = None) -> DataFrame:
        rows = posts.filtered(with_indicator(self.spark, self.sf_dir), category=platform)
        return rows.agg(*counts(), F.coalesce(F.avg("comparative"), F.lit(0.0)).alias("avg_comparative"), F.max("collected_at").alias("last_updated"))

    def latest(self, limit: int | str | None = None, platform: str | None = None) -> DataFrame:
        """The newest posts; this endpoint moves the limit into 1 to 100."""
        return posts.listed(with_indicator(self.spark, self.sf_dir), values.clamped(limit, 1, 100, 20), category=platform)

    def query(self, limit: int | str | None = None, **conditions: str | None) -> DataFrame:
        """Filtered posts; this endpoint refuses a limit outside 1 to 100."""
        return posts.listed(with_indicator(self.spark, self.sf_dir), limit, **conditions)

    def audited_post(self, post_id: int) -> DataFrame:
        """The post that a trail belongs to, one row; a post that does not exist is a LookupError."""
        found = audit.post_block(scored_posts(self.spark, self.sf_dir), post_id)
        if found.isEmpty():
            raise LookupError(f"no post {post_id}")
        return found

    def audit(self, post_id: int, key: str | None = None) -> DataFrame:
        """The decisions on a post with method, settings and reasons, in order of time."""
        return audit.trail(scored_posts(self.spark, self.sf_dir), post_id, key)

    def bias(self) -> DataFrame:
        """All assessments of the latest completed job; `is_violation` marks the violations."""
        return bias.latest_assessments(with_indicator(self.spark, self.sf_dir), audit.jobs(self.spark, self.sf_dir))

    def methodology(self) -> DataFrame:
        return audit.methodology_current(self.spark, self.sf_dir)

    def sources(self, active: bool | None = None) -> DataFrame:
        found = sources(self.spark, self.sf_dir)
        return (found if active is None else found.where(F.col("active") == active)).orderBy("category", "source_name")

    def timeseries(self, hours: int | str | None = None) -> DataFrame:
        return posts.hourly(with_indicator(self.spark, self.sf_dir), hours, self.as_of)

    def themes(self, k: int = 12, min_volume: int = 3) -> DataFrame:
        return posts.themes(with_relevance(with_indicator(self.spark, self.sf_dir)), k, min_volume)

    def assess(self, store: Store, job_id: int) -> DataFrame:
        """Checks the stored posts of a job for bias, stores assessments and alerts once, and gives the open alerts."""
        bias.record(store, bias.stored_posts(store, job_id), job_id)
        return bias.open_alerts(store)

    def compact(self, store: Store, today: str, month: str | None = None) -> DataFrame:
        """Compacts the months beyond retention, or the one asked for, and says what was done."""
        return retention.compact(store, today, month)

    def run_pipeline(self, store: Store, incoming: DataFrame) -> None:
        """Takes a batch of posts in: new ones are scored in one pass, then posts, results and audit rows are
        appended. Running it again with the same batch adds nothing."""
        scored = posts.ingested(incoming, store.read("raw_posts")).withColumn("content_hash", F.sha2("content", 256)).withColumn("month", F.trunc(F.col("collected_at").cast("date"), "month"))
        scored = scored.persist()
        try:
            store.append("sentiment_results", scored)
            store.append("relevance_results", scored)
            store.append("discourse_results", scored)
            store.append("decision_audit_log", audit.audited(scored))
            store.append("raw_posts", scored)  # last: until then a repeated run takes the same posts in again
        finally:
            scored.unpersist()
