"""Checks of a batch for bias: concentration, parity, dominance, and parity against ground truth."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions import values
from ..plans.scored import with_indicator
from ..sources.shared import shared_base
from ..sources.store import Store
from ..sources.tables import table
from .audit import JOBS_SQL, jobs, latest

ASSESSMENT = "assessment_type string, group_field string, group_value string, metric_name string, metric_value double, threshold double, is_violation boolean, severity string"
JOB = 1


def of_job(scored: DataFrame, job_id: int) -> DataFrame:
    """Posts that the job's inferences name, each once however many audit rows it has (a semi join)."""
    named = scored.where(F.col("job_id") == job_id).select("post_id")
    return scored.join(named, "post_id", "left_semi")


def _assessed(df: DataFrame, kind: str, field: str, metric: str, threshold: float, severity=None) -> DataFrame:
    violated = F.col("metric_value") > threshold
    severity = F.lit("warning") if severity is None else severity
    return df.select(
        F.lit(kind).alias("assessment_type"), F.lit(field).alias("group_field"), "group_value", F.lit(metric).alias("metric_name"), F.col("metric_value"),
        F.lit(threshold).alias("threshold"), violated.alias("is_violation"), F.when(violated, severity).alias("severity"),
    )


def concentration(rows: DataFrame, field: str, threshold: float, kind: str) -> DataFrame:
    """Share of the most frequent value of `field` (ties to the first in the alphabet); 0 and 'none' without rows."""
    n = rows.where(F.col(field).isNotNull() & (F.col(field) != "")).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))
    one = n.agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("m"), F.max("n").alias("top"), F.sum("n").alias("all"))
    one = one.select(F.coalesce(F.col("m.value"), F.lit("none")).alias("group_value"), values.ratio(F.col("top"), F.col("all")).alias("metric_value"))
    critical = F.when(F.col("metric_value") > model.LOCATION_CRITICAL, "critical").otherwise("warning")
    return _assessed(one, kind, field, "max_share", threshold, critical)


def platform_parity(rows: DataFrame, threshold: float = model.PARITY_MAX) -> DataFrame:
    """Largest difference of mean comparative between two categories; they are named in order of the alphabet."""
    means = rows.groupBy("category").agg(F.avg("comparative").alias("mean"))
    ends = means.agg(F.min(F.struct("mean", "category")).alias("lo"), F.max(F.struct(F.col("mean"), F.col("category"))).alias("hi"), F.count("*").alias("n"))
    pair = F.concat_ws(" vs ", F.array_sort(F.array("lo.category", "hi.category")))
    name = F.when(F.col("n") >= 2, pair).otherwise(F.coalesce("lo.category", F.lit("none")))
    one = ends.select(name.alias("group_value"), F.when(F.col("n") >= 2, F.col("hi.mean") - F.col("lo.mean")).otherwise(0.0).alias("metric_value"))
    return _assessed(one, "platform_sentiment_parity", "category", "max_pairwise_difference", threshold)


def negative_dominance(rows: DataFrame, threshold: float = model.DOMINANCE_MAX) -> DataFrame:
    """Share of distinct posts that are negative."""
    one = rows.agg(F.count_distinct(F.when(F.col("indicator") == "negative", F.col("post_id"))).alias("bad"), F.count_distinct("post_id").alias("n"))
    one = one.select(F.lit("negative").alias("group_value"), values.ratio(F.col("bad"), F.col("n")).alias("metric_value"))
    return _assessed(one, "negative_dominance", "indicator", "negative_share", threshold)


#: Thresholds of the three checks, and stricter ones for demonstrations, which ordinary data violate.
LIMITS = (model.LOCATION_MAX, model.PARITY_MAX, model.DOMINANCE_MAX)
STRICT = (0.05, 0.001, 0.01)


def assessments(rows: DataFrame, limits: tuple[float, float, float] = LIMITS) -> DataFrame:
    """The three checks of a job's posts, one row each."""
    location, parity, dominance = limits
    checks = concentration(rows, "location", location, "location_concentration")
    return checks.unionByName(platform_parity(rows, parity)).unionByName(negative_dominance(rows, dominance))


def record(store: Store, rows: DataFrame, job_id: int, limits: tuple[float, float, float] = LIMITS) -> None:
    """Stores a job's assessments, and an open alert for each violation. Both are stored once for each job and check, so
    repeating it after a failure adds what is missing, and doing it again changes nothing. Alerts are made from the
    stored assessments, not from a second reading of the posts."""
    store.append("bias_assessments", assessments(rows, limits).withColumn("job_id", F.lit(job_id).cast("long")))
    found = store.read("bias_assessments").where((F.col("job_id") == job_id) & F.col("is_violation"))
    store.append("alert_events", found.withColumn("resolved_at", F.lit(None).cast("timestamp_ntz")))


def resolve(store: Store, job_id: int, kind: str, at: str) -> None:
    """Marks an open alert as resolved; one resolved before keeps its time. The table has at most three rows for each job."""
    own = (F.col("job_id") == job_id) & (F.col("assessment_type") == kind) & F.col("resolved_at").isNull()
    store.replace("alert_events", store.read("alert_events").withColumn("resolved_at", F.when(own, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("resolved_at"))))


def open_alerts(store: Store) -> DataFrame:
    return store.read("alert_events").where("resolved_at is null")


def stored_posts(store: Store, job_id: int) -> DataFrame:
    """The stored posts that a job decided on, with their scores; their number may be any, so both joins shuffle or adapt."""
    named = store.read("decision_audit_log").where(F.col("job_id") == job_id).select("post_id")
    scores = store.read("sentiment_results").select("post_id", "comparative", "indicator")
    return store.read("raw_posts").select("post_id", "location", "category", "source_name").join(named, "post_id", "left_semi").join(scores, "post_id")


def _job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's posts; where the posts carry the job themselves, a filter that reaches the scan does for the semi join."""
    return with_indicator(spark, sf_dir).where(F.col("job_id") == JOB)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("metric_value", F.round("metric_value", 6))


_J = f"from sentiment where job_id = {JOB}"


def _concentration_sql(field: str, where: str, threshold: float, kind: str) -> str:
    n = f"(select {field} as v, count(*) as n from sentiment where {where} {field} <> '' group by 1)"
    return (
        f"select '{kind}' as assessment_type, '{field}' as group_field, (select v from {n} order by n desc, v limit 1) as group_value, 'max_share' as metric_name, round(max(n)::double / sum(n), 6) as metric_value, {threshold}::double as threshold, "
        f"max(n)::double / sum(n) > {threshold} as is_violation, case when max(n)::double / sum(n) > {threshold} then case when max(n)::double / sum(n) > 0.8 then 'critical' else 'warning' end end as severity from {n}"
    )



def _all_sql(job: str, limits: tuple[float, float, float] = LIMITS) -> str:
    """The three checks of the job that `job` names, a number or a subquery."""
    of = f"from sentiment where job_id = {job}"
    location = _concentration_sql("location", f"job_id = {job} and", limits[0], "location_concentration")
    parity, negative = _PARITY.replace(_J, of).replace("0.3", str(limits[1])), _NEGATIVE.replace(_J, of).replace("0.7", str(limits[2]))
    return f"({location}) union all ({parity}) union all ({negative})"


_LOCATION = _concentration_sql("location", f"job_id = {JOB} and", model.LOCATION_MAX, "location_concentration")
_PARITY = f"""select 'platform_sentiment_parity' as assessment_type, 'category' as group_field, least(arg_min(category, m), arg_max(category, m)) || ' vs ' || greatest(arg_min(category, m), arg_max(category, m)) as group_value,
    'max_pairwise_difference' as metric_name, round(max(m) - min(m), 6) as metric_value, 0.3::double as threshold, max(m) - min(m) > 0.3 as is_violation, case when max(m) - min(m) > 0.3 then 'warning' end as severity
    from (select category, avg(comparative) as m {_J} group by 1)"""
_NEGATIVE = f"""select 'negative_dominance' as assessment_type, 'indicator' as group_field, 'negative' as group_value, 'negative_share' as metric_name, round(count(distinct post_id) filter (indicator = 'negative')::double / count(distinct post_id), 6) as metric_value,
    0.7::double as threshold, count(distinct post_id) filter (indicator = 'negative')::double / count(distinct post_id) > 0.7 as is_violation, case when count(distinct post_id) filter (indicator = 'negative')::double / count(distinct post_id) > 0.7 then 'warning' end as severity {_J}"""
_ALL = _all_sql(str(JOB))


@query("job_posts", f"select post_id {_J}")
def job_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_job(with_indicator(spark, sf_dir), JOB).select("post_id")


@query("bias_location_concentration", _LOCATION)
def bias_location_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(concentration(_job(spark, sf_dir), "location", model.LOCATION_MAX, "location_concentration"))


@query("bias_platform_parity", _PARITY)
def bias_platform_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(platform_parity(_job(spark, sf_dir)))


@query("bias_negative_dominance", _NEGATIVE)
def bias_negative_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(negative_dominance(_job(spark, sf_dir)))


@query("bias_assessments", _ALL)
def bias_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(assessments(_job(spark, sf_dir)))


@query("bias_alerts", f"select assessment_type, severity, group_value from ({_ALL}) where is_violation")
def bias_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of violated checks only."""
    return assessments(_job(spark, sf_dir)).where("is_violation").select("assessment_type", "severity", "group_value")


@query("bias_alerts_strict", f"select assessment_type, severity, group_value from ({_all_sql(str(JOB), STRICT)}) where is_violation")
def bias_alerts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts under the strict limits."""
    return assessments(_job(spark, sf_dir), STRICT).where("is_violation").select("assessment_type", "severity", "group_value")


@query("stored_open_alerts", f"select {JOB}::bigint as job_id, assessment_type, severity from ({_all_sql(str(JOB), STRICT)}) where is_violation and assessment_type <> 'negative_dominance'")
def stored_open_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's posts, scores, assessments and alerts go through a store, twice; alerts of dominance are resolved there."""
    store = Store(spark, f"{shared_base(spark)}/alerts-{uuid.uuid4().hex}")
    store.migrate()
    scored = _job(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256)).withColumn("month", F.trunc(F.to_date("collected_at"), "month"))
    store.append("raw_posts", scored)
    store.append("sentiment_results", scored)
    decided = scored.select(F.sha2(F.col("post_id").cast("string"), 256).alias("audit_id"), "post_id", "job_id", F.lit("sentiment").alias("decision_type"), F.col("content_hash").alias("input_hash"), F.col("indicator").alias("output"), F.lit(None).cast("double").alias("confidence"))
    store.append("decision_audit_log", decided)
    for _ in range(2):
        record(store, stored_posts(store, JOB), JOB, STRICT)
    resolve(store, JOB, "negative_dominance", "2024-07-01 13:00:00")
    return open_alerts(store).select("job_id", "assessment_type", "severity")


@query("bias_summary", f"select count(*) as checks_run, count(*) filter (is_violation) as violations_found from ({_ALL})")
def bias_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessments(_job(spark, sf_dir)).agg(F.count("*").alias("checks_run"), F.count_if("is_violation").alias("violations_found"))


@query("bias_latest", f"select * from (with {JOBS_SQL}, last as (select job_id from jobs where status = 'completed' order by started_at desc, job_id limit 1) select location as group_value, count(*)::double / sum(count(*)) over () as share, (select job_id from last) as job_id from sentiment where job_id = (select job_id from last) and location <> '' group by location order by 2 desc, 1 limit 1)")
def bias_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location check of the latest completed job, which a one-row join picks inside the plan."""
    last = latest(jobs(spark, sf_dir)).select("job_id")
    rows = with_indicator(spark, sf_dir).join(F.broadcast(last), "job_id").where("location <> ''")
    n = rows.groupBy("location", "job_id").agg(F.count("*").alias("n"))
    top = n.agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("location").alias("v"), "job_id")).alias("m"), F.sum("n").alias("all"))
    return top.select(F.col("m.v").alias("group_value"), values.ratio(-F.col("m.k"), F.col("all")).alias("share"), F.col("m.job_id").alias("job_id"))


_LAST = "(select job_id from jobs where status = 'completed' order by started_at desc, job_id limit 1)"


@query("bias_latest_assessments", f"select * from (with {JOBS_SQL} select a.*, j.job_id, j.completed_at as assessed_at from ({_all_sql(_LAST)}) a cross join (select job_id, completed_at from jobs where job_id = {_LAST}) j)")
def bias_latest_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assessment of the latest completed job, violations marked, with the time of assessing: the job's end.
    Without a completed job there are no rows."""
    return _rounded(latest_assessments(with_indicator(spark, sf_dir), jobs(spark, sf_dir)))


def latest_assessments(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The checks over the posts of the latest completed job of `found`, a one-row broadcast."""
    last = latest(found).select("job_id", F.col("completed_at").alias("assessed_at"))
    return assessments(rows.join(F.broadcast(last.select("job_id")), "job_id", "left_semi")).join(F.broadcast(last))


@query("active_alerts", f"select assessment_type, group_value from ({_ALL}) where is_violation and assessment_type <> 'negative_dominance'")
def active_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts not yet resolved; those of dominance count as resolved here."""
    alerts = assessments(_job(spark, sf_dir)).where("is_violation").withColumn("resolved_at", F.when(F.col("assessment_type") == "negative_dominance", F.lit("2024-07-01")))
    return alerts.where("resolved_at is null").select("assessment_type", "group_value")


@query("health_snapshot", f"select * from (with {JOBS_SQL} select job_id, posts_processed, (select count(*) from ({_ALL}) where is_violation) as open_alerts from jobs where status = 'completed' order by started_at desc, job_id limit 1)")
def health_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest completed job and how many alerts are open."""
    alerts = assessments(_job(spark, sf_dir)).agg(F.count_if("is_violation").alias("open_alerts"))
    return latest(jobs(spark, sf_dir)).select("job_id", "posts_processed").crossJoin(F.broadcast(alerts))


def health(found: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: the newest job in any state (nulls without one) and the open alerts, ordered by their type. An answer that comes
    at all shows that the engine is connected."""
    last = found.orderBy(F.desc("started_at"), "job_id").limit(1).select("job_id", "status", "posts_processed", "started_at", "completed_at")
    listed = alerts.where("resolved_at is null").agg(F.array_sort(F.collect_list(F.struct("assessment_type", "severity"))).alias("active_alerts"))
    state = listed.select(F.lit("healthy").alias("health"), F.lit(True).alias("connected"), "active_alerts")
    return state.join(F.broadcast(last), how="left")


@query("health_report", f"select * from (with {JOBS_SQL}, last as (select * from jobs order by started_at desc, job_id limit 1) select 'healthy' as health, true as connected, job_id, status, posts_processed, started_at, completed_at, (select coalesce(string_agg(assessment_type || '/' || severity, ',' order by assessment_type), '') from ({_ALL}) where is_violation) as active_alerts from last)")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = assessments(_job(spark, sf_dir)).where("is_violation").withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    shown = F.array_join(F.transform("active_alerts", lambda a: F.concat(a["assessment_type"], F.lit("/"), a["severity"])), ",")
    return health(jobs(spark, sf_dir), alerts).withColumn("active_alerts", shown)


@query("bias_source_concentration", _concentration_sql("source_name", f"job_id = {JOB} and", model.SOURCE_MAX, "source_concentration"))
def bias_source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(concentration(_job(spark, sf_dir), "source_name", model.SOURCE_MAX, "source_concentration"))


def _gaps(rates: DataFrame, metric: str) -> DataFrame:
    """All pairs of groups (a few categories) with the difference of a rate."""
    a, b = rates.select(F.col("category").alias("group_a"), F.col(metric).alias("rate_a")), rates.select(F.col("category").alias("group_b"), F.col(metric).alias("rate_b"))
    return a.join(F.broadcast(b), F.col("group_a") < F.col("group_b")).withColumn("gap", F.abs(F.col("rate_a") - F.col("rate_b")))


@query(
    "bias_demographic_parity",
    "select a.category as group_a, b.category as group_b, round(abs(a.r - b.r), 6) as gap, case when abs(a.r - b.r) > 0.2 then 'critical' when abs(a.r - b.r) > 0.1 then 'warning' else 'none' end as severity "
    "from (select category, count(*) filter (indicator = 'positive')::double / count(*) as r from sentiment group by 1) a join (select category, count(*) filter (indicator = 'positive')::double / count(*) as r from sentiment group by 1) b on a.category < b.category",
)
def bias_demographic_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of positive rates between categories."""
    rates = with_indicator(spark, sf_dir).groupBy("category").agg((F.count_if(F.col("indicator") == "positive").cast("double") / F.count("*")).alias("rate"))
    severity = F.when(F.col("gap") > model.PARITY_GAP_CRITICAL, "critical").when(F.col("gap") > model.PARITY_GAP_WARNING, "warning").otherwise("none")
    return _gaps(rates, "rate").select("group_a", "group_b", F.round("gap", 6).alias("gap"), severity.alias("severity"))


_ODDS = "select category, coalesce(count(*) filter (toxic = 1 and indicator = 'negative')::double / nullif(count(*) filter (toxic = 1), 0), 0) as tpr, coalesce(count(*) filter (toxic = 0 and indicator = 'negative')::double / nullif(count(*) filter (toxic = 0), 0), 0) as fpr from sentiment join labels on doc_id = post_id group by 1"


@query("bias_equalized_odds", f"select a.category as group_a, b.category as group_b, round(abs(a.tpr - b.tpr), 6) as tpr_gap, round(abs(a.fpr - b.fpr), 6) as fpr_gap, abs(a.tpr - b.tpr) > 0.08 or abs(a.fpr - b.fpr) > 0.08 as is_violation from ({_ODDS}) a join ({_ODDS}) b on a.category < b.category")
def bias_equalized_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of true and false positive rates of 'negative' as a sign of toxicity, between categories."""
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"), "toxic")
    rows = with_indicator(spark, sf_dir).join(truth, "post_id")
    said = F.col("indicator") == "negative"
    rates = rows.groupBy("category").agg(
        values.ratio(F.count_if(said & (F.col("toxic") == 1)), F.count_if(F.col("toxic") == 1)).alias("tpr"), values.ratio(F.count_if(said & (F.col("toxic") == 0)), F.count_if(F.col("toxic") == 0)).alias("fpr")
    )
    a, b = (rates.select(*[F.col(c).alias(f"{c}_{k}") for c in rates.columns]) for k in ("a", "b"))
    pairs = a.join(F.broadcast(b), F.col("category_a") < F.col("category_b"))
    tpr, fpr = F.abs(F.col("tpr_a") - F.col("tpr_b")), F.abs(F.col("fpr_a") - F.col("fpr_b"))
    return pairs.select(F.col("category_a").alias("group_a"), F.col("category_b").alias("group_b"), F.round(tpr, 6).alias("tpr_gap"), F.round(fpr, 6).alias("fpr_gap"), ((tpr > model.ODDS_GAP) | (fpr > model.ODDS_GAP)).alias("is_violation"))
