"""Audit: one row for each inference, trails of a post, methodologies, jobs, alerts and the health snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions import values
from ..plans.scored import scored_posts
from ..sources.tables import AS_OF, posts

#: Key of the demonstration trail; a deployment gives its own.
KEY = "demonstration-key"


def methodologies(spark: SparkSession) -> DataFrame:
    """The registered methods; a fixed small table."""
    return spark.createDataFrame(model.METHODOLOGIES, "component string, version string, model_name string, config string, effective_from string, deprecated_at string")


def audited(scored: DataFrame) -> DataFrame:
    """Three audit rows for each scored post: what was decided, by which method, on which input.

    The id is a hash of post and component, so scoring again gives the same rows; an anti-join on it
    makes saving idempotent. Confidence is null but for deliberative quality, whose total doubles as it.
    """
    rows = scored.where("content is not null").withColumn("input_hash", F.sha2("content", 256))
    decisions = F.array(
        F.struct(F.lit("sentiment").alias("decision_type"), F.to_json(F.struct("score", "token_count", "indicator")).alias("output"), F.lit(None).cast("double").alias("confidence")),
        F.struct(F.lit("relevance").alias("decision_type"), F.to_json(F.struct("matched_keywords", "is_relevant")).alias("output"), F.lit(None).cast("double").alias("confidence")),
        F.struct(F.lit("discourse").alias("decision_type"), F.to_json(F.struct(*[F.col(d) for d in model.DIMENSIONS])).alias("output"), F.col("dqi_total").alias("confidence")),
    )
    each = rows.select("post_id", "job_id", "collected_at", "input_hash", F.explode(decisions).alias("d"))
    return each.select(F.sha2(F.concat_ws(":", F.col("post_id").cast("string"), "d.decision_type"), 256).alias("audit_id"), "post_id", "job_id", "collected_at", "d.decision_type", "input_hash", "d.output", "d.confidence")


_AUDIT = """audit as (
    select sha256(post_id || ':' || decision_type) as audit_id, post_id, job_id, collected_at, decision_type, sha256(content) as input_hash,
        case when decision_type = 'discourse' then round(dqi_total, 6) end as confidence,
        case decision_type when 'sentiment' then '{"score":' || score || ',"token_count":' || token_count || ',"indicator":"' || indicator || '"}'
            when 'relevance' then '{"matched_keywords":[' || array_to_string(list_transform(matched_keywords, lambda k: '"' || k || '"'), ',') || '],"is_relevant":' || is_relevant || '}'
            else '{"participation":' || participation || ',"justification":' || justification || ',"respectfulness":' || respectfulness || ',"constructiveness":' || constructiveness || ',"evidence":' || evidence || '}' end as output
    from (select *, unnest(['sentiment', 'relevance', 'discourse']) as decision_type from dqi where content is not null)
)"""


@query("audit_rows", f"select * from (with {_AUDIT} select audit_id, post_id, decision_type, input_hash, output, confidence from audit)")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(scored_posts(spark, sf_dir))
    return rows.select("audit_id", "post_id", "decision_type", "input_hash", "output", F.round("confidence", 6).alias("confidence"))


@query("audit_post", "select post_id, content, indicator, score from sentiment where post_id = 7")
def audit_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point lookup: the filter on the id reaches the Parquet scan."""
    return scored_posts(spark, sf_dir).where("post_id = 7").select("post_id", "content", "indicator", "score")


def trail(scored: DataFrame, post_id: int, key: str | None) -> DataFrame:
    """A post's audit rows with the method in force; the input hash only as a keyed hash, and not at all without a key."""
    spark = scored.sparkSession
    methods = methodologies(spark).where("deprecated_at is null").select(F.col("component").alias("decision_type"), "version", "model_name", "config")
    rows = audited(scored.where(F.col("post_id") == post_id)).join(F.broadcast(methods), "decision_type")
    reasons = F.create_map(*[F.lit(x) for pair in model.JUSTIFICATIONS.items() for x in pair])
    rows = rows.withColumn("justification", F.element_at(reasons, F.col("decision_type"))).orderBy("collected_at", "decision_type")
    shown = rows.withColumn("input_hmac", values.hmac_sha256(key, F.col("input_hash"))) if key else rows
    return shown.drop("input_hash")


def post_block(found: DataFrame, post_id: int) -> DataFrame:
    """What a trail says of its post: the first 120 characters, place, source and time; no row without the post."""
    return found.where(F.col("post_id") == post_id).select("post_id", F.substring("content", 1, 120).alias("content_snippet"), "location", "category", "source_name", "collected_at")


@query("audit_post_block", "select post_id, content[:120] as content_snippet, location, category, source_name, collected_at from posts where post_id = 8")
def audit_post_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_block(posts(spark, sf_dir), 8)


def as_json(rows: DataFrame) -> DataFrame:
    """Each post's decisions as one JSON array."""
    return rows.groupBy("post_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("decision_type", "output")))).alias("decisions"))


def _of_method(column: int) -> str:
    """A column of the methods in force, by decision type, in SQL."""
    return "case decision_type " + " ".join(f"when '{m[0]}' then '{m[column]}'" for m in model.METHODOLOGIES if m[5] is None) + " end"


def _hmac_constant() -> str:
    """The keyed hash in SQL, with the padded keys as literals."""
    raw = KEY.encode().ljust(64, b"\0")
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in raw) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::blob || unhex(sha256('{inner}'::blob || encode(input_hash))))"


@query("audit_trail", f"select * from (with {_AUDIT} select post_id, decision_type, case decision_type when 'discourse' then '1.0.0-DQI' else '1.0.0' end as version, output, {_hmac_constant()} as input_hmac from audit where post_id = 8)")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trail(scored_posts(spark, sf_dir), 8, KEY).select("post_id", "decision_type", "version", "output", "input_hmac")


_REASON = "case decision_type " + " ".join(f"when '{k}' then '{v}'" for k, v in model.JUSTIFICATIONS.items()) + " end"


@query("audit_decisions", f"select * from (with {_AUDIT} select post_id, decision_type, {_of_method(2)} as model_name, {_of_method(1)} as version, {_of_method(3)} as config, {_REASON} as justification, output, confidence, collected_at from audit where post_id = 8)")
def audit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full trail of a post without a key: no input hash in any form, the method with its settings and reasons."""
    found = trail(scored_posts(spark, sf_dir), 8, None).withColumn("confidence", F.round("confidence", 6))
    return found.select("post_id", "decision_type", "model_name", "version", "config", "justification", "output", "confidence", "collected_at")


@query("audit_trail_json_all", f"select * from (with {_AUDIT} select post_id, '[' || string_agg('{{\"decision_type\":\"' || decision_type || '\",\"output\":' || to_json(output) || '}}', ',' order by decision_type) || ']' as decisions from audit group by post_id)")
@query("audit_trail_json", f"select * from (with {_AUDIT} select post_id, '[' || string_agg('{{\"decision_type\":\"' || decision_type || '\",\"output\":' || to_json(output) || '}}', ',' order by decision_type) || ']' as decisions from audit group by post_id)")
def audit_trail_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on every post; registered under two names."""
    return as_json(audited(scored_posts(spark, sf_dir)))


_UUID = "h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"


@query("valid_uuid_flags", f"select post_id, regexp_full_match(case post_id % 3 when 0 then {_UUID} when 1 then upper({_UUID}) else 'x' || {_UUID} end, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}') as valid from (select post_id, sha256(post_id::varchar) as h from posts)")
def valid_uuid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some derived identifiers have the form of a UUID, in either case."""
    h = F.sha2(F.col("post_id").cast("string"), 256)
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.when(F.col("post_id") % 3 == 0, made).when(F.col("post_id") % 3 == 1, F.upper(made)).otherwise(F.concat(F.lit("x"), made))
    return posts(spark, sf_dir).select("post_id", values.is_uuid(text).alias("valid"))


@query("methodology_current", "select * from (values ('bias', '1.0.0', 'distribution-checks-v1'), ('discourse', '1.0.0-DQI', 'dqi-heuristic-v1'), ('relevance', '1.0.0', 'keyword-relevance-v1'), ('sentiment', '1.0.0', 'lexicon-valence-v1')) t(component, version, model_name)")
def methodology_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods in force, the newest of a component first."""
    return methodologies(spark).where("deprecated_at is null").orderBy("component", F.col("effective_from").desc_nulls_first()).select("component", "version", "model_name")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing jobs, derived from the posts they took in; the last one is still running."""
    found = posts(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("posts_processed"))
    started = F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (F.lit(4) - F.col("job_id")).cast("int"))
    found = found.withColumn("started_at", started).withColumn("status", F.when(F.col("job_id") == 3, "running").otherwise("completed"))
    return found.withColumn("completed_at", F.when(F.col("status") == "completed", F.col("started_at") + F.expr("interval 30 minutes")))


JOBS_SQL = f"jobs as (select job_id, count(*) as posts_processed, timestamp '{AS_OF}' - to_hours(4 - job_id) as started_at, case when job_id = 3 then 'running' else 'completed' end as status, case when job_id <> 3 then timestamp '{AS_OF}' - to_hours(4 - job_id) + to_minutes(30) end as completed_at from posts group by job_id)"


def latest(found: DataFrame) -> DataFrame:
    """The completed job that started last."""
    return found.where("status = 'completed'").orderBy(F.desc("started_at"), "job_id").limit(1)


@query("latest_job", f"select * from (with {JOBS_SQL} select * from jobs where status = 'completed' order by started_at desc, job_id limit 1)")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(jobs(spark, sf_dir))
