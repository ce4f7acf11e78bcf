"""Joins in time: as-of (the newest earlier row of the same key) and points within intervals.

Neither compares all rows of a key with one another. Time is cut into spans, so a key with a large part of all
rows is dealt over as many tasks as it has spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..plans.scored import scored_posts
from ..sources.tables import table
from .audit import _AUDIT, audited, methodologies

HOUR = 3_600_000_000


def micros(df: DataFrame, name: str) -> Column:
    """A time as microseconds; times without zone by their calendar, so that no zone's summer time moves them."""
    t = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(t.cast("timestamp"))
    parts = F.datediff(t, F.lit("1970-01-01")).cast("long") * 24 + F.hour(t)
    return (parts * 60 + F.minute(t)) * 60_000_000 + (F.expr(f"extract(second from `{name}`)") * 1_000_000).cast("long")


def asof(left: DataFrame, right: DataFrame, on: list[str], at: str, right_at: str, name: str, take: list[str], strict: bool = False, hours: int = 24, within: int | None = None) -> DataFrame:
    """Every row of `left` with a struct `name`: the columns `take` of the newest row of `right` with the same key that is not
    later (`strict`: earlier), null where there is none or where it is older than `within` microseconds.

    Rows of both sides are sorted together within a key and a span of `hours`; what a span inherits from earlier ones
    is the last row of each, one for each key and span, combined before the shuffle. Rows of `right` of one time are
    ordered by `take`, and the last counts. Null keys and null times of `left` keep a null; those of `right` take no part.
    Repeated rows of `left` stay repeated.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    rows = left.select(*[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], micros(left, at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))
    value = F.struct(*[F.col(f"`{c}`") for c in take])
    other = right.select(*[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], micros(right, right_at).alias("_t"), value.alias("_r"))
    whole = F.lit(True)
    for c in (*keys, "_t"):
        whole = whole & F.col(c).isNotNull()
    found = rows.where(whole).select("*", F.lit(None).cast(other.schema["_r"].dataType).alias("_r"), F.lit(0 if strict else 1).alias("_side"))
    other = other.where(whole).select(*keys, "_t", F.lit(None).cast(rows.schema["_l"].dataType).alias("_l"), "_r", F.lit(1 if strict else 0).alias("_side"))
    both = found.unionByName(other).withColumn("_span", F.expr(f"_t div {hours * HOUR}") - F.when(F.col("_t") < 0, 1).otherwise(0))
    seen = F.when(F.col("_r").isNotNull(), F.struct("_t", "_r"))
    sorted_ = Window.partitionBy(*keys, "_span").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.last(seen, ignorenulls=True).over(sorted_)).where("_l is not null")
    spans = both.groupBy(*keys, "_span").agg(F.max(seen).alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("_far", F.last("_m", ignorenulls=True).over(earlier)).where("_far is not null").drop("_m")
    newest = near.join(carried, [*keys, "_span"], "left").withColumn("_n", F.coalesce("_near", "_far"))
    if within is not None:
        newest = newest.withColumn("_n", F.when(F.col("_t") - F.col("_n._t") <= within, F.col("_n")))
    out = newest.select("_l", F.col("_n._r").alias(name))
    unknown = rows.where(~whole).select("_l", F.lit(None).cast(out.schema[name].dataType).alias(name))
    return out.unionByName(unknown).select("_l.*", name)


def in_intervals(points: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, unit: int = HOUR) -> DataFrame:
    """Pairs (`p` of `points`, `i` of `intervals`, structs) of one key with start <= at < end.

    An interval lies in one or two spans of its own level, the smallest of `unit` times a power of two that is not
    shorter than it; a point is looked for in one span of each level in use, of which a time of 64 bits allows a few dozen.
    So the rows shuffled are in proportion to both inputs, whatever the lengths. Null keys and times, and empty
    intervals, are in no pair; repeated rows make repeated pairs.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    i = intervals.select(*[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], micros(intervals, start).alias("_a"), micros(intervals, end).alias("_b"), F.struct(*[F.col(f"`{c}`") for c in intervals.columns]).alias("i")).where("_a < _b")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("_b") - F.col("_a")) / F.lit(unit)))).cast("int")
    i = i.withColumn("_level", level)
    levels = sorted(r[0] for r in i.select("_level").distinct().collect())  # at most one for each power of two
    size = F.expr(f"{unit} * shiftleft(1L, _level)")
    span = lambda t: F.floor(t / size).cast("long")
    i = i.withColumn("_span", F.explode(F.sequence(span(F.col("_a")), span(F.col("_b") - 1))))
    p = points.select(*[F.col(k).alias(n) for k, n in zip(on, keys, strict=True)], micros(points, at).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("p"))
    p = p.where("_t is not null").withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    p = p.withColumn("_span", span(F.col("_t")))
    return p.join(i, [*keys, "_level", "_span"]).where("_a <= _t and _t < _b").select("p", "i")


def in_force(rows: DataFrame, methods: DataFrame, at: str) -> DataFrame:
    """Decisions with the `method` (version, model_name, deprecated_at) in force at the time of each; null where none was."""
    dated = methods.withColumn("_from", F.to_timestamp_ntz("effective_from")).withColumnRenamed("component", "decision_type")
    found = asof(rows, dated, ["decision_type"], at, "_from", "method", ["version", "model_name", "deprecated_at"])
    ended = F.to_timestamp_ntz("method.deprecated_at") <= F.col(at)
    return found.withColumn("method", F.when(F.coalesce(ended, F.lit(False)), F.lit(None)).otherwise(F.col("method")))


_DECIDED = "collected_at - to_months((post_id % 18)::int) as decided_at"


@query(
    "asof_methods_in_force",
    f"select * from (with {_AUDIT} select audit_id, decided_at, case when decision_type = 'sentiment' and decided_at >= timestamp '2023-06-01' and decided_at < timestamp '2024-01-01' then '0.9.0' when decided_at < timestamp '2024-01-01' then null when decision_type = 'discourse' then '1.0.0-DQI' else '1.0.0' end as version "
    f"from (select audit_id, decision_type, {_DECIDED} from audit))",
)
def asof_methods_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each decision with the version of its method that was in force when it was made; decisions are dated over 18 months here."""
    rows = audited(scored_posts(spark, sf_dir)).withColumn("decided_at", F.col("collected_at") - F.make_ym_interval(F.lit(0), (F.col("post_id") % 18).cast("int")))
    return in_force(rows, methodologies(spark), "decided_at").select("audit_id", "decided_at", F.col("method.version").alias("version"))


@query(
    "asof_last_view",
    "select p.event_id, p.user_id, v.event_id as view_id, v.value as view_value, epoch_us(p.ts) - epoch_us(v.ts) as age from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts > v.ts",
)
def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the newest earlier view of its user."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    views = events.where("event_type = 'view'").withColumn("at", micros(events, "ts"))
    bought = events.where("event_type = 'purchase'")
    found = asof(bought, views, ["user_id"], "ts", "ts", "view", ["at", "event_id", "value"], strict=True)
    return found.select("event_id", "user_id", F.col("view.event_id").alias("view_id"), F.col("view.value").alias("view_value"), (micros(bought, "ts") - F.col("view.at")).alias("age"))


@query(
    "interval_events_after_purchase",
    "select p.event_id, count(*) as n, count(*) filter (e.event_type = 'error') as errors from (select *, ts + to_minutes((value * 40)::int) as until from events where event_type = 'purchase') p join events e on e.user_id = p.user_id and e.ts >= p.ts and e.ts < p.until group by 1",
)
def interval_events_after_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of its user fall into the time after each purchase, the longer the more was paid."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    minutes = F.round(F.col("value") * 40).cast("int")
    bought = events.where("event_type = 'purchase'").withColumn("until", F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0.0)))
    pairs = in_intervals(events.drop("value"), bought, ["user_id"], "ts", "ts", "until")
    return pairs.groupBy(F.col("i.event_id").alias("event_id")).agg(F.count("*").alias("n"), F.count_if(F.col("p.event_type") == "error").alias("errors"))
