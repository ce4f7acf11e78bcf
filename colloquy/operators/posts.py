"""Posts: scoring, filters, listings, themes, hourly series and the ingest pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions import values
from ..functions.text import one_spaced, trimmed, with_dqi, with_relevance, with_sentiment
from ..plans.scored import counts, scored_posts, with_indicator
from ..sources.tables import AS_OF, posts, sources, table

# --- row-wise scores ---


@query("sentiment_posts", "select post_id, score, comparative, indicator, token_count from sentiment")
def sentiment_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon sentiment of every post."""
    return with_indicator(spark, sf_dir).select("post_id", "score", "comparative", "indicator", "token_count")


@query("relevance_posts", "select post_id, relevance, array_to_string(matched_keywords, '|') as matched_keywords, is_relevant from relevance")
def relevance_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword relevance of every post."""
    return with_relevance(posts(spark, sf_dir)).select("post_id", "relevance", F.array_join("matched_keywords", "|").alias("matched_keywords"), "is_relevant")


@query("dqi_posts", "select post_id, participation, justification, respectfulness, constructiveness, evidence, round(dqi_total, 6) as dqi_total from dqi")
def dqi_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliberative quality of every post."""
    return with_dqi(posts(spark, sf_dir)).select("post_id", *model.DIMENSIONS, F.round("dqi_total", 6).alias("dqi_total"))


@query("relevance_gate", "select post_id, relevance from relevance where relevance >= 0.4")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts relevant enough to be embedded and correlated."""
    return with_relevance(posts(spark, sf_dir)).where(F.col("relevance") >= model.GATE_RELEVANCE).select("post_id", "relevance")


# --- filters ---


def filtered(df: DataFrame, category: str | None = None, location: str | None = None, from_: str | None = None, to: str | None = None) -> DataFrame:
    """The conjunction of the conditions given; both time bounds are inclusive. Parameters are checked, never spliced into SQL."""
    conditions: list[Column] = []
    if values.non_blank(category, "category") is not None:
        conditions.append(F.col("category") == category)
    if values.non_blank(location, "location") is not None:
        conditions.append(F.col("location") == location)
    if values.moment(from_):
        conditions.append(F.col("collected_at") >= F.lit(from_).cast("timestamp_ntz"))
    if values.moment(to):
        conditions.append(F.col("collected_at") <= F.lit(to).cast("timestamp_ntz"))
    for c in conditions:
        df = df.where(c)
    return df


def listed(df: DataFrame, limit: int | str | None = None, **conditions: str | None) -> DataFrame:
    """Scored posts that meet the conditions, newest first (ties by id), with a snippet of the content."""
    n = values.in_range(limit, 1, 100, 20)
    shown = filtered(df, **conditions).select("post_id", F.left("content", F.lit(120)).alias("snippet"), "source_name", "category", "location", "indicator", "comparative", "collected_at")
    return shown.orderBy(F.desc("collected_at"), "post_id").limit(n)


_LISTED = "select post_id, left(content, 120) as snippet, source_name, category, location, indicator, comparative, collected_at from sentiment"


@query("filter_platform", "select post_id, category from posts where category = 'news'")
def filter_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(posts(spark, sf_dir), category="news").select("post_id", "category")


@query("filter_location", "select post_id, location from posts where location = 'Tokyo'")
def filter_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(posts(spark, sf_dir), location="Tokyo").select("post_id", "location")


@query("filter_date_range", "select post_id, collected_at from posts where collected_at >= timestamp '2024-06-30' and collected_at <= timestamp '2024-07-01'")
def filter_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(posts(spark, sf_dir), from_="2024-06-30", to="2024-07-01").select("post_id", "collected_at")


@query("located_posts", "select post_id, location from posts where location is not null and location <> ''")
def located_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).where("location is not null and location <> ''").select("post_id", "location")


@query("query_posts", f"{_LISTED} where category = 'social' and location = 'London' and collected_at >= timestamp '2024-06-05' order by collected_at desc, post_id limit 50")
def query_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered list endpoint."""
    return listed(with_indicator(spark, sf_dir), 50, category="social", location="London", from_="2024-06-05")


@query("recent_posts", f"{_LISTED} order by collected_at desc, post_id limit 20")
def recent_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest scored posts."""
    return listed(with_indicator(spark, sf_dir))


@query(
    "query_grouped",
    "select category, date_trunc('day', collected_at)::timestamp as day, count(*) as posts, round(avg(comparative), 6) as avg_comparative, round(avg(dqi_total), 6) as avg_dqi, count(*) filter (is_relevant) as relevant from dqi where location <> '' group by 1, 2",
)
def query_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The richer query form: measures by category and day."""
    located = scored_posts(spark, sf_dir).where("location <> ''")
    return located.groupBy("category", F.date_trunc("day", "collected_at").cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("posts"), F.round(F.avg("comparative"), 6).alias("avg_comparative"), F.round(F.avg("dqi_total"), 6).alias("avg_dqi"), F.count_if("is_relevant").alias("relevant")
    )


# --- aggregates ---


@query(
    "sentiment_summary",
    "select count(*) as total, count(*) filter (indicator = 'positive') as positive, count(*) filter (indicator = 'neutral') as neutral, count(*) filter (indicator = 'negative') as negative, coalesce(round(avg(comparative), 6), 0) as avg_comparative, max(collected_at) as last_updated from sentiment s join sources using (source_name)",
)
def sentiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean and newest moment over all scored posts; zeros when there are none."""
    star = with_indicator(spark, sf_dir).join(F.broadcast(sources(spark, sf_dir).select("source_name")), "source_name")
    return star.agg(*counts(), F.coalesce(F.round(F.avg("comparative"), 6), F.lit(0.0)).alias("avg_comparative"), F.max("collected_at").alias("last_updated"))


@query("category_avg_sentiment", "select category, round(avg(comparative), 6) as avg_comparative from sentiment group by category")
def category_avg_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indicator(spark, sf_dir).groupBy("category").agg(F.round(F.avg("comparative"), 6).alias("avg_comparative"))


@query("sources_registry", "select * from sources where active order by category, source_name")
def sources_registry(spark: SparkSession, sf_dir: str, active: bool | None = True) -> DataFrame:
    """The sources, optionally only the (in)active ones."""
    found = sources(spark, sf_dir)
    return (found if active is None else found.where(F.col("active") == active)).orderBy("category", "source_name")


def hourly(df: DataFrame, hours: int | str | None = None, as_of: str = AS_OF) -> DataFrame:
    """Posts by category and hour over the last whole hours, empty hours as zeros.

    The window starts at the oldest bucket and ends with the current hour, so future rows neither
    count nor bring in their category. The frame of categories and hours is small whatever the input.
    """
    n = values.clamped(hours, 1, 48, 12)
    now = F.date_trunc("hour", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    first, hour = now - F.make_dt_interval(F.lit(0), F.lit(n - 1)), F.make_dt_interval(F.lit(0), F.lit(1))
    inside = df.where((F.col("collected_at") >= first) & (F.col("collected_at") < now + hour))
    counted = inside.groupBy("category", F.date_trunc("hour", "collected_at").cast("timestamp_ntz").alias("hour")).agg(*counts())
    frame = counted.select("category").distinct().select("category", F.explode(F.sequence(first, now, hour)).alias("hour"))
    return frame.join(counted, ["category", "hour"], "left").select("category", "hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in [*model.INDICATORS, "total"]])


_HOURLY = f"""hours as (
    select unnest(generate_series(date_trunc('hour', timestamp '{AS_OF}') - interval 23 hour, date_trunc('hour', timestamp '{AS_OF}'), interval 1 hour)) as hour
), counted as (
    select category, date_trunc('hour', collected_at) as hour, count(*) filter (indicator = 'positive') as positive, count(*) filter (indicator = 'neutral') as neutral,
        count(*) filter (indicator = 'negative') as negative, count(*) as total
    from sentiment where collected_at >= date_trunc('hour', timestamp '{AS_OF}') - interval 23 hour and collected_at < date_trunc('hour', timestamp '{AS_OF}') + interval 1 hour group by 1, 2
), filled as (
    select category, hours.hour::timestamp as hour, coalesce(positive, 0) as positive, coalesce(neutral, 0) as neutral, coalesce(negative, 0) as negative, coalesce(total, 0) as total
    from (select distinct category from counted) c cross join hours left join counted using (category, hour)
)"""


@query("timeseries_by_category", f"select * from (with {_HOURLY} select * from filled)")
def timeseries_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(with_indicator(spark, sf_dir), 24)


@query("timeseries_nested", f"select category, string_agg(strftime(hour, '%Y-%m-%dT%H:%M:%S') || '=' || positive || '/' || neutral || '/' || negative, ';' order by hour) as series from (with {_HOURLY} select * from filled) group by category")
def timeseries_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each category with its whole series, oldest hour first."""
    point = F.concat(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("="), F.concat_ws("/", *[F.col(i).cast("string") for i in model.INDICATORS]))
    series = F.transform(F.array_sort(F.collect_list(F.struct("hour", point.alias("point")))), lambda x: x["point"])
    return hourly(with_indicator(spark, sf_dir), 24).groupBy("category").agg(F.array_join(series, ";").alias("series"))


# --- themes ---


def keyword_posts(df: DataFrame) -> DataFrame:
    """One row for each distinct keyword of a scored post."""
    return df.select("post_id", "category", "indicator", F.explode(F.array_distinct("matched_keywords")).alias("keyword"))


def top_categories(tagged: DataFrame) -> DataFrame:
    """Each keyword's most frequent category; ties go to the first in the alphabet."""
    n = tagged.groupBy("keyword", "category").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("n"), "category"))
    return n.withColumn("rn", first).where("rn = 1").select("keyword", F.col("category").alias("top_category"))


def themes(df: DataFrame, k: int = 12, least: int = model.MIN_THEME_VOLUME) -> DataFrame:
    """The largest themes: keywords of at least `least` posts with their sentiment and top category."""
    tagged = keyword_posts(df)
    # volume by indicator and category in one aggregation; all else is folded from these few rows
    cells = tagged.groupBy("keyword", "category").agg(*counts())
    volume = cells.groupBy("keyword").agg(F.sum("total").alias("volume"), *[F.sum(i).alias(i) for i in model.INDICATORS]).where(F.col("volume") >= least)
    first = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("total"), "category"))
    top = cells.withColumn("rn", first).where("rn = 1").select("keyword", F.col("category").alias("top_category"))
    return volume.join(top, "keyword").orderBy(F.desc("volume"), "keyword").limit(k)


_TAGGED = "tagged as (select distinct post_id, category, indicator, unnest(matched_keywords) as keyword from relevance)"
_THEMES = f"""select * from (with {_TAGGED}, ranked as (
    select keyword, category, row_number() over (partition by keyword order by count(*) desc, category) as rn from tagged group by keyword, category
)
select keyword, count(*) as volume, count(*) filter (indicator = 'positive') as positive, count(*) filter (indicator = 'neutral') as neutral, count(*) filter (indicator = 'negative') as negative, r.category as top_category
from tagged t join ranked r using (keyword) where rn = 1 group by keyword, r.category having count(*) >= 3 order by volume desc, keyword limit 12)"""


@query("themes", _THEMES)
def themes_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return themes(with_relevance(with_indicator(spark, sf_dir)))


@query("themes_top_category", f"select keyword, category as top_category from (with {_TAGGED} select keyword, category, row_number() over (partition by keyword order by count(*) desc, category) as rn from tagged group by keyword, category) where rn = 1")
def themes_top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_categories(keyword_posts(with_relevance(with_indicator(spark, sf_dir))))


def partitioned_themes(found: DataFrame, mode: str) -> DataFrame:
    """The warm (net >= 0.1, warmest first) or cold half of the themes; together they lose nothing."""
    if mode not in ("warm", "cold"):
        raise ValueError(f"unknown mode {mode!r}")
    given = [F.col(c) for c in ("net", "sent") if c in found.columns]
    rows = found.withColumn("net", F.coalesce(*given, values.net(total="volume")))
    if mode == "warm":
        return rows.where(F.col("net") >= model.WARM_FROM).orderBy(F.desc("net"), "keyword")
    return rows.where(F.col("net") < model.WARM_FROM).orderBy("net", "keyword")


@query("themes_warm", f"select * from (select *, (positive - negative)::double / volume as net from ({_THEMES})) where net >= 0.1")
def themes_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioned_themes(themes_query(spark, sf_dir), "warm")


@query("themes_cold", f"select * from (select *, (positive - negative)::double / volume as net from ({_THEMES})) where net < 0.1")
def themes_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioned_themes(themes_query(spark, sf_dir), "cold")


# --- ingest ---


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads as they might arrive, derived from the whole documents."""
    d = F.col("doc_id")
    head = F.concat(F.lit("  Title  "), d.cast("string"), F.lit("\n"))
    body = F.col("text")
    return table(spark, sf_dir, "documents").select(
        d.alias("post_id"),
        F.when(d % 3 == 0, "reddit").otherwise("rss").alias("source_type"),
        F.when(d % 3 == 0, F.to_json(F.struct(d.cast("string").alias("id"), head.alias("title"), F.when(d % 2 == 0, body).otherwise("").alias("selftext"), F.lit("someone").alias("author"))))
        .when(d % 3 == 1, F.to_json(F.struct(F.concat(F.lit("e"), d.cast("string")).alias("external_id"), F.lit("").alias("text"), body.alias("body"), F.lit("a@b.c").alias("email"))))
        .otherwise(F.to_json(F.struct(body.alias("content"), F.lit("u").alias("user"))))
        .alias("payload"),
    )


def normalised(raw: DataFrame, *more: str) -> DataFrame:
    """Content, its hash, external id and the payload without personal keys, from raw JSON payloads; and the columns that `more` names.

    Posts of the kind reddit join their trimmed title and body by a blank line; others take the
    first of text, body, content and title that isn't empty. White space runs become one space.
    """
    keys = ["title", "selftext", "text", "body", "content", "id", "external_id"]
    fields = raw.withColumn("_f", F.from_json("payload", ", ".join(f"{k} string" for k in keys)))
    f = {k: F.col(f"_f.{k}") for k in keys}
    joined = F.concat_ws("\n\n", F.nullif(trimmed(f["title"]), F.lit("")), F.nullif(trimmed(f["selftext"]), F.lit("")))
    first = F.coalesce(*[F.nullif(f[k], F.lit("")) for k in ("text", "body", "content", "title")], F.lit(""))
    content = F.btrim(one_spaced(F.when(F.col("source_type") == "reddit", joined).otherwise(first)), F.lit(" "))
    kept = F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: ~k.isin(model.PII_KEYS))
    return fields.select(
        "post_id", "source_type", content.alias("content"), F.sha2(content, 256).alias("content_hash"),
        F.coalesce(F.nullif(f["id"], F.lit("")), F.nullif(f["external_id"], F.lit("")), F.lit("")).alias("external_id"), F.to_json(kept).alias("payload"), *more,
    )


_RAW = """raw as (
    select doc_id as post_id, case when doc_id % 3 = 0 then 'reddit' else 'rss' end as source_type,
        trim(regexp_replace(case when doc_id % 3 = 0 then 'Title  ' || doc_id || case when doc_id % 2 = 0 and trim(text, E' \\t\\n\\r') <> '' then E'\\n\\n' || trim(text, E' \\t\\n\\r') else '' end else text end, '\\s+', ' ', 'g')) as content,
        case doc_id % 3 when 0 then doc_id::varchar when 1 then 'e' || doc_id else '' end as external_id
    from documents
)"""


@query("normalise_posts_whole", f"select * from (with {_RAW} select post_id, source_type, content, sha256(content) as content_hash, external_id from raw)")
@query("normalise_posts", f"select * from (with {_RAW} select post_id, source_type, content, sha256(content) as content_hash, external_id from raw)")
def normalise_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, normalised and hashed; registered under two names."""
    return normalised(payloads(spark, sf_dir)).drop("payload")


@query("payload_pii_stripped", "select doc_id as post_id, case doc_id % 3 when 0 then 'id|selftext|title' when 1 then 'body|external_id|text' else 'content' end as keys from documents")
def payload_pii_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that remain in each payload."""
    kept = F.from_json("payload", "map<string,string>")
    return normalised(payloads(spark, sf_dir)).select("post_id", F.array_join(F.array_sort(F.map_keys(kept)), "|").alias("keys"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An incoming batch: all posts, some of them twice."""
    incoming = posts(spark, sf_dir)
    return incoming.unionByName(incoming.where("post_id % 10 = 0"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that the store already has."""
    return posts(spark, sf_dir).where("post_id % 3 = 0")


def new_posts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch that the store doesn't hold by source and external id, each once; of rows that differ, the first in order of their columns."""
    key = ["source_name", "external_id"]
    rest = [c for c in incoming.columns if c not in key]
    new = incoming.join(existing.select(*key), key, "left_anti")
    return new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row")).select(*key, "_row.*").select(*incoming.columns)


@query("ingest_new_posts", "select post_id, source_name, external_id from posts where post_id % 3 <> 0")
def ingest_new_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_posts(batch(spark, sf_dir), stored(spark, sf_dir)).select("post_id", "source_name", "external_id")


@query("ingest_batch_counts", "select count(*) + count(*) filter (post_id % 10 = 0) as total, count(*) filter (post_id % 3 <> 0) as new, count(*) filter (post_id % 3 = 0) + count(*) filter (post_id % 10 = 0) as skipped from posts")
def ingest_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of the batch came, were new and were skipped."""
    key = ["source_name", "external_id"]
    rows = batch(spark, sf_dir).groupBy(*key).agg(F.count("*").alias("n"))
    known = stored(spark, sf_dir).select(*key).distinct().withColumn("old", F.lit(True))
    per_key = rows.join(known, key, "left").withColumn("is_new", F.when(F.col("old").isNull(), 1).otherwise(0))
    return per_key.agg(F.sum("n").alias("total"), F.sum("is_new").cast("bigint").alias("new"), F.sum(F.col("n") - F.col("is_new")).alias("skipped"))


def ingested(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """New posts with all three scores as sibling columns of one pass."""
    return with_dqi(with_relevance(with_sentiment(new_posts(incoming, existing))))


@query("ingest_pipeline", "select post_id, indicator, comparative, relevance, round(dqi_total, 6) as dqi_total from dqi where post_id % 3 <> 0")
def ingest_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(batch(spark, sf_dir), stored(spark, sf_dir)).select("post_id", "indicator", "comparative", "relevance", F.round("dqi_total", 6).alias("dqi_total"))


@query("seed_sources_idempotent", "select source_name, display_name, source_type, category, active from sources")
def seed_sources_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding twice: rows whose name is there already change nothing."""
    first = sources(spark, sf_dir)
    return first.unionByName(first.join(first.select("source_name"), "source_name", "left_anti").select(first.columns))


def demo_posts(spark: SparkSession, per_city: int = 8, seed: int = 11) -> DataFrame:
    """Demo posts of the known cities: 60 % of the city's leaning, 25 % neutral, the rest opposite, chosen by a hash."""
    from ..sources.tables import coordinates

    cities = coordinates(spark).select(F.col("location").alias("city"))
    leaning = F.element_at(F.array(*map(F.lit, model.INDICATORS)), (F.pmod(F.xxhash64("city", F.lit(seed)), F.lit(3)) + 1).cast("int"))
    rows = cities.withColumn("leaning", leaning).crossJoin(F.broadcast(spark.range(per_city).select(F.col("id").alias("n"))))
    r = F.pmod(F.xxhash64("city", "n", F.lit(seed)), F.lit(100))
    indicator = F.when(r < 60, F.col("leaning")).when(r < 85, "neutral").when(F.col("leaning") == "negative", "positive").otherwise("negative")
    return rows.withColumn("indicator", indicator).select(
        F.concat(F.lit("demo-"), F.lower(F.replace("city", F.lit(" "), F.lit("-"))), F.lit("-"), F.col("n").cast("string")).alias("external_id"), "city", "indicator",
        F.when(F.col("indicator") == "positive", 4).when(F.col("indicator") == "negative", -4).otherwise(0).alias("score"),
        F.when(F.col("indicator") == "positive", 0.28).when(F.col("indicator") == "negative", -0.28).otherwise(0.01).cast("double").alias("comparative"),
        F.when(F.col("indicator") == "positive", 0.88).when(F.col("indicator") == "negative", 0.84).otherwise(0.75).cast("double").alias("confidence"),
    )


@query("demo_posts")
def demo_posts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo_posts(spark)
