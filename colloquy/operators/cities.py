"""The city aggregate: counts by place, nested sources, normalisation of dirty rows, bars of the globe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions import values
from ..plans.scored import counts, with_indicator
from ..sources.tables import coordinates
from .posts import demo_posts, filtered


def by_city(scored: DataFrame, **conditions: str | None) -> DataFrame:
    """Posts of each indicator and the dominant one, by city; unknown cities have null coordinates."""
    located = filtered(scored, **conditions).where("location is not null and location <> ''")
    rows = located.groupBy(F.col("location").alias("city")).agg(*counts(), F.max("collected_at").alias("last_updated"))
    places = F.broadcast(coordinates(scored.sparkSession).withColumnRenamed("location", "city"))
    return rows.withColumn("dominant", values.dominant()).join(places, "city", "left")


def by_city_source(scored: DataFrame) -> DataFrame:
    """Posts of each indicator by city, source and category."""
    located = scored.where("location is not null and location <> ''")
    return located.groupBy(F.col("location").alias("city"), "source_name", "category").agg(*counts())


def nested(cells: DataFrame) -> DataFrame:
    """Cities with their sources as an array (most posts first), from one aggregation by city and source."""
    source = F.struct((-F.col("total")).alias("_order"), "source_name", F.col("category").alias("source_category"), *model.INDICATORS, "total")
    rows = cells.groupBy("city").agg(*[F.sum(c).alias(c) for c in [*model.INDICATORS, "total"]], F.array_sort(F.collect_list(source)).alias("sources"))
    places = F.broadcast(coordinates(cells.sparkSession).withColumnRenamed("location", "city"))
    return rows.withColumn("sources", F.transform("sources", lambda s: s.dropFields("_order"))).withColumn("dominant", values.dominant()).join(places, "city", "left")


@query(
    "city_sentiment",
    "select city, positive, neutral, negative, total, last_updated, case when positive >= neutral and positive >= negative then 'positive' when neutral >= negative then 'neutral' else 'negative' end as dominant, lat, lng "
    "from cities join (select location as city, max(collected_at) as last_updated from posts group by 1) using (city) left join places using (city)",
)
def city_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_city(with_indicator(spark, sf_dir))


@query("city_dominant", "select city, case when positive >= neutral and positive >= negative then 'positive' when neutral >= negative then 'neutral' else 'negative' end as dominant from cities")
def city_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_city(with_indicator(spark, sf_dir)).select("city", "dominant")


@query("city_source_breakdown", "select * from city_sources")
def city_source_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_city_source(with_indicator(spark, sf_dir))


@query(
    "city_sentiment_nested",
    "select city, sum(total)::bigint as total, string_agg(source_name || ':' || category || ':' || positive || '/' || neutral || '/' || negative, ';' order by total desc, source_name) as sources from city_sources group by city",
)
def city_sentiment_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested aggregate, its array shown as text."""
    rows = nested(by_city_source(with_indicator(spark, sf_dir)))
    shown = F.transform("sources", lambda s: F.concat_ws(":", s["source_name"], s["source_category"], F.concat_ws("/", s["positive"].cast("string"), s["neutral"].cast("string"), s["negative"].cast("string"))))
    return rows.select("city", "total", F.array_join(shown, ";").alias("sources"))


def normalised_cities(raw: DataFrame) -> DataFrame:
    """Cities from rows of text: rows without valid coordinates go; counts that are no finite number, or negative, are 0;
    total, shares and the dominant label are recomputed."""

    def coordinate(name: str, bound: int):
        x = F.col(name).try_cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x) & x.between(-bound, bound), x)

    def count(name: str):
        x = F.col(name).try_cast("double")
        return F.when(x.isNotNull() & ~F.isnan(x) & (x < float("inf")), F.greatest(x, F.lit(0.0))).otherwise(0.0).cast("bigint")

    rows = raw.withColumns({"lat": coordinate("lat", 90), "lng": coordinate("lng", 180)}).where("lat is not null and lng is not null")
    rows = rows.withColumns({i: count(i) for i in model.INDICATORS}).withColumn("total", F.col("positive") + F.col("neutral") + F.col("negative"))
    return rows.withColumns({f"{i}_share": values.ratio(F.col(i), F.col("total")) for i in model.INDICATORS}).withColumn("dominant", values.dominant())


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city aggregate as text, with faults put in by the length of the name."""
    rows = by_city(with_indicator(spark, sf_dir))
    n = F.length("city")
    return rows.select(
        "city",
        F.when(n % 5 == 0, "abc").otherwise(F.col("lat").cast("string")).alias("lat"),
        F.when(n % 7 == 0, "999").otherwise(F.col("lng").cast("string")).alias("lng"),
        F.col("positive").cast("string").alias("positive"),
        F.when(n % 6 == 0, "-4").otherwise(F.col("neutral").cast("string")).alias("neutral"),
        F.when(n % 2 == 0, "NaN").otherwise(F.col("negative").cast("string")).alias("negative"),
    )


@query(
    "city_normalized",
    """select city, lat, lng, positive, neutral, negative, positive + neutral + negative as total, coalesce(round(positive::double / nullif(positive + neutral + negative, 0), 6), 0) as positive_share,
    case when positive >= neutral and positive >= negative then 'positive' when neutral >= negative then 'neutral' else 'negative' end as dominant
    from (select city, lat, lng, positive, case when length(city) % 6 = 0 then 0 else neutral end as neutral, case when length(city) % 2 = 0 then 0 else negative end as negative
        from cities join places using (city) where length(city) % 5 <> 0 and length(city) % 7 <> 0)""",
)
def city_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalised_cities(_dirty(spark, sf_dir))
    return rows.select("city", "lat", "lng", *model.INDICATORS, "total", F.round("positive_share", 6).alias("positive_share"), "dominant")


def with_demo_fallback(live: DataFrame, demo: DataFrame) -> DataFrame:
    """The live rows, or the demo's where there are none; decided inside the plan."""
    empty = live.agg(F.count("*").alias("n"))
    return live.unionByName(demo.join(F.broadcast(empty.where("n = 0")), how="left_semi"))


@query("city_with_demo_fallback", "select city, positive, neutral, negative, total from cities")
def city_with_demo_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["city", *model.INDICATORS, "total"]
    return with_demo_fallback(by_city(with_indicator(spark, sf_dir)).select(*columns), demo_posts(spark).groupBy("city").agg(*counts()).select(*columns))


@query("city_net_bucket", "select city, round((positive - negative)::double / total, 6) as net, case when (positive - negative)::double / total > 0.1 then 'positive' when (positive - negative)::double / total < -0.1 then 'negative' else 'neutral' end as bucket from cities")
def city_net_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_city(with_indicator(spark, sf_dir)).withColumn("net", values.net())
    return rows.select("city", F.round("net", 6).alias("net"), values.net_bucket(F.col("net")).alias("bucket"))


@query("tooltip_pcts", "select city, floor(positive * 100.0::double / total + 0.5)::bigint as positive_pct, floor(neutral * 100.0::double / total + 0.5)::bigint as neutral_pct, floor(negative * 100.0::double / total + 0.5)::bigint as negative_pct from cities")
def tooltip_pcts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole percentages, halves rounded up."""
    rows = by_city(with_indicator(spark, sf_dir))
    return rows.select("city", *[F.floor(F.col(i) * F.lit(100.0) / F.col("total") + 0.5).cast("bigint").alias(f"{i}_pct") for i in model.INDICATORS])


def sentiment_bars(cities: DataFrame) -> DataFrame:
    """Three bars for each placed city: height on a scale that takes the largest count to the top, and the rectangle it stands on."""
    placed = cities.where("lat is not null and lng is not null")
    top = placed.agg(F.greatest(F.coalesce(F.max(F.greatest(*model.INDICATORS)), F.lit(1)), F.lit(1)).alias("top"))
    step = model.BAR_WIDTH + model.BAR_GAP
    bars = F.array(*[F.struct(F.lit(i).alias("bar"), F.lit(k * step).alias("dx"), F.col(i).alias("count")) for k, i in zip((-1, 0, 1), model.INDICATORS, strict=True)])
    rows = placed.join(F.broadcast(top)).select("city", "lat", "lng", "top", F.explode(bars).alias("b"))
    return rows.select(
        "city", F.col("b.bar").alias("bar"), F.col("b.count").alias("count"),
        F.greatest(F.col("b.count") * (F.lit(float(model.BAR_TOP)) / F.col("top")), F.lit(float(model.BAR_FLOOR))).alias("height"),
        (F.col("lng") + F.col("b.dx") - model.BAR_WIDTH / 2).alias("x0"), (F.col("lng") + F.col("b.dx") + model.BAR_WIDTH / 2).alias("x1"),
        (F.col("lat") - model.BAR_DEPTH / 2).alias("y0"), (F.col("lat") + model.BAR_DEPTH / 2).alias("y1"),
    )


@query(
    "globe_bar_features",
    """select city, bar, n as count, round(greatest(n * (500000.0::double / top), 5000.0::double), 3) as height, round(lng + dx - 0.075::double, 6) as x0, round(lng + dx + 0.075::double, 6) as x1, round(lat - 0.05::double, 6) as y0, round(lat + 0.05::double, 6) as y1
    from (select city, lat, lng, max(greatest(positive, neutral, negative)) over () as top, unnest(['positive', 'neutral', 'negative']) as bar, unnest([-0.2::double, 0.0::double, 0.2::double]) as dx, unnest([positive, neutral, negative]) as n from cities join places using (city))""",
)
def globe_bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentiment_bars(by_city(with_indicator(spark, sf_dir)))
    return rows.select("city", "bar", "count", F.round("height", 3).alias("height"), *[F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")])


def source_stack(cells: DataFrame, scale: float) -> DataFrame:
    """Segments of each city's source bar, most posts first: base is the sum of the heights below."""
    height = F.greatest(F.col("total") * F.lit(scale), F.lit(float(model.SEGMENT_FLOOR)))
    below = Window.partitionBy("city").orderBy(F.desc("total"), "source_name").rowsBetween(Window.unboundedPreceding, -1)
    rows = cells.withColumn("segment", height).withColumn("base", F.coalesce(F.sum("segment").over(below), F.lit(0.0)))
    return rows.select("city", "source_name", "base", (F.col("base") + F.col("segment")).alias("height"))


@query(
    "globe_source_stack",
    "select city, source_name, round(top - seg, 3) as base, round(top, 3) as height from (select *, sum(seg) over (partition by city order by total desc, source_name rows unbounded preceding) as top from (select *, greatest(total * 100.0::double, 2000.0::double) as seg from city_sources))",
)
def globe_source_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source_stack(by_city_source(with_indicator(spark, sf_dir)), 100.0)
    return rows.select("city", "source_name", F.round("base", 3).alias("base"), F.round("height", 3).alias("height"))
