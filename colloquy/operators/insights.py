"""Insights over the city aggregate: superlatives, ratios, categories, regions, divides.

All of them fold the cells of one aggregation (city, source), which has a few rows for each city
whatever the number of posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..catalog import query
from ..functions import values
from ..plans.scored import with_indicator
from .cities import by_city, by_city_source


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_city(with_indicator(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_city_source(with_indicator(spark, sf_dir))


def best(df: DataFrame, *order: Column) -> DataFrame:
    """The first row in this order, as a top-1 that needs no full sort."""
    return df.orderBy(*order).limit(1)


def totals(rows: DataFrame) -> DataFrame:
    """Posts over all cities and the shares of the indicators; zeros where there are none."""
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*model.INDICATORS, "total"]], F.count("*").alias("cities"))
    return sums.withColumns({f"{i}_share": values.ratio(F.col(i), F.col("total")) for i in model.INDICATORS})


@query("insight_global", "select count(*) as cities, sum(positive)::bigint as positive, sum(neutral)::bigint as neutral, sum(negative)::bigint as negative, sum(total)::bigint as total, round(sum(positive)::double / sum(total), 6) as positive_share, round(sum(negative)::double / sum(total), 6) as negative_share from cities")
def insight_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = totals(cities(spark, sf_dir))
    return rows.select("cities", *model.INDICATORS, "total", F.round("positive_share", 6).alias("positive_share"), F.round("negative_share", 6).alias("negative_share"))


def superlatives(rows: DataFrame) -> DataFrame:
    """Loudest city, and the most positive and negative of those with five posts at least; ties go to more posts, then the name."""
    big = rows.where(F.col("total") >= model.MIN_TOTAL)
    found = [("highest_volume", rows, F.col("total").cast("double")), ("most_positive", big, values.ratio(F.col("positive"), F.col("total"))), ("most_negative", big, values.ratio(F.col("negative"), F.col("total")))]
    out = None
    for kind, df, value in found:
        one = best(df.select(F.lit(kind).alias("kind"), "city", "total", value.alias("value")), F.desc("value"), F.desc("total"), F.asc("city"))
        out = one if out is None else out.unionByName(one)
    return out


def _top_sql(kind: str, value: str, where: str = "total >= 5") -> str:
    return f"(select '{kind}' as kind, city, total, {value} as value from cities where {where} order by {value} desc, total desc, city limit 1)"


_SUPERLATIVES = " union all ".join([_top_sql("highest_volume", "total::double", "true"), _top_sql("most_positive", "positive::double / total"), _top_sql("most_negative", "negative::double / total")])


@query("insight_superlatives", f"select kind, city, total, round(value, 6) as value from ({_SUPERLATIVES})")
def insight_superlatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superlatives(cities(spark, sf_dir)).withColumn("value", F.round("value", 6))


def ratio_extremes(rows: DataFrame) -> DataFrame:
    """Cities with the highest and lowest smoothed ratio of positive to negative; none if fewer than two qualify."""
    big = rows.where(F.col("total") >= model.MIN_TOTAL).select("city", "total", ((F.col("positive") + 1) / (F.col("negative") + 1)).alias("ratio"))
    enough = F.broadcast(big.agg(F.count("*").alias("n")).where("n >= 2"))
    high = best(big.withColumn("kind", F.lit("highest")), F.desc("ratio"), F.desc("total"), F.asc("city"))
    low = best(big.withColumn("kind", F.lit("lowest")), F.asc("ratio"), F.desc("total"), F.asc("city"))
    return high.unionByName(low).join(enough, how="left_semi").select("kind", "city", "ratio")


_RATIO = "(positive + 1)::double / (negative + 1)"


@query("insight_ratio_extremes", f"select kind, city, round(ratio, 6) as ratio from ((select 'highest' as kind, city, {_RATIO} as ratio from cities where total >= 5 order by {_RATIO} desc, total desc, city limit 1) union all (select 'lowest', city, {_RATIO} from cities where total >= 5 order by {_RATIO}, total desc, city limit 1))")
def insight_ratio_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratio_extremes(cities(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


def dominant_categories(found: DataFrame) -> DataFrame:
    """The category with the most posts in each city, and over all ('*'), with its share; ties to the first in the alphabet."""
    n = found.groupBy("city", "category").agg(F.sum("total").alias("n"))
    everywhere = n.groupBy("category").agg(F.sum("n").alias("n")).withColumn("city", F.lit("*"))
    rows = n.unionByName(everywhere)
    top = rows.groupBy("city").agg(F.min(F.struct((-F.col("n")).alias("k"), "category")).alias("m"), F.sum("n").alias("all"))
    return top.select("city", F.col("m.category").alias("category"), values.ratio(-F.col("m.k"), F.col("all")).alias("share"))


@query("insight_dominant_category", "select city, category, round(n::double / alln, 6) as share from (select city, category, n, sum(n) over (partition by city) as alln, row_number() over (partition by city order by n desc, category) as rn from (select city, category, sum(total) as n from city_sources group by 1, 2 union all select '*', category, sum(total) from city_sources group by 2)) where rn = 1")
def insight_dominant_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_categories(cells(spark, sf_dir)).withColumn("share", F.round("share", 6))


def source_concentration(found: DataFrame) -> DataFrame:
    """The largest share that one source has of a city of five posts at least; ties by city, then source."""
    whole = found.groupBy("city").agg(F.sum("total").alias("whole")).where(F.col("whole") >= model.MIN_TOTAL)
    rows = found.join(whole, "city").select("city", "source_name", "category", F.least(F.lit(1.0), F.col("total") / F.col("whole")).alias("pct"))
    return best(rows, F.desc("pct"), F.asc("city"), F.asc("source_name"))


@query("insight_source_concentration", "select city, source_name, category, round(pct, 6) as pct from (select city, source_name, category, total::double / sum(total) over (partition by city) as pct, sum(total) over (partition by city) as whole from city_sources) where whole >= 5 order by pct desc, city, source_name limit 1")
def insight_source_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_concentration(cells(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


def regions(rows: DataFrame) -> DataFrame:
    """Posts by region of placed cities, and which region leads (the first of the list on a tie)."""
    names = ["Americas", "Europe-Africa", "Asia-Pacific"]
    spark = rows.sparkSession
    n = rows.where("lng is not null").groupBy(values.region(F.col("lng")).alias("region")).agg(F.sum("total").alias("total"))
    full = spark.createDataFrame(list(enumerate(names)), "place int, region string").join(n, "region", "left").select("place", "region", F.coalesce("total", F.lit(0)).alias("total"))
    lead = full.agg(F.min(F.struct((-F.col("total")).alias("k"), "place")).alias("m"))
    return full.join(F.broadcast(lead)).select("region", "total", ((F.col("place") == F.col("m.place")) & (F.col("total") > 0)).alias("leads"))


@query("regional_dominance", "select region, total, row_number() over (order by total desc, place) = 1 and total > 0 as leads from (select region, place, coalesce(sum(total), 0)::bigint as total from (values ('Americas', 0), ('Europe-Africa', 1), ('Asia-Pacific', 2)) r(region, place) left join (select total, case when lng < -30 then 'Americas' when lng < 60 then 'Europe-Africa' else 'Asia-Pacific' end as region from cities join places using (city)) c using (region) group by 1, 2)")
def regional_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(cities(spark, sf_dir))


@query("insight_extremes_delta", "select round((select max(positive::double / total) from cities where total >= 5) - sum(positive)::double / sum(total), 6) as positive_delta, round((select max(negative::double / total) from cities where total >= 5) - sum(negative)::double / sum(total), 6) as negative_delta from cities")
def insight_extremes_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the extreme cities' shares lie from those over all."""
    big = F.col("total") >= model.MIN_TOTAL

    def delta(i: str) -> Column:
        return F.round(F.max(F.when(big, values.ratio(F.col(i), F.col("total")))) - values.ratio(F.sum(i), F.sum("total")), 6).alias(f"{i}_delta")

    return cities(spark, sf_dir).agg(delta("positive"), delta("negative"))


def breakdown(found: DataFrame) -> DataFrame:
    """Share and net sentiment of each category in each city."""
    n = found.groupBy("city", "category").agg(*[F.sum(c).alias(c) for c in [*model.INDICATORS, "total"]])
    whole = n.groupBy("city").agg(F.sum("total").alias("whole"))
    return n.join(whole, "city").select("city", "category", values.ratio(F.col("total"), F.col("whole")).alias("share"), values.net().alias("net"), "whole")


_BREAKDOWN = "(select city, category, sum(total)::double / sum(sum(total)) over (partition by city) as share, (sum(positive) - sum(negative))::double / sum(total) as net, sum(sum(total)) over (partition by city) as whole from city_sources group by 1, 2)"


@query("city_category_breakdown", f"select city, category, round(share, 6) as share, round(net, 6) as net from {_BREAKDOWN}")
def city_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(cells(spark, sf_dir)).select("city", "category", F.round("share", 6).alias("share"), F.round("net", 6).alias("net"))


def widest_divide(found: DataFrame) -> DataFrame:
    """The city whose categories (8 % of its posts at least, two of them) differ most in net sentiment.

    Equal nets go to the category with the larger share, then the alphabet; equal spans to more posts, then the name.
    """
    rows = breakdown(found).where((F.col("whole") >= model.MIN_TOTAL) & (F.col("share") >= model.DIVIDE_MIN_SHARE))
    ends = rows.groupBy("city", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("net")).alias("k"), (-F.col("share")).alias("s"), "category")).alias("hi"), F.min(F.struct(F.col("net").alias("k"), (-F.col("share")).alias("s"), "category")).alias("lo")
    )
    spans = ends.where("n >= 2").select("city", "whole", F.col("hi.category").alias("hi_category"), (-F.col("hi.k")).alias("hi_net"), F.col("lo.category").alias("lo_category"), F.col("lo.k").alias("lo_net"))
    return best(spans.withColumn("span", F.col("hi_net") - F.col("lo_net")), F.desc("span"), F.desc("whole"), F.asc("city"))


@query(
    "widest_category_divide",
    f"select city, hi_category, round(hi_net, 6) as hi_net, lo_category, round(lo_net, 6) as lo_net, round(hi_net - lo_net, 6) as span from (select city, whole, arg_min(category, (-net, -share, category)) as hi_category, max(net) as hi_net, arg_min(category, (net, -share, category)) as lo_category, min(net) as lo_net "
    f"from {_BREAKDOWN} where whole >= 5 and share >= 0.08 group by 1, 2 having count(*) >= 2) order by hi_net - lo_net desc, whole desc, city limit 1",
)
def widest_category_divide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = widest_divide(cells(spark, sf_dir))
    return rows.select("city", "hi_category", F.round("hi_net", 6).alias("hi_net"), "lo_category", F.round("lo_net", 6).alias("lo_net"), F.round("span", 6).alias("span"))


def ribbon(found: DataFrame) -> DataFrame:
    """Each category over all cities: share, volume, net, split and the source with the most posts (ties to the alphabet)."""
    by_source = found.groupBy("category", "source_name").agg(*[F.sum(c).alias(c) for c in [*model.INDICATORS, "total"]])
    rows = by_source.groupBy("category").agg(*[F.sum(c).alias(c) for c in [*model.INDICATORS, "total"]], F.min(F.struct((-F.col("total")).alias("k"), "source_name")).alias("top"))
    whole = rows.agg(F.sum("total").alias("whole"))
    return rows.join(F.broadcast(whole)).select(
        "category", values.ratio(F.col("total"), F.col("whole")).alias("share"), F.col("total").alias("volume"), values.net().alias("net"),
        *[values.ratio(F.col(i), F.col("total")).alias(f"{i}_share") for i in model.INDICATORS], F.col("top.source_name").alias("top_source"),
    )


_RIBBON = "(select category, sum(total)::double / sum(sum(total)) over () as share, sum(total)::bigint as volume, (sum(positive) - sum(negative))::double / sum(total) as net, sum(positive)::double / sum(total) as positive_share, sum(neutral)::double / sum(total) as neutral_share, sum(negative)::double / sum(total) as negative_share, arg_min(source_name, (-total, source_name)) as top_source from (select category, source_name, sum(positive) as positive, sum(neutral) as neutral, sum(negative) as negative, sum(total)::bigint as total from city_sources group by 1, 2) group by 1)"


@query("category_ribbon", f"select category, round(share, 6) as share, volume, round(net, 6) as net, round(positive_share, 6) as positive_share, round(neutral_share, 6) as neutral_share, round(negative_share, 6) as negative_share, top_source from {_RIBBON}")
def category_ribbon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ribbon(cells(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 6) for c in ("share", "net", "positive_share", "neutral_share", "negative_share")})


@query("messenger_gap", f"select arg_min(category, (-net, category)) as hi_category, arg_min(top_source, (-net, category)) as hi_source, arg_max(category, (-net, category)) as lo_category, arg_max(top_source, (-net, category)) as lo_source, round(max(net) - min(net), 6) as gap from {_RIBBON} having count(*) >= 2")
def messenger_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The warmest and coldest categories with their leading sources, and the gap between them."""
    rows = ribbon(cells(spark, sf_dir)).withColumn("at", F.struct((-F.col("net")).alias("k"), "category"))
    ends = rows.agg(F.min_by(F.struct("category", "top_source", "net"), "at").alias("hi"), F.max_by(F.struct("category", "top_source", "net"), "at").alias("lo"), F.count("*").alias("n")).where("n >= 2")
    return ends.select(F.col("hi.category").alias("hi_category"), F.col("hi.top_source").alias("hi_source"), F.col("lo.category").alias("lo_category"), F.col("lo.top_source").alias("lo_source"), F.round(F.col("hi.net") - F.col("lo.net"), 6).alias("gap"))
