"""Questions over any range of time, from exact posts inside the hot window and mergeable rollups before it.

A monthly rollup keeps, for each category, counts and two sketches that merge without loss: HyperLogLog
registers of the distinct texts, and a histogram of the comparative score in bins of `BIN`. A range takes
whole months of rollups and single posts; posts pass through the same sketches, so both tiers meet in one
aggregate whose rows are bounded by categories and bins, not by posts.

Error bounds: totals are exact. A quantile is off by `BIN / 2` at most (the middle of the bin that holds it).
Distinct texts have a relative standard error of 1.04 / sqrt(2^`LOG_K`), 1.6 per cent; small numbers are exact.

Rollup months that only partly lie in the range are left out, and the coverage columns say from when to when
each tier answers. Posts without time are ignored; an empty range gives no row. Null categories are a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..plans.scored import with_indicator
from .retention import CUTOFF_SQL, TODAY, cutoff, month

#: Width of a bin of the comparative score, and the base-2 logarithm of the number of registers.
BIN, LOG_K = 0.01, 12
QUANTILES = (0.1, 0.5, 0.9)


def _bin(score: Column) -> Column:
    return F.floor(score / BIN).cast("int")


def _sketched(keyed: DataFrame, *keys: str) -> DataFrame:
    """Counts, registers and bins of posts by the keys."""
    bins = keyed.groupBy(*keys, _bin(F.col("comparative")).alias("bin")).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.sha2("content", 256), F.lit(LOG_K)).alias("texts"))
    return bins.groupBy(*keys).agg(F.sum("n").alias("total"), F.hll_union_agg("texts").alias("texts"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("bins"))


def sketch_rollup(rows: DataFrame) -> DataFrame:
    """month, category, total, texts (registers) and bins of posts with content, category, collected_at and comparative."""
    return _sketched(rows.where("collected_at is not null").select(month().alias("month"), "category", "content", F.coalesce("comparative", F.lit(0.0)).alias("comparative")), "month", "category")


def ranged(rollups: DataFrame, posts: DataFrame, start: str, end: str, hot_from: Column) -> DataFrame:
    """One row for each category over the days from `start` to `end`, both included, with the coverage of both tiers."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    cold = rollups.where((F.col("month") >= first) & (F.last_day("month") <= last))
    cold = cold.select("category", F.lit("rollup").alias("tier"), F.col("month").alias("low"), F.last_day("month").alias("high"), "total", "texts", "bins")
    day = F.col("collected_at").cast("date")
    hot = posts.where((day >= first) & (day <= last) & (day >= hot_from)).select("category", day.alias("day"), "content", F.coalesce("comparative", F.lit(0.0)).alias("comparative"))
    hot = _sketched(hot, "category", "day").select("category", F.lit("detail").alias("tier"), F.col("day").alias("low"), F.col("day").alias("high"), "total", "texts", "bins")
    both = cold.unionByName(hot)

    def within(tier: str, value: str, pick) -> Column:
        return pick(F.when(F.col("tier") == tier, F.col(value)))

    whole = both.groupBy("category").agg(
        F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("texts")).alias("distinct_texts"),
        F.coalesce(F.sum(F.when(F.col("tier") == "rollup", F.col("total"))), F.lit(0)).alias("from_rollups"),
        within("detail", "low", F.min).alias("detail_from"), within("detail", "high", F.max).alias("detail_to"), within("rollup", "low", F.min).alias("rollup_from"), within("rollup", "high", F.max).alias("rollup_to"),
    )
    bins = both.select("category", F.explode("bins").alias("bin", "n")).groupBy("category", "bin").agg(F.sum("n").alias("n"))
    upto, all_ = Window.partitionBy("category").orderBy("bin"), Window.partitionBy("category")
    placed = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("of", F.sum("n").over(all_))
    of_quantile = [F.round((F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("of")), F.col("bin"))) + 0.5) * BIN, 6).alias(f"p{round(100 * q)}") for q in QUANTILES]
    quantiles = placed.groupBy("category").agg(*of_quantile).withColumnRenamed("category", "_category")
    return whole.join(quantiles, F.col("category").eqNullSafe(F.col("_category"))).drop("_category")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last half year before TODAY: rollups of whole months that ended before the hot window, posts inside it."""
    rows = with_indicator(spark, sf_dir)
    before = rows.where(F.col("collected_at") < F.trunc(cutoff(TODAY), "month"))
    hot = F.trunc(cutoff(TODAY), "month").cast("date")
    return ranged(sketch_rollup(before), rows, "2024-01-01", TODAY, hot)


_BINNED = f"""select category, collected_at::date as day, date_trunc('month', {CUTOFF_SQL})::date as hot, floor(comparative / {BIN}::double)::int as bin from sentiment"""


@query(
    "tiered_range",
    f"""select category, count(*) as total, count(*) filter (day < hot) as from_rollups, min(day) filter (day >= hot) as detail_from, max(day) filter (day >= hot) as detail_to,
        min(date_trunc('month', day)::date) filter (day < hot) as rollup_from, last_day(max(day) filter (day < hot)) as rollup_to,
        round((quantile_disc(bin, 0.1) + 0.5) * {BIN}, 6)::double as p10, round((quantile_disc(bin, 0.5) + 0.5) * {BIN}, 6)::double as p50, round((quantile_disc(bin, 0.9) + 0.5) * {BIN}, 6)::double as p90
        from ({_BINNED}) where day between '2024-01-01' and '{TODAY}' group by category""",
)
def tiered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, quantiles of the score, and what each tier covers."""
    return history(spark, sf_dir).drop("distinct_texts")


@query("tiered_distinct_texts")
def tiered_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of each category over both tiers, from merged registers."""
    return history(spark, sf_dir).select("category", "total", "distinct_texts")
