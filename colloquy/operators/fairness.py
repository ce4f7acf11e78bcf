"""Counterfactual fairness: an exact daily sample, scored again with one marker of a group exchanged for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..functions.text import PUNCTUATION, with_sentiment
from ..plans.oracle import _VALENCE
from ..sources.tables import posts

#: A difference of scores above this is flagged for review; this share of each day's posts is looked at.
GAP, SHARE_PERCENT = 0.05, 5
#: Markers and what they are exchanged for: known cities of different continents.
EXCHANGED = {"London": "Lagos", "Lagos": "London", "Tokyo": "Nairobi", "Nairobi": "Tokyo", "Austin": "Mumbai", "Mumbai": "Austin", "Berlin": "Cairo", "Cairo": "Berlin", "San Francisco": "Jakarta", "Jakarta": "San Francisco"}


def id_hash(column: str) -> Column:
    """32 bits of an id's digest, the same in every engine."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long")


def daily_sample(rows: DataFrame, at: str, key: str, percent: int = SHARE_PERCENT, bins: int = 4096) -> DataFrame:
    """Of each day the rows with the smallest hashes, exactly `percent` of the day's rows, rounded up. Ties go to the smaller
    `key`; rows without a time or key are in no day; which of two repeated rows at the edge is taken makes no difference.

    No day is sorted: rows are counted by day and by bins of the hash, the bin in which a day's quota is used up
    follows from these counts, and only the rows of that one bin, of some 4096, are ranked.
    """
    dated = rows.where(F.col(at).isNotNull() & F.col(key).isNotNull()).withColumns({"_day": F.to_date(at), "_hash": id_hash(key)})
    dated = dated.withColumn("_bin", F.shiftright("_hash", 32 - (bins - 1).bit_length()).cast("int"))
    counts = dated.groupBy("_day", "_bin").agg(F.count("*").alias("_n"))
    day = Window.partitionBy("_day")
    counts = counts.withColumn("_quota", F.expr(f"(sum(_n) over (partition by _day) * {percent} + 99) div 100")).withColumn("_before", F.sum("_n").over(day.orderBy("_bin")) - F.col("_n"))
    counts = counts.where("_before < _quota").withColumn("_edge", F.col("_before") + F.col("_n") > F.col("_quota")).select("_day", "_bin", "_edge", (F.col("_quota") - F.col("_before")).alias("_left"))
    taken = dated.join(counts, ["_day", "_bin"])
    ranked = taken.where("_edge").withColumn("_rank", F.row_number().over(Window.partitionBy("_day", "_bin").orderBy("_hash", key))).where("_rank <= _left")
    return taken.where("not _edge").select(*rows.columns).unionByName(ranked.select(*rows.columns))


def minimal_pairs(rows: DataFrame, pairs: dict[str, str] | None = None, text: str = "content") -> DataFrame:
    """One row for each marker that a text holds as a word: `marker`, `partner` and `exchanged`, the text with every occurrence
    of the marker replaced. Texts without markers, null ones included, have no rows."""
    pairs = EXCHANGED if pairs is None else pairs
    t = F.col(text)
    options = [F.when(t.rlike(rf"\b{m}\b"), F.struct(F.lit(m).alias("marker"), F.lit(p).alias("partner"), F.regexp_replace(t, rf"\b{m}\b", p).alias("exchanged"))) for m, p in pairs.items()]
    return rows.select("*", F.explode(F.array_compact(F.array(*options))).alias("_pair")).select(*rows.columns, "_pair.*")


def counterfactual(rows: DataFrame, at: str = "collected_at", key: str = "post_id", lexicon: dict[str, int] | None = None, pairs: dict[str, str] | None = None) -> DataFrame:
    """The daily sample's minimal pairs with both scores, their gap, and whether it is flagged."""
    sample = minimal_pairs(daily_sample(rows.select(key, at, "content"), at, key), pairs)
    first = with_sentiment(sample, lexicon).select(key, at, "marker", "partner", "exchanged", F.col("comparative").alias("as_written"), F.col("indicator").alias("indicator_as_written"))
    again = with_sentiment(first, lexicon, "exchanged").withColumn("gap", F.abs(F.col("as_written") - F.col("comparative")))
    return again.select(key, at, "marker", "partner", "as_written", F.col("comparative").alias("exchanged"), "indicator_as_written", F.col("indicator").alias("indicator_exchanged"), "gap", (F.col("gap") > GAP).alias("flagged"))


_SAMPLE = "select * from (select *, row_number() over (partition by collected_at::date order by h, post_id) as r, count(*) over (partition by collected_at::date) as n from (select post_id, collected_at, %s as content, ('0x' || md5(post_id::varchar)[:8])::bigint as h from posts)) where r <= (n * 5 + 99) // 100"
_BYLINE = "case when location = '' then content else location || ': ' || content end"
_PAIRS = "(values " + ", ".join(f"('{m}', '{p}')" for m, p in EXCHANGED.items()) + ") m(marker, partner)"


def _scored_sql(text: str) -> str:
    """The comparative score of a text in SQL, for each post and marker."""
    bare = f"trim(translate(lower({text}), '{PUNCTUATION}', ''), E' \\t\\n\\r')"
    return f"select post_id, marker, case when len(toks) = 0 then 0.0::double else ({_VALENCE})::double / len(toks) end as comparative from (select *, case when {bare} = '' then [] else string_split_regex({bare}, '[ \\t\\n\\r]+') end as toks from pairs)"


@query("daily_sample", _SAMPLE.replace("select *", "select post_id, collected_at::date as day", 1) % "content")
def daily_sample_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself: five in the hundred of each day, exactly."""
    return daily_sample(posts(spark, sf_dir).select("post_id", "collected_at"), "collected_at", "post_id").select("post_id", F.to_date("collected_at").alias("day"))


@query(
    "bias_counterfactual",
    f"select * from (with pairs as (select post_id, marker, partner, content, regexp_replace(content, '\\b' || marker || '\\b', partner, 'g') as exchanged from ({_SAMPLE % _BYLINE}) join {_PAIRS} on regexp_matches(content, '\\b' || marker || '\\b')), "
    f"one as ({_scored_sql('content')}), two as ({_scored_sql('exchanged')}) select post_id, marker, partner, round(one.comparative, 9) as as_written, round(two.comparative, 9) as exchanged, abs(one.comparative - two.comparative) > {GAP} as flagged from pairs join one using (post_id, marker) join two using (post_id, marker))",
)
def bias_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the daily sample, bylines before their texts, with the city exchanged."""
    byline = F.when(F.col("location") == "", F.col("content")).otherwise(F.concat("location", F.lit(": "), "content"))
    found = counterfactual(posts(spark, sf_dir).withColumn("content", byline))
    return found.select("post_id", "marker", "partner", F.round("as_written", 9).alias("as_written"), F.round("exchanged", 9).alias("exchanged"), "flagged")
