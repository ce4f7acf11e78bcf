"""Tables of the model: read as they are, or derived from the test tables.

Derivations depend on ids alone, never on the clock, so every engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CATEGORIES, CITY_COORDINATES, SOURCE_TYPES

#: The newest moment of the derived posts, and the moment that queries take as "now".
AS_OF = "2024-07-01 12:00:00"
#: Phrases appended to the invented prose, one for each remainder of the id, so that lexicons match.
PHRASES = [
    "",
    "machine learning is great because research shows progress",
    "we should improve ai safety since the data suggests a risk of harm",
    "this gpt report is terrible and stupid",
    "a large language model and an llm with embeddings could build trust therefore it is useful",
    "the survey and the study published evidence that bert and the transformer help computer vision",
    "I hate this worthless fraud, shut up",
    "deep learning, generative ai and reinforcement learning bring hope; we propose a solution",
    "artificial intelligence natural language processing nlp neural network foundation model fine-tuning diffusion model autonomous agent are good good good",
]
#: Cities that the derived posts come from; the last is not among the known ones.
CITIES = ["London", "Tokyo", "Austin", "Berlin", "San Francisco", "Lagos", "Atlantis"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _at(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _source_number(source: Column) -> Column:
    return F.substring(source, 4, 9).cast("int")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts derived from `documents`; see model.POSTS."""
    d = F.col("doc_id")
    minutes = ((d * 7) % 43_200).cast("int")
    return table(spark, sf_dir, "documents").select(
        d.alias("post_id"),
        F.col("source").alias("source_name"),
        _at(CATEGORIES, _source_number(F.col("source")) % len(CATEGORIES)).alias("category"),
        F.concat(F.lit("ext-"), d.cast("string")).alias("external_id"),
        F.concat_ws(" ", "text", F.nullif(_at(PHRASES, d % len(PHRASES)), F.lit(""))).alias("content"),
        F.when(d % 11 == 0, "").otherwise(_at(CITIES, d % len(CITIES))).alias("location"),
        F.col("lang").alias("language"),
        (F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0.0))).alias("collected_at"),
        (d % 4).alias("job_id"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of sources: one row for each source that the documents name."""
    number = _source_number(F.col("source_name"))
    named = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name")).distinct()
    return named.select(
        "source_name",
        F.concat(F.lit("Source "), number.cast("string")).alias("display_name"),
        _at(SOURCE_TYPES, number % len(SOURCE_TYPES)).alias("source_type"),
        _at(CATEGORIES, number % len(CATEGORIES)).alias("category"),
        (number % 9 != 4).alias("active"),
    )


def coordinates(spark: SparkSession) -> DataFrame:
    """The known cities; a fixed small table, broadcast where it is joined."""
    return spark.createDataFrame([(city, lat, lng) for city, (lat, lng) in CITY_COORDINATES.items()], "location string, lat double, lng double")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post embeddings: any dimension."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), "embedding", "label")
