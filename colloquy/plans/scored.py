"""Posts with their scores: the base of most queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.text import with_dqi, with_relevance, with_sentiment
from ..sources.tables import posts


def with_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with sentiment alone; the content is dropped by pruning where a query doesn't ask for it."""
    return with_sentiment(posts(spark, sf_dir))


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with sentiment, relevance and deliberative quality, in one pass."""
    return with_dqi(with_relevance(with_sentiment(posts(spark, sf_dir))))


def counts() -> list[Column]:
    """Posts of each indicator and altogether, as one aggregation."""
    return [F.count_if(F.col("indicator") == i).alias(i) for i in model.INDICATORS] + [F.count("*").alias("total")]
