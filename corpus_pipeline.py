"""The corpus pipeline: stages applied to `documents` one after another, each on all its predecessor kept.

Every stage but the last returns the columns of the documents it was given; its rejections take
effect. Models are learned from the whole tables of the directory, never from a stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, language_id, near_dedup, packing, toxicity
from colloquy.llm.common import fresh, read, written
from colloquy.llm.registry import TOXIC_FROM, language_dictionaries, tokenizer, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold."""
    name = fresh(docs, "toxicity")
    return toxicity.score(docs, toxicity_model(spark, sf_dir), name).where(F.col(name) < TOXIC_FROM).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language was told with a sufficient margin."""
    names = (fresh(docs, "lang_pred"), fresh(docs, "lang_score"), fresh(docs, "lang_rejected"))
    return language_id.identify(docs, language_dictionaries(spark, sf_dir), names).where(~F.col(names[2])).select(*docs.columns)


#: Documents of this similarity in the hundred or more are near-duplicates; op5_near_dedup has a contract of its own.
NEAR_PERCENT = 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near-duplicates."""
    return near_dedup.one_of_each(docs, NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that remain, in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learned models and tokenization can't be said in SQL; the tests hold the exact stages against a brute-force version,
#: and those of learned models against what was planted.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again as the next one's documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
