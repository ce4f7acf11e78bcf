"""Row-wise text operators as column expressions: nothing shuffles, everything stays in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model

#: Characters that the tokenizer removes.
PUNCTUATION = ".,;:!?\"()[]{}#&%$*|/<>@+="
BLANKS = " \t\n\r"


def trimmed(text: Column) -> Column:
    """Text without white space at its ends; null is empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def one_spaced(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, r"\s+", " ")


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; empty for blank text."""
    bare = F.btrim(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), F.lit(BLANKS))
    # blank text splits into one empty word, which no other text has; a condition would compute `bare` twice
    return F.array_remove(F.split(bare, "[ \t\n\r]+"), "")


def has_tokens(text: Column) -> Column:
    """Whether `tokens` would find a word, without splitting the text; false for null."""
    return F.coalesce(text.rlike("[^" + re.escape(PUNCTUATION + BLANKS) + "]"), F.lit(False))


def word_count(text: Column) -> Column:
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"\s+")))


def with_sentiment(df: DataFrame, lexicon: dict[str, int] | None = None, text: str = "content") -> DataFrame:
    """Adds score, comparative, indicator, positive_words, negative_words and token_count.

    The distinct words that a text shares with the lexicon come from a hash intersection; only
    those few are then looked for among its tokens, so the cost does not grow with the lexicon.
    """
    lexicon = lexicon or model.LEXICON
    valence = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    found = df.withColumn("_tokens", tokens(F.col(text))).withColumn("_hits", F.array_intersect("_tokens", F.array(*map(F.lit, lexicon))))
    found = found.withColumn("_own", F.when(F.size("_hits") == 0, F.array().cast("array<string>")).otherwise(F.filter("_tokens", lambda t: F.array_contains(F.col("_hits"), t))))
    found = found.withColumn("score", F.aggregate("_own", F.lit(0), lambda s, t: s + F.element_at(valence, t)).cast("bigint"))
    found = found.withColumn("token_count", F.size("_tokens").cast("bigint"))
    found = found.withColumn("comparative", F.coalesce(F.try_divide(F.col("score").cast("double"), F.col("token_count").cast("double")), F.lit(0.0)))
    return (
        found.withColumn("indicator", indicator(F.col("comparative")))
        .withColumn("positive_words", F.filter("_own", lambda t: F.element_at(valence, t) > 0))
        .withColumn("negative_words", F.filter("_own", lambda t: F.element_at(valence, t) < 0))
        .drop("_tokens", "_hits", "_own")
    )


def indicator(comparative: Column) -> Column:
    """Label of a comparative score; both thresholds are strict."""
    return F.when(comparative > model.POSITIVE_ABOVE, "positive").when(comparative < model.NEGATIVE_BELOW, "negative").otherwise("neutral")


def contained(low: Column, markers: list[str]) -> Column:
    """Markers that occur as substrings, in their own order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers]))


def hits(low: Column, markers: list[str]) -> Column:
    """How many of the markers occur as substrings."""
    total = F.lit(0)
    for m in markers:
        total = total + F.contains(low, F.lit(m)).cast("int")
    return total


def with_relevance(df: DataFrame, keywords: list[str] | None = None, weight: float | None = None, above: float = 0.0, text: str = "content") -> DataFrame:
    """Adds relevance (0 to 1), matched_keywords and is_relevant (relevance > `above`); each match weighs 1/keywords unless told otherwise."""
    keywords = keywords or model.RELEVANCE_KEYWORDS
    # the lower case text is bound once: as a column it would be repeated for each keyword where a filter on the result moves below it
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = df.withColumn("matched_keywords", F.element_at(F.transform(F.array(low), lambda t: contained(t, keywords)), 1))
    n = F.size("matched_keywords")
    share = n / F.lit(len(keywords)) if weight is None else n * F.lit(weight)
    return found.withColumn("relevance", F.least(share.cast("double"), F.lit(1.0))).withColumn("is_relevant", F.col("relevance") > above)


def with_dqi(df: DataFrame, weights: dict[str, float] | None = None, text: str = "content") -> DataFrame:
    """Adds the five dimensions of deliberative quality and dqi_total, their (weighted) mean; blank text scores 0 throughout."""
    low = F.col("_low")
    found = df.withColumn("_low", F.lower(trimmed(F.col(text)))).withColumn("_words", word_count(F.col(text)))
    markers = {"_reasons": model.JUSTIFICATION_MARKERS, "_hostile": model.HOSTILE_MARKERS, "_proposals": model.CONSTRUCTIVE_MARKERS, "_sources": model.EVIDENCE_MARKERS}
    found = found.withColumns({name: hits(low, own) for name, own in markers.items()})  # each text is searched once for each marker

    def steps(count: Column, full: int) -> Column:
        return F.when(count >= full, 1.0).when(count >= 1, 0.5).otherwise(0.0)

    scores = {
        "participation": F.when(F.col("_words") >= model.WORDS_FULL, 1.0).when(F.col("_words") >= model.WORDS_PARTIAL, 0.5).otherwise(0.0),
        "justification": steps(F.col("_reasons"), 2),
        "respectfulness": F.when(F.col("_words") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_hostile") * F.lit(0.25))),
        "constructiveness": steps(F.col("_proposals"), 3),
        "evidence": steps(F.col("_sources"), 2),
    }
    found = found.withColumns({name: score.cast("double") for name, score in scores.items()}).drop("_low", "_words", *markers)
    weights = weights or dict.fromkeys(model.DIMENSIONS, 1 / len(model.DIMENSIONS))
    if len(set(weights.values())) == 1:
        total = (F.col("participation") + F.col("justification") + F.col("respectfulness") + F.col("constructiveness") + F.col("evidence")) / len(model.DIMENSIONS)
    else:
        total = sum((F.col(d) * F.lit(w) for d, w in weights.items()), F.lit(0.0))
    return found.withColumn("dqi_total", total)
