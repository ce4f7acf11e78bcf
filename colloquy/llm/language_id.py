"""Language identification by compression with per-language zstandard dictionaries.

For each language a raw-content dictionary is filled with sampled training text. A text, reduced to
lower-case letters and single spaces, is compressed in pieces of a few thousand characters with each
language's dictionary; the language with the smallest total wins. When the two smallest totals are
close, as in very short texts, the sizes under further dictionaries of each language, filled with
other training text, are added. The decision is rejected when the relative margin stays narrow.

The dictionaries hold a bounded sample: about `docs_per_language` documents of each language, chosen
by a hash of their ids, are cut whole into pieces of `SAMPLE_PIECE` characters; the pieces with the
smallest hashes fill the dictionaries, so that no place in a text is preferred. A dictionary has
`DICTIONARY_BYTES`, or less where all of them together would exceed `TOTAL_BYTES`. Every whole text is scored.

Defined results: a text that is null or has no letter is `und` with score 0 and rejected, as is
everything where no language was learned. Rows whose lang is null teach nothing. Repeated rows are
judged row by row; ties go to the language first in alphabetical order. Other columns are carried
along; those that have the names of the results are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, freeing, place_of, share_below, small_batches

UNKNOWN = "und"
#: Bytes of each dictionary, dictionaries of each language, characters compressed at once.
DICTIONARY_BYTES, DICTIONARIES, PIECE = 48 * 1024, 4, 4096
#: Characters of a piece of sampled text; bytes of all dictionaries together.
SAMPLE_PIECE, TOTAL_BYTES = 1024, 64 << 20
#: Margins below `CLOSE` call for the further dictionaries; below `NARROW` the text is rejected.
CLOSE, NARROW = 0.10, 0.01

NOT_LETTERS = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> str:
    """Lower-case words of letters; empty if there is no letter."""
    words = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return words if words and any(map(str.isalpha, words)) else ""


class Compressors:
    """One compressor for each dictionary of each language."""

    PARAMETERS = zstandard.ZstdCompressionParameters.from_level(6, min_match=4, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def __init__(self, contents: dict[str, list[bytes]]):
        self.languages = sorted(contents)
        self.by_language = [[self._compressor(c) for c in contents[lang]] for lang in self.languages]

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=self.PARAMETERS)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=self.PARAMETERS)

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language and the relative margin by which it won."""
        words = normal(text)
        if not words or not self.languages:
            return UNKNOWN, 0.0
        pieces = [words[i : i + PIECE].encode() for i in range(0, len(words), PIECE)]
        sizes = [sum(len(own[0].compress(p)) for p in pieces) for own in self.by_language]
        best, margin = self._margin(sizes)
        if margin < CLOSE:
            sizes = [n + sum(len(c.compress(p)) for c in own[1:] for p in pieces) for n, own in zip(sizes, self.by_language, strict=True)]
            best, margin = self._margin(sizes)
        return self.languages[best], margin

    @staticmethod
    def _margin(sizes: list[int]) -> tuple[int, float]:
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return order[0], 1.0
        first, second = sizes[order[0]], sizes[order[1]]
        return order[0], (second - first) / second


def train(docs: DataFrame, learn: Column, docs_per_language: int = 160) -> dict[str, list[bytes]]:
    """Dictionary contents by language, from documents for which `learn` holds."""
    small_batches(docs.sparkSession)
    docs = docs.where("lang is not null and doc_id is not null").where(learn)
    counts = docs.groupBy("lang").agg(F.count("*").alias("of_lang"))
    languages = counts.count()
    if not languages:
        return {}
    each = min(DICTIONARY_BYTES, TOTAL_BYTES // (languages * DICTIONARIES))
    shares = counts.select(F.col("lang").alias("of"), F.least(F.lit(1.0), docs_per_language / F.col("of_lang")).alias("share"))
    # a row for each language, whose dictionaries the driver holds as well
    chosen = docs.join(F.broadcast(shares), F.col("lang") == F.col("of")).where(share_below(F.col("doc_id"), F.col("share")))

    @freeing
    def cut(batches: Batches) -> Batches:
        for batch in batches:
            langs, pieces = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normal(text)
                own = [words[i : i + SAMPLE_PIECE] for i in range(0, len(words), SAMPLE_PIECE)]
                langs += [lang] * len(own)
                pieces += own
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(pieces, pa.string())], ["lang", "piece"])

    pieces = chosen.select("lang", "text").mapInArrow(cut, "lang string, piece string").distinct()
    # enough pieces to fill every dictionary, short ones included
    most = -(-4 * DICTIONARIES * each // SAMPLE_PIECE)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece"))
    kept = pieces.withColumn("k", rank).where(F.col("k") <= most).orderBy("lang", "k").toLocalIterator()  # bounded: languages x sample
    own: dict[str, list[bytes]] = {}
    for r in kept:
        own.setdefault(r["lang"], []).append(r["piece"].encode())
    contents: dict[str, list[bytes]] = {}
    for lang, sampled in own.items():
        filled = [b" ".join(sampled[i::DICTIONARIES])[:each] for i in range(min(DICTIONARIES, len(sampled)))]
        contents[lang] = (filled * DICTIONARIES)[:DICTIONARIES]
    return contents


def identify(docs: DataFrame, contents: dict[str, list[bytes]], names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_rejected")) -> DataFrame:
    """`docs` with the predicted language, its score (0 to 1) and whether the decision is rejected, under `names`.
    The dictionaries, bounded by their total size, are broadcast."""
    spark = docs.sparkSession
    docs = docs.drop(*names)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(contents)
    place = place_of(docs, "text")

    @freeing
    def run(batches: Batches) -> Batches:
        compressors = Compressors(shared.value)
        for batch in batches:
            found = [compressors.judge(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] / (x[1] + 0.02) if x[1] > 0 else 0.0 for x in found], pa.float64()), pa.array([x[0] == UNKNOWN or x[1] < NARROW for x in found], pa.bool_())],
                [*batch.schema.names, *names],
            )

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))
