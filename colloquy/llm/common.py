"""What the operators of this subpackage share: reading, folds, shared storage, word hashing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written  # noqa: F401  for the operators

#: Rows and bytes of whole documents handed to Python at once, whichever is reached first; texts may be long.
ARROW_ROWS, ARROW_BYTES = 500, 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table, through Spark's own reader (any store that Spark can open)."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch of texts holds in a Python worker. All operators set the same values, so their order does not matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


Batches = Iterator[pa.RecordBatch]


def freeing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """`run` with its memory given back to the system when the task ends; workers are used again and would keep it."""

    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores behind it: one that no column of `df` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """Where the column stands, as Spark resolves its name: in any case, the exact one first."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, as bytes; bytes.lower and bytes.split do just that."""
    return text.lower().split() if text else []


def share_below(key: Column, share: Column) -> Column:
    """True for about `share` (0 to 1) of the values of `key`, chosen by their hash: the same ones on every run."""
    return F.pmod(F.xxhash64(F.lit(2_024), key), F.lit(1_000_000_007)) < share * 1_000_000_007


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each position in a window of words.
STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def windows(hashes: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at `offsets` from each start at which all of them exist."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, len(offsets) * 1_000_003 + sum(offsets), np.uint64)  # the same words further apart differ
    for step, at in zip(STEPS, offsets, strict=False):
        total = mixed(total + hashes[at : at + n] * np.uint64(step))
    return total
