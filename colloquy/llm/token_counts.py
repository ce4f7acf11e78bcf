"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list, its adjacent mergeable pairs a heap ordered by
(rank, position). The lowest pair is popped, merged and its neighbours pushed, until no pair is
left; the count is the initial symbols minus the merges. No token identifiers are produced.

Defined results: null text counts as empty (0 bytes, 0 tokens). Repeated rows give repeated rows.
Other columns of the input are ignored. Texts are never cut: a word of n bytes takes O(n log n).
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, freeing, small_batches

#: Fixed value: the published byte-level word pattern of this vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the other bytes take code points from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeCounter(dict):
    """Tokens of a word (a string of the word pattern), remembered up to a limit."""

    def __init__(self, tokenizer_json: str, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        model = json.loads(tokenizer_json)
        symbol_of = byte_symbols()
        ids: dict[str, int] = {}
        self.symbol = [ids.setdefault(c, len(ids)) for c in symbol_of]
        # (left, right) -> (rank, merged symbol), over small integers
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = ids.setdefault(left, len(ids)), ids.setdefault(right, len(ids))
            self.merges.setdefault((a, b), (rank, ids.setdefault(left + right, len(ids))))
        self.special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.words = regex.compile(WORD_PATTERN).findall

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.merged([self.symbol[b] for b in word.encode()])
        return value

    def merged(self, symbols: list[int]) -> int:
        """Symbols left when the pairs have been merged in order of (rank, position)."""
        n = len(symbols)
        if n < 2:
            return n
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (m := merges.get((a, b)))]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # an earlier merge has taken one of the two
            symbols[i], symbols[j] = new, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, symbols[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((symbols[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], symbols[h], new))
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; a special token's string inside it is one token, as the library has it by default."""
        parts = [text]
        total = 0
        for special in self.special:
            if any(special in p for p in parts):
                pieces = [p.split(special) for p in parts]
                total += sum(len(p) - 1 for p in pieces)
                parts = [x for p in pieces for x in p]
        for part in parts:
            total += sum(map(self.__getitem__, self.words(part)))
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """Bytes and tokens of each row's whole text. The tokenizer's JSON (a few MB, whatever the
    input) is read on the driver and sent along, so executors need no copy of it."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @freeing
    def run(batches: Batches) -> Batches:
        counter = MergeCounter(shared.value)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                n_bytes.append(len(text.encode()))
                n_tokens.append(counter.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
