"""Packing of documents into sequences: first-fit decreasing with a tournament tree of bins.

Documents are dealt at random (by a hash of id, place in the input and a seed) to groups of a
bounded amount of text, and each group is packed for itself. Inside a group a document longer than
a sequence is cut into full pieces and one rest; rests go, longest first, to the first bin that has
room, found in O(log bins) in a tournament tree whose nodes hold the largest room below them. Bins
that stay underfull are then filled by cutting pieces of the last bins, and what remains of the last
one is cut into lengths that are powers of two, which need no padding.

Defined results: null text is empty; every document ends with the separator id and so has one token
at least. Repeated rows and repeated ids are packed as separate documents. An empty table gives no
rows. Other columns are ignored. One text is never split between groups, so memory is bounded by a
group's target or the longest single text.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, freeing, small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters of text for each group, on average.
GROUP_CHARS = 1_000_000
#: A sequence id is its group's number times this, plus its place in the group.
ID_SPACE = 1 << 32


class BinTree:
    """Bins in order of opening; finds the first with enough room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for `size`, which is taken from it."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        at = node - self.leaves
        room[node] -= size
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
        return at


Piece = tuple[int, int, int]  # document, start, length


def pack_group(lengths: list[int], size: int) -> list[list[Piece]]:
    """Sequences, each a list of pieces, that hold every id of documents of these lengths once."""
    full: list[list[Piece]] = []
    rests: list[Piece] = []
    for doc, n in enumerate(lengths):
        cut = n - n % size
        full += [[(doc, start, size)] for start in range(0, cut, size)]
        if n > cut:
            rests.append((doc, cut, n - cut))
    rests.sort(key=lambda p: (-p[2], p[0]))
    tree = BinTree(len(rests), size)
    bins: list[list[Piece]] = []
    for piece in rests:
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    bins = _filled(bins, size)
    if bins and (n := sum(p[2] for p in bins[-1])) < size:
        bins[-1:] = _powers(bins[-1], n)
    return full + bins


def _filled(bins: list[list[Piece]], size: int) -> list[list[Piece]]:
    """Fills bins from the first on with pieces cut from the last, until one at most is underfull."""
    rooms = [size - sum(p[2] for p in b) for b in bins]
    first, last = 0, len(bins) - 1
    while first < last:
        if not rooms[first]:
            first += 1
            continue
        if not bins[last]:
            last -= 1
            continue
        doc, start, n = bins[last].pop()
        take = min(n, rooms[first])
        bins[first].append((doc, start, take))
        rooms[first] -= take
        rooms[last] += take
        if take < n:
            bins[last].append((doc, start + take, n - take))
    return [b for b in bins if b]


def _powers(pieces: list[Piece], n: int) -> list[list[Piece]]:
    """The pieces of an underfull bin in sequences whose lengths are the powers of two that sum to n."""
    out, pending = [], pieces[::-1]
    for bit in range(n.bit_length() - 1, -1, -1):
        room = n & (1 << bit)
        sequence: list[Piece] = []
        while room:
            doc, start, k = pending.pop()
            take = min(k, room)
            sequence.append((doc, start, take))
            room -= take
            if take < k:
                pending.append((doc, start + take, k - take))
        if sequence:
            out.append(sequence)
    return out


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Ids:
    """Token ids of some words, one after another: those of word i are `sizes[i]` ids of `pool` from `starts[i]` on."""

    def __init__(self, pool: np.ndarray, sizes: np.ndarray):
        self.pool, self.sizes, self.starts = pool, sizes, np.cumsum(sizes) - sizes

    def take(self, at: np.ndarray) -> Ids:
        """Those of the words at these places, in this order."""
        sizes = self.sizes[at]
        after = np.cumsum(sizes)
        return Ids(self.pool[np.repeat(self.starts[at] - after + sizes, sizes) + np.arange(sizes.sum())], sizes)

    def summed(self, counts: np.ndarray) -> Ids:
        """Neighbours as one: so many of them each."""
        after = np.concatenate([[0], np.cumsum(self.sizes)])
        ends = np.cumsum(counts)
        return Ids(self.pool, after[ends] - after[ends - counts])

    @classmethod
    def joined(cls, parts: list[Ids]) -> Ids:
        return cls(np.concatenate([p.pool for p in parts]), np.concatenate([p.sizes for p in parts]))


class Encoder:
    """Token ids of texts, a batch at a time, with the ids of words seen remembered up to a limit.

    White space never joins two words of this tokenizer's pattern, so a text's ids are its words'
    ids one after another. A text with special tokens' strings or with unusual white space is
    given to the library as a whole. The other texts of a batch are split together, and each distinct
    word is looked up once, in a memory that is one array of words and one of ids. The tokenizer ignores
    case, so A-Z are lowered before, and it splits letters and digits from marks that follow them, so these
    are parted as well where no composing letter is near. New words of plain letters go to the library's model
    many in a call, which tells the ids of each by its place; other words are given to the library one by one.
    """

    #: Texts for the library.
    ODD = "<[|]|[\\x1c-\\x1f\\x{85}\\x{180e}]"
    #: Latin letters that normalising leaves as they are; one of them, or a digit, ends a piece before marks like these.
    LETTERS = "^[a-zß-öø-ÿ]+$"
    TRAILING = "([a-z0-9ß-öø-ÿ])([.,;:!?#&%$*|)\\]}\"]+)"
    #: Words in one call of the library.
    AT_ONCE = 4_000

    def __init__(self, tokenizer_json: str, limit: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.limit = limit
        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = Tokenizer(self.library.model)  # the same model, for words that are one piece in lower case already
        self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.ids = pa.array([], pa.string()), Ids(np.empty(0, "<u4"), np.empty(0, np.int64))

    def whole(self, text: str) -> bytes:
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return bytes(self.encode_all(pa.array([text], pa.string()))[0])

    def encode_all(self, texts: pa.Array) -> list[bytes | memoryview]:
        """The ids of each of the texts, none of which is null."""
        odd = pc.match_substring_regex(texts, self.ODD)
        parted = pc.replace_substring_regex(pc.ascii_lower(pc.if_else(odd, "", texts)), self.TRAILING, "\\1 \\2")
        split = pc.ascii_split_whitespace(parted)
        words = split.flatten().dictionary_encode()
        found = self._known(words.dictionary).take(words.indices.to_numpy()).summed(split.value_lengths().to_numpy())
        ids, starts = memoryview(found.pool).cast("B"), [*(4 * found.starts).tolist(), 4 * len(found.pool)]
        return [self.whole(texts[i].as_py()) if is_odd else ids[starts[i] : starts[i + 1]] for i, is_odd in enumerate(odd.to_pylist())]

    def _known(self, words: pa.Array) -> Ids:
        """The ids of distinct words, which are remembered from now on."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        if len(self.words) + len(new) > self.limit and len(self.words):
            self.words, self.ids = self.words[:0], Ids(self.ids.pool[:0], self.ids.sizes[:0])
            return self._known(words)
        at = at.fill_null(-1).to_numpy()
        at = np.where(at < 0, len(self.words) - 1 + np.cumsum(at < 0), at)
        if len(new):
            plain = pc.match_substring_regex(new, self.LETTERS)
            own, others = new.filter(plain), new.filter(pc.invert(plain)).to_pylist()
            order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
            place = np.empty(len(new), np.int64)
            place[order] = np.arange(len(new))
            ids = Ids.joined([*(self._letters(own[i : i + self.AT_ONCE]) for i in range(0, len(own), self.AT_ONCE)), self._of_bytes(list(map(self.whole, others)))])
            self.words, self.ids = pa.concat_arrays([self.words, new]), Ids.joined([self.ids, ids.take(place)])
        return self.ids.take(at)

    def _letters(self, words: pa.Array) -> Ids:
        """The ids of words that are one piece of lower-case letters each."""
        found = self.model.encode(" ".join(words.to_pylist()), add_special_tokens=False)
        sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
        return Ids(np.array(found.ids, "<u4"), sizes)

    @staticmethod
    def _of_bytes(values: list[bytes]) -> Ids:
        return Ids(np.frombuffer(b"".join(values), "<u4"), np.array([len(v) // 4 for v in values], np.int64))


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, separator: int = 1, seed: int = 17, group_chars: int = GROUP_CHARS) -> DataFrame:
    """One row per piece of a document: where it starts, its length and CRC, its sequence and offset there.

    A pass over text lengths fixes the number of groups; the texts are then shuffled once, by
    group, and read in order of group as a stream, so a task holds the ids of one group at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    groups = max(1, -(-int(total) // group_chars))
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    end = np.array([separator], "<u4").tobytes()
    names_of = [c.split()[0] for c in SCHEMA.split(", ")]

    def packed(group: int, names: list[int | None], ids: list[bytes]) -> pa.RecordBatch:
        # an order that does not depend on how the rows arrived
        order = sorted(range(len(ids)), key=lambda i: (names[i] is not None, names[i] or 0, zlib.crc32(ids[i]), len(ids[i])))
        lengths = [len(ids[i]) // 4 for i in order]
        rows = []
        for k, sequence in enumerate(pack_group(lengths, size)):
            offset = 0
            for doc, start, n in sequence:
                own = memoryview(ids[order[doc]])[4 * start : 4 * (start + n)]
                rows.append((names[order[doc]], start, n, zlib.crc32(own), lengths[doc], group * ID_SPACE + k, offset))
                offset += n
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names_of)

    @freeing
    def run(batches: Batches) -> Batches:
        encoder = Encoder(shared.value)
        open_group, names, ids = None, [], []
        for batch in batches:
            for doc_id, own, group in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if group != open_group:
                    if ids:
                        yield packed(open_group, names, ids)
                    open_group, names, ids = group, [], []
                names.append(doc_id)
                ids.append(b"".join((own, end)))
        if ids:
            yield packed(open_group, names, ids)

    dealt = docs.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.repartition("grp").sortWithinPartitions("grp").select("doc_id", "text", "grp").mapInArrow(run, SCHEMA)
