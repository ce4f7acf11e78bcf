import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from colloquy.llm.packing import BinTree, Encoder, pack, pack_group

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def test_tree_finds_the_first_bin():
    rng, tree, room = random.Random(3), BinTree(50, 100), [100] * 50
    for _ in range(50):
        n = rng.randint(1, 100)
        want = next(i for i, r in enumerate(room) if r >= n)
        assert tree.place(n) == want
        room[want] -= n


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 5000, 1], [700] * 31, list(range(1, 400))])
def test_groups_hold_each_token_once_without_padding(lengths):
    seen = defaultdict(list)
    for sequence in pack_group(lengths, 2048):
        n = sum(p[2] for p in sequence)
        assert 0 < n <= 2048 and (n == 2048 or n & (n - 1) == 0)
        for doc, start, k in sequence:
            seen[doc].append((start, k))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[doc]):
            assert start == at and k > 0
            at += k
        assert at == n


def test_pieces_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", "Hello THERE, it's me", "x<|endoftext|>y <|endoftext|> z", "a\x1cb   c\u0085d", "É é ñ 中文 Σας ΟΔΟΣ á", "tion thing " * 3000, "short", "short"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(7, "short", 7), (None, "no id", 7)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, group_chars=9000).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, _ in rows if i != 7}
    for r in got:
        if r.doc_id != 7:
            own = ids[r.doc_id]
            assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in got if r.doc_id != 7) == sum(map(len, ids.values()))
    assert sum(r.length for r in got if r.doc_id == 7) == 2 * next(r.doc_tokens for r in got if r.doc_id == 7)
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for pieces in filled.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_memory_of_words_equals_the_library_on_random_texts():
    """Letters that decompose, marks, digits, other scripts and unusual white space in any order."""
    rng = random.Random(11)
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read())
    library = Tokenizer.from_file(PATH)
    decomposing = [chr(c) for c in range(0xC0, 0x2000) if unicodedata.decomposition(chr(c)) and chr(c).isalpha()]
    pool = [*"aBcXYZ059 .,;:!?#&%$*|)]}\"'-_<>", "İ", "ǆ", "ß", "́", "̇", "क़", "ड़", "中", "か", "が", "゙", "\u00a0", "\u2003", "\t", "\n", "<|", "|>", "'s", "'ll"]
    for _ in range(20_000):
        text = "".join(rng.choice(decomposing) if rng.random() < 0.2 else rng.choice(pool) for _ in range(rng.randint(1, 14)))
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == want, text
    for letter in decomposing:
        for mark in ".,*":
            assert encoder.encode(letter + mark) == np.array(library.encode(letter + mark, add_special_tokens=False).ids, "<u4").tobytes()


def test_a_batch_asks_the_library_once_for_all_its_new_words():
    """Words in any case and with marks behind them are looked up as one, whatever the texts; the memory may be cleared between batches."""
    with open(PATH, encoding="utf-8") as f:
        encoder = Encoder(f.read(), limit=3_000)
    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    words = ["".join(rng.choices("abcdeéñß", k=8)) for _ in range(2_000)]
    asked = []

    class Counting:
        def __init__(self, of):
            self.of = of

        def encode(self, text, **options):
            asked.append(text)
            return self.of.encode(text, **options)

    encoder.library, encoder.model = Counting(encoder.library), Counting(encoder.model)
    for _ in range(3):
        rng.shuffle(words)
        texts = [" ".join(rng.choice([w, w + ".", w[0].upper() + w[1:] + ",", w + '?!"']) if w[0].isascii() else w for w in words[i : i + 100]) for i in range(0, 2_000, 50)]
        texts += ["", " \t", "1.5 a-b <|endoftext|>"]
        got = encoder.encode_all(pa.array(texts))
        assert [bytes(x) for x in got] == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        words += ["".join(rng.choices("xyzéñß", k=9)) for _ in range(400)]
    assert len(asked) < 40
