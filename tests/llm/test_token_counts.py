import pytest
from colloquy.llm.token_counts import MergeCounter, count_tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [None, "", " ", "a", "Hello, world's  end\n\n\tnow ", "aaaaaaaaaaaaaaaaaaaaaaaaab" * 50, "x<|endoftext|> y<|endoftext|>", "<|endoftext|>", "héllo ñandú 中文字 🎉🎉    z", "1234 56.78", "word " * 3000, "ab" * 20000]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(1, "", "again")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows)
    assert sorted(tuple(r) for r in got) == want


def test_memory_limit_changes_nothing():
    text = "the quick brown foxes jumped over thirteen lazier dogs " * 5
    with open(PATH, encoding="utf-8") as f:
        source = f.read()
    assert MergeCounter(source, limit=3).count(text) == MergeCounter(source).count(text)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
