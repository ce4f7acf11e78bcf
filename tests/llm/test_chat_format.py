import hashlib
import random

import pytest
from colloquy.llm.chat_format import Flattener, digests, escape, format_conversations, turns_of, unescape
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<|>en d\nturimage3é𝄞"))
def test_escaping_round_trip(text):
    assert unescape(escape(text)) == text
    assert "<|" not in escape(text)


def test_digests_equal_brute_force(spark):
    rng = random.Random(6)
    bits = ["<|end|>\n", "\\", "|>", "<|turn user|>", "ok", "é", "𝄞", "<|image 0|>", "\n", "<", "|"]
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "we|ird\\<|", None]), rng.choice([None, "", "".join(rng.choices(bits, k=9))])))
    rows += [(50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, None, "user", "first"), (50, 0, "assistant", "a"), (None, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(format_conversations(df)).collect()}
    assert got == want
    assert digests(format_conversations(df.limit(0))).collect() == []


def test_parts_and_attachments(spark):
    parts = [("text", "see ", None, None), ("image", None, "s3/a.png", 85), ("text", " and <|image 0|>", None, None), ("document", None, "b.pdf", 300), None]
    kind = "conv_id long, turn int, role string, text string, parts array<struct<kind:string,text:string,ref:string,tokens:int>>"
    row = format_conversations(spark.createDataFrame([(1, 0, "user", "ignored", parts), (1, 1, "assistant", "plain", None)], kind)).first()
    assert row.formatted == "<|turn user|>see <|image 0|> and \\<\\|image 0\\|><|document 1|><|end|>\n<|turn assistant|>plain<|end|>\n"
    assert [(a.turn, a.place, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, 0, "image", "s3/a.png", 85), (0, 1, "document", "b.pdf", 300)]
    assert row.expanded_tokens == 385
    assert turns_of(row.formatted) == [("user", "see  and <|image 0|>"), ("assistant", "plain")]


@pytest.mark.parametrize("broken", ["x", "<|turn a|>b", "<|end|>\n", "<|turn a|>b<|end|>\nc"])
def test_broken_strings_are_refused(broken):
    with pytest.raises(ValueError):
        turns_of(broken)


@pytest.mark.parametrize("kind", ["attachment", "turn", "video", None])
def test_kinds_that_are_none(kind):
    with pytest.raises(ValueError, match="unknown kind"):
        Flattener().visit_turn("user", [{"kind": kind, "text": "x", "ref": None, "tokens": None}])
