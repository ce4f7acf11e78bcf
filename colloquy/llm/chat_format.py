r"""Chat formatting of typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor flattens the parts in order:
text is escaped, every other part becomes a numbered placeholder, and its reference and the tokens
it will expand to are recorded. A turn is written as

    <|turn ROLE|>CONTENT<|end|>\n

and a placeholder as <|image 3|>. Inside texts, roles included, a backslash precedes each of the
characters `\`, `<` and `|`, so that no text can be taken for markup and every text can be read back
exactly. The loss mask lists the spans of the formatted string (in code points) that hold the assistant's texts.

Rows are dealt by conversation and read in order of turn as a stream, so a worker holds one
conversation at a time.

Defined results: null text is empty, null role is the empty role. Turns order by turn (null first),
then role, then text, then parts, so ties and repeated rows keep a fixed order. A null conversation id is a
conversation of its own. An empty table gives no rows. Where the input has a column `parts`
(array<struct<kind, text, ref, tokens>>) that isn't null, it replaces the row's text; a part of
unknown kind is an error, a null part is skipped. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATTED = (
    "conv_id long, formatted string, loss_starts array<int>, loss_ends array<int>, "
    "attachments array<struct<turn: int, place: int, kind: string, ref: string, tokens: long>>, expanded_tokens long"
)
KINDS = ("text", "image", "audio", "document")
CONTROL = re.compile(r"[\\<|]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Escapes, turn heads, ends and placeholders, as they stand in a formatted string.
MARKUP = re.compile(r"\\.|<\|(turn |end\|>\n|image \d+\|>|audio \d+\|>|document \d+\|>)", re.DOTALL)
HEAD = re.compile(r"(?:[^\\|]|\\.)*", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Flattener:
    """Visits the parts of a conversation's turns and writes its formatted string."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    turn: int = -1
    attachments: list[dict] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def visit_turn(self, role: str, parts: list[dict]) -> None:
        self.turn += 1
        self.write(f"<|turn {escape(role)}|>")
        for part in parts:
            if part is not None:
                if part["kind"] not in KINDS:
                    raise ValueError(f"unknown kind of part: {part['kind']}")
                getattr(self, f"visit_{part['kind']}")(part, role)
        self.write("<|end|>\n")

    def visit_text(self, part: dict, role: str) -> None:
        start = self.length
        self.write(escape(part["text"] or ""))
        if role == "assistant" and self.length > start:
            self.starts.append(start)
            self.ends.append(self.length)

    def visit_attachment(self, part: dict, role: str) -> None:
        place = len(self.attachments)
        self.attachments.append({"turn": self.turn, "place": place, "kind": part["kind"], "ref": part["ref"], "tokens": part["tokens"] or 0})
        self.write(f"<|{part['kind']} {place}|>")

    visit_image = visit_audio = visit_document = visit_attachment

    def row(self, conv_id: int | None) -> dict:
        return {"conv_id": conv_id, "formatted": "".join(self.pieces), "loss_starts": self.starts, "loss_ends": self.ends, "attachments": self.attachments, "expanded_tokens": sum(a["tokens"] for a in self.attachments)}


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: the formatted string, its loss spans, attachments and their tokens."""
    kind = "array<struct<kind: string, text: string, ref: string, tokens: long>>"
    text_part = F.array(F.struct(F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))).cast(kind)
    parts = F.coalesce(F.col("parts").cast(kind), text_part) if "parts" in turns.columns else text_part
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "parts").select("conv_id", "role", "parts")
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int32())), ("loss_ends", pa.list_(pa.int32())), ("attachments", pa.list_(pa.struct([("turn", pa.int32()), ("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id: int | None = None
        now: Flattener | None = None
        for batch in batches:
            done = []
            for conv_id, role, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != open_id:
                    if now is not None:
                        done.append(now.row(open_id))
                    open_id, now = conv_id, Flattener()
                now.visit_turn(role, own)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row(open_id)], schema)

    return ordered.mapInArrow(run, FORMATTED)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back from a formatted string; placeholders are not text."""
    found: list[tuple[str, str]] = []
    role: str | None = None  # of the open turn
    texts: list[str] = []
    at = 0
    for match in MARKUP.finditer(formatted):
        mark = match[1]
        if mark is None or match.start() < at:
            continue  # an escape, or inside a turn's head
        if mark == "turn ":
            if role is not None or match.start() != at:
                raise ValueError(f"a turn begins inside another at {match.start()}")
            head = HEAD.match(formatted, match.end()).end()  # the first bar without a backslash
            role, texts, at = unescape(formatted[match.end() : head]), [], head + 2
            continue
        if role is None:
            raise ValueError(f"markup outside a turn at {match.start()}")
        texts.append(formatted[at : match.start()])
        at = match.end()
        if mark.startswith("end"):
            found.append((role, unescape("".join(texts))))
            role = None
    if role is not None or at != len(formatted):
        raise ValueError(f"not a formatted conversation at {at}")
    return found


def digests(formatted: DataFrame) -> DataFrame:
    """What each formatted string says when it is read back: turns, loss text and length."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                whole = row["formatted"]
                turns = turns_of(whole)
                under = "".join(unescape(whole[a:b]) for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True))
                said = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                rows.append({"conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": said, "loss_chars": len(under), "loss_sha256": hashlib.sha256(under.encode()).hexdigest(), "formatted_chars": len(whole)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.select("conv_id", "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)
