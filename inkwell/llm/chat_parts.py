"""Chat formatting: a visitor flattens typed content parts into marked turns with ordered placeholders, and a reader undoes it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from inkwell.llm.common import WORD, fresh_path

PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
#: Positions that an attachment takes once it is expanded: image patches of 28 x 28, audio frames a second, a page of a document.
PATCH, FRAMES, PAGE = 28, 25, 576
#: A block of formatted text ends with the turn that reaches so many characters.
BLOCK_CHARS = 1 << 20
LEARNT = "assistant"
OPEN, SHUT = "<turn ", "</turn>\n"
ESCAPED = re.compile(r"[\\<>]")
UNESCAPED = re.compile(r"\\(.)", re.S)
PIECES = re.compile(r"<((?:[^\\<>]++|\\.)*+)>\n|((?:[^\\<>]++|\\.)++)", re.S)


def escape(text: str) -> str:
    """No control mark is left in a text: each begins with a bare "<" and ends with a bare ">"."""
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


@dataclass
class Sample:
    """Formatted text, the places of what is learnt in it, and its attachments in the order of their placeholders."""

    chars: int = 0
    n_turns: int = 0
    tokens: int = 0
    pieces: list[str] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.chars += len(text)


class Visitor:
    """One method per type of part; parts of another or no type count as text."""

    def __init__(self):
        self.words = re.compile(WORD)

    def turn(self, sample: Sample, role: str, parts: list[dict | None]) -> None:
        sample.add(f"{OPEN}{escape(role)}>\n")
        for part in parts:
            if part:
                getattr(self, f"visit_{part['type']}" if part["type"] in ("image", "audio", "document") else "visit_text")(sample, part, role == LEARNT)
        sample.add(SHUT)
        sample.n_turns += 1

    def visit_text(self, sample: Sample, part: dict, learnt: bool) -> None:
        text = part["text"] or ""
        start = sample.chars
        sample.add(escape(text))
        sample.tokens += sum(1 for _ in self.words.finditer(text))
        if learnt and text:
            sample.loss.append((start, sample.chars - start))

    def _attach(self, sample: Sample, part: dict, tokens: int) -> None:
        sample.attachments.append({"type": part["type"], "ref": part["ref"], "at": sample.chars, "tokens": tokens})
        sample.add(f"<{part['type']}>\n")
        sample.tokens += tokens

    def visit_image(self, sample: Sample, part: dict, learnt: bool) -> None:
        self._attach(sample, part, -(-max(part["width"] or 1, 1) // PATCH) * -(-max(part["height"] or 1, 1) // PATCH))

    def visit_audio(self, sample: Sample, part: dict, learnt: bool) -> None:
        self._attach(sample, part, max(int(-(-(part["seconds"] or 0.0) * FRAMES // 1)), 1))

    def visit_document(self, sample: Sample, part: dict, learnt: bool) -> None:
        self._attach(sample, part, max(part["pages"] or 1, 1) * PAGE)


def text_parts(text: Column | str) -> Column:
    """Content of one text part."""
    text = F.col(text) if isinstance(text, str) else text
    nothing = ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))
    parts = [F.lit("text").alias("type"), text.alias("text"), *(F.expr(e) for e in nothing.split(", "))]
    return F.array(F.struct(*parts)).cast(f"array<{PART}>")


SAMPLES = (
    "conv_id {key}, block long, whole boolean, n_turns long, formatted string, expanded_tokens long, loss array<struct<start: int, length: int>>,"
    " attachments array<struct<type: string, ref: string, at: int, tokens: long>>"
)


def format_chats(turns: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """turns: conv_id, turn, role, content (array of parts). One row per conversation and block of about `block_chars` characters.

    Rows are dealt by ranges of (conv_id, turn), so a conversation of any length is spread over tasks; its
    blocks, in the order of `block`, are parts of one text, and `whole` says that there is but one (it is false as well for the first and the last
    conversation of a task, which may go on in the next). `loss` names the places (in the
    block) of the assistants' texts; attachments keep the order of their placeholders, with their references and the
    tokens that they expand to. Turns of one number come by role and content; a null turn comes last, a null role is empty, a null
    content has no parts, rows without conv_id are one conversation. Other columns are not read.
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(SAMPLES.format(key=key))
    arrow = to_arrow_schema(schema)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col("content").cast(f"array<{PART}>").alias("content"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "content").withColumn("task", F.spark_partition_id())

    def run(batches):
        visitor, sample, now, done, block, size = Visitor(), Sample(), None, [], 0, 0
        edge = True  # the task's first conversation may have begun in another task

        def finish(goes_on):
            done.append({
                "conv_id": now[0], "block": block, "whole": not (edge or goes_on), "n_turns": sample.n_turns, "formatted": "".join(sample.pieces),
                "expanded_tokens": sample.tokens, "loss": [{"start": a, "length": b} for a, b in sample.loss], "attachments": sample.attachments,
            })

        def emitted():
            batch = pa.RecordBatch.from_pylist(done, arrow)
            done.clear()
            return batch

        for batch in batches:
            for conv_id, role, content, task in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "content", "task")), strict=True):
                if now is None:
                    now, block = (conv_id,), task << 32
                elif now[0] != conv_id or sample.chars >= block_chars:
                    goes_on = now[0] == conv_id
                    finish(goes_on)
                    size += sample.chars
                    edge, block = goes_on, block + 1
                    sample, now = Sample(), (conv_id,)
                    if size >= BLOCK_CHARS or len(done) >= 2000:
                        yield emitted()
                        size = 0
                visitor.turn(sample, role, content or [])
        if now is not None:
            finish(True)
        yield emitted()

    return dealt.mapInArrow(run, schema)


def write_chats(turns: DataFrame, path: str | None = None) -> str:
    path = path or fresh_path(turns.sparkSession, "chats")
    format_chats(turns).write.parquet(path)
    return path


def read_turns(formatted: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(role, [(type, text)]) of each turn of a formatted text; a placeholder has its type and no text."""
    role, parts, at = "", [], 0
    while at < len(formatted):
        piece = PIECES.match(formatted, at)
        if piece is None:
            raise ValueError(f"no mark or text at {at}")
        mark, text = piece.groups()
        if mark is None:
            parts.append(("text", unescape(text)))
        elif mark == "/turn":
            yield role, parts
        elif mark.startswith("turn "):
            role, parts = unescape(mark[5:]), []
        else:
            parts.append((mark, ""))
        at = piece.end()


def learnt(formatted: str, loss: list[dict]) -> list[str]:
    """The texts under the loss mask."""
    return [unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in loss]


class Digest:
    """Digests of a conversation, block by block."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, parts in read_turns(formatted):
            self.turns.update(f"{role}\n{''.join(text for _, text in parts)}\n".encode())
            self.n_turns += 1
        for text in learnt(formatted, loss):
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self, conv_id) -> list:
        return [conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Read formatted conversations back: per conversation n_turns, turns_sha256 (role, LF, text, LF of every turn), loss_chars, loss_sha256,
    formatted_chars. Whole ones are digested where they are read; the blocks of the few others meet, sorted, in a task that holds one at a time."""
    samples = spark.read.parquet(path)
    schema = StructType([samples.schema["conv_id"], *StructType.fromDDL(
        "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        now, digest = None, None
        for batch in batches:
            rows = []
            for conv_id, formatted, loss in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss")), strict=True):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        rows.append(digest.row(now[0]))
                    now, digest = (conv_id,), Digest()
                digest.add(formatted, loss)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(digest.row(now[0]), arrow, strict=True)], schema=arrow)

    columns = samples.select("conv_id", "block", "whole", "formatted", "loss")
    blocks = columns.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return columns.where("whole").mapInArrow(run, schema).unionByName(blocks.mapInArrow(run, schema))
