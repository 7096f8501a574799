"""Chat formatting with typed content parts.

A turn holds a list of parts: text, image, audio or document. A visitor flattens them in order: text is
escaped, any other part becomes a numbered placeholder, and its reference and the number of tokens that it expands to
are recorded. The template marks the begin, role and end of turns; texts escape the character that all control strings
start with, so that a text which looks like a marker stays a text and reads back as it was.

Turns are formatted where they lie. A formatted conversation is its turns in order; it is never put together in
one value, so that a conversation of any length is read back as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from siteframe.llm.common import prepare

#: The template. In texts and roles, the begin of a control string, <|, is written as <\\|.
TURN, TEXT_BEGIN, TURN_END, LOSS_BEGIN, LOSS_END = "<|turn|>", "<|text|>", "<|end|>", "<|loss|>", "<|/loss|>"
PLACEHOLDER = "<|{kind}:{number}|>"
LEARNT_ROLE = "assistant"
#: Tokens that a part expands to: those of an image tile, of a second of audio, of a page.
TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: str) -> str:
    """A text without control strings. A run of backslashes between < and | gets one more."""
    if "<" not in text or "|" not in text:
        return text
    out, i = [], 0
    while (at := text.find("<", i)) >= 0:
        j = at + 1
        while text.startswith("\\", j):
            j += 1
        if text.startswith("|", j):
            out.append(text[i:j] + "\\")
        else:
            out.append(text[i:j])
        i = j
    return "".join([*out, text[i:]])


def unescape(text: str) -> str:
    """The text that `escape` was given."""
    if "\\|" not in text:
        return text
    out, i = [], 0
    while (at := text.find("<\\", i)) >= 0:
        j = at + 1
        while text.startswith("\\", j):
            j += 1
        out.append(text[i:j - 1] if text.startswith("|", j) else text[i:j])
        i = j
    return "".join([*out, text[i:]])


@dataclass
class Flat:
    """What the visitor has gathered of a turn. Adjacent texts are escaped together: a marker could begin in one and end in the next."""

    pieces: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)  # kind, reference, expanded tokens

    def visit(self, part: dict) -> None:
        getattr(self, "visit_" + (part.get("type") or "text"))(part)

    def visit_text(self, part: dict) -> None:
        self.texts.append(part.get("text") or "")

    def flush(self) -> None:
        self.pieces.append(escape("".join(self.texts)))
        self.texts = []

    def _attach(self, part: dict, kind: str, units: int) -> None:
        self.flush()
        self.pieces.append(PLACEHOLDER.format(kind=kind, number=len(self.attachments)))
        self.attachments.append((kind, part.get("ref") or "", units * TOKENS[kind]))

    def visit_image(self, part: dict) -> None:
        self._attach(part, "image", max(1, part.get("units") or 1))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, "audio", max(1, part.get("units") or 1))

    def visit_document(self, part: dict) -> None:
        self._attach(part, "document", max(1, part.get("units") or 1))


def format_turn(role: str, parts: list[dict]) -> tuple[str, list[tuple[str, str, int]]]:
    flat = Flat()
    for part in parts:
        flat.visit(part)
    flat.flush()
    body = "".join(flat.pieces)
    if role == LEARNT_ROLE:
        body = f"{LOSS_BEGIN}{body}{LOSS_END}"
    return f"{TURN}{escape(role)}{TEXT_BEGIN}{body}{TURN_END}\n", flat.attachments


def read_turn(formatted: str) -> tuple[str, str, str | None]:
    """Role, text (placeholders as they are) and what is under the loss mask, of one formatted turn."""
    if not formatted.startswith(TURN) or not formatted.endswith(TURN_END + "\n"):
        raise ValueError("no turn")
    role, found, body = formatted[len(TURN):-len(TURN_END) - 1].partition(TEXT_BEGIN)
    if not found:
        raise ValueError("turn without text")
    masked = None
    if body.startswith(LOSS_BEGIN) and body.endswith(LOSS_END):
        body = body[len(LOSS_BEGIN):-len(LOSS_END)]
        masked = unescape(body)
    return unescape(role), unescape(body), masked


def read_parts(body: str, attachments: list[tuple[str, str, int]]) -> list[dict]:
    """The parts of an escaped body: texts between placeholders, and what these refer to."""
    out, i = [], 0
    for m in re.finditer(r"<\|(image|audio|document):(\d+)\|>", body):
        out += [{"type": "text", "text": unescape(body[i:m.start()])}] if m.start() > i else []
        kind, ref, n = attachments[int(m[2])]
        out.append({"type": kind, "ref": ref, "units": n // TOKENS[kind]})
        i = m.end()
    return [*out, {"type": "text", "text": unescape(body[i:])}] if i < len(body) else out


PART = "struct<type:string,text:string,ref:string,units:int>"
ATTACHMENT = StructType([StructField("kind", StringType()), StructField("ref", StringType()), StructField("tokens", LongType())])
TURNS = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("formatted", StringType()),
                    StructField("attachments", ArrayType(ATTACHMENT)), StructField("expanded_tokens", LongType())])


def text_parts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds `parts` to rows whose content is one text."""
    part = F.struct(F.lit("text").alias("type"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
                    F.lit(None).cast("int").alias("units"))
    return rows.withColumn("parts", F.array(part))


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, attachments, expanded_tokens) of rows (conv_id, turn, role, parts).

    A null role is an empty one, null parts are none, a null text is empty, an unknown kind of part is an error. Every row is a
    turn, also if it repeats another; an empty table gives an empty result. Other columns are not read.
    """
    arrow = to_arrow_schema(TURNS)
    source = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                         F.col("parts").cast(f"array<{PART}>").alias("parts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(role, parts or []) for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            found = [[{"kind": k, "ref": r, "tokens": n} for k, r, n in a] for _, a in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f for f, _ in made], arrow.field(2).type), pa.array(found, arrow.field(3).type),
                 pa.array([sum(n for _, _, n in a) for _, a in made], pa.int64())], schema=arrow)

    prepare(rows.sparkSession)
    return source.mapInArrow(run, TURNS)


DIGESTS = StructType([StructField("conv_id", LongType()), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
                      StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its formatted turns in order.

    A digest runs over a whole conversation, so one task reads it; it holds one turn at a time.
    Turns with equal numbers come in the order of their formatted text; rows without conv_id are one conversation.
    """
    arrow = to_arrow_schema(DIGESTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now, started = None, False
        turns = chars = learnt = 0
        all_sha, loss_sha = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            done.append((now, turns, all_sha.hexdigest(), learnt, loss_sha.hexdigest(), chars))

        def give() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not started or conv != now:
                    if started:
                        close()
                    now, started = conv, True
                    turns = chars = learnt = 0
                    all_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
                value = raw.as_py()
                role, text, masked = read_turn(value)
                turns += 1
                chars += len(value)
                all_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if masked is not None:
                    learnt += len(masked)
                    loss_sha.update(masked.encode("utf-8", "surrogatepass"))
            yield give()
            done.clear()
        if started:
            close()
            yield give()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.select("conv_id", "formatted").mapInArrow(run, DIGESTS)
