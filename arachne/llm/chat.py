"""Conversations as one text each, with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens them in order into text with
placeholders, and records each attachment's reference, its place and the tokens that it stands for. The template marks
turns; control strings inside texts and roles are escaped with a backslash, so the turns can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm.hashing import runs
from arachne.llm.shared import small_batches

BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|<\||:)")
_TOKEN = re.compile(r"\\(?:\\|###|</turn>|<\||:)|<\|(image|audio|document)\|>|</turn>\n|: ")
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class PartVisitor:
    """Flattens parts; `units` are an image's tiles, an audio's seconds or a document's pages, null counting as 1."""

    TOKENS = {"image": 256, "audio": 25, "document": 512}

    def __init__(self):
        self.out: list[str] = []
        self.length = 0
        self.attachments: list[dict] = []

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type')}", self.visit_text)(part)

    def visit_text(self, part: dict) -> None:
        """Parts of other types are text too; a null text is empty."""
        self.put(escape(part.get("text") or ""))

    def _attach(self, part: dict) -> None:
        kind, units = part["type"], part.get("units")
        self.attachments.append({"ordinal": len(self.attachments), "type": kind, "ref": part.get("ref"), "offset": self.length, "tokens": self.TOKENS[kind] * max(0, 1 if units is None else units)})
        self.put(f"<|{kind}|>")

    visit_image = visit_audio = visit_document = _attach


def format_turns(turns: list[tuple[str, list[dict]]], loss_role: str = "assistant") -> tuple[str, list[dict], list[dict]]:
    """(text, loss mask as spans of code points, attachments) of (role, parts) turns. The mask covers the contents of
    turns of loss_role."""
    v, mask = PartVisitor(), []
    for role, parts in turns:
        v.put(BEGIN + escape(role).replace(":", "\\:") + MIDDLE)
        start = v.length
        for p in parts:
            v.visit(p)
        if role == loss_role:
            mask.append({"start": start, "end": v.length})
        v.put(END)
    return "".join(v.out), mask, v.attachments


def read_turns(text: str) -> Iterator[tuple[str, list[str]]]:
    """(role, parts) of a formatted text: texts unescaped, attachments as their placeholders."""
    at = 0
    while at < len(text):
        if not text.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        at += len(BEGIN)
        role, parts, since = None, [], at
        for m in _TOKEN.finditer(text, at):
            if m[0] == MIDDLE and role is None:
                role = unescape(text[since : m.start()])
            elif m[1] and role is not None:
                parts += [unescape(text[since : m.start()]), m[0]]
            elif m[0] == END and role is not None:
                parts.append(unescape(text[since : m.start()]))
                at = m.end()
                break
            else:
                continue
            since = m.end()
        else:
            raise ValueError(f"a turn doesn't end after {at}")
        yield role, [p for p in parts if p]


FORMATTED = "formatted string, loss_mask array<struct<start:bigint,end:bigint>>, attachments array<struct<ordinal:bigint,type:string,ref:string,offset:bigint,tokens:bigint>>, n_turns bigint, expanded_tokens bigint"


def format_conversations(rows: DataFrame, parts_col: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss_mask, attachments, n_turns, expanded_tokens) of each conversation.

    Turns go by number, ties by role and text, nulls first; repeated rows are turns of their own. A null role or text is
    empty. Rows of a null id are one conversation. A row's parts, where parts_col has any, stand for its text. Each
    task reads its conversations in order and holds one at a time. Ids are of any type that has a text form of its own. Other columns
    are ignored; no rows: none.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    parts = F.col(parts_col) if parts_col else F.lit(None).cast(PARTS)
    turns = rows.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), parts.cast(PARTS).alias("parts"))

    def formatted(batches):
        kinds = [None]

        def keyed():
            for b in batches:
                kinds[0] = b.schema.field("id").type
                yield b

        def rows_of():
            for t in runs(keyed(), ("none", "key")):
                said = [(r, p if p else [{"type": "text", "text": x}]) for r, x, p in zip(t.column("role").to_pylist(), t.column("text").to_pylist(), t.column("parts").to_pylist(), strict=True)]
                text, mask, attachments = format_turns(said)
                yield t.column("id")[0].as_py(), text, mask, attachments, len(said), sum(a["tokens"] for a in attachments)

        out, size = [], 0
        for r in rows_of():
            out.append(r)
            size += len(r[1])
            if size > 4_000_000:
                yield batch(out, kinds[0])
                out, size = [], 0
        if out:
            yield batch(out, kinds[0])

    def batch(out, ids):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        attached = pa.list_(pa.struct([("ordinal", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())]))
        kinds = [ids, pa.string(), span, attached, pa.int64(), pa.int64()]
        names = ["id", "formatted", "loss_mask", "attachments", "n_turns", "expanded_tokens"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    turns = turns.withColumns({"none": F.col("id").isNull(), "key": F.coalesce(F.col("id").cast("string"), F.lit(""))})
    ordered = turns.repartition("id").sortWithinPartitions("none", "key", "turn", "role", "text")
    return ordered.mapInArrow(formatted, f"id {kind}, {FORMATTED}").withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted texts and their masks."""
    kind = formatted.schema[id_col].dataType.simpleString()

    def digests(batches):
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in range(5))
            for text, mask in zip(b.column("formatted").to_pylist(), b.column("loss_mask").to_pylist(), strict=True):
                turns = list(read_turns(text))
                every = hashlib.sha256()
                for role, parts in turns:
                    every.update(f"{role}\n{''.join(parts)}\n".encode())
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                for c, v in zip(out, (len(turns), every.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c) for c in out)], ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = formatted.select(F.col(id_col).alias("id"), "formatted", "loss_mask").mapInArrow(digests, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    return read.withColumnRenamed("id", id_col)
