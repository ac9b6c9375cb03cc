"""Chat formatting with typed content parts.

A message is a role and a list of parts: text, image, audio or document. A visitor flattens the parts in order: text is
escaped, an attachment becomes a placeholder ``<|image_1|>`` numbered by kind within the conversation, and its
reference and expanded token count are recorded. A turn is ``<|im_start|>role\\n ... <|im_end|>\\n``.

Escaping is reversible: each ``<`` that begins ``<|``, ``<\\|``, ``<\\\\|`` and so on gets one more backslash before the
bar, so no control string survives inside a text, and taking one away restores it. A role's backslashes and line feeds
are written ``\\\\`` and ``\\n`` first. The loss mask covers the texts of assistant turns.

Turns are ordered by turn (null first), then role, then text, so ties and repeated rows have one order and all stay.
A null text or role is empty; a null conv_id is a conversation of its own; an empty table has no conversations.
Rows of one conversation meet in one task, since its formatted text is one value; conversations are dealt by id. The
turns of a conversation are read as a stream from sorted rows, with no list of other conversations beside it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

START, END = "<|im_start|>", "<|im_end|>"
_RAW = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document)_[0-9]+\|>")


def escape(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Text:
    text: str

    def accept(self, visitor):
        return visitor.text(self)


@dataclass
class Image:
    ref: str
    width: int = 336
    height: int = 336

    def accept(self, visitor):
        return visitor.image(self)


@dataclass
class Audio:
    ref: str
    seconds: float = 1.0

    def accept(self, visitor):
        return visitor.audio(self)


@dataclass
class Document:
    ref: str
    pages: int = 1

    def accept(self, visitor):
        return visitor.document(self)


@dataclass
class Flattener:
    """Visitor of one conversation's parts. Token counts: a patch of 14 by 14 pixels, 40 ms of sound, 512 for a page."""

    attachments: list[dict] = field(default_factory=list)
    seen: dict[str, int] = field(default_factory=dict)

    def _place(self, kind: str, ref: str, tokens: int) -> str:
        n = self.seen[kind] = self.seen.get(kind, 0) + 1
        self.attachments.append({"placeholder": f"<|{kind}_{n}|>", "kind": kind, "ref": ref, "tokens": tokens})
        return f"<|{kind}_{n}|>"

    def text(self, part: Text) -> str:
        return escape(part.text or "")

    def image(self, part: Image) -> str:
        return self._place("image", part.ref, -(-part.width // 14) * -(-part.height // 14))

    def audio(self, part: Audio) -> str:
        return self._place("audio", part.ref, max(1, round(part.seconds * 25)))

    def document(self, part: Document) -> str:
        return self._place("document", part.ref, 512 * part.pages)


@dataclass
class Formatted:
    text: str
    loss: list[tuple[int, int]]
    attachments: list[dict]


def format_conversation(turns) -> Formatted:
    """``turns``: (role, parts). Offsets of the loss mask are code points of the formatted text, end exclusive."""
    flat, out, loss, at = Flattener(), [], [], 0
    for role, parts in turns:
        head = f"{START}{escape_role(role or '')}\n"
        merged: list = []
        for p in parts:  # texts side by side are escaped as one, lest a control string form across them
            if isinstance(p, Text) and merged and isinstance(merged[-1], Text):
                merged[-1] = Text(merged[-1].text + (p.text or ""))
            else:
                merged.append(Text(p.text or "") if isinstance(p, Text) else p)
        body = "".join(p.accept(flat) for p in merged)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return Formatted("".join(out), loss, flat.attachments)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, unescaped; placeholders stay."""
    for m in _TURN.finditer(formatted):
        yield unescape_role(m[1]), unescape(m[2])


SCHEMA = (
    "conv_id long, formatted string, loss array<struct<start:long,end:long>>, "
    "attachments array<struct<placeholder:string,kind:string,ref:string,tokens:long>>"
)


def _parts(kind: str | None, text: str | None, ref: str | None, size: float | None):
    if kind in (None, "text"):
        return Text(text or "")
    size = size or 1
    return {"image": lambda: Image(ref or "", int(size), int(size)), "audio": lambda: Audio(ref or "", size), "document": lambda: Document(ref or "", int(size))}[kind]()


def _format(batches):
    types = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    types.append(pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "parts")))

    def flush(done):
        columns = list(zip(*done)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["conv_id", "formatted", "loss", "attachments"])

    done, size, turns, own, begun = [], 0, [], None, False
    for conv, role, parts in rows():
        if begun and conv != own:
            f = format_conversation(turns)
            done.append((own, f.text, [{"start": a, "end": b} for a, b in f.loss], f.attachments))
            size, turns = size + len(f.text), []
            if size > 4 << 20:
                yield flush(done)
                done, size = [], 0
        own, begun = conv, True
        turns.append((role, [_parts(p["kind"], p["text"], p["ref"], p["size"]) for p in parts]))
    if begun:
        f = format_conversation(turns)
        done.append((own, f.text, [{"start": a, "end": b} for a, b in f.loss], f.attachments))
    yield flush(done)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row a conversation (SCHEMA) from conv_id, turn, role and either text or parts (kind, text, ref, size)."""
    if "parts" in rows.columns:
        parts = F.col("parts")
    else:
        none = F.lit(None)
        text = F.struct(F.lit("text").alias("kind"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("double").alias("size"))
        parts = F.array(text)
    src = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    return map_arrow(src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", F.to_json("parts")), _format, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all taken from the formatted text and mask."""

    def run(batches):
        for batch in batches:
            out = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss"))):
                turns, seen = hashlib.sha256(), 0
                for role, body in parse(text):
                    turns.update(f"{role}\n{body}\n".encode("utf-8"))
                    seen += 1
                under, n = hashlib.sha256(), 0
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    under.update(body.encode("utf-8"))
                    n += len(body)
                out.append((conv, seen, turns.hexdigest(), n, under.hexdigest(), len(text)))
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return map_arrow(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
