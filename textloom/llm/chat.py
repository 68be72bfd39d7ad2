"""Chat formatting with typed content parts (operator 4).

A turn's content is a list of typed parts. A visitor flattens text, image, audio and
document parts into text with ordered placeholders, and records for each attachment its
reference, place and expanded token count. A turn then becomes

    <turn role="ROLE">CONTENT</turn> and a line feed,

with every control string inside roles and texts escaped by a backslash code, so the
reader gives back exactly what went in. The loss mask covers the content of assistant turns.

Turns are formatted where they lie, one by one. The formatted turns are dealt by
conversation, sorted, and read as a stream: hashes and counts go on from turn to turn, so
no task holds more than one batch, however long a conversation or a turn is.

Nulls: a null text or role is empty; a null conversation id is a conversation of its own
(all such rows together). A null part gives nothing. A part without a type is text; a part of
an unknown type is an attachment of kind "other" and of one token. Sizes that are missing,
negative or no numbers count as the least size. Null turn numbers come first; rows with
equal ids and turns are ordered by their formatted text, and repeated rows are turns of
their own. An empty table gives an empty result. Only named columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Escape codes. The backslash comes first on the way out.
CODES = {"\\": "\\\\", "<": "\\l", ">": "\\g", '"': "\\q", "\x00": "\\0"}
_OUT = re.compile('[\\\\<>"\x00]')
_BACK = {v: k for k, v in CODES.items()}
_IN = re.compile(r"\\.", re.S)
_TURN = re.compile(r'<turn role="([^"]*)">([^<]*(?:<(?:image|audio|document|other) \d+>[^<]*)*)</turn>\n')


def escape(text: str) -> str:
    return _OUT.sub(lambda m: CODES[m[0]], text)


def unescape(text: str) -> str:
    return _IN.sub(lambda m: _BACK[m[0]], text)


def _size(value: object) -> float:
    """A size that a part states, 0 if it states none."""
    return float(value) if isinstance(value, (int, float)) and 0 < value < math.inf else 0.0


@dataclass
class Attachment:
    kind: str
    ref: str
    number: int  # of the placeholder
    at: int  # code points before the placeholder in the content
    tokens: int  # that the placeholder expands to


@dataclass
class Visitor:
    """Flattens parts in order. Token counts follow the sizes that the parts state."""

    tile: int = 512
    tile_tokens: int = 170
    base_tokens: int = 85
    audio_rate: float = 12.5
    chars_per_token: int = 4
    out: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, part: dict | None) -> None:
        if part is None:
            return
        known = {"text": self.visit_text, "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        known.get(part.get("type") or "text", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, math.ceil(_size(part.get(side)) / self.tile)) for side in ("width", "height"))
        self._attach("image", part, self.base_tokens + self.tile_tokens * across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, round(_size(part.get("seconds")) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, math.ceil(_size(part.get("chars")) / self.chars_per_token)))

    def visit_other(self, part: dict) -> None:
        self._attach("other", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments) + 1
        self.attachments.append(Attachment(kind, part.get("ref") or "", n, sum(map(len, self.out)), tokens))
        self.out.append(f"<{kind} {n}>")

    def tokens(self) -> int:
        """Expanded count: attachments as given, text by its length."""
        chars = sum(len(x) for x in self.out if not re.fullmatch(r"<(?:image|audio|document|other) \d+>", x))
        return sum(a.tokens for a in self.attachments) + -(-chars // self.chars_per_token)


def flatten(parts: list[dict]) -> Visitor:
    visitor = Visitor()
    for part in parts:
        visitor.visit(part)
    return visitor


def format_turn(role: str | None, parts: list[dict]) -> tuple[str, Visitor]:
    """A turn as text, and what its parts gave."""
    seen = flatten(parts)
    return f'<turn role="{escape(role or "")}">{"".join(seen.out)}</turn>\n', seen


def read_turns(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, content, span of the content) of each turn; text that is no turn is an error."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        yield unescape(m[1]), unescape(m[2]), m.span(2)
    if at != len(formatted):
        raise ValueError("text after the last turn")


def loss_spans(formatted: str, roles: tuple[str, ...] = ("assistant",)) -> list[tuple[int, int]]:
    """Spans of the formatted text that count for the loss."""
    return [span for role, _, span in read_turns(formatted) if role in roles]


FORMATTED = "conv_id long, turn long, formatted string, tokens long, attachments array<struct<kind:string,ref:string,number:int,at:long,tokens:long>>"
_ATTACHED = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("number", pa.int32()), ("at", pa.int64()), ("tokens", pa.int64())]))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to formatted turns, each where it lies.

    ``parts`` is an array of structs with type, text, ref, width, height, seconds and chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(role.as_py(), parts.as_py() or []) for role, parts in zip(batch.column(2), batch.column(3), strict=True)]
            attached = pa.array([[vars(a) for a in seen.attachments] for _, seen in made], _ATTACHED)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in made], pa.string()), pa.array([s.tokens() for _, s in made], pa.int64()), attached], names=["conv_id", "turn", "formatted", "tokens", "attachments"])

    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(run, FORMATTED)


def in_order(formatted: DataFrame) -> DataFrame:
    """Formatted turns dealt by conversation, each conversation in order."""
    return formatted.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "formatted")


def text_parts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Turns of plain text as turns of one text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), *(F.lit(None).cast(k).alias(n) for n, k in (("width", "int"), ("height", "int"), ("seconds", "double"), ("chars", "int"))))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.array(part).alias("parts"))


def digests(formatted: DataFrame) -> DataFrame:
    """Reads formatted turns back, stream by stream, into one row a conversation."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: object = run  # no conversation yet
        count = [0] * 5
        turns = loss = None

        def row() -> tuple:
            return here, count[0], turns.hexdigest(), count[1], loss.hexdigest(), count[2], count[3], count[4]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        for batch in batches:
            done: list[tuple] = []
            for conv, text, tokens, attached in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                conv, text = conv.as_py(), text.as_py()
                if here is run or conv != here:
                    if here is not run:
                        done.append(row())
                    here, count, turns, loss = conv, [0] * 5, hashlib.sha256(), hashlib.sha256()
                for role, content, _ in read_turns(text):
                    turns.update(f"{role}\n{content}\n".encode("utf-8", "surrogatepass"))
                    count[0] += 1
                for lo, hi in loss_spans(text):
                    said = unescape(text[lo:hi])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    count[1] += len(said)
                count[2] += len(text)
                count[3] += attached.as_py()
                count[4] += tokens.as_py()
            if done:
                yield made(done)
        if here is not run:
            yield made([row()])

    rows = formatted.select("conv_id", "turn", "formatted", "tokens", F.size("attachments").cast("long").alias("n_attachments"))
    return in_order(rows).drop("turn").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")
