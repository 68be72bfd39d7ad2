"""Interleaved document sequences with media columns (operator 2).

A page is parsed into an ordered sequence of text parts and media references; a reference
keeps its position and caption and names its payload by digest. Payloads lie in a store
with one row a digest. References are resolved by a join on the digest, and positions and
captions stay with their references because the parts are never re-ordered.

``text_media`` stores texts as 8-bit mono PCM (RIFF/WAVE): a sample is a byte of the
payload, whole files are kept, and the samples are read back from the stored file.

Nulls: a null page has no parts and a null text is the empty text. A reference whose digest
is not in the store, or that has none, resolves to null; parts without a digest take no part
in the join, so they gather nowhere. Of store rows with one digest the least counts. A store
column called like a column of the parts comes back with media_ before its name. Equal
texts share one stored payload. Very long texts are stored whole. Empty tables give empty
results. Only named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import markup

UNIT = 192
RATE = 16000
PARTS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
_PARTS = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
_MEDIA = frozenset("img audio video source embed".split())
SCHEME = "media:sha256/"


def sequence(html: str | None) -> list[dict]:
    """Ordered parts of a page; a figure's caption belongs to the media of that figure."""
    parts: list[dict] = []
    text: list[str] = []
    figure: list[dict] | None = None
    caption: list[str] | None = None

    def flush() -> None:
        line = markup.squeeze(text)
        text.clear()
        if line:
            parts.append({"pos": len(parts), "kind": "text", "text": line, "digest": None, "caption": None})

    for kind, tag, rest in markup.events(html or ""):
        if kind == "text":
            (text if caption is None else caption).append(rest)
            continue
        if tag == "figcaption":
            if kind == "open":
                flush()
                caption = []
            elif caption is not None:
                line = markup.squeeze(caption)
                for ref in figure or ():
                    ref["caption"] = line
                caption = None
            continue
        if tag == "figure":
            flush()
            figure = [] if kind == "open" else None
        elif tag in markup.BLOCK:
            flush()
        elif tag == "br":
            (text if caption is None else caption).append(" ")
        if kind == "open" and tag in _MEDIA:
            flush()
            attrs = markup.attributes(rest)
            src = attrs.get("src", "")
            ref = {"pos": len(parts), "kind": tag, "text": None, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": attrs.get("alt") or None}
            parts.append(ref)
            if figure is not None:
                figure.append(ref)
    flush()
    return parts


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, parts) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sequence(x.as_py()) for x in batch.column(1)], _PARTS)], names=["id", "parts"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, parts {PARTS}")


def attach(refs: DataFrame, store: DataFrame, *columns: str) -> DataFrame:
    """``refs``, which have a digest each, with the ``columns`` of a store that has one row a digest."""
    names = [f"media_{c}" if c in refs.columns else c for c in columns]
    held = store.select(F.col("digest").alias("held"), F.struct(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).alias("of_held"))
    return refs.join(held, refs["digest"] == held["held"], "left").select(*(refs[c] for c in refs.columns), *(F.col("of_held").getField(n).alias(n) for n in names))


def resolve(seqs: DataFrame, store: DataFrame, *columns: str) -> DataFrame:
    """One row a part, with the store's ``columns`` for its digest; (id, pos) is the order."""
    parts = seqs.select("id", F.explode("parts").alias("part")).select("id", "part.*").select("id", "pos", "kind", "text", "digest", "caption")
    one = store.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(*columns)).alias("held"))
    # The join deals the digests anew, so that the references of a hot one can be split.
    one = one.select(F.concat("digest", F.lit("")).alias("digest"), *(F.col("held").getField(c).alias(c) for c in columns))
    found = attach(parts.filter("digest is not null"), one, *columns)
    none = [F.lit(None).cast(found.schema[n].dataType).alias(n) for n in found.columns[len(parts.columns) :]]
    return found.union(parts.filter("digest is null").select("*", *none))


def payload(text: bytes) -> bytes:
    """The text and spaces up to a positive multiple of UNIT bytes."""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def to_wave(samples: bytes) -> bytes:
    """A WAVE file of unsigned 8-bit mono samples."""
    pad = len(samples) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * pad


def from_wave(stored: bytes) -> bytes:
    """The samples of a WAVE file, found by its chunks."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at = 12
    while at + 8 <= len(stored):
        name, n = struct.unpack_from("<4sI", stored, at)
        if name == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def feature(samples: bytes) -> str:
    """Length in frames of UNIT samples, mean level and share of frames that begin with a pause."""
    frames = len(samples) // UNIT
    pauses = samples[::UNIT].count(b" ")
    return f"frames={frames};mean={sum(samples) / len(samples):.4f};pauses={pauses};edge={samples[:4].hex()}-{samples[-4:].hex()}"


def _page(text: str, digest: str) -> str:
    """The text as a page: a paragraph a line, its recording after the first."""
    first, *rest = text.split("\n")
    figure = f'<figure><audio src="{SCHEME}{digest}"></audio><figcaption>{escape(first)}</figcaption></figure>'
    return f"<article><p>{escape(first)}</p>{figure}" + "".join(f"<p>{escape(x)}</p>" for x in rest) + "</article>"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, the stored file's figures and how its sequence is laid out.

    The store is made of one file a digest; what is read back from a file is computed once
    there, and the join by digest carries the figures to every reference.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, texts, refs = [], [], []
            for one in batch.column(1):
                text = one.as_py()
                raw = text.encode("utf-8", "surrogatepass")
                parts = sequence(_page(text, hashlib.sha256(to_wave(payload(raw))).hexdigest()))
                media = [p for p in parts if p["kind"] != "text"]
                for p in media:  # a caption can be as long as its text
                    p["caption"] = hashlib.sha256((p["caption"] or "").encode("utf-8", "surrogatepass")).hexdigest()[:16]
                sizes.append(len(raw)), texts.append(len(parts) - len(media)), refs.append(media)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.int64()), pa.array(refs, _PARTS)], names=["id", "n_bytes", "n_texts", "parts"])

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, bytes] = {}
            for one in batch.column(1).cast(pa.large_binary()):
                stored = to_wave(payload(one.as_py()))
                seen.setdefault(hashlib.sha256(stored).hexdigest(), stored)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.binary())], names=["digest", "file"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for one in batch.column(1):
                stored = one.as_py()
                samples = from_wave(stored)
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    refs = rows.mapInArrow(refer, f"id long, n_bytes long, n_texts long, parts {PARTS}").select("id", "n_bytes", "n_texts", F.explode("parts").alias("p")).select("id", "n_bytes", "n_texts", "p.pos", "p.digest", "p.caption")
    store = rows.mapInArrow(record, "digest string, file binary").groupBy("digest").agg(F.first("file").alias("file"))
    figures = store.mapInArrow(read, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    out = attach(refs, figures, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    layout = F.concat_ws(";", "feature", F.concat(F.lit("texts="), "n_texts"), F.concat(F.lit("at="), "pos"), F.concat(F.lit("caption="), "caption"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", layout.alias("feature"))
