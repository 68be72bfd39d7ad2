"""Places where a model is called, and the plain text work before and after the call.

A slot is a function of Columns or DataFrames. What ships here is deterministic and makes no
claim to be a model; a real one is passed in its place.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

Embedder = Callable[[list[str]], np.ndarray]
BATCH = 32
_FIELD = re.compile("[^ \t\n\x0b\f\r]+")


def echo_model(prompt: Column) -> Column:
    """Stands for a text model: says the prompt."""
    return F.concat(F.lit("echo: "), prompt)


def hashed_embedder(dim: int) -> Embedder:
    """Stands for an embedding model: words dealt to ``dim`` signed buckets, normalised."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=4).digest()
                out[i, int.from_bytes(h[:3], "little") % dim] += 1 if h[3] & 1 else -1
            if not out[i].any():  # words that cancel out, or none: the text as one word
                out[i, int.from_bytes(hashlib.blake2b(text.encode(), digest_size=3).digest(), "little") % dim] = 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return run


@functools.lru_cache(maxsize=1 << 16)
def _place(word: str) -> tuple[int, int]:
    h = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
    return int(h[:6], 16), 1 if int(h[6], 16) & 1 else -1


def counted_embedder(dim: int) -> Embedder:
    """Stands for an embedding model: words dealt to ``dim`` signed buckets by MD5, in whole
    numbers (a cosine needs no unit length)."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for word, n in Counter(_FIELD.findall(text.lower())).items():
                at, sign = _place(word)
                out[i, at % dim] += sign * n
        return out

    return run


def embed(rows: DataFrame, text_col: str, model: Embedder, prefix: str = "passage: ") -> DataFrame:
    """(h, embedding): each distinct text once, by its hash, in model batches."""
    distinct = rows.select(F.sha2(text_col, 256).alias("h"), F.concat(F.lit(prefix), F.col(text_col)).alias("x")).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                vectors = model(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["h", "embedding"])

    return distinct.mapInArrow(run, "h string, embedding array<float>")


def embed_rows(rows: DataFrame, text_col: str, model: Embedder, prefix: str = "passage: ") -> DataFrame:
    """``rows`` without the text and with its embedding, made where the text lies; equal texts are embedded each."""
    kept = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                vectors = model(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(list(vectors), pa.list_(pa.float32()))], names=[*kept, "embedding"])

    told = rows.select(F.concat(F.lit(prefix), F.col(text_col)).alias("__text"), *kept)
    return told.mapInArrow(run, S.StructType([*(rows.schema[c] for c in kept), S.StructField("embedding", S.ArrayType(S.FloatType()))]))


def fill(template: Column, values: Mapping[str, Column]) -> Column:
    """Names in braces replaced by their values; unknown names stay."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def stable_id(*columns: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 32)


def with_sidecar(markdown: Column, authors: Column) -> Column:
    """The authors as a comment before the text, once."""
    note = F.concat(F.lit("<!-- AUTHORS "), F.to_json(authors), F.lit(" -->\n"))
    return F.when(F.startswith(F.ltrim(markdown), F.lit("<!-- AUTHORS")), markdown).otherwise(F.concat(note, markdown))


def markdown_rows(columns: Sequence[str], order: str) -> Column:
    """Aggregate of rows to lines of a Markdown table; a missing value is a dash."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")


def accepted(draft: Column, corrected: Column, last_source: Column) -> Column:
    """Whether a correction keeps 80 % of the length and the last source's heading."""
    return (F.length(corrected) >= 0.8 * F.length(draft)) & F.contains(corrected, F.concat(F.lit("QUELLE ["), last_source.cast("string"), F.lit("]")))


def warned(draft: Column, failed: Column) -> Column:
    """A warning before each paragraph that holds two or more of the failed quotations."""
    note = '<WARNUNG typ="unverifizierbar">Dieser Absatz beruht womöglich auf nicht belegten Zitaten.</WARNUNG>\n\n'

    def mark(paragraph: Column) -> Column:
        hits = F.size(F.filter(failed, lambda q: F.contains(paragraph, F.substring(q, 1, 40))))
        return F.when(hits >= 2, F.concat(F.lit(note), paragraph)).otherwise(paragraph)

    return F.array_join(F.transform(F.split(draft, "\n\n"), mark), "\n\n")
