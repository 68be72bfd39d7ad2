"""Sparse text features for the two trained operators, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import wordkit

#: Structure statistics that ``structure`` returns, in this order.
STATS = ("log_chars", "log_words", "upper", "digits", "symbols", "marks_end", "non_ascii", "white", "word_length", "distinct_words", "distinct_pairs", "lines", "distinct_lines", "pipes", "bangs", "most_frequent")


def hashed(text: bytes | None, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the words of a text, how often each occurs, and the number of words."""
    h = wordkit.words(text, wordkit.ALNUM)
    where, often = np.unique((h % np.uint64(dim)).astype(np.int64), return_counts=True)
    return where, often, len(h)


def structure(text: bytes | None) -> np.ndarray:
    """Statistics of a whole text, each between 0 and about 1."""
    out = np.zeros(len(STATS))
    if not text:
        return out
    raw = np.frombuffer(text, dtype=np.uint8)
    n = len(raw)
    of = np.bincount(raw, minlength=256)
    h = wordkit.words(text, wordkit.NONSPACE)
    m = max(1, len(h))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = of[0x41:0x5B].sum() + of[0x61:0x7B].sum()
    white = of[0x20] + of[9:14].sum()
    end_marks = of[[0x2E, 0x2C, 0x3A, 0x3B, 0x3F]].sum()
    symbols = of[0x21:0x30].sum() + of[0x3A:0x41].sum() + of[0x5B:0x61].sum() + of[0x7B:0x7F].sum()
    _, times = np.unique(h, return_counts=True)
    out[:] = (
        np.log1p(n) / 12, np.log1p(m) / 10, of[0x41:0x5B].sum() / max(1, letters), of[0x30:0x3A].sum() / n, symbols / m / 4, end_marks / m, of[0x80:].sum() / n, white / n,
        min(2.0, (n - white) / m / 10), len(times) / m, len(np.unique(wordkit.grams(h, 2))) / max(1, m - 1), np.log1p(len(lines)) / 6, len(set(lines)) / max(1, len(lines)), min(1.0, of[0x7C] / m), min(1.0, of[0x21] / m), (times.max() if len(times) else 0) / m,
    )
    return out


def labelled(docs: DataFrame, labels: DataFrame, column: str, bound: int, seed: int, id_col: str = "doc_id", text_col: str = "text", keep=None) -> DataFrame:
    """The rows (id, text, label) of at most ``bound`` labelled ids, taken in the order of a seeded hash.

    The bound is what makes it safe to fit on the driver. Ids are picked from the label
    table alone, so their set is bounded before it is sent to the documents. A document
    with several labels has their rounded mean; of several texts with one id the one with the
    least hash is taken; rows without an id, text or label are left out.
    """
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(column).isNotNull())
    if keep is not None:
        marks = marks.filter(keep(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.round(F.avg(column)).cast("int").alias("label"))
    taken = marks.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(bound)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text")).filter("text is not null")
    found = texts.join(F.broadcast(taken), "id")  # at most ``bound`` ids
    return found.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"), F.first("label").alias("label"))
