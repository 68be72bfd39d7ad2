"""Benchmark decontamination by winnowing (operator 9).

Of each run of ``window - k + 1`` k-grams the least hash is kept, rightmost on ties, so
every shared span of ``window`` words leaves a common fingerprint in the document and in
the item. Each hit is extended to the windows of ``window`` words around it: those that an
item has make the shared span. Items with fewer words are one window of their own length
and are looked up by that length. A window that repeats, in an item or in a document, is
looked up once, so runs of one word cost no more than other texts.

The items are the stated query set. Up to ``joined_from`` bytes of them are read in blocks of at
most ``block_bytes`` of text, one broadcast index a block, and the documents stream through
the blocks without a shuffle, so neither a hot passage nor a copied document gathers
anywhere. Beyond that, fingerprints and then windows are joined by hash (``_joined``).

Nulls: a null text has no words; a null item id counts as the empty string. Repeated
items of one id count once, equal texts of several ids for each id. Very long texts are read
whole. An empty benchmark hits nothing, an empty table gives an empty result. Only the id
and text columns are read; ``clean`` hands every column through.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import wordkit
from textloom.session import settle

BLOCK_BYTES = 16 << 20
JOINED_FROM = 256 << 20


def winnow(h: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes and the places they start at, for shared spans of ``window`` words."""
    g = wordkit.grams(h, k)
    width = window - k + 1
    if len(g) < width:
        return g[:0], np.empty(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.arange(len(views)) + (width - 1 - views[:, ::-1].argmin(axis=1))
    at = np.unique(at)
    return g[at], at


def _item(text: bytes | None, window: int, k: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Length of an item's windows, their hashes and the fingerprints that lead to them."""
    h = wordkit.words(text, wordkit.ALNUM)
    if not len(h):
        return 0, h, h
    n = min(window, len(h))
    found = np.unique(wordkit.grams(h, n))
    return n, found, found if n < window else np.unique(winnow(h, k, window)[0])


def _within(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``of``."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _around(h: np.ndarray, prints: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows around the fingerprints of a text that are in ``prints``, and their hashes."""
    g, at = winnow(h, k, window)
    at = at[_within(g, prints)]
    reach = np.arange(window - k + 1)
    starts = np.unique(at[:, None] - reach) if len(at) else at
    starts = starts[(starts >= 0) & (starts <= len(h) - window)]
    acc = np.zeros(len(starts), dtype=np.uint64)
    for j in range(window):  # as wordkit.grams does
        acc = acc * wordkit.GRAM + h[starts + j]
    return starts, wordkit.mix(acc ^ np.uint64(window))


class Index:
    """Fingerprints and windows of one block of items, ready for lookups in a worker."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, k: int) -> None:
        self.window, self.k, self.ids = window, k, [name for name, _ in items]
        hashes, owners, prints = defaultdict(list), defaultdict(list), [np.empty(0, dtype=np.uint64)]
        for number, (_, text) in enumerate(items):
            n, found, heads = _item(text, window, k)
            if n:
                hashes[n].append(found), owners[n].append(np.full(len(found), number, dtype=np.int32))
                if n == window:
                    prints.append(heads)
        self.prints = np.unique(np.concatenate(prints))
        #: By length: the windows in order, and the item of each.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in hashes:
            all_of = np.concatenate(hashes[n])
            order = np.argsort(all_of, kind="stable")
            self.windows[n] = all_of[order], np.concatenate(owners[n])[order]

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """By length: starts of the windows that items have, the length, and the distinct hashes found."""
        for n, (known, _) in self.windows.items():
            if n < self.window:
                g = wordkit.grams(h, n)
                starts = np.arange(len(g))
            else:
                starts, g = _around(h, self.prints, self.window, self.k)
            hit = _within(g, known)
            if hit.any():
                yield starts[hit], n, np.unique(g[hit])

    def names(self, n: int, found: np.ndarray) -> set[str]:
        """Ids of the items that have one of the windows."""
        known, owner = self.windows[n]
        lo, hi = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
        return {self.ids[i] for i in np.unique(np.concatenate([owner[a:b] for a, b in zip(lo, hi, strict=True)]))}


def _spans(length: int, hits: list[tuple[np.ndarray, int]]) -> list[tuple[int, int]]:
    """Merged (from, to) of windows given by starts and length."""
    step = np.zeros(length + 1, dtype=np.int64)
    for starts, n in hits:
        np.add.at(step, starts, 1)
        np.add.at(step, starts + n, -1)
    inside = np.concatenate([[False], np.cumsum(step) > 0])
    return list(zip(np.flatnonzero(inside[1:] & ~inside[:-1]).tolist(), np.flatnonzero(inside[:-1] & ~inside[1:]).tolist(), strict=True))


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded text; each row is in one block."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text")).filter("text is not null")
    block, held = [], 0
    for row in rows.toLocalIterator():
        if block and held + len(row["text"]) > block_bytes:
            yield block
            block, held = [], 0
        block.append((row["id"], bytes(row["text"])))
        held += len(row["text"])
    if block:
        yield block


def _broadcast_blocks(items: DataFrame, window: int, k: int, id_col: str, text_col: str, block_bytes: int) -> Iterator[Broadcast]:
    """An index a block, or an empty one; the driver holds one block at a time."""
    made = False
    for block in blocks(items, id_col, text_col, block_bytes):
        made = True
        yield items.sparkSession.sparkContext.broadcast(Index(block, window, k))
    if not made:
        yield items.sparkSession.sparkContext.broadcast(Index([], window, k))


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


_SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _bytes_of(items: DataFrame, text_col: str) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]


def scan(
    docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, joined_from: int = JOINED_FROM
) -> DataFrame:
    """Per row of ``docs``: doc_id, text, n_words, spans (merged word spans) and items (their ids, sorted)."""
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<lo:long,hi:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, text string, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"
    if _bytes_of(items, item_text) > joined_from:
        return _joined(found.select("doc_id", "text"), items, window, k, item_id, item_text, schema)
    for shared in _broadcast_blocks(items, window, k, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                counts, spans, items = [], [], []
                for text, before, names in zip(batch.column(1).cast(pa.large_binary()), batch.column(3), batch.column(4), strict=True):
                    h = wordkit.words(text.as_py(), wordkit.ALNUM)
                    hits = list(index.hits(h)) if len(h) else []
                    counts.append(len(h))
                    had = [(s["lo"], s["hi"]) for s in before.as_py() or []]
                    spans.append([{"lo": lo, "hi": hi} for lo, hi in (_merge(had + _spans(len(h), [x[:2] for x in hits])) if hits else had)])
                    items.append(sorted({*(names.as_py() or []), *(name for _, n, g in hits for name in index.names(n, g))}))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])

        found = found.mapInArrow(run, schema)
    return found


def _flat(rows: DataFrame, make, name: str, kind: str) -> DataFrame:
    """Rows (id, text) or (id, text, more) to rows (id, n, hash): ``make`` yields (n, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a row at a time: one text can give many
                text = batch.column(1)[i].cast(pa.large_binary()).as_py()
                for n, hashes in make(text, *(c[i].as_py() for c in batch.columns[2:])):
                    if len(hashes):
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(hashes), batch.column(0).type), pa.array(np.full(len(hashes), n)), pa.array(hashes.view(np.int64))], names=[name, "n", "hash"])

    return rows.mapInArrow(run, f"{name} {kind}, n long, hash long")


def _joined(docs: DataFrame, items: DataFrame, window: int, k: int, item_id: str, item_text: str, schema: str) -> DataFrame:
    """``scan`` by shuffled joins, for items too many to send to every task.

    Texts are known by a digest. Fingerprints that an item has lead from all texts to the few with
    hits; the windows around these are joined to the windows of the items, and what a
    text has of them goes back to its rows.
    """
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.encode(F.col(item_text), "UTF-8").alias("text")).filter("text is not null")

    def windows(text):
        n, found, _ = _item(text, window, k)
        yield n, found

    def heads(text):
        n, _, found = _item(text, window, k)
        yield n, found

    known = settle(_flat(named, windows, "item", "string").distinct())
    prints = settle(_flat(named, heads, "item", "string").select("n", "hash").distinct())
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # at most ``window`` of them

    def of_text(text):
        h = wordkit.words(text, wordkit.ALNUM)
        for n in lengths:
            yield n, np.unique(winnow(h, k, window)[0] if n == window else wordkit.grams(h, n))

    def near(text, marks):
        h = wordkit.words(text, wordkit.ALNUM)
        by: dict[int, list[int]] = defaultdict(list)
        for mark in marks:
            by[mark["n"]].append(mark["hash"])
        for n, found in by.items():
            found = np.sort(np.array(found, dtype=np.int64).view(np.uint64))
            yield n, found if n < window else np.unique(_around(h, found, window, k)[1])

    digest = F.sha2(F.encode(F.col("text"), "UTF-8"), 256)
    keyed = docs.filter("text is not null").select(digest.alias("key"), "text")
    met = _flat(keyed, of_text, "key", "string").join(prints, ["n", "hash"], "left_semi").distinct()
    marks = settle(met.groupBy("key").agg(F.collect_list(F.struct("n", "hash")).alias("marks")))  # no more than a text has words
    around = _flat(keyed.join(marks, "key").select("key", "text", "marks"), near, "key", "string").distinct()
    hits = settle(around.join(known, ["n", "hash"]).select("key", "n", "hash", "item"))
    of_key = hits.groupBy("key").agg(F.collect_set(F.struct("n", "hash")).alias("marks"), F.array_sort(F.collect_set("item")).alias("items"))
    rows = docs.withColumn("key", digest).join(of_key, "key", "left").select("doc_id", "text", "marks", "items")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans = [], []
            for text, marks in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                h, by = wordkit.words(text.as_py(), wordkit.ALNUM), defaultdict(list)
                for mark in marks.as_py() or []:
                    by[mark["n"]].append(mark["hash"])
                hits = [(np.flatnonzero(_within(wordkit.grams(h, n), np.sort(np.array(found, dtype=np.int64).view(np.uint64)))), n) for n, found in by.items()]
                counts.append(len(h))
                spans.append([{"lo": lo, "hi": hi} for lo, hi in _spans(len(h), hits)])
            items = pa.array([x.as_py() or [] for x in batch.column(3)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), items], names=["doc_id", "text", "n_words", "spans", "items"])

    return rows.mapInArrow(place, schema)


def report(scanned: DataFrame) -> DataFrame:
    """Counts and digests of what ``scan`` found."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return scanned.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(
    docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, joined_from: int = JOINED_FROM
) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    if _bytes_of(items, item_text) > joined_from:
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), F.col(text_col).alias("text"))
        kept = scan(rows, items, window, k, "doc_id", "text", item_id, item_text, block_bytes, joined_from).filter(F.size("spans") == 0)
        return kept.select(*(F.col("doc_id").getField(c).alias(c) for c in docs.columns))
    for shared in _broadcast_blocks(items, window, k, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
                keep = [next(index.hits(wordkit.words(x.as_py(), wordkit.ALNUM)), None) is None for x in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
