"""Ranked lexical search by hierarchical max trees (operator 12).

The items to search for are the stated query set, read in bounded blocks against all documents.
For a block, a first pass counts documents, terms and the documents that hold each item
term. A second pass reads the documents of a task in segments. Over a segment stands a tree of
document ranges: leaves of ``LEAF`` documents, ``FAN`` of which make a node, and so on up to
the root. Each node knows, for every term, the largest impact that the term has on any
document of its range. The bound of a node for an item is the sum of these maxima over the
item's terms. The search opens the node with the highest bound first, and ends when ``k``
documents are found and the highest bound left is below the k-th score. Nodes with a bound
equal to it are opened too, as they may hold a document of equal score and smaller id. The
k-th score goes on from segment to segment of a task. Each task hands out its best ``k`` per
item, which are ranked together in two steps.

All scores are 64-bit integers, so they do not depend on the order of summing. Terms are known
by 64-bit hashes; A-Z count as a-z.

Nulls: a null or empty text has no terms, counts as no document and is in no result; items
without terms have no rows. Items without an id are left out. Repeated rows of an item
count once; different texts of one id are one item with the terms of all. Repeated documents are ranked
each; equal scores are ranked by ascending id, a null id last. Texts are read whole, of any
length. An empty table on either side gives an empty result. Only the id and text columns
are read, so other columns cannot clash.

Memory of a task: the index of a segment, at most ``CELLS`` maxima of leaves (32 MB) and 24 bytes
for each of its postings of item terms.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm import wordkit

BLOCK_BYTES = 4 << 20  # of item texts in a block; one longer item is a block of its own
LEAF, FAN = 32, 8
CELLS = 1 << 22
POSTINGS = 1 << 22  # a segment ends with the document that reaches so many
LAST = 1 << 64  # stands for a null id


@dataclass
class Block:
    """Items of one block: sorted distinct term hashes, and per item its terms and their numbers."""

    terms: np.ndarray
    items: list[tuple[object, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]]) -> Block:
        bags = [(name, np.concatenate([wordkit.words(x, wordkit.ALNUM) for x in texts])) for name, texts in items]
        terms = np.unique(np.concatenate([h for _, h in bags] or [np.empty(0, np.uint64)]))
        return cls(terms, [(name, *(x.astype(np.int64) for x in np.unique(np.searchsorted(terms, h), return_counts=True))) for name, h in bags if len(h)])


def blocks(items: DataFrame, item_id: str, item_text: str, block_bytes: int) -> Iterator[Block]:
    """The items in blocks of bounded text; the driver holds one block at a time."""
    rows = items.select(F.col(item_id).alias("id"), F.encode(F.col(item_text), "UTF-8").alias("text")).filter("id is not null and text is not null").distinct()
    held: list[tuple[object, list[bytes]]] = []
    size = 0
    for row in rows.orderBy("id", "text").toLocalIterator():
        new = not held or held[-1][0] != row["id"]
        if new and held and size + len(row["text"]) > block_bytes:
            yield Block.of(held)
            held, size = [], 0
        if new:
            held.append((row["id"], []))
        held[-1][1].append(bytes(row["text"]))
        size += len(row["text"])
    if held:
        yield Block.of(held)


def _postings(text: bytes | None, terms: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms of a text, which of ``terms`` it has, and how often."""
    h = wordkit.words(text, wordkit.ALNUM)
    if not len(h) or not len(terms):
        return len(h), np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    found, often = np.unique(at[terms[at] == h], return_counts=True)
    return len(h), found, often


def _counts(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents that hold each term of the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        df, n_docs, n_terms = np.zeros(len(terms), dtype=np.int64), 0, 0
        for batch in batches:
            for text in batch.column(1):
                n, found, _ = _postings(text.as_py(), terms)
                df[found] += 1
                n_docs += n > 0
                n_terms += n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[held].tolist()], pa.int64())], names=["term", "n"])

    sums = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(sums.toLocalIterator())  # a row a term of the block
    df = np.zeros(len(shared.value.terms), dtype=np.int64)
    for term, n in found.items():
        if term >= 0:
            df[term] = n
    return found.get(-2, 0), found.get(-1, 0), df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)


class Segment:
    """A run of documents with the max tree of every term.

    ``doc``, ``term`` and ``impact`` are postings; ``levels[0]`` has the maxima of the leaves, a row
    a leaf and a column a term, and each further level those of ``FAN`` nodes of the one below.
    """

    def __init__(self, ids: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> None:
        self.ids, self.n_terms = ids, n_terms
        key = doc // LEAF * n_terms + term
        by = np.argsort(key, kind="stable")
        self.doc, self.impact, key = doc[by], impact[by], key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.key, self.start = key[first], np.append(first, len(key))
        leaves = np.zeros((-(-len(ids) // LEAF), n_terms), dtype=np.int64)
        if len(first):
            leaves.reshape(-1)[self.key] = np.maximum.reduceat(self.impact, first)
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def bounds(self, level: int, lo: int, hi: int, terms: np.ndarray, often: np.ndarray) -> np.ndarray:
        return self.levels[level][lo:hi][:, terms] @ often

    def scores(self, leaf: int, terms: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Scores of the documents of a leaf."""
        want = leaf * self.n_terms + terms
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        met = self.key[at] == want
        at, often = at[met], often[met]
        lo, n = self.start[at], self.start[at + 1] - self.start[at]
        out = np.zeros(LEAF, dtype=np.int64)
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        np.add.at(out, self.doc[where] - leaf * LEAF, self.impact[where] * np.repeat(often, n))
        return out

    def search(self, terms: np.ndarray, often: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Adds documents to ``best``, a heap of (score, minus id); returns the number of nodes opened."""
        if not len(self.ids):
            return 0
        top = len(self.levels) - 1
        heap = [(-int(self.bounds(top, 0, 1, terms, often)[0]), top, 0)]
        opened = 0
        while heap:
            bound, level, node = heapq.heappop(heap)
            if bound == 0 or len(best) == k and -bound < best[0][0]:
                break
            opened += 1
            if level:
                lo = node * FAN
                for i, b in enumerate(self.bounds(level - 1, lo, lo + FAN, terms, often).tolist(), lo):
                    if b > 0 and not (len(best) == k and b < best[0][0]):
                        heapq.heappush(heap, (-b, level - 1, i))
                continue
            scores = self.scores(node, terms, often)
            for i in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == k else 1)).tolist():
                one = (int(scores[i]), -(LAST if (name := self.ids[node * LEAF + i]) is None else name))
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        return opened


def segments(rows: Iterator[tuple[object, bytes | None]], terms: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, cells: int = CELLS) -> Iterator[Segment]:
    """The documents of a task in segments of bounded memory."""
    most = LEAF * max(1, min(1024, cells // max(1, len(terms))))
    ids, docs, found, impacts, held = [], [], [], [], 0

    def made() -> Segment:
        return Segment(ids, *(np.concatenate([np.empty(0, np.int64), *x]) for x in (docs, found, impacts)), len(terms))

    for name, text in rows:
        n, term, often = _postings(text, terms)
        if not len(term):
            continue
        m = 75 + 25 * n * n_docs // n_terms
        docs.append(np.full(len(term), len(ids), dtype=np.int64))
        found.append(term.astype(np.int64))
        impacts.append(weight[term] * (1_000_000_000 * often // (1000 * often + 12 * m)))
        ids.append(name)
        held += len(term)
        if len(ids) == most or held >= POSTINGS:
            yield made()
            ids, docs, found, impacts, held = [], [], [], [], 0
    if ids:
        yield made()


def _best(docs: DataFrame, shared, k: int, item_type: str) -> DataFrame:
    """(item_id, doc_id, score): the best ``k`` documents of each task for each item of a block."""
    spark = docs.sparkSession
    n_docs, n_terms, df = _counts(docs, shared)
    weight = spark.sparkContext.broadcast(weights(df, n_docs))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in block.items]
        rows = ((i.as_py(), text.as_py()) for batch in batches for i, text in zip(batch.column(0), batch.column(1), strict=True))
        for segment in segments(rows, block.terms, weight.value, n_docs, n_terms):
            for (_, terms, often), found in zip(block.items, best, strict=True):
                segment.search(terms, often, found, k)
        for (name, _, _), found in zip(block.items, best, strict=True):
            if found:
                yield pa.RecordBatch.from_pydict({"item_id": [name] * len(found), "doc_id": [None if -i == LAST else -i for _, i in found], "score": [s for s, _ in found]}, schema=pa.schema([("item_id", pa.string() if item_type == "string" else pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return docs.mapInArrow(search, f"item_id {item_type}, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` highest-scoring documents of each item."""
    spark = docs.sparkSession
    item_type = "string" if items.schema[item_id].dataType.simpleString() == "string" else "long"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.col(text_col), "UTF-8").alias("text")).filter("text is not null")
    out = spark.createDataFrame([], f"item_id {item_type}, doc_id long, score long")
    for block in blocks(items.withColumn(item_id, F.col(f"`{item_id}`").cast(item_type)), item_id, item_text, block_bytes):
        found = _best(texts, spark.sparkContext.broadcast(block), k, item_type)
        out = out.union(found)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    few = out.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
