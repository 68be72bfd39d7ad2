"""A vector index that is kept in a folder, by cells around centroids.

Centroids are fitted on a bounded sample; every vector is then written to the cell of its
nearest centroid (by cosine). A search probes the cells nearest to each query and reads no others.
``search(exact=True)`` goes on: no vector of a cell can be nearer to a query than the angle
to the centroid less the cell's widest angle, so the cells that this bound cannot rule out are read
too, and the result is that of a full scan.

Nulls: a null or zero vector has no direction and is in no cell and no result. Vectors of another length
than the sample's first are an error. Ties are ranked by id. Repeated rows are found each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import settle

SAMPLE = 20_000  # vectors that the centroids are fitted on
ROUNDS = 12
BLOCK = 8192  # vectors of a cell, and queries to it, that one step holds
SLICE = 256  # queries that are scored at once
#: Angles are compared with this much room for rounding.
SLACK = 1e-6


def unit(vector: Column) -> Column:
    """The vector as doubles of length one; null for one without a direction."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length > 0, F.transform(v, lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of at most ``cells`` groups of unit vectors, by rounds of assignment and mean."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    out = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(ROUNDS):
        of = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, of, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), out)
    return out


class Index:
    """The index in ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, cells: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> None:
        """Fits centroids on ``sample`` vectors, in the order of a seeded hash, and writes all vectors by cell."""
        rows = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v")).filter("v is not null")
        taken = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("v").toArrow()
        fitted = centroids(np.array(taken.column(0).to_pylist(), dtype=np.float64).reshape(taken.num_rows, -1), cells, seed) if taken.num_rows else np.empty((0, 0))
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted)], "cell int, centroid array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centroids")
        dealt = _assigned(rows, self.spark.sparkContext.broadcast(fitted))
        dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        held = self.vectors().groupBy("cell").agg(F.min("near").alias("least"), F.count("*").alias("n"))
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")

    def vectors(self) -> DataFrame:
        """(id, v, near, cell): all vectors, with the cosine to their centroid."""
        return self.spark.read.schema("id long, v array<double>, near double, cell int").parquet(f"{self.path}/vectors")

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query, q, cell, near, most): each query with each cell and the highest cosine that a vector there may have."""
        cells = self.spark.read.parquet(f"{self.path}/centroids").join(self.spark.read.schema("cell int, least double, n long").parquet(f"{self.path}/cells"), "cell")
        pairs = queries.crossJoin(F.broadcast(cells))  # by the cells, whose number is a parameter
        angle = lambda c: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
        pairs = pairs.withColumn("near", dot(F.col("q"), F.col("centroid")))
        most = F.cos(F.greatest(F.lit(0.0), angle(F.col("near")) - angle(F.col("least")) - SLACK))
        return pairs.select("query", "q", "cell", "near", most.alias("most"))

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """(query, id, score, rank): the ``k`` nearest of each query, from its nearest ``probes`` cells or exactly."""
        asked = queries.select(F.col(id_col).alias("query"), unit(F.col(vector_col)).alias("q")).filter("q is not null")
        pairs = self.bounds(asked).withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "cell")))  # a row a cell and query
        pairs = settle(pairs) if exact else pairs
        first = self._best(pairs.filter(F.col("place") <= probes), k)
        if not exact:
            return first
        first = settle(first)
        floor = first.filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        more = pairs.filter(F.col("place") > probes).join(floor, "query", "left").filter(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - SLACK))
        return _ranked(first.select("query", "id", "score").union(self._best(more, k).select("query", "id", "score")), k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
        """The least number of cells that finds the share ``recall`` of the exact nearest of some queries."""
        found = self.search(queries, k, exact=True, id_col=id_col, vector_col=vector_col)
        asked = queries.select(F.col(id_col).alias("query"), unit(F.col(vector_col)).alias("q")).filter("q is not null")
        places = self.bounds(asked).withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("near"), "cell"))).select("query", "cell", "place")
        met = found.select("query", "id").join(self.vectors().select("id", "cell").distinct(), "id").join(places, ["query", "cell"])
        at = met.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()  # a row a cell
        total, seen = sum(r["n"] for r in at), 0
        for r in at:
            seen += r["n"]
            if seen >= recall * total:
                return r["place"]
        return 1

    def _best(self, pairs: DataFrame, k: int) -> DataFrame:
        """The ``k`` nearest of each query in its cells. Large cells, and the queries to one, are cut into blocks, and every two blocks of a cell meet once."""
        blocks = lambda n, name: F.ceil(n / BLOCK).cast("int").alias(name)
        asked = pairs.select("cell", F.col("query").cast("long").alias("id"), F.col("q").alias("v"))
        held = self.spark.read.schema("cell int, least double, n long").parquet(f"{self.path}/cells").select("cell", blocks(F.col("n"), "n_held"))
        sizes = F.broadcast(asked.groupBy("cell").agg(blocks(F.count("*"), "n_asked")).join(held, "cell"))  # a row a cell

        def dealt(rows: DataFrame, own: str, other: str) -> GroupedData:
            at = F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int").alias(own)
            each = F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other)
            return rows.join(sizes, "cell").select("cell", "id", "v", at, each).groupBy("cell", "held", "asked")

        met = dealt(self.vectors().select("cell", "id", "v"), "held", "asked").cogroup(dealt(asked, "asked", "held"))
        return _ranked(met.applyInArrow(functools.partial(_nearest, k=k), "query long, id long, score double"), k)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows, by id."""
    ids = table.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]


def _nearest(held: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """(query, id, score): the ``k`` nearest of ``held`` to each of ``asked``, equal scores by id."""
    out: list[tuple[np.ndarray, ...]] = []
    if held.num_rows and asked.num_rows:
        (ids, v), (queries, q) = _matrix(held), _matrix(asked)
        for at in range(0, len(queries), SLICE):
            score = np.round(q[at : at + SLICE] @ v.T, 9)
            least = np.partition(score, -k, axis=1)[:, -k, None] if k < len(ids) else -np.inf
            row, column = np.nonzero(score >= least)
            found = score[row, column]
            order = np.lexsort((column, -found, row))
            row, column, found = row[order], column[order], found[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((queries[at + row[first]], ids[column[first]], found[first]))
    names, kinds = ("query", "id", "score"), (pa.int64(), pa.int64(), pa.float64())
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
    return pa.table({n: pa.array(c, kind) for n, c, kind in zip(names, columns, kinds, strict=True)})


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def _assigned(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(id, v, near, cell) by the nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).values.to_numpy().reshape(batch.num_rows, -1)
            near = v @ fitted.T
            cell = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near[np.arange(len(v)), cell]), pa.array(cell.astype(np.int32))], names=["id", "v", "near", "cell"])

    return rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "id long, v array<double>, near double, cell int")
