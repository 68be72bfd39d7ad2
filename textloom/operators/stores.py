"""Keyed rows and tables that are kept in a folder and changed in place.

``Ignoring`` takes rows whose key it does not have and ignores the others. ``Buckets`` is a table in
partitions by a hash of one column; a change reads, computes and overwrites the partitions of
the keys it names and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textloom.session import remove, settle


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Ignoring:
    """Rows by ``key``, of which the first one stays.

    Rows come in numbered batches; within a batch the least by ``order`` comes first. A batch takes
    the keys that no batch before it has, so that one that is run again writes the same rows again.
    Null keys are keys like others. With ``most`` only the newest so many keys are held: after every batch the
    ones inserted first go (a key that is asked for again does not move), and one that comes back
    later is new.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str], order: Sequence[str], most: int | None = None) -> None:
        self.spark, self.path, self.key, self.order, self.most = spark, path, list(key), list(order), most
        self.schema = S.StructType.fromDDL(schema)

    def _all(self) -> DataFrame:
        schema = S.StructType([*self.schema.fields, S.StructField("batch", S.LongType())])
        return self.spark.read.schema(schema).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def rows(self, before: int | None = None) -> DataFrame:
        """What is held now, or was before a batch."""
        held = self._all() if before is None else self._all().filter(F.col("batch") < before)
        if self.most is None:
            return held
        newest = held.groupBy(*self.key).agg(F.max(F.struct("batch", *self.order)).alias("__in"))
        newest = newest.orderBy(F.desc("__in"), *self.key).limit(self.most)
        return self._with(held, newest).filter(F.col("batch") == F.col("__in.batch")).drop("__in")

    def _with(self, rows: DataFrame, keys: DataFrame, how: str = "inner") -> DataFrame:
        a, b = rows.alias("a"), keys.alias("b")
        on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.key]
        found = a.join(b, on, how)
        return found if how != "inner" else found.select("a.*", *(F.col(f"b.{c}") for c in keys.columns if c not in self.key))

    def put(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows that a batch inserts; they are written before it returns."""
        first = rows.select(*self.schema.names).withColumn("__n", F.row_number().over(W.partitionBy(*self.key).orderBy(*self.order))).filter("__n = 1").drop("__n")
        new = settle(self._with(first, self.rows(batch).select(*self.key), "left_anti"))
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return new


class Buckets:
    """A table in ``buckets`` partitions by a hash of ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: S.StructType, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def bucket(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        self._put(rows)

    def _put(self, rows: DataFrame) -> None:
        dealt = rows.withColumn("bucket", self.bucket(F.col(self.key))).repartition(self.buckets, "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def rows(self) -> DataFrame:
        return self._all().drop("bucket")

    def _all(self) -> DataFrame:
        return self.spark.read.schema(S.StructType([*self.schema.fields, S.StructField("bucket", S.IntegerType())])).parquet(self.path)

    def change(self, keys: Sequence, change: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrites the partitions of the keys by a function of their rows; it has to leave rows of other keys alone."""
        kind = self.schema[self.key].dataType
        where = self.spark.createDataFrame([(k,) for k in keys], S.StructType([S.StructField("k", kind)])).select(self.bucket(F.col("k")).alias("b")).distinct()
        wanted = sorted(r["b"] for r in where.collect())  # a row a key named
        held = self._all().filter(F.col("bucket").isin(wanted))
        new = settle(change(held.drop("bucket")))
        self._put(new)
        left = {r["b"] for r in new.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}
        for b in wanted:
            if b not in left:  # an empty partition is not overwritten
                remove(self.spark, f"{self.path}/bucket={b}")
        self.spark.catalog.refreshByPath(self.path)

    def delete(self, keys: Sequence, also: Column | None = None) -> None:
        """Rows of the keys go, or those of them for which ``also`` is true."""
        hit = F.col(self.key).isin(*keys) & (F.coalesce(also, F.lit(False)) if also is not None else F.lit(True))
        self.change(keys, lambda rows: rows.filter(~F.coalesce(hit, F.lit(False))))

    def update(self, keys: Sequence, values: dict[str, Column], also: Column | None = None) -> None:
        """New values for the rows of the keys, or those of them for which ``also`` is true; columns that do not exist are left out."""
        hit = F.coalesce(F.col(self.key).isin(*keys) & (also if also is not None else F.lit(True)), F.lit(False))
        self.change(keys, lambda rows: rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items() if c in rows.columns}))


def cascade(tables: Sequence[Buckets], keys: Sequence) -> None:
    """Deletes the rows of the keys from one table after the other; a repeated call finds nothing left to do."""
    for table in tables:
        table.delete(keys)
