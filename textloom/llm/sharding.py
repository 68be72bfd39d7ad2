"""Two-pass external shuffle into shards (operator 8, native).

Pass 1 scatters records by a seeded hash into buckets of about ``bucket_bytes``. Pass 2
reads a bucket as one partition, puts its records in the order of their keys, shuffles them by
Fisher-Yates (Spark's seeded ``shuffle`` of an array) and deals the buckets, one after the
other, round robin over the shards (law ``rows``: shard sizes differ by one row at most).
``plan`` says where each record goes and ``deal`` hands out the records themselves; both use
the same key, so they agree. Rows of ``deal`` lie bucket by bucket in shuffled order, and are
written so.

The key of a record is 128 bits of a hash of all its columns, with a number for each copy of
a repeated record. So copies, however many, are scattered like other records, and ties are
equal in every column. The swaps of a bucket depend on the seed, its number and its size, but on
no setting and no row order: a bucket that is made again after a lost executor comes out in
the same order.

Nulls: a null text has size 8 and the crc32 of no bytes; a null id is a value like any
other. Very long texts fill a bucket of their own size. An empty table gives an empty
result. In ``deal`` an input column called shard or slot comes back as input_shard or
input_slot. Columns of map type cannot be hashed and are not supported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.session import settle

BUCKET_BYTES = 64 << 20
PAD = 8
COPIES = 10_000  # of a repeated record that one task makes at a time


def size_of(text_col: str) -> Column:
    return (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + PAD).cast("long")


def _keyed(docs: DataFrame, row: Column, text_col: str) -> DataFrame:
    """(row, size, a, b): what is carried of each record, and 128 bits of all its columns."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    a, b = (F.xxhash64(F.lit(seed), *columns, *(c.isNull() for c in columns)) for seed in (1, 2))
    return docs.select(row.alias("row"), size_of(text_col).alias("size"), a.alias("a"), b.alias("b"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: 0 for the only record of a key, 0, 1, 2 ... for repeated ones.

    Only repeated records are moved; partial aggregation makes one of them where they lie, and
    their copies are made in chunks by many tasks.
    """
    often = settle(rows.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"))
    once = rows.join(often, ["a", "b"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    again = rows.join(often, ["a", "b"], "left_semi").select("row", "size", "a", "b").groupBy("a", "b").agg(F.first("row").alias("row"), F.first("size").alias("size"), F.count("*").alias("n"))
    zero, step = F.lit(0).cast("long"), F.lit(COPIES).cast("long")
    chunks = again.withColumn("chunk", F.explode(F.sequence(zero, F.floor((F.col("n") - 1) / step)))).repartition("a", "b", "chunk")
    copies = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * step, F.least((F.col("chunk") + 1) * step, F.col("n")) - 1)))
    return once.select("row", "size", "a", "b", "copy").union(copies.select("row", "size", "a", "b", "copy"))


def _places(rows: DataFrame, n_shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """(row, size, bucket, place, shard, slot) of rows that have size, a and b.

    Partition and bucket are one, so that the draws of a bucket come from the seed and its number alone.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_buckets = max(1, -(-total // bucket_bytes))
    rows = _numbered(rows).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "a", "b", "copy"), F.lit(n_buckets)).cast("int"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row a bucket
    starts = counts.select(F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    held = rows.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("a", "b", "copy", "size", "row"))).alias("records"))
    shuffled = held.join(F.broadcast(starts), F.col("bucket") == F.col("of")).select("bucket", "start", F.shuffle("records", F.lit(seed)).alias("records"))  # starts: a row for each ``bucket_bytes``
    at = shuffled.select("bucket", "start", F.posexplode("records").alias("pos", "record"))
    at = at.select("record.row", "record.size", "bucket", (F.col("start") + F.col("pos")).alias("place"))
    return at.withColumns({"shard": F.pmod("place", F.lit(n_shards)).cast("int"), "slot": F.floor(F.col("place") / n_shards).cast("long")})


def plan(docs: DataFrame, n_shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where each record goes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    row = F.struct(F.col(id_col).alias("doc_id"), crc.alias("text_crc32"))
    out = _places(_keyed(docs, row, text_col), n_shards, seed, bucket_bytes)
    return out.select("row.doc_id", "size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def deal(docs: DataFrame, n_shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records themselves with their shard and slot, each bucket in shuffled order."""
    names = {c: f"input_{c}" if c in ("shard", "slot") else c for c in docs.columns}
    row = F.struct(*(F.col(f"`{c}`").alias(name) for c, name in names.items()))
    out = _places(_keyed(docs, row, text_col), n_shards, seed, bucket_bytes)
    return out.select(*(F.col("row").getField(name).alias(name) for name in names.values()), "shard", "slot")
