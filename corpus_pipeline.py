"""From documents to training shards: filter, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontam, dedup, mixing, sharding, toxicity
from textloom.session import remove, shared_folder, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal model rejects go; it is fitted on all documents with labels."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn so that sources, languages and topics near their target weights."""
    return mixing.keep_drawn(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.deal(docs)


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: No SQL expresses the fitted filter and the signatures; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again.

    The files go to the shared folder of ``spark.checkpoint.dir``; a stage's files are
    deleted once the next stage is written.
    """
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{at}/{name}"
    return docs
