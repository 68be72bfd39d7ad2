"""Folders of exports in, result files out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import importers

FORMATS = ("parquet", "json", "csv", "orc")


def read_exports(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row a message of every export below a path: file, platform, pos, role, content, model_name.

    The platform is told by content, then by extension; text that tells nothing is read as plain text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.try_validate_utf8("content")
    name, _ = importers.sniff(F.coalesce(text, F.lit("")), F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    told = files.select("path", "content", F.coalesce(name, F.lit("text")).alias("platform"))
    return importers.flat(importers.read_messages(told, "path", "content", "platform")).withColumnRenamed("id", "file")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole text files, such as Markdown run files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def write_rows(rows: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Rows as files of one of the formats; CSV gets nested columns as JSON."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    if kind == "csv":
        nested = [f.name for f in rows.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        rows = rows.withColumns({c: F.to_json(c) for c in nested})
    writer = rows.write.mode("overwrite").partitionBy(*partition_by)
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)


def write_markdown(rows: DataFrame, path: str, key: str, markdown: str) -> None:
    """One Markdown text a row, in folders by key."""
    rows.select(F.col(key).alias("key"), F.col(markdown).alias("value")).write.mode("overwrite").partitionBy("key").option("lineSep", "\n").text(path)
