"""The canonical tables (chats, messages, chunk registry, reviews) from the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 4000, 1200


def chats(documents: DataFrame) -> DataFrame:
    """A chat a document: id, title (blank for some), updated, model_name, chunk_count, skipped_chunks."""
    i = F.col("doc_id")
    count = F.when(i % 7 == 0, None).when(i % 7 == 1, 0).otherwise(F.floor(F.col("n_chars") / (CHUNK - OVERLAP)) + 1).cast("long")
    return documents.select(
        i.cast("string").alias("id"), F.when(i % 11 == 0, "").otherwise(F.concat_ws(" ", "source", i.cast("string"))).alias("title"), (i * 37 % 1000).alias("updated"), F.when(i % 5 == 0, None).otherwise(F.col("lang")).alias("model_name"), count.alias("chunk_count"), (i % 4).alias("skipped_chunks")
    )


def messages(conversations: DataFrame) -> DataFrame:
    """A message a turn; the assistant's role is called model."""
    role = F.when(F.col("role") == "assistant", "model").otherwise(F.col("role"))
    return conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("chat_id"), "turn", role.alias("role"), F.col("text").alias("content"))


def chunk_spans(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Spans (lo, hi) of overlapping windows, each ended at its last full stop beyond the middle.

    The window that follows starts ``overlap`` before the end; the cursor is the state of a fold,
    so the spans are found in the engine without leaving the row.
    """
    n = F.length(text)
    steps = F.sequence(F.lit(0), F.floor(n / (size // 2 - overlap + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<lo:int,hi:int>>").alias("spans"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        window = F.substring(text, at + 1, F.lit(size).cast("int"))
        dot = size - F.instr(F.reverse(window), ".")  # place of the last full stop, or size if there is none
        cut = F.when((at + size < n) & (dot < size) & (dot > size // 2), at + dot + 1).otherwise(at + size).cast("int")
        grown = F.struct((cut - overlap).cast("int").alias("at"), F.concat(state["spans"], F.array(F.struct(at.alias("lo"), F.least(cut, n).alias("hi")))).alias("spans"))
        return F.when(at < n, grown).otherwise(state)

    return F.aggregate(steps, start, step, lambda s: s["spans"])


SPEAKER = r"(?i)(?:\*\*|#)?\s*Modell:?\s*(.*?)(?:\*\*|$|\n)"


def chunks(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """chunk_id, chat_id, chunk_index, content and content_hash of every window of every document."""
    rows = documents.filter(F.length(text_col) > 0).select(F.col("doc_id").cast("string").alias("chat_id"), F.col(text_col).alias("text"))
    spans = rows.select("chat_id", "text", F.posexplode(chunk_spans(F.col("text"))).alias("i", "span"))
    content = F.substring(F.col("text"), F.col("span.lo") + 1, F.col("span.hi") - F.col("span.lo"))
    out = spans.select("chat_id", F.col("i").cast("long").alias("chunk_index"), content.alias("content"))
    return out.select(F.concat_ws("_", "chat_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "chat_id", "chunk_index", "content", F.sha2("content", 256).alias("content_hash"))


def reviews(labels: DataFrame) -> DataFrame:
    """A review a label: human_valid is unknown for some, confidence is derived from the id."""
    i = F.col("doc_id")
    return labels.select(i.alias("id"), F.when(i % 3 == 0, None).otherwise(F.col("quality")).alias("human_valid"), F.when(i % 13 == 0, None).otherwise((i % 21) * F.lit(0.05)).alias("confidence"), F.concat(F.lit("v"), (i % 2).cast("string")).alias("version"))
