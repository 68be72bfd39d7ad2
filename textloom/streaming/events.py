"""Event streams: windowed counts, call statistics, dialogue state.

Every function takes a streaming (or static) DataFrame and gives one; sinks are the caller's.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.session import remove, settle, shared_folder

TURN_CAP = 50


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a window and type; rows later than ``late`` are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of each user's runs of events without a longer gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def call_statistics(events: DataFrame) -> DataFrame:
    """Running totals a task, missing token counts taken as none."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("tokens"))


def dialogue_state(turns: DataFrame, cap: int = TURN_CAP) -> DataFrame:
    """Per conversation: turns kept (the last ``cap``) and the number of user turns so far."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, users = state.get if state.exists else (0, 0)
        for batch in batches:
            kept = min(cap, kept + len(batch))
            users += int((batch["role"] == "user").sum())
        state.update((kept, users))
        yield pd.DataFrame({"conv_id": [key[0]], "kept": [kept], "user_turns": [users]})

    return turns.select("conv_id", "role").groupBy("conv_id").applyInPandasWithState(step, "conv_id long, kept long, user_turns long", "kept long, users long", "update", GroupStateTimeout.NoTimeout)


def carry_forward(rows: DataFrame, late: str = "10 minutes", unknown: str = "Unknown") -> DataFrame:
    """(chat_id, id, speaker): who speaks in each row (chat_id, id, ts, said): ``said`` or the last one said before.

    Rows may come in any order within ``late``: they wait in their chat's state until the watermark
    has passed them, and are then told in the order of ``ts`` and ``id``. Rows that come later are
    left out. A chat's state is its last speaker and the rows of one stretch of ``late``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = json.loads(state.get[0]) if state.exists else (unknown, [])
        for batch in batches:
            waiting += [[int(ts.value // 1000), int(i), None if pd.isna(said) else said] for ts, i, said in zip(batch["ts"], batch["id"], batch["said"])]
        waiting.sort(key=lambda x: x[:2])
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        while waiting and waiting[0][0] <= passed:
            _, i, said = waiting.pop(0)
            last = said or last
            out.append((key[0], i, last))
        state.update((json.dumps([last, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed // 1000) + 1)
        yield pd.DataFrame(out, columns=["chat_id", "id", "speaker"])

    timed = rows.select("chat_id", F.col("id").cast("long").alias("id"), "ts", "said").withWatermark("ts", late)
    return timed.groupBy("chat_id").applyInPandasWithState(step, "chat_id string, id long, speaker string", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def replay(parts: list[DataFrame], path: str) -> DataFrame:
    """A stream of the parts, each one batch, from files in ``path``."""
    for number, part in enumerate(parts):
        part.repartition(1).write.parquet(f"{path}/part={number}")  # one file, but what it is made from stays spread
        if number + 1 < len(parts):
            time.sleep(1.1)  # files are taken by the time they were written, in whole seconds on some stores
    spark = parts[0].sparkSession
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Everything a stream holds now, by way of files in the shared folder; the driver holds no rows."""
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    kept: set[str] = set()

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{at}/rows/{0 if mode == 'complete' else number}"
        batch.write.mode("overwrite").parquet(path)
        kept.add(path)

    try:
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return settle(spark.read.schema(stream.schema).parquet(*sorted(kept)) if kept else spark.createDataFrame([], stream.schema))
    finally:
        remove(spark, at)
