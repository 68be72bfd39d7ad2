"""Streams with rows out of order and late rows."""

import datetime
import random

from pyspark.sql import functions as F

from textloom.streaming import events as E

START = datetime.datetime(2024, 5, 1, 12)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_speakers_are_carried_in_event_time(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{c}", c * 100 + i, at(i * 10), rng.choice(["A", "B", None, None]) if i else None) for c in range(4) for i in range(30)]
    want, last = {}, {}
    for chat, i, _, said in rows:
        last[chat] = said or last.get(chat, "Unknown")
        want[i] = last[chat]
    mixed = [rows[i] for i in sorted(range(len(rows)), key=lambda i: rows[i][2].timestamp() + rng.randrange(55))]  # no row is 60 s behind
    parts = [mixed[i : i + 30] for i in range(0, 120, 30)] + [[("c0", 999, at(0), "LATE"), ("", -1, at(9999), None)], [("c0", 998, at(1), "LATE")]]
    schema = "chat_id string, id long, ts timestamp, said string"
    out = E.drain(E.carry_forward(E.replay([spark.createDataFrame(p, schema) for p in parts], str(tmp_path / "in")), late="60 seconds"), "append")
    got = {r["id"]: r["speaker"] for r in out.collect() if r["id"] >= 0}
    assert 998 not in got and {i: s for i, s in got.items() if i < 900} == want
    assert out.count() == len({r["id"] for r in out.collect()})


def test_late_events_are_left_out_of_sessions(spark, tmp_path):
    schema = "user_id long, ts timestamp"
    parts = [[(1, at(0)), (1, at(100)), (2, at(50))], [(1, at(4000)), (2, at(60))], [(1, at(3900))], [(1, at(120))], [(9, at(90000))]]
    stream = E.replay([spark.createDataFrame(p, schema) for p in parts], str(tmp_path / "in"))
    rows = E.drain(E.sessions(stream, gap="10 minutes", late="5 minutes"), "append").collect()
    # 60 s of user 2 is timely; 120 s of user 1 comes two batches after the watermark went to 3700 s
    assert sorted((r["user_id"], r["n"]) for r in rows) == [(1, 2), (1, 2), (2, 2)]
    assert {(r["user_id"], r["start"]) for r in rows} == {(1, at(0)), (1, at(3900)), (2, at(50))}


def test_late_events_are_left_out_of_windows(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double"
    parts = [[("a", at(0), 1.0), ("a", at(7300), 1.0)], [("a", at(7200), 2.0)], [("a", at(30), 5.0)], [("z", at(90000), 0.0)]]
    stream = E.replay([spark.createDataFrame(p, schema) for p in parts], str(tmp_path / "in"))
    rows = E.drain(E.windowed(stream), "append").filter(F.col("event_type") == "a").collect()
    assert sorted((r["start"], r["n"], r["total"]) for r in rows) == [(at(0), 1, 1.0), (at(7200), 2, 3.0)]


def test_drain_holds_no_rows_in_the_driver(spark, sf_dir):
    before = {x.name for x in spark.catalog.listTables()}
    found = E.drain(E.sessions(spark.readStream.schema("user_id long, ts timestamp").parquet(f"{sf_dir}/events.parque[t]"), late="60 days"))
    assert found.count() > 0 and {x.name for x in spark.catalog.listTables()} == before
