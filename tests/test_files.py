"""Folders of exports and result files."""

import pytest
from pyspark.sql import functions as F

from textloom.plans.kernels import SAMPLES
from textloom.sources import files


def test_exports_are_told_by_their_content(spark, tmp_path):
    for name in ("chatgpt", "grok", "glm"):
        (tmp_path / f"{name}.html").write_text(SAMPLES[name].format(1))
    (tmp_path / "note.md").write_text("nur eine Notiz")
    (tmp_path / "g.json").write_text(SAMPLES["gemini_json"].format(2))
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe\x00")
    rows = files.read_exports(spark, str(tmp_path)).groupBy("platform").agg(F.count("*").alias("n")).collect()
    assert {r["platform"]: r["n"] for r in rows} == {"chatgpt": 2, "grok": 2, "glm": 2, "gemini_json": 2, "markdown": 1, "text": 1}


@pytest.mark.parametrize("kind", files.FORMATS)
def test_rows_come_back(spark, tmp_path, kind):
    rows = spark.range(3).select("id", F.lit("x,\"y").alias("s"))
    files.write_rows(rows, str(tmp_path / kind), kind)
    back = spark.read.format(kind).option("header", "true").option("escape", "\\").load(str(tmp_path / kind))
    assert sorted((int(r["id"]), r["s"]) for r in back.collect()) == [(i, 'x,"y') for i in range(3)]


def test_unknown_format_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        files.write_rows(spark.range(1), str(tmp_path), "xlsx")


def test_notes_are_whole(spark, tmp_path):
    (tmp_path / "a.md").write_text("eins\nzwei")
    assert files.read_notes(spark, str(tmp_path)).first()["text"] == "eins\nzwei"
