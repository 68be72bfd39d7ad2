"""Edges of the flows and renderers that the tables do not reach."""

from pyspark.sql import functions as F

from textloom.functions import render
from textloom.operators import flows


def same(prompt):
    return prompt


def test_points_reads_lists_objects_and_prose(spark):
    rows = spark.createDataFrame([(0, '[{"a": 1}, {"b": "x"}]'), (1, 'So: {"a": 1}'), (2, "[]"), (3, "gut"), (4, None), (5, '```json\n[{"a": [1]}]\n```')], "i int, x string")
    got = {r["i"]: r["p"] for r in rows.select("i", flows.points(F.col("x")).alias("p")).collect()}
    assert got == {0: ['{"a":1}', '{"b":"x"}'], 1: ['{"a":1}'], 2: [], 3: None, 4: None, 5: ['{"a":[1]}']}


def test_an_empty_draft_is_not_edited_and_a_failed_critic_keeps_the_draft(spark):
    rows = spark.createDataFrame([(0, ""), (1, "Text")], "i int, d string")
    out = flows.revised(rows, "r", F.col("d"), F.lit("de"), lambda p: F.lit('[{"a": 1}]'), same, "Los")
    got = {r["i"]: r["r"] for r in out.collect()}
    assert (got[0]["text"], got[0]["points"], got[0]["skipped"]) == ("", None, True)
    assert got[1]["text"].startswith("Los\n\n## Sprache\nde\n\n## Entwurf\nText\n\n## Kritikpunkte\nnur diese 1 Stelle ändern\n") and out.columns == ["i", "d", "r"]
    failed = flows.revised(rows, "r", F.col("d"), F.lit("de"), lambda p: F.lit(None).cast("string"), same, "Los")
    assert {r["r"]["text"] for r in failed.collect()} == {"", "Text"} and all(r["r"]["skipped"] for r in failed.collect())


def test_only_three_points_reach_the_editor(spark):
    rows = spark.createDataFrame([("Text",)], "d string")
    r = flows.revised(rows, "r", F.col("d"), F.lit("de"), lambda p: F.lit('[{"n":1},{"n":2},{"n":3},{"n":4}]'), same, "Los").collect()[0]["r"]
    assert r["points"] == ['{"n":1}', '{"n":2}', '{"n":3}'] and '{"n":4}' not in r["text"]


def test_evidence_without_speakers_or_with_failed_calls(spark):
    fail = lambda p: F.lit(None).cast("string")
    rows = spark.createDataFrame([([(None, "a\nb")],)], "s array<struct<speaker: string, content: string>>")
    none = flows.evidence_text(rows, "x", F.lit("F"), F.col("s"), F.array(F.lit("A")), fail, fail, same)
    assert none.collect()[0]["x"] is None
    found = lambda p: F.lit('{"primary_quotes": [{"source_id": 1, "speaker": "A", "quote": "ja"}], "secondary_mentions": [{"source_id": 2}]}')
    passed = flows.evidence_text(rows, "x", F.lit("F"), F.col("s"), F.array(F.lit("A")), found, fail, same).collect()[0]["x"]
    assert "[1] A: ja" in passed
    seen = flows.evidence_text(rows, "x", F.lit("F"), F.col("s"), F.array(F.lit("A")), lambda p: F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("source_id"), F.lit("A").alias("speaker"), p.alias("quote"))).alias("primary_quotes"))), fail, same)
    assert "SOURCE_ID [1] | SPEAKER: Unbekannt | CONTENT: a b" in seen.collect()[0]["x"]


def test_facts_of_no_chunks(spark):
    kind = "array<struct<date: string, speaker: string, role: string, content: string>>"
    rows = spark.createDataFrame([(0, []), (1, [(None, "A", None, "x")])], f"i int, c {kind}")
    got = {r["i"]: r["f"] for r in flows.facts(rows, "f", F.col("c"), lambda p: F.lit('[{"source_id": 0, "fact": "x"}]')).collect()}
    assert got[0] is None and got[1][0]["fact"] == "x" and got[1][0]["quote"] is None


def test_vision_call_limits(spark):
    kind = "array<struct<bytes: binary, mime: string>>"
    rows = spark.createDataFrame([(0, []), (1, [(b"abc", "image/png")]), (2, [(b"abc", "image/png"), (b"de", "image/png")]), (3, [(b"abcdef", "image/png")])], f"i int, m {kind}")
    call = flows.vision_call(F.col("m"), F.lit(""), F.lit("photograph"), "Sieh hin.", {"photograph": "Regel"}, limit=5)
    got = {r["i"]: r["c"] for r in rows.select("i", call.alias("c")).collect()}
    assert got[0] is None and got[3] is None
    assert got[1]["instruction"] == "Sieh hin.\n\nRegel" and got[1]["parts"][-1]["text"] == "Analysiere das Bild."
    assert [p["mime"] for p in got[2]["parts"]] == ["image/png", "image/png", None] and got[2]["parts"][2]["text"] == "Analysiere und vergleiche die Bilder."


def test_first_path(spark):
    rows = spark.createDataFrame([(0, "x", True), (1, "", True), (2, None, False)], "i int, s string, e boolean")
    got = {r["i"]: r["p"] for r in rows.select("i", flows.first_path(F.col("s"), F.lit("d"), F.col("e"), "f").alias("p")).collect()}
    assert got == {0: "x", 1: "d", 2: "f"}


def test_style_result_without_sources_and_with_sounds(spark):
    names = sorted(set(render.COMPARED.values()) | set(render.SOUNDS.values()) | set(render.DETAILS.values()))
    kind = f"r array<struct<{', '.join(f'{n}: string' for n in names)}>>, o array<struct<label: string, text: string>>"
    full = tuple("ja" if n == "verse" else n.upper() for n in names)
    rows = spark.createDataFrame([([], []), ([full], [("L", None)])], kind)
    x = render.style_result(F.col("r"), F.col("o"), F.lit(None).cast("string"), F.lit(""), F.lit(""), F.lit("m"))
    empty, one = sorted((r["x"] for r in rows.select(x.alias("x")).collect()), key=len)
    assert "## Vergleich" not in empty and "(Keine Klang-Kennzahlen verfügbar)" in empty and "(Keine Synthese verfügbar)" in empty and "Gegenposition" not in empty and "Frage" not in empty
    assert "| LABEL | ALLITERATIONS | ASSONANCES | INTERNAL_RHYMES | ECHOES | RHYME | ENJAMBEMENTS |" in one and "**Verse**" in one and "- **Reimschema:** RHYME" in one
