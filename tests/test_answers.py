"""Guards, failing calls and phases against plain Python; stores and changed tables read back."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import judge as J
from textloom.operators import calls, flows, stores

REFUSAL = "Bitte sprich mit einem Menschen."
CRISIS = "Ich will nicht mehr leben."

#: Message, answer and whether the answer is an echo.
ECHOES = [
    ("Die Gedanken lassen mich nicht in Ruhe.", "Die Gedanken lassen dich nicht in Ruhe.", True),
    ("Ich bin verzweifelt und alles wird zu viel.", "Es klingt, als wäre dieser Tag wirklich schwer für dich gewesen.", False),
    ("Die Lestrigonen lassen mich nicht in Ruhe, sobald ich allein bin.", "Diese Lestrigonen, wie du sie nennst, lassen dich nicht in Ruhe, sobald du allein bist.", True),
    ("Die Lestrigonen lassen mich nicht in Ruhe, sobald ich allein bin.", "Sie drängen sich rein, sobald es still wird. Andere Wörter, aber denselben Kern.", False),
    ("", "Was auch immer.", False),
    ("Hallo", "", False),
    ("Ja.", "Gerne.", False),
]
HARMLESS = ["Ich hatte einen furchtbaren Tag und fühle mich erschöpft.", "Ich bin wütend auf meinen Kollegen und möchte laut werden.", "Ich bin traurig und möchte weinen.", "Mir fällt keine Lösung ein.", "Ich bin verzweifelt."]
ALARMING = [CRISIS, "Ich habe Suizidgedanken und weiß nicht mehr weiter.", "Ich möchte mir etwas antun.", "Ich will mich ritzen, das hilft manchmal."]


def test_echoes(spark):
    rows = spark.createDataFrame(ECHOES, "said string, answer string, echo boolean")
    for r in rows.withColumn("got", J.echo_overlap(F.col("said"), F.col("answer")) >= 0.6).collect():
        assert r["got"] == r["echo"], r


def test_crisis_signs(spark):
    limit = J.crisis_threshold(F.lit("IFS_CONTROL"))
    rows = spark.createDataFrame([(x, False) for x in HARMLESS] + [(x, True) for x in ALARMING], "x string, alarm boolean")
    for r in rows.withColumn("got", J.folded_score(J.crisis_hits(F.col("x")), limit) >= limit).collect():
        assert r["got"] == r["alarm"], r


def test_guarded_answers(spark):
    echo = "Die Gedanken lassen mich nicht in Ruhe."
    cases = [
        (CRISIS, "nie gefragt", None, REFUSAL, "crisis in message", 0),
        (CRISIS.replace("Ich will", "__START__ Ich will"), "x", None, REFUSAL, "crisis in message", 0),
        ("__START__", "Willkommen, erzähl.", None, "Willkommen, erzähl.", "answer", 1),
        ("Hallo du", CRISIS, None, REFUSAL, "crisis in answer", 1),
        (echo, echo, "Etwas ganz Anderes beginnt.", "Etwas ganz Anderes beginnt.", "second answer", 2),
        (echo, echo, echo, echo, "still an echo", 2),
        (echo, echo, CRISIS, REFUSAL, "crisis in second answer", 2),
        (echo, echo, None, "", "second answer", 2),
        (None, "Was ist los?", None, "Was ist los?", "answer", 1),
        ("Hallo du", None, None, "", "answer", 1),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, said string, first string, second string")
    out = flows.guarded(rows, "g", F.col("said"), F.lit(None).cast("string"), lambda _: F.col("first"), lambda _: F.col("second"), REFUSAL)
    assert out.columns == [*rows.columns, "g"]
    for r in out.collect():
        assert (r["g"]["answer"], r["g"]["route"], r["g"]["calls"]) == cases[r["i"]][3:], r


def test_the_last_user_turn_counts(spark):
    rows = spark.createDataFrame([("c", 0, "model", "m0"), ("c", 1, "user", "u1"), ("c", 2, "model", "m2"), ("c", 3, "model", "m3"), ("c", 4, "user", "u4"), ("d", 9, "model", "x")], "chat_id string, turn int, role string, content string")
    assert {r["content"]: r["said"] for r in flows.last_said(rows).collect()} == {"m0": None, "u1": None, "m2": "u1", "m3": "u1", "u4": "u1", "x": None}


# Calls
def test_tries_and_waits():
    slept, asked = [], []

    def model(prompts, k):
        asked.append(list(prompts))
        if k == 1:
            raise ConnectionError("down")
        return [{"a": "A", "b": "" if k == 0 else "B", "c": ValueError("bad") if k < 2 else "C", "d": None}[p] for p in prompts]

    got = calls.tried(model, ["a", "b", "c", "d"], calls.Retry(), slept.append)
    assert got == [("A", 1, 0.0, None), ("B", 3, 1.5 + 4, None), ("C", 3, 2.0 + 4, None), ("", 3, 1.5 + 4 + 6, "empty")]
    assert asked == [["a", "b", "c", "d"], ["b", "c", "d"], ["b", "c", "d"]] and slept == [2.0, 4.0, 6.0]
    assert calls.tried(lambda p, k: ["x"], ["a", "b"], calls.Retry(tries=1), slept.append)[0][3].startswith("ValueError")
    assert calls.tried(model, [], calls.Retry(), slept.append) == []


def test_calls_keep_rows_and_columns(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"p{i}", [i]) for i in range(70)], "i int, p string, answer array<int>")
    out = calls.call(rows, F.col("p"), lambda p, k: [x.upper() for x in p], sleep=calls.no_wait)
    assert out.columns == ["i", "p", "answer", "call"]
    assert {r["i"]: r["call"] and r["call"]["answer"] for r in out.collect()} == {i: None if i == 3 else f"P{i}" for i in range(70)}
    assert calls.call(rows.limit(0), F.col("p"), lambda p, k: p).count() == 0


@pytest.mark.parametrize(
    "text, value",
    [
        ('{"a": 1, "t": ["x", "y', {"a": 1, "t": ["x", "y"]}), ('[{"a": 1}, {"a": 2, "b', [{"a": 1}, {"a": 2}]), ('Hier: {"a": "q, r", "b": tru', {"a": "q, r"}), ('{"a": "x\\"y, z', {"a": 'x"y, z'}), ('{"a": {"b": [1, 2', {"a": {"b": [1, 2]}}),
        ('{"a"', {}), ("[[1, [2, [3", [[1, [2, [3]]]]), ('{"k": "}]', {"k": "}]"}), ('{"a": 1,', {"a": 1}), ("[1, 2]", [1, 2]), ('{"a": "\\', {}),
    ],
)
def test_answers_that_break_off_are_closed(text, value):
    assert json.loads(calls.closed(text)) == value


def test_every_prefix_of_a_value_can_be_closed():
    whole = json.dumps({"a": [1, {"b": "x, {y]", "c": None}], "d": {"e": [[], {}], "f": 'q"r\\'}, "g": -1.5})
    for end in range(1, len(whole)):
        assert calls.cut_off(whole[:end]) and isinstance(json.loads(calls.closed(whole[:end])), dict)
    assert not calls.cut_off(whole) and calls.closed(whole) == whole and calls.closed("prose only") == "prose only"


def test_json_calls(spark):
    answers = {"fence": ['x ```json\n{"n": 1, "h": "a"}\n```'], "later": ['{"n": 2', '{"n": 2, "h": "b"}'], "never": ['{"n": 3, "h": "c'] * 3, "other": ['{"z": 1}'], "prose": ["nichts"], "list": ["[1]"]}
    rows = spark.createDataFrame([(k,) for k in answers] + [(None,)], "p string")

    def run(repair):
        out = calls.call_json(rows, F.col("p"), lambda p, k: [answers[x][k] for x in p], "n int, h string", sleep=calls.no_wait, repair=repair)
        return {r["p"]: (r["value"]["value"] and tuple(r["value"]["value"]), r["value"]["tries"], r["value"]["error"]) for r in out.collect()}

    want = {"fence": ((1, "a"), 1, None), "later": ((2, "b"), 2, None), "never": (None, 3, "cut off"), "other": (None, 1, "not of the schema"), "prose": (None, 1, "no JSON"), "list": (None, 1, "not of the schema"), None: (None, None, None)}
    assert run(False) == want
    assert run(True) == want | {"never": ((3, "c"), 3, None)}


# Phases
def test_phases_equal_a_plain_loop(spark):
    from textloom.plans import answers

    def whole(*ns):
        return "\n\n".join(f"### QUELLE [{n}]: T\nText [{n}]." for n in ns)

    drafts = [whole(1, 2, 3), whole(1), whole(2, 3), "Nichts.", whole(1, 2) + "\n\nbricht a", whole(1, 2, 3) + "\n\nSchluss [8].", whole(1, 2, 3) + "\n\n" + "[9]" * 200, ""]

    def sections(x):
        return [n for n in (1, 2, 3) if f"### QUELLE [{n}]" not in x]

    def loop(x):
        continued = corrected = 0
        refused = False
        while sections(x) and continued < 2:
            if not x.endswith((".", "!", "?", ":", ";")) and "\n\n" in x:
                x = x[: x.rindex("\n\n")]
            n = sections(x)[0]
            x = x.rstrip() + f"\n\n### QUELLE [{n}]: Titel\nNachtrag [{n}]."
            continued += 1
        while ("[8]" in x or "[9]" in x) and corrected < 2 and not refused:
            new = x.replace("[8]", "").replace("[9]", "")
            refused = not (len(new) >= 0.8 * len(x) and "QUELLE [3]" in new)
            x = x if refused else new.strip()
            corrected += 1
        return x.strip(), continued, corrected, refused

    rows = spark.createDataFrame(list(enumerate(drafts)), "i int, draft string")
    out = flows.phases(rows, "draft", F.lit(3), answers.next_section, lambda d, _: J.only_valid_references(d, [1, 2, 3]), answers.wrong_references)
    got = {r["i"]: (r["draft"].strip(), r["continued"], r["corrected"], r["refused"]) for r in out.collect()}
    assert got == {i: loop(x) for i, x in enumerate(drafts)}


# Stores
def test_rows_are_taken_once(spark, tmp_path):
    store = stores.Ignoring(spark, str(tmp_path / "s"), "k string, at int, v string", ["k"], ["at"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, at int, v string")
    assert {r["k"] for r in store.put(batch(("a", 2, "late"), ("a", 1, "first"), ("b", 1, "x"), (None, 1, "null")), 0).collect()} == {"a", "b", None}
    second = batch(("a", 1, "again"), ("c", 1, "y"), (None, 5, "again"))
    for _ in range(3):
        assert [r["k"] for r in store.put(second, 1).collect()] == ["c"]
    held = {(r["k"], r["v"]) for r in store.rows().collect()}
    assert held == {("a", "first"), ("b", "x"), (None, "null"), ("c", "y")} and store.rows().count() == 4


def test_the_first_inserted_go_first(spark, tmp_path):
    store = stores.Ignoring(spark, str(tmp_path / "s"), "k string, at int", ["k"], ["at"], most=3)
    held: list = []
    for number, keys in enumerate(["abc", "ad", "a", "ba", "eeff", "c"]):
        new = [k for k in dict.fromkeys(keys) if k not in held]
        held = (held + new)[-3:]
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, at int")
        for _ in range(1 + number % 2):
            store.put(rows, number)
        assert sorted(r["k"] for r in store.rows().collect()) == sorted(held), number


def test_changes_touch_the_partitions_of_their_keys(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i % 40}", i, f"text {i}") for i in range(400)], "chat_id string, id int, content string")
    at = str(tmp_path / "t")
    table = stores.Buckets(spark, at, rows.schema, "chat_id", 16)
    table.create(rows)
    files = lambda: {p.parent.name: sorted((q.name, q.stat().st_mtime_ns) for q in p.parent.glob("*.parquet")) for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    table.delete(["c3"])
    table.update(["c5"], {"content": F.lit("new"), "unknown": F.lit("x")}, F.col("id") > 100)
    table.delete(["c7"], F.col("id") == 47)
    after = files()
    assert 0 < sum(before[b] != after.get(b) for b in before) <= 3
    want = {(f"c{i % 40}", i, "new" if i % 40 == 5 and i > 100 else f"text {i}") for i in range(400) if i % 40 != 3 and i != 47}
    assert {tuple(r) for r in table.rows().collect()} == want
    table.delete(["nobody"])
    table.delete([f"c{i}" for i in range(40)])
    assert table.rows().count() == 0
