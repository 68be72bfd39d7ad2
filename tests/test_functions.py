"""Golden cases of the text functions, and plain re-statements of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import compounds, fuzzy, judge, metaruns, scripts, verse
from textloom.functions import text as T
from textloom.operators import corpus, ranking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "lines, kind, notation",
    [
        ("Das alte Haus\nder Morgen rot\nes geht hinaus\nund bringt das Brot", "Kreuzreim", "A B A B"),
        ("im Wald\nso bald\nein Kind\nder Wind", "Paarreim", "A A B B"),
        ("im Wald\nein Kind\nder Wind\nso bald", "Umarmender Reim", "A B B A"),
        ("eins\nzwo", "Kein Reim", "x x"),
        ("", "Kein Reim", ""),
    ],
)
def test_rhyme_schemes(lines, kind, notation):
    found = verse.rhyme_scheme(lines)
    assert (found["type"], found["notation"]) == (kind, notation)


def test_sound_patterns_count_pairs_once():
    found = verse.sound_patterns("Milch macht müde Männer munter munter")
    assert found["n_alliterations"] == 1 and len(found["alliterations"][0]["words"]) >= 4
    assert verse.sound_patterns("Haus Maus Haus")["n_internal_rhymes"] == 1


def test_greek():
    assert scripts.greek_syllables("Ἀτρεΐδης") == 4
    assert scripts.greek_words("ἔνθ᾽ δ᾽ 87")[:2] == ["ἔνθα", "δέ"]
    assert scripts.script_of("μῆνιν ἄειδε") == "greek" and scripts.script_of("hello") == "other"
    assert scripts.greek_stanzas("a\n" * 7) == [1] * 7


def test_hebrew():
    assert scripts.hebrew_words("בָּרָא־אֱלֹהִים׃")[1].endswith("ם")
    assert scripts.parallelism([4, 4, 1])["parallel_pairs"] == 1


def test_compounds_and_fuzzy():
    found = {c["word"]: c["kind"] for c in compounds.compounds("bronze-schild verschlafen donaudampfschiff haus haus".split(), [])}
    assert found == {"bronze-schild": "bindestrich", "verschlafen": "praefix", "donaudampfschiff": "lang"}
    assert fuzzy.best_window("hello world this is a test", "xx hello world this is a tesst yy") > fuzzy.THRESHOLD
    assert fuzzy.best_source("abc", ["xyz", "abd"])[1] == 1 and fuzzy.best_source("a", []) == (0.0, -1)


@pytest.mark.parametrize("title, iso", [("Chat Mai 2024", "2024-05-01"), ("am 04122025", "2025-12-04"), ("x 99999999 05102025", "2025-10-05"), ("nichts", None), ("31022024", None)])
def test_dates_in_titles(spark, title, iso):
    assert one(spark, judge.date_in_title(F.lit(title))) == iso


@pytest.mark.parametrize("text, mode, score", [("suizid", "IFS_CONTROL", 3), ("verzweifelt hoffnungslos", "IFS_CONTROL", 2), ("verzweifelt hoffnungslos sinnlos suizid", "IFS_CONTROL", 3), ("guten Tag", "x", 0)])
def test_crisis_scores(spark, text, mode, score):
    assert one(spark, judge.folded_score(judge.crisis_hits(F.lit(text)), judge.crisis_threshold(F.lit(mode)))) == score


@pytest.mark.parametrize("said, answer, overlap", [("Ich habe Angst vor Morgen", "Angst vor Morgen", 1.0), ("Haus Baum", "Katze Hund", 0.0), ("Haus", "und der", 0.0), ("Haus Baum", "Haus Katze", 0.5)])
def test_echo(spark, said, answer, overlap):
    assert one(spark, judge.echo_overlap(F.lit(said), F.lit(answer))) == overlap


def test_variants_and_sums(spark):
    assert [one(spark, metaruns.variant(F.lit(v))) for v in ("v2.3", "v2.4", "v2.7", "v3.0", "pre-v2.4", "x")] == ["A", "B", "C", "C", "A", "A"]
    table = "Klang-Vergleichstabelle\n| QUELLE 1 | 396 | 38 | 4 | 42 |"
    assert one(spark, metaruns.sound_sums(F.lit(table)))[0]["total"] == 480


def spans(text, size=4000, overlap=1200):
    out, at = [], 0
    while at < len(text):
        end = at + size
        dot = text.rfind(".", at, end)
        if end < len(text) and dot > at + size // 2:
            end = dot + 1
        out.append((at, min(end, len(text))))
        at = end - overlap
    return out


def test_chunk_spans_follow_the_cursor(spark):
    rng = random.Random(3)
    texts = ["", "a", "x" * 2801, "x" * 3000, "y" * 9000, *("".join(rng.choice("abc .") for _ in range(rng.randrange(1, 15000))) for _ in range(8))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").filter("length(t) > 0")
    for row in rows.select("t", corpus.chunk_spans(F.col("t")).alias("s")).collect():
        assert [(s["lo"], s["hi"]) for s in row["s"]] == spans(row["t"])


def fold(rows, budget):
    from math import log

    k = {r[0]: len(r[2]) // 4 for r in rows}
    n = {d: sum(r[1] == d for r in rows) for d in {r[1] for r in rows}}
    total = sum(log(v + 1) for v in n.values())
    firsts, rest, seen = [], [], set()
    for r in rows:
        (rest if r[1] in seen else firsts).append(r)
        seen.add(r[1])
    used, took, later = 0, set(), []
    for r in firsts:
        if k[r[0]] <= int(budget * (log(n[r[1]] + 1) / total)) and used + k[r[0]] <= budget:
            took.add(r[0])
            used += k[r[0]]
        else:
            later.append(r)
    for r in later + rest:
        if used + k[r[0]] <= budget:
            took.add(r[0])
            used += k[r[0]]
    return took


def test_token_budget_matches_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(i, f"d{rng.randrange(6)}", "x" * rng.randrange(0, 4000)) for i in range(40)]
    df = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], "id int, chat_id string, content string, rank int")
    for budget in (500, 2000, 6000, 100000):
        assert {r["id"] for r in ranking.token_budget(df, budget).collect()} == fold(rows, budget)


def test_essence_parity_keeps_the_minimum(spark):
    rows = [(i, i % 4, 1 / (i + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, doc int, score double")
    kept = ranking.essence_parity(df, df, "doc", "id", 4).groupBy("doc").count().collect()
    assert all(r["count"] >= 4 for r in kept)


def test_sentences_and_words(spark):
    found = one(spark, T.sentences(F.lit("Dr. Meier kam z.B. heute. Er ging. Am 3. Mai! Gut so?")))
    assert found == ["Dr. Meier kam z.B. heute.", "Er ging.", "Am 3. Mai!", "Gut so?"]
    assert one(spark, T.words(F.lit("Бронзово-Острое, Haus!"))) == ["бронзово-острое", "haus"]


def test_words_of_analyses_are_no_authors(spark):
    """Read off the list of the words by hand, not from the library."""
    none = "Die Demontage Exklusion Verklärung Verdichtung Zertrümmerung Entgrenzung Expansion Entwertung Redefinition Subsumption Imperativ Appell Vision Prophetie Polemik Polemischer Agency Responsive Keim Vorbereitung Hegemonie Imperialer Wendung Gedichts Stile Texten Werke Dichters Perioden Stadien Schritte Identifikation Klassifikation Radikalisierung Eskalation Konstitution Dekonstruktion Dispersion Genealogie Kontinuität Stabilität Variabilität Validierung Falsifikation Adjudikation Gegenposition Bestätigung Reimes Wertes Fremdwörter TTR DESTILLATION Vergleichstabelle Blo Celans AufSicht Чёрная".split()
    some = "Blok Mandelstam Achmatowa Пушкин Маяковский Толстой Tsvetaeva".split()
    rows = spark.createDataFrame([(x,) for x in none + some], "name string").select("name", metaruns.likely_author(F.col("name")).alias("a"), metaruns.likely_lab_author(F.col("name")).alias("b")).collect()
    assert [r["name"] for r in rows if r["a"]] == some
    lab = {r["name"] for r in rows if r["b"]}
    assert {"Verdichtung", "Celans", "AufSicht", "Blok"} <= lab and not {"Quelle", "Reimes", "DESTILLATION", "Blo"} & lab
