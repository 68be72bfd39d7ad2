"""Results as Markdown. A value that is missing is a dash, a section without content is left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heading of a column of the comparison and the field of a source that fills it.
COMPARED = {
    "Quelle": "label", "Wörter": "words", "Sätze": "sentences", "Ø Satzl.": "avg_sentence", "HS": "hs", "NS": "ns", "Gem.": "mixed", "TTR": "ttr", "Morph": "morphology", "Kommas": "commas",
    "Lyrik": "verse", "Stroph.": "stanzas", "Reim": "rhyme", "Ø Silb.": "syllables", "Enjamb.": "enjambements",
}
SOUNDS = {"Quelle": "label", "Alliterationen": "alliterations", "Assonanzen": "assonances", "Binnenreime": "internal_rhymes", "Vokal-Echos": "echoes", "Reim": "rhyme", "Enjamb.": "enjambements"}
#: Lines of a source's details.
DETAILS = {"Wörter": "words", "Zeichen": "chars", "Sätze": "sentences", "Ø Satzlänge": "avg_sentence", "HS": "hs", "NS": "ns", "Gemischt": "mixed", "TTR": "ttr", "Morphologische Komplexität": "morphology"}
VERSE = {"Strophen": "stanzas", "Reimschema": "rhyme", "Ø Silben": "syllables", "Enjambements": "enjambements"}


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("—"))


def table(rows: Column, columns: dict[str, str]) -> Column:
    """Structs as a table; without rows there is none."""
    head = "| " + " | ".join(columns) + " |\n" + "|" + " --- |" * len(columns)
    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *(_shown(r[c]) for c in columns.values())), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(rows, line), "\n")))


def _head(title: str, fields: Sequence[tuple[str, Column]]) -> Column:
    lines = (F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{name}: "), value.cast("string"))) for name, value in fields)
    return F.concat_ws("\n", F.lit(f"---\n{title}"), *lines, F.lit("---"))


def _section(title: str, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"{title}\n\n"), body))


def _bullets(row: Column, fields: dict[str, str]) -> Column:
    return F.concat_ws("\n", *(F.concat(F.lit(f"- **{name}:** "), row[c].cast("string")) for name, c in fields.items()))


def details(row: Column) -> Column:
    """Figures of one source; the verse figures only where the text is likely verse."""
    verse = F.when(row["verse"] == "ja", F.concat(F.lit("**Verse**\n\n"), _bullets(row, VERSE)))
    return F.concat_ws("\n\n", F.concat(F.lit("### "), row["label"]), _bullets(row, DETAILS), verse)


def style_result(sources: Column, observations: Column, synthesis: Column, counter: Column, question: Column, model: Column) -> Column:
    """The result of a style run: comparison, sounds, details, observations, synthesis, counter position.

    ``sources`` are structs with the fields named above, ``observations`` structs of label and
    text. A run without a synthesis says so.
    """
    seen = F.array_join(F.transform(observations, lambda o: F.concat(F.lit("### "), o["label"], F.lit("\n\n"), F.coalesce(o["text"], F.lit("")))), "\n\n---\n\n")
    return F.concat_ws(
        "\n\n",
        _head("Stilanalyse", [("Quellen", F.size(sources)), ("Modell", model), ("Frage", question)]),
        _section("## Vergleich", table(sources, COMPARED)),
        _section("### Klang", F.coalesce(table(sources, SOUNDS), F.lit("(Keine Klang-Kennzahlen verfügbar)"))),
        F.array_join(F.transform(sources, details), "\n\n---\n\n"),
        _section("## Beobachtungen", seen),
        _section("## Globale Synthese", F.coalesce(synthesis, F.lit("(Keine Synthese verfügbar)"))),
        _section("## Gegenposition", counter),
    )


def comparison_result(label_a: Column, label_b: Column, a: Column, b: Column, model: Column, question: Column, said: Column) -> Column:
    """What a comparison of two texts said, under a head that names both sides and their lengths."""
    side = lambda label, x: F.concat(F.coalesce(label, F.lit("?")), F.lit(" ("), F.coalesce(F.length(x).cast("string"), F.lit("?")), F.lit(" Zeichen)"))
    return F.concat(_head("Vergleich", [("Seite A", side(label_a, a)), ("Seite B", side(label_b, b)), ("Modell", F.coalesce(model, F.lit("?"))), ("Frage", question)]), F.lit("\n\n"), F.coalesce(said, F.lit("")))
