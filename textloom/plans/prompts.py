"""Prompts: what stands before a model call, assembled from the sources of an answer.

An answer draws on ten documents. Each query returns the prompt's length and digest, so that
whole texts go into it and are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.book import Book
from textloom.plans.retrieve import QUERY
from textloom.plans.stats import SQL_WORDS

book = Book()

#: Heading of a section and the column of ``answers`` that fills it.
SECTIONS = {
    "Frage": "question", "Sprache": "language", "Quellenverzeichnis": "directory", "Auszüge": "context", "Kennzahlen": "figures", "Vergleich": "comparison", "Text A": "first", "Text B": "last",
    "Andere Quellen": "others", "Verfasser": "author", "Regeln": "rules", "Verlauf": "history", "Anker": "anchors", "Fragen": "questions",
}

#: Task and sections of each prompt, in order.
PROMPTS = {
    "R06_synthesis_prompt": ("Beantworte die Frage allein aus den Auszügen und belege jeden Satz mit seiner Nummer.", "Frage Sprache Quellenverzeichnis Kennzahlen Auszüge Regeln"),
    "R19_questions": ("Forme jede Frage in eine Aussage um, eine je Zeile.", "Fragen"),
    "R26_final_text": ("Schreibe den Text aus den geprüften Belegen.", "Frage Quellenverzeichnis Auszüge"),
    "R32_style_prompt": ("Beschreibe den Stil der Quelle anhand ihrer Kennzahlen.", "Frage Verfasser Andere_Quellen Kennzahlen Vergleich Text_A"),
    "R33_counter_prompt": ("Nimm für jede Quelle die Gegenposition zur Synthese ein.", "Frage Auszüge Kennzahlen Vergleich"),
    "R34_global_prompt": ("Fasse die Ergebnisse aller Quellen zusammen.", "Frage Verfasser Kennzahlen Vergleich Auszüge"),
    "R35_comparison_prompt": ("Vergleiche die beiden Texte.", "Frage Text_A Text_B"),
    "R41_counter_position": ("Widersprich der Beobachtung.", "Auszüge Vergleich"),
    "R42_adjudication": ("Entscheide zwischen Beobachtung und Gegenposition.", "Text_A Text_B"),
    "R43_distillation": ("Verdichte die Beobachtung.", "Text_A"),
    "R44_revised_distillation": ("Verdichte nach der Entscheidung neu.", "Text_A Kennzahlen"),
    "R46_confrontation": ("Halte die Ergebnisse gegen die Kritik.", "Auszüge Text_B"),
    "R50_opening": ("Eröffne das Gespräch mit einem Satz.", "Sprache Frage"),
    "R52_prepare_call": ("Antworte auf die Nachricht.", "Verlauf Anker Frage"),
    "R54_opening": ("Eröffne das Gespräch mit einem Satz.", "Sprache"),
    "R61_parameters": ("Antworte auf die Nachricht.", "Verlauf Frage"),
}

RULES = "Nur Belegtes. Keine Quelle ohne Nummer."
ANSWERS = f"""WITH d AS (SELECT doc_id, doc_id // 10 AS answer, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS n, source, lang, text, len({SQL_WORDS}) AS words FROM documents WHERE text IS NOT NULL),
answers AS (SELECT answer, '{QUERY}' AS question, '{RULES}' AS rules, min(lang) AS language,
  string_agg('[' || n || '] ' || source || ', Dokument ' || doc_id || ' (' || lang || ')', chr(10) ORDER BY n) AS directory,
  string_agg('[' || n || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context,
  string_agg('[' || n || '] ' || length(text) || ' Zeichen, ' || words || ' Wörter', chr(10) ORDER BY n) AS figures,
  '| Nr | Zeichen | Wörter |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || n || ' | ' || length(text) || ' | ' || words || ' |', chr(10) ORDER BY n) AS comparison,
  min_by(text, n) AS first, max_by(text, n) AS last, max_by(source, n) AS author,
  coalesce(string_agg(source, ', ' ORDER BY n) FILTER (n > 1), '') AS others,
  string_agg(CASE WHEN n % 2 = 1 THEN 'Nutzer: ' ELSE 'Modell: ' END || source, chr(10) ORDER BY n) AS history,
  coalesce(string_agg('- ' || lang, chr(10) ORDER BY n) FILTER (n <= 3 AND lang <> 'de'), '') AS anchors,
  string_agg(n || '. Was sagt ' || source || '?', chr(10) ORDER BY n) AS questions
FROM d GROUP BY answer)"""


def answers(t) -> DataFrame:
    """One row an answer: what its prompts are made of. Ten documents are one answer, so groups are small."""
    d = t.documents.filter("text is not null").select(F.floor(F.col("doc_id") / 10).alias("answer"), F.struct("doc_id", "source", "lang", "text", F.size(T.words(F.col("text"))).alias("words")).alias("d"))
    rows = d.groupBy("answer").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    ds = F.transform("ds", lambda x, i: F.struct((i + 1).cast("string").alias("n"), i.alias("i"), x.alias("d")))
    rows = rows.select("answer", ds.alias("ds"))

    def joined(line, between: str = "\n", keep=None):
        some = F.filter("ds", keep) if keep else F.col("ds")
        return F.array_join(F.transform(some, line), between)

    def text(*parts):
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    chars = lambda x: F.length(x["d"]["text"])
    return rows.select(
        "answer",
        F.lit(QUERY).alias("question"),
        F.lit(RULES).alias("rules"),
        F.array_min(F.transform("ds", lambda x: x["d"]["lang"])).alias("language"),
        joined(lambda x: text("[", x["n"], "] ", x["d"]["source"], ", Dokument ", x["d"]["doc_id"], " (", x["d"]["lang"], ")")).alias("directory"),
        joined(lambda x: text("[", x["n"], "]\n", x["d"]["text"]), "\n\n").alias("context"),
        joined(lambda x: text("[", x["n"], "] ", chars(x), " Zeichen, ", x["d"]["words"], " Wörter")).alias("figures"),
        F.concat(F.lit("| Nr | Zeichen | Wörter |\n|---|---|---|\n"), joined(lambda x: text("| ", x["n"], " | ", chars(x), " | ", x["d"]["words"], " |"))).alias("comparison"),
        F.col("ds")[0]["d"]["text"].alias("first"),
        F.element_at("ds", -1)["d"]["text"].alias("last"),
        F.element_at("ds", -1)["d"]["source"].alias("author"),
        joined(lambda x: x["d"]["source"], ", ", lambda x: x["i"] > 0).alias("others"),
        joined(lambda x: F.concat(F.when(x["i"] % 2 == 0, "Nutzer: ").otherwise("Modell: "), x["d"]["source"])).alias("history"),
        joined(lambda x: text("- ", x["d"]["lang"]), "\n", lambda x: (x["i"] < 3) & (x["d"]["lang"] != "de")).alias("anchors"),
        joined(lambda x: text(x["n"], ". Was sagt ", x["d"]["source"], "?")).alias("questions"),
    )


def register(name: str, task: str, headings: list[str]) -> None:
    sections = [(h, SECTIONS[h]) for h in headings]
    parts = ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN '## {h}' || chr(10) || {c} END" for h, c in sections)

    @book.query(name, f"{ANSWERS}, p AS (SELECT answer, concat_ws(chr(10) || chr(10), '{task}', {parts}) AS x FROM answers) SELECT answer, length(x) AS n_chars, md5(x) AS prompt_md5 FROM p")
    def run(t):
        x = T.assembled(task, *((h, F.col(c)) for h, c in sections))
        return answers(t).select("answer", x.alias("x")).select("answer", F.length("x").cast("long").alias("n_chars"), F.md5("x").alias("prompt_md5"))


for _name, (_task, _headings) in PROMPTS.items():
    register(_name, _task, [h.replace("_", " ") for h in _headings.split()])


@book.query("R36_meta_comparison", f"{ANSWERS} SELECT answer, 'echo: ' || concat_ws(chr(10) || chr(10), 'Vergleiche die beiden Texte.', '## Frage' || chr(10) || question, '## Text A' || chr(10) || first, '## Text B' || chr(10) || last) AS said FROM answers WHERE first <> last")
def meta_comparison(t):
    """Both sides in one call; equal sides are not compared."""
    from textloom.operators import slots

    x = T.assembled("Vergleiche die beiden Texte.", ("Frage", F.col("question")), ("Text A", F.col("first")), ("Text B", F.col("last")))
    return answers(t).filter("first <> last").select("answer", slots.echo_model(x).alias("said"))
