"""Flows of several model calls, what stands around an image call, and results as Markdown.

Stand-ins for models read their prompt and answer in several shapes, unreadable ones included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import render
from textloom.functions import text as T
from textloom.operators import flows as P
from textloom.plans import stats
from textloom.plans.book import Book
from textloom.plans.corpus import MESSAGES, messages, sql
from textloom.plans.prompts import ANSWERS, answers
from textloom.plans.retrieve import QUERY
from textloom.sources import importers

book = Book()
NL2 = "chr(10) || chr(10)"
TEN = "d AS (SELECT doc_id, doc_id // 10 AS answer, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS n, source, lang, text FROM documents WHERE text IS NOT NULL)"


def sections(task: str, *parts: tuple[str, str]) -> str:
    """SQL of an assembled prompt."""
    return f"concat_ws({NL2}, '{task}', " + ", ".join(f"CASE WHEN coalesce({x}, '') <> '' THEN '## {h}' || chr(10) || {x} END" for h, x in parts) + ")"


def same(prompt: Column) -> Column:
    """Stands for a model: says its whole prompt."""
    return prompt


def ten(t) -> DataFrame:
    """One row an answer, with its ten documents in order."""
    d = t.documents.filter("text is not null").select(F.floor(F.col("doc_id") / 10).alias("answer"), F.struct("doc_id", "source", "lang", "text").alias("d"))
    return d.groupBy("answer").agg(F.array_sort(F.collect_list("d")).alias("ds"))


def talks(t) -> DataFrame:
    """One row a conversation: its turns as one text."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    m = messages(t).filter("content is not null").groupBy("chat_id").agg(turns.alias("ts"))
    return m.select("chat_id", F.array_join(F.transform("ts", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("talk"))


TALKS = f"{MESSAGES}, talks AS (SELECT chat_id, string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS talk FROM messages WHERE content IS NOT NULL GROUP BY chat_id)"
EDIT = "Überarbeite den Entwurf."


def critic(prompt: Column) -> Column:
    """Finds a point for each comma, and says so in prose, as one object, as an empty or as a fenced list."""
    k = F.length(prompt) - F.length(F.replace(prompt, F.lit(","), F.lit("")))
    listed = F.to_json(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.struct(i.alias("problem"))))
    return F.when(k % 4 == 0, "nichts auszusetzen").when(k % 4 == 1, F.concat(F.lit('Nur dies: {"problem": '), k.cast("string"), F.lit("}"))).when(k % 4 == 2, "[]").otherwise(F.concat(F.lit("```json\n"), listed, F.lit("\n```")))


FOUND = """CASE k % 4 WHEN 1 THEN 'nur diese 1 Stelle ändern' || chr(10) || '{"problem":' || k || '}' WHEN 3 THEN 'nur diese 3 Stellen ändern' || chr(10) || '{"problem":1}' || chr(10) || '{"problem":2}' || chr(10) || '{"problem":3}' END"""


@book.query(
    "R10_agentic_input",
    sql(TALKS, f"SELECT chat_id, k % 4 IN (0, 2) AS skipped, CASE k % 4 WHEN 1 THEN 1 WHEN 3 THEN 3 END::BIGINT AS n_points, md5(CASE WHEN k % 4 IN (0, 2) THEN talk ELSE {sections(EDIT, ('Sprache', 'lang'), ('Entwurf', 'talk'), ('Kritikpunkte', FOUND))} END) AS text_md5 FROM (SELECT *, 'de' AS lang, length(talk) - length(replace(talk, ',', '')) AS k FROM talks)"),
)
def agentic(t):
    """Draft, critique and edit of each conversation."""
    return P.revised(talks(t), "r", F.col("talk"), F.lit("de"), critic, same, EDIT).select("chat_id", "r.skipped", F.size("r.points").cast("long").alias("n_points"), F.md5("r.text").alias("text_md5"))


MANAGER = f"CASE WHEN contains(talk, 'model: ') THEN md5({sections('Zeige, wer das Gespräch lenkt und wie.', ('Gespräch', 'talk'))}) ELSE '[FEHLER: MANAGER]' END"
EXILE = f"length({sections('Zeige die Brüche des Gesprächs.', ('Gespräch', 'talk'))})::VARCHAR"


@book.query("R15_supervision_input", sql(TALKS, f"SELECT chat_id, manager, exile, md5({sections('Begutachte die Beziehung.', ('Gespräch', 'talk'), ('Lenkung', 'manager'), ('Brüche', 'exile'))}) AS meta_md5 FROM (SELECT chat_id, talk, {MANAGER} AS manager, {EXILE} AS exile FROM talks)"))
def supervision(t):
    """Two readings of each conversation and a third call over both; the first model fails where no model speaks."""
    return P.supervised(talks(t), "r", F.col("talk"), lambda p: F.when(F.contains(p, F.lit("model: ")), F.md5(p)), lambda p: F.length(p).cast("string"), same).select("chat_id", "r.manager", "r.exile", F.md5("r.meta").alias("meta_md5"))


def extractor(prompt: Column) -> Column:
    """Quotes every source whose speaker is de."""
    found = [F.regexp_extract_all(prompt, F.lit(r"SOURCE_ID \[([0-9]+)\] \| SPEAKER: de \| CONTENT: ([^\n]*)"), F.lit(g)) for g in (1, 2)]
    quotes = F.zip_with(*found, lambda i, q: F.struct(i.cast("int").alias("source_id"), F.lit("de").alias("speaker"), q.alias("quote")))
    return F.to_json(F.struct(quotes.alias("primary_quotes")))


def validator(prompt: Column) -> Column:
    """Contradicts quotations with an ß; has nothing readable to say of a single one."""
    given = F.from_json(F.regexp_extract(prompt, r"(?s)## Zitate\n(.*)\n\n## Erwähnungen", 1), P.QUOTES)
    bad = lambda q: F.contains(q["quote"], F.lit("ß"))
    against = F.transform(F.filter(given, bad), lambda q: F.struct(q["source_id"].alias("primary_id")))
    return F.when(F.size(given) == 1, "kaputt").otherwise(F.to_json(F.struct(F.filter(given, lambda q: ~bad(q)).alias("validated_primary"), against.alias("contradictions"))))


@book.query(
    "N22_evidence_first",
    f"""WITH {TEN}, p AS (SELECT answer, n, replace(text, chr(10), ' ') AS q, count(*) OVER (PARTITION BY answer) > 1 AND contains(text, 'ß') AS bad FROM d WHERE lang = 'de'),
e AS (SELECT answer, string_agg('[' || n || '] de: ' || q, chr(10) ORDER BY n) FILTER (NOT bad) AS quoted, '[' || coalesce(string_agg('{{"primary_id":' || n || '}}', ',' ORDER BY n) FILTER (bad), '') || ']' AS against FROM p GROUP BY answer)
SELECT DISTINCT d.answer, CASE WHEN against IS NOT NULL THEN md5({sections('Schreibe den Text aus den geprüften Zitaten.', ('Frage', f"'{QUERY}'"), ('Zitate', 'quoted'), ('Widersprüche', 'against'))}) END AS text_md5 FROM d LEFT JOIN e USING (answer)""",
)
def evidence_first(t):
    """Quotations of one speaker, checked and written up; null where the speaker has none."""
    sources = F.transform("ds", lambda x: F.struct(x["lang"].alias("speaker"), x["text"].alias("content")))
    return P.evidence_text(ten(t), "said", F.lit(QUERY), sources, F.array(F.lit("de")), extractor, validator, same).select("answer", F.md5("said").alias("text_md5"))


def lister(prompt: Column) -> Column:
    """Takes the first line of each German or French chunk for a fact; a single one is not worth a list."""
    found = [F.regexp_extract_all(prompt, F.lit(r"--- CHUNK ID ([0-9]+) ---\nMetadaten: Datum=[^,]*, Modell=(de|fr), Rolle=[^\n]*\nInhalt: ([^\n]*)"), F.lit(g)) for g in (1, 2, 3)]
    listed = F.transform(F.arrays_zip(*(f.alias(n) for f, n in zip(found, "isq", strict=True))), lambda x: F.struct(x["i"].cast("int").alias("source_id"), x["s"].alias("speaker"), x["q"].alias("fact")))
    return F.when(F.size(found[0]) > 1, F.to_json(listed)).otherwise("nichts Erwähnenswertes")


@book.query("N23_fact_extractor", f"WITH {TEN} SELECT answer, doc_id, lang AS speaker, md5(split_part(text, chr(10), 1)) AS fact_md5 FROM (SELECT *, count(*) OVER (PARTITION BY answer) AS k FROM d WHERE lang IN ('de', 'fr')) WHERE k > 1")
def fact_extractor(t):
    """Facts that a model lists from an answer's documents, each led back to its document."""
    chunks = F.transform("ds", lambda x: F.struct(F.lit(None).cast("string").alias("date"), x["lang"].alias("speaker"), x["source"].alias("role"), x["text"].alias("content")))
    rows = P.facts(ten(t), "fs", chunks, lister).select("answer", "ds", F.explode("fs").alias("f"))
    return rows.select("answer", F.element_at("ds", F.col("f.source_id") + 1)["doc_id"].alias("doc_id"), "f.speaker", F.md5("f.fact").alias("fact_md5"))


#: What an instruction adds by the origin of its images.
ORIGINS = {"photograph": "Das Bild zeigt, was vor der Kamera war.", "drawing": "Das Bild zeigt, was jemand zeichnen wollte."}


@book.query(
    "R71_vision_prompt",
    f"""WITH {TEN}, a AS (SELECT answer, max_by(lang, n) AS last, count(*) FILTER (length(text) > 2000) AS k, string_agg(md5(text), '|' ORDER BY n) FILTER (length(text) > 2000) AS images FROM d GROUP BY answer)
SELECT answer, CASE WHEN k > 0 THEN k + 1 END::BIGINT AS n_parts, CASE WHEN k > 0 THEN 'Beschreibe.' || CASE last WHEN 'en' THEN {NL2} || '{ORIGINS["photograph"]}' WHEN 'de' THEN {NL2} || '{ORIGINS["drawing"]}' ELSE '' END END AS instruction,
images || '|' || CASE WHEN last = 'en' THEN '{QUERY}' WHEN k >= 2 THEN 'Analysiere und vergleiche die Bilder.' ELSE 'Analysiere das Bild.' END AS said FROM a""",
)
def vision_prompt(t):
    """Long texts of an answer as its images (their bytes are all a call looks at); the last document asks."""
    images = F.transform(F.filter("ds", lambda x: F.length(x["text"]) > 2000), lambda x: F.struct(F.encode(x["text"], "utf-8").alias("bytes"), F.lit("image/png").alias("mime")))
    last = F.element_at("ds", -1)["lang"]
    origin = F.when(last == "en", "photograph").when(last == "de", "drawing").otherwise("unknown")
    call = P.vision_call(images, F.when(last == "en", QUERY), origin, "Beschreibe.", ORIGINS)
    said = F.array_join(F.transform("call.parts", lambda p: F.coalesce(F.md5(p["bytes"]), p["text"])), "|")
    return ten(t).select("answer", call.alias("call")).select("answer", F.size("call.parts").cast("long").alias("n_parts"), "call.instruction", said.alias("said"))


@book.query("R58_anchor_path", "SELECT doc_id, CASE WHEN lang IN ('es', 'fr') THEN lang || '/anker.md' WHEN f.source IS NOT NULL THEN d.source || '/anker.md' ELSE 'anker.md' END AS path FROM documents d LEFT JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND n_chars > 2000) f ON d.source = f.source")
def anchor_path(t):
    """Where the list of a document lies: named by its language, else by its source if a file is there."""
    files = t.documents.filter("lang = 'de' and n_chars > 2000").select(F.concat("source", F.lit("/anker.md")).alias("file")).distinct()
    d = t.documents.select("doc_id", F.when(F.col("lang").isin("es", "fr"), F.concat("lang", F.lit("/anker.md"))).alias("setting"), F.concat("source", F.lit("/anker.md")).alias("default"))
    return d.join(files, d["default"] == files["file"], "left").select("doc_id", P.first_path(F.col("setting"), F.col("default"), F.col("file").isNotNull(), "anker.md").alias("path"))


KNOWN = ", ".join(f"('{k}', '{v.title}', {list(v.formats)}, {v.experimental}, '{v.description}')" for k, v in importers.INFO.items())


@book.query("R99_platform_info", f"WITH known(platform, title, formats, experimental, description) AS (VALUES {KNOWN}), names AS (SELECT platform FROM known UNION SELECT source FROM documents WHERE source IS NOT NULL) SELECT n.platform, coalesce(k.title, n.platform) AS title, coalesce(k.formats, []) AS formats, coalesce(k.experimental, TRUE) AS experimental, coalesce(k.description, 'Unbekannte Plattform') AS description FROM names n LEFT JOIN known k USING (platform)")
def platform_info(t):
    """What is known of each platform; the sources of documents are unknown ones."""
    names = t.spark.createDataFrame([(k,) for k in importers.INFO], "platform string").union(t.documents.filter("source is not null").select("source")).distinct()
    return names.select("platform", importers.info(F.col("platform")).alias("i")).select("platform", "i.*")


# Results
@book.query(
    "B19_render_comparison",
    f"""{ANSWERS} SELECT answer, md5('---' || chr(10) || 'Vergleich' || chr(10) || 'Seite A: ' || language || ' (' || length(first) || ' Zeichen)' || chr(10) || 'Seite B: ' || author || ' (' || length(last) || ' Zeichen)' || chr(10) || 'Modell: ?' || chr(10)
|| CASE WHEN anchors <> '' THEN 'Frage: ' || question || chr(10) ELSE '' END || '---' || {NL2} || comparison) AS markdown_md5 FROM answers""",
)
def render_comparison(t):
    """First and last document of an answer compared; only some comparisons were asked for by a question."""
    x = render.comparison_result(F.col("language"), F.col("author"), F.col("first"), F.col("last"), F.lit(None).cast("string"), F.when(F.col("anchors") != "", F.col("question")), F.col("comparison"))
    return answers(t).select("answer", F.md5(x).alias("markdown_md5"))


def styled(t) -> DataFrame:
    """Figures of each document for a style result, made where the text lies. Sounds are left unknown."""
    d = t.documents.filter("text is not null")
    lengths = F.transform(T.verse_lines(F.col("text")), lambda s: F.size(T.fields(s)))
    s = T.sentences(F.col("text"))
    d = d.select("doc_id", "source", "text", T.words(F.col("text")).alias("w"), s.alias("s"), T.lines(F.col("text")).alias("l"), lengths.alias("v"))
    d = d.withColumns({"k": F.transform("s", T.clause_type), "n": F.transform("s", lambda x: F.size(T.words(x))), "y": F.transform("l", stats.syllables)})
    few = (F.size("v") >= 2) & ((T.mean(F.col("v")) < 12) | (T.deviation(F.col("v")) < 3))
    blocks = F.filter(F.transform(F.split("text", "\n\n"), lambda b: F.size(T.lines(b))), lambda n: n > 0)
    upto = F.greatest(F.size("l") - 1, F.lit(0))
    carried = F.zip_with(F.slice("l", 1, upto), F.slice("l", 2, upto), stats.runs_on)
    fields = {
        "chars": F.length("text"), "words": F.size("w"), "sentences": F.size("s"), "avg_sentence": T.rounded(F.when(F.size("n") == 0, F.lit(0.0)).otherwise(T.mean(F.col("n"))), 1),
        **{name: F.size("k") - F.size(F.array_remove("k", kind)) for name, kind in (("hs", "HS"), ("ns", "NS"), ("mixed", "gemischt"))},
        "ttr": T.rounded(T.type_token_ratio(F.col("w")), 3), "morphology": T.morphological_complexity(F.col("w")).cast("double"), "commas": T.occurrences(F.col("text"), ","),
        "verse": F.when(few, "ja").otherwise("nein"), "stanzas": F.size(blocks), "syllables": F.when(F.size("y") > 0, T.rounded(T.mean(F.col("y")), 1)), "enjambements": F.when(upto > 0, F.size(F.filter(carried, lambda x: x))),
        **{name: F.lit(None).cast("string") for name in ("rhyme", "alliterations", "assonances", "internal_rhymes", "echoes")}, "said": F.try_element_at("s", F.lit(1)),
    }
    return d.select("doc_id", F.concat("source", F.lit(" "), F.col("doc_id").cast("string")).alias("label"), *(x.alias(name) for name, x in fields.items()))


def sql_row(*cells: str) -> str:
    return "'| ' || concat_ws(' | ', " + ", ".join(f"coalesce({c}::VARCHAR, '—')" for c in cells) + ") || ' |'"


def sql_table(columns: dict[str, str]) -> str:
    head = "| " + " | ".join(columns) + " |"
    return f"'{head}' || chr(10) || '|{' --- |' * len(columns)}' || chr(10) || string_agg({sql_row(*columns.values())}, chr(10) ORDER BY doc_id)"


def sql_bullets(columns: dict[str, str]) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"'- **{name}:** ' || {c}::VARCHAR" for name, c in columns.items()) + ")"


SHEET = f"""sheet AS (SELECT d.doc_id, d.doc_id // 10 AS answer, source || ' ' || d.doc_id AS label, a.chars, a.words, a.sentences, a.avg_sentence, hs, ns, mixed, a.ttr, complexity AS morphology, a.commas, CASE WHEN signal_strength = 'kein' THEN 'nein' ELSE 'ja' END AS verse,
  stanza_count AS stanzas, avg_syllables AS syllables, n_runs AS enjambements, NULL AS rhyme, NULL AS alliterations, NULL AS assonances, NULL AS internal_rhymes, NULL AS echoes, said
FROM documents d JOIN ({stats.book.oracles["E32_comparison_table"]}) a ON a.doc_id = d.doc_id JOIN ({stats.book.oracles["E21_sentence_types"]}) b ON b.doc_id = d.doc_id JOIN ({stats.book.oracles["E24_morphological_complexity"]}) c ON c.doc_id = d.doc_id
JOIN ({stats.book.oracles["E27_verse_structure"]}) e ON e.doc_id = d.doc_id JOIN ({stats.book.oracles["K05_stanzas"]}) f ON f.doc_id = d.doc_id LEFT JOIN ({stats.book.oracles["K11_verse_rhythm"]}) g ON g.doc_id = d.doc_id LEFT JOIN ({stats.book.oracles["K10_enjambement"]}) h ON h.doc_id = d.doc_id
JOIN ({stats.WITH}SELECT doc_id, s[1] AS said FROM d) j ON j.doc_id = d.doc_id)"""
RULE = f"{NL2} || '---' || {NL2}"


@book.query(
    "B18_render_style",
    f"""WITH {SHEET} SELECT answer, md5(concat_ws({NL2}, '---' || chr(10) || 'Stilanalyse' || chr(10) || 'Quellen: ' || count(*) || chr(10) || 'Frage: {QUERY}' || chr(10) || '---',
'## Vergleich' || {NL2} || {sql_table(render.COMPARED)}, '### Klang' || {NL2} || {sql_table(render.SOUNDS)},
string_agg(concat_ws({NL2}, '### ' || label, {sql_bullets(render.DETAILS)}, CASE verse WHEN 'ja' THEN '**Verse**' || {NL2} || {sql_bullets(render.VERSE)} END), {RULE} ORDER BY doc_id),
'## Beobachtungen' || {NL2} || string_agg('### ' || label || {NL2} || coalesce(said, ''), {RULE} ORDER BY doc_id),
'## Globale Synthese' || {NL2} || CASE WHEN sum(words) > 2000 THEN sum(words) || ' Wörter' ELSE '(Keine Synthese verfügbar)' END,
CASE WHEN max_by(coalesce(said, ''), doc_id) <> '' THEN '## Gegenposition' || {NL2} || max_by(said, doc_id) END)) AS markdown_md5 FROM sheet GROUP BY answer""",
)
def render_style(t):
    """The style result of each answer's ten documents; long answers have a synthesis."""
    rows = styled(t)
    rows = rows.groupBy(F.floor(F.col("doc_id") / 10).alias("answer")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rs"))
    total = F.aggregate("rs", F.lit(0).cast("long"), lambda n, r: n + r["words"])
    observed = F.transform("rs", lambda r: F.struct(r["label"].alias("label"), r["said"].alias("text")))
    synthesis = F.when(total > 2000, F.concat(total.cast("string"), F.lit(" Wörter")))
    x = render.style_result(F.col("rs"), observed, synthesis, F.element_at("rs", -1)["said"], F.lit(QUERY), F.lit(None).cast("string"))
    return rows.select("answer", F.md5(x).alias("markdown_md5"))
