"""Run files, exports, model slots and orchestration over the input tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.functions import judge as J
from textloom.functions import metaruns as M
from textloom.functions import text as T
from textloom.operators import corpus as C
from textloom.operators import slots
from textloom.plans import judge
from textloom.plans.book import Book
from textloom.plans.corpus import CHATS, MESSAGES, chats, messages, sql

book = Book()
D = "FROM documents WHERE text IS NOT NULL"


#: What a run file says of its document: its number and all its words in one line.
SAYS = "(doc_id || ' ' || trim(lower(regexp_replace(text, '[^A-Za-zÄÖÜäöüß]+', ' ', 'g'))))"


def runs(t):
    """A run file a document, of one of three versions, that holds the words of the document."""
    i = F.col("doc_id").cast("string")
    said = F.concat(i, F.lit(" "), F.trim(F.lower(F.regexp_replace("text", "[^A-Za-zÄÖÜäöüß]+", " "))))
    version = F.when(F.col("doc_id") % 3 == 0, "v2.3").when(F.col("doc_id") % 3 == 1, "v2.5.1").otherwise("v2.8")
    file = F.concat(
        F.lit("# Meta-Hermeneutic Analyse ("), version, F.lit(")\n**Runs:** "), i, F.lit("\n**Dauer:** 12.5s\n**Modell Beobachten:** m1\n**Etappe-1-Daten:** Ja\n\n## META-SEZIEREN\n| Run | n |\n| --- | --- |\n| r"), i,
        F.lit(" | 1 |\n\n## META-BEOBACHTEN\nText "), said, F.lit("\n### 4. FREIER RAUM\nfrei\n### 5. Mehr\nx\n\n## META-DESTILLATION\nErster Satz. Letzter Satz "), said,
        F.lit(".\n\n### GLOBALE SYNTHESE\n**HYPOTHESE**\nKern "), said, F.lit("\n\nBlok (Quelle 1) und Пушкин (Quelle 2)\n\nKlang-Vergleichstabelle\n| QUELLE 1 | 396 | 38 | 4 | 42 |\n| QUELLE 2 | 1 | 2 | 3 | "), i, F.lit(" |\n"),
    )
    return t.documents.filter("text is not null").select("doc_id", file.alias("x"))


@book.query("J44_core_hypothesis", f"SELECT doc_id, 'Kern ' || {SAYS} AS kern {D}")
def core_hypothesis(t):
    return runs(t).select("doc_id", M.core_hypothesis(F.col("x")).alias("kern"))


LAB = f"SELECT doc_id, 'b' || {SAYS} AS beweis, 'r' || doc_id AS raum, 'h' || {SAYS} AS hypothese {D}"


@book.query("J46_beweisfuehrung", LAB)
@book.query("J47_freier_raum", LAB)
@book.query("J48_hypothese", LAB)
def lab_sections(t):
    i = F.col("doc_id").cast("string")
    said = F.concat(i, F.lit(" "), F.trim(F.lower(F.regexp_replace("text", "[^A-Za-zÄÖÜäöüß]+", " "))))
    x = F.concat(F.lit("## BEWEISFÜHRUNG\nb"), said, F.lit("\n## FREIER RAUM\nr"), i, F.lit("\n## HYPOTHESE\nh"), said)
    return t.documents.filter("text is not null").select("doc_id", x.alias("x")).select("doc_id", *(J.section(F.col("x"), h).alias(n) for h, n in (("BEWEISFÜHRUNG", "beweis"), ("FREIER RAUM", "raum"), ("HYPOTHESE", "hypothese"))))


@book.query("J49_destillation", f"SELECT doc_id, md5('Erster Satz. Letzter Satz ' || {SAYS} || '.') AS head_md5 {D}")
def destillation(t):
    return runs(t).select("doc_id", F.md5(F.regexp_extract(M.destillation(F.col("x")), r"\A([^\n]*)", 1)).alias("head_md5"))


@book.query("J50_last_sentence", f"SELECT doc_id, 'Letzter Satz ' || {SAYS} || '.' AS s {D}")
def last_sentence(t):
    short = F.regexp_replace("x", r"(?s)\n\n### GLOBALE.*", "")
    return runs(t).select("doc_id", M.last_sentence(short).alias("s"))


@book.query("J51_beobachten", f"SELECT doc_id, md5('Text ' || {SAYS} || chr(10) || '### 4. FREIER RAUM' || chr(10) || 'frei' || chr(10) || '### 5. Mehr' || chr(10) || 'x') AS part_md5 {D}")
def beobachten(t):
    return runs(t).select("doc_id", F.md5(M.beobachten(F.col("x"))).alias("part_md5"))


@book.query("J52_free_space", f"SELECT doc_id, 'frei' AS raum {D}")
def free_space(t):
    return runs(t).select("doc_id", M.free_space(F.col("x")).alias("raum"))


@book.query("J53_table_lines", f"SELECT doc_id, 3::BIGINT AS n_lines {D}")
def table_lines(t):
    return runs(t).select("doc_id", F.size(M.table_lines(F.col("x"))).cast("long").alias("n_lines"))


VERSION = "CASE doc_id % 3 WHEN 0 THEN 'v2.3' WHEN 1 THEN 'v2.5.1' ELSE 'v2.8' END"


@book.query("J54_meta_header", f"SELECT doc_id, {VERSION} AS version, doc_id::INT AS runs, 12.5::DOUBLE AS seconds, 'm1' AS model_beobachten, TRUE AS has_stage1 {D}")
def meta_header(t):
    return runs(t).select("doc_id", M.header(F.col("x")).alias("h")).select("doc_id", "h.version", "h.runs", "h.seconds", "h.model_beobachten", "h.has_stage1")


@book.query("J55_variant", f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant {D}")
def variant(t):
    return runs(t).select("doc_id", M.variant(M.header(F.col("x"))["version"]).alias("variant"))


@book.query("J56_is_run_file", f"SELECT doc_id, TRUE AS is_run {D}")
def is_run_file(t):
    return runs(t).select("doc_id", M.is_run_file(F.col("x")).alias("is_run"))


@book.query("A39_dissect_runs", f"SELECT doc_id, {VERSION} AS version, 'Kern ' || {SAYS} AS kern, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant {D}")
def dissect_runs(t):
    h = M.header(F.col("x"))["version"]
    return runs(t).select("doc_id", h.alias("version"), M.core_hypothesis(F.col("x")).alias("kern"), M.variant(h).alias("variant"))


@book.query("E34_run_diagnostics", f"SELECT CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS variant, count(*) AS n, count(*) AS n_kern {D} GROUP BY 1")
def run_diagnostics(t):
    return dissect_runs(t).groupBy("variant").agg(F.count("*").alias("n"), F.count("kern").alias("n_kern"))


@book.query("E33_sound_sums", f"SELECT doc_id, 1::INT AS source, 480::INT AS total {D} UNION ALL SELECT doc_id, 2, (6 + doc_id)::INT {D}")
def sound_sums(t):
    return runs(t).select("doc_id", F.explode(M.sound_sums(F.col("x"))).alias("s")).select("doc_id", "s.*")


@book.query("K23_detect_authors", f"SELECT doc_id, 'Blok,Puschkin' AS authors {D}")
@book.query("K25_authors_in_texts", f"SELECT doc_id, 'Blok,Puschkin' AS authors {D}")
def detect_authors(t):
    return runs(t).select("doc_id", F.array_join(M.authors(F.col("x")), ",").alias("authors"))


@book.query("K24_source_authors", "SELECT * FROM (VALUES (1::INT, 'Blok'), (2::INT, 'Пушкин')) v(source, author)")
def source_authors(t):
    found = runs(t).select("doc_id", F.posexplode(M.source_authors(F.col("x"))).alias("pos", "a")).select("doc_id", "pos", "a.*")
    return found.groupBy("source").agg(F.min_by("author", F.struct("priority", "doc_id", "pos")).alias("author"))


NAMES = ["Blok", "Synthese", "Texts", "AufSicht", "Mandelstam", "Die", "Verdichtung", "Imperativs", "Stabilität", "Wertes", "Reimes", "Celans", *(way for ways in M.AUTHORS.values() for way in ways)]
SQL_NAMES = f"WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-ZÄÖÜ][a-zäöüß]+')) AS name FROM documents UNION SELECT unnest({NAMES}))"


def names(t):
    """Capitalised words of all texts, and names that are known."""
    words = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-ZÄÖÜ][a-zäöüß]+"), F.lit(0))).alias("name"))
    return words.union(t.spark.createDataFrame([(n,) for n in NAMES], "name string")).distinct()


LIKELY = f"""{SQL_NAMES} SELECT name, length(name) >= 4 AND NOT list_contains({list(M.NO_NAMES)}, name)
AND NOT (ends_with(name, 's') AND (list_contains({list(M.NO_NAMES)}, regexp_replace(name, 's$', '')) OR list_contains({list(M.NO_NAMES)}, regexp_replace(name, 'es$', '')) OR length(name) <= 6))
AND NOT regexp_matches(name, '^(Auf|Bei|Durch|Für|Gegen|In|Mit|Nach|Über|Um|Unter|Vom|Von|Vor|Zu)[A-ZÄÖÜ][a-zäöüß]+') AND NOT regexp_matches(name, '({"|".join(M.NO_SURNAME_ENDINGS)})$') AS likely FROM names"""


@book.query("J57_likely_author", LIKELY)
def likely_author(t):
    return names(t).select("name", M.likely_author(F.col("name")).alias("likely"))


@book.query("J60_likely_author_lab", f"{SQL_NAMES} SELECT name, length(name) >= 4 AND name NOT IN {M.NO_LAB_NAMES} AND NOT (ends_with(name, 's') AND (name[:-2] IN {M.NO_LAB_NAMES} OR length(name) > 4 AND ends_with(name, 'es') AND name[:-3] IN {M.NO_LAB_NAMES})) AS likely FROM names")
def likely_author_lab(t):
    return names(t).select("name", M.likely_lab_author(F.col("name")).alias("likely"))


FORMS = ", ".join(f"('{way}', '{form}')" for form, ways in M.AUTHORS.items() for way in ways)


@book.query("J58_canonical_author", f"{SQL_NAMES} SELECT name, coalesce(form, name) AS form FROM names LEFT JOIN (VALUES {FORMS}) v(way, form) ON way = name")
def canonical_author(t):
    return names(t).select("name", M.canonical(F.col("name")).alias("form"))


@book.query("J59_authors_sidecar", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{\"QUELLE 1\":\"' || source || '\"}' END AS sidecar FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def authors_sidecar(t):
    head = F.concat(F.lit('<!-- AUTHORS {"QUELLE 1":"'), "source", F.lit('"} -->\n'), "text")
    d = t.documents.filter("text is not null and source is not null")
    return d.select("doc_id", J.author_sidecar(F.when(F.col("doc_id") % 2 == 0, head).otherwise(F.col("text"))).alias("sidecar"))


@book.query("B20_embed_sidecar", "SELECT doc_id, md5('<!-- AUTHORS {\"QUELLE 1\":\"' || source || '\"} -->' || chr(10) || text) AS markdown_md5 FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def embed_sidecar(t):
    """A text keeps the sidecar that it has."""
    authors = F.create_map(F.lit("QUELLE 1"), F.col("source"))
    once = t.documents.filter("text is not null and source is not null").select("doc_id", "source", slots.with_sidecar(F.col("text"), authors).alias("x"))
    return once.select("doc_id", F.md5(slots.with_sidecar(F.col("x"), authors)).alias("markdown_md5"))


@book.query("K26_author_priority", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'user' WHEN contains(text, 'é') THEN 'sidecar' WHEN n_chars > 2000 THEN 'model' ELSE 'unresolved' END AS provenance FROM documents")
def author_priority(t):
    """Who names the author of a text: the user, else its sidecar, else the model."""
    given = [(F.when(F.col("lang") == "de", "a"), "user"), (F.when(F.contains("text", F.lit("é")), "b"), "sidecar"), (F.when(F.col("n_chars") > 2000, "c"), "model")]
    told = F.coalesce(*(F.when(c.isNotNull(), n) for c, n in given), F.lit("unresolved"))
    return t.documents.select("doc_id", told.alias("provenance"))


AGENCY = "SELECT doc_id, CASE lang WHEN 'de' THEN 'aktiv' WHEN 'en' THEN 'passiv' END AS agency FROM documents"


@book.query("J11_agency_json", AGENCY)
def agency_json(t):
    """Answers of which some break off and some leave the vocabulary."""
    said = F.when(F.col("lang") == "de", '"aktiv"').when(F.col("lang") == "en", '"passiv"}').when(F.col("lang") == "fr", "null}").otherwise('"sonst"}')
    return t.documents.select("doc_id", M.json_map(F.concat(F.lit('Hier: {"Blok": '), said), ("aktiv", "passiv"))["Blok"].alias("agency"))


TERMS = "SELECT doc_id, CASE WHEN contains(text, 'é') THEN 2 ELSE 1 END::BIGINT AS n, source AS term FROM documents WHERE text IS NOT NULL AND source IS NOT NULL"


@book.query("J12_terms_json", TERMS)
@book.query("R38_terms_per_run", TERMS)
def terms_json(t):
    """Terms of a run; those without a meaning go."""
    x = F.concat(F.lit('{"a": "'), "source", F.lit('", "b": null, "c": '), F.when(F.contains("text", F.lit("é")), '"x"').otherwise("null"), F.lit("}"))
    d = t.documents.filter("text is not null and source is not null").select("doc_id", M.json_map(x).alias("m"))
    return d.select("doc_id", F.size("m").cast("long").alias("n"), F.col("m")["a"].alias("term"))


STRIPPED = "'**[Buch-Auszug Teil 1]**' || chr(10) || 'QUELLE 1: x' || chr(10) || text || CASE doc_id % 3 WHEN 0 THEN chr(10) || 'Chapter: 3' || chr(10) || '[ein Hinweis]' WHEN 1 THEN chr(10) || '(Published 1999)' || chr(10) || chr(10) || chr(10) || 'Ende' ELSE '' END"
for _pattern, _by in (
    (r"\*\*\[.*?\]\*\*[ \t\n\x0b\f\r]*", ""), (r"(?m)^.*[Aa]uszug.*$", ""), (r"(?m)^.{3,60}[—–-]\s*[«„\x22].*?[»“\x22].*?\([0-9]{4}\)\s*$", ""), (r"(?m)^.{3,60}[—–-]\s*[«„\x22].*?[»“\x22]\s*$", ""),
    (r"(?m)^\((?:Опубликовано|Veröffentlicht|Published).*?\)\s*$", ""), (r"\n{3,}", "\n\n"), (r"(?m)^QUELLE\s+[0-9]+:\s*.*$", ""), (r"(?m)^\[.{3,300}\]\s*$", ""), (r"(?m)^(?:Sprache|Language|Kapitel|Chapter|Source):.*$", ""),
):
    STRIPPED = f"regexp_replace({STRIPPED}, '{_pattern}', '{_by}', 'g')"


@book.query("J26_strip_metadata", f"SELECT doc_id, md5(regexp_replace({STRIPPED}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS text_md5 {D}")
def strip_metadata(t):
    """Whole texts with lines of importers before and after them."""
    i, n = F.col("doc_id") % 3, "\n"
    end = F.when(i == 0, f"{n}Chapter: 3{n}[ein Hinweis]").when(i == 1, f"{n}(Published 1999){n}{n}{n}Ende").otherwise("")
    return t.documents.filter("text is not null").select("doc_id", F.md5(T.without_metadata(F.concat(F.lit(f"**[Buch-Auszug Teil 1]**{n}QUELLE 1: x{n}"), F.col("text"), end))).alias("text_md5"))


@book.query("J41_template", f"SELECT doc_id, md5('Frage ' || doc_id || ' {{offen}} ' || text) AS filled_md5 {D}")
def template(t):
    """Known names are filled in, others stay."""
    x = slots.fill(F.lit("Frage {id} {offen} {text}"), {"id": F.col("doc_id").cast("string"), "text": F.col("text")})
    return t.documents.filter("text is not null").select("doc_id", F.md5(x).alias("filled_md5"))


@book.query("R40_stability", "SELECT source, CASE WHEN s >= 0.88 THEN 'stabil' WHEN s >= 0.59 THEN 'häufig' ELSE 'variabel' END AS stability FROM (SELECT source, count(*) FILTER (lang = 'en') / count(*)::DOUBLE AS s FROM documents GROUP BY source)")
def stability(t):
    share = t.documents.groupBy("source").agg((F.count_if(F.col("lang") == "en") / F.count("*")).alias("s"))
    return share.select("source", M.stability(F.col("s")).alias("stability"))


# Sinks
@book.query("B01_create_chat", sql(CHATS, "SELECT sha256(id || '|' || title)[1:32] AS chat_id FROM chats"))
def create_chat(t):
    return chats(t).select(slots.stable_id("id", "title").alias("chat_id"))


@book.query("B02_save_message", sql(MESSAGES, "SELECT chat_id, max(turn) AS last_turn, count(*) AS n FROM messages GROUP BY chat_id"))
def save_message(t):
    return messages(t).groupBy("chat_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@book.query("B03_import_to_db", sql(MESSAGES, "SELECT chat_id, bool_or(contains(content, '**Thinking:**')) AS has_thinking, min(content) FILTER (turn = 0) IS NOT NULL AS titled FROM messages GROUP BY chat_id"))
def import_to_db(t):
    return messages(t).groupBy("chat_id").agg(F.bool_or(F.contains("content", F.lit("**Thinking:**"))).alias("has_thinking"), F.min(F.when(F.col("turn") == 0, F.col("content"))).isNotNull().alias("titled"))


@book.query("B06_index_pipeline")
def index_pipeline(t):
    """Messages long enough, cut into chunks, hashed, first of each hash kept, classified."""
    long_enough = messages(t).filter(F.length(F.trim("content")) >= 50)
    cut = long_enough.select("id", "chat_id", "role", F.col("content").alias("text")).select("id", "chat_id", "role", "text", F.posexplode(C.chunk_spans(F.col("text"))).alias("i", "span"))
    rows = cut.select(F.concat_ws("_", "chat_id", F.col("id").cast("string"), F.col("i").cast("string")).alias("chunk_id"), "role", F.substring(F.col("text"), F.col("span.lo") + 1, F.col("span.hi") - F.col("span.lo")).alias("content"))
    hashed = rows.withColumn("h", F.sha2("content", 256))
    first = hashed.groupBy("h").agg(F.min_by(F.struct("role", "content"), "chunk_id").alias("r"), F.min("chunk_id").alias("chunk_id"))
    return first.select("chunk_id", "r.role", J.content_type(F.col("r.content")).alias("content_type"), F.size(J.entities(F.col("r.content"))).cast("long").alias("entity_count"), "h")


@book.query("B10_json_dump", "SELECT event_id, '{\"event_id\":' || event_id || ',\"type\":\"' || event_type || '\",\"day\":\"' || strftime(ts, '%Y-%m-%d') || '\"}' AS j FROM events")
def json_dump(t):
    return t.events.select("event_id", F.to_json(F.struct("event_id", F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("day"))).alias("j"))


@book.query("B11_evidence_table", sql(f"{CHATS}, {MESSAGES}", "SELECT m.id, row_number() OVER (ORDER BY length(content) DESC, m.id) AS rank, coalesce(nullif(title, ''), 'Unbekannt') AS chat_title, role FROM messages m LEFT JOIN chats c ON c.id = m.chat_id ORDER BY length(content) DESC, m.id LIMIT 100"))
def evidence_table(t):
    best = messages(t).orderBy(F.length("content").desc(), "id").limit(100)
    ranked = best.select("id", "chat_id", "role", F.row_number().over(W.orderBy(F.length("content").desc(), "id")).cast("long").alias("rank"))
    c = chats(t).select(F.col("id").alias("cid"), "title")
    return ranked.join(c, ranked["chat_id"] == c["cid"], "left").select("id", "rank", F.coalesce(F.nullif("title", F.lit("")), F.lit("Unbekannt")).alias("chat_title"), "role")


@book.query("B14_save_analysis", "SELECT lang, '[' || string_agg('\"' || doc_id || '\"', ',' ORDER BY doc_id) || ']' AS ids FROM documents WHERE n_chars > 8000 GROUP BY lang")
def save_analysis(t):
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda i: i.cast("string"))
    return t.documents.filter("n_chars > 8000").groupBy("lang").agg(F.to_json(ids).alias("ids"))


@book.query("B22_comparison_markdown", "SELECT lang, string_agg('| ' || source || ' | ' || n || ' |', chr(10) ORDER BY source) AS markdown FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang")
def comparison_markdown(t):
    per = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    return per.groupBy("lang").agg(slots.markdown_rows(["source", "n"], "source").alias("markdown"))


@book.query("B23_sound_markdown", "SELECT lang, string_agg('| ' || source || ' | ' || coalesce(n::VARCHAR, '—') || ' |', chr(10) ORDER BY source) AS markdown FROM (SELECT lang, source, nullif(count(*) FILTER (n_chars > 9000), 0) AS n FROM documents GROUP BY lang, source) GROUP BY lang")
def sound_markdown(t):
    per = t.documents.groupBy("lang", "source").agg(F.nullif(F.count_if(F.col("n_chars") > 9000), F.lit(0).cast("long")).alias("n"))
    return per.groupBy("lang").agg(slots.markdown_rows(["source", "n"], "source").alias("markdown"))


@book.query("B07_bibliography", "SELECT lang, '---' || chr(10) || 'language: ' || lang || chr(10) || '---' || chr(10) || string_agg('[' || r || '] ' || source, chr(10) ORDER BY r) AS markdown FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS r FROM (SELECT DISTINCT lang, source FROM documents)) GROUP BY lang")
@book.query("B08_record_markdown", "SELECT lang, '---' || chr(10) || 'language: ' || lang || chr(10) || '---' || chr(10) || string_agg('[' || r || '] ' || source, chr(10) ORDER BY r) AS markdown FROM (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS r FROM (SELECT DISTINCT lang, source FROM documents)) GROUP BY lang")
def bibliography(t):
    s = t.documents.select("lang", "source").distinct().withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("source")))
    lines = F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("["), F.col("r").cast("string"), F.lit("] "), F.col("source")).alias("line"))))
    body = F.array_join(F.transform(lines, lambda x: x["line"]), "\n")
    return s.groupBy("lang").agg(F.concat(F.lit("---\nlanguage: "), F.first("lang"), F.lit("\n---\n"), body).alias("markdown"))


@book.query("B21_stats_report", "SELECT doc_id, 'QUELLE ' || doc_id || ': ' || length(text) || ' Zeichen' AS report " + D)
def stats_report(t):
    return t.documents.filter("text is not null").select("doc_id", F.format_string("QUELLE %d: %d Zeichen", "doc_id", F.length("text")).alias("report"))


# Model slots and what stands around them
@book.query("L04_embed_batches", "SELECT DISTINCT sha256(text) AS h, 16::INTEGER AS n, TRUE AS unit " + D)
def embed_batches(t):
    """Vectors of the deterministic stand-in for an embedding model, one a distinct text, in batches of the model's size."""
    made = slots.embed(t.documents.filter("text is not null").select("text"), "text", slots.hashed_embedder(16))
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("h", F.size("embedding").alias("n"), (F.abs(length - 1) < 1e-5).alias("unit"))


@book.query("R21_llm_slot", "SELECT doc_id, 'echo: ' || text AS answer " + D)
def llm_slot(t):
    return t.documents.filter("text is not null").select("doc_id", slots.echo_model(F.col("text")).alias("answer"))


@book.query("L19_quotes_per_document", "SELECT doc_id, 2::INT AS n FROM documents WHERE length(text) >= 50")
@book.query("R08_extract_quotes", "SELECT doc_id, 2::INT AS n FROM documents WHERE length(text) >= 50")
def quotes_per_document(t):
    """An answer's quotations by JSON, each forced to its source, the first of equal heads kept."""
    d = t.documents.filter(F.length("text") >= 50)
    answer = F.concat(F.lit('```json\n[{"quelle": 9, "text": "a"}, {"quelle": 9, "text": "a"}, {"quelle": 1, "text": "b'), F.col("doc_id").cast("string"), F.lit('"}]\n```'))
    q = F.from_json(J.json_of(answer), "array<struct<quelle:int,text:string>>")
    one = d.select("doc_id", F.explode(q).alias("q")).select("doc_id", F.substring("q.text", 1, 100).alias("head")).distinct()
    return one.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


DRAFTED = "'### QUELLE [1]: ' || text || chr(10) || '### QUELLE [2]: b'"
FIXED = "'### QUELLE [1]: ' || text[1:length(text) * (6 + doc_id % 5) // 10] || CASE WHEN contains(text, 'e') THEN chr(10) || '### QUELLE [2]: b' ELSE '' END"


@book.query("R17_accept_correction", f"SELECT doc_id, length({FIXED}) >= 0.8 * length({DRAFTED}) AND contains(text, 'e') AS accepted {D}")
def accept_correction(t):
    """A corrected draft counts if it is long enough and still has the last source's heading."""
    first, last = F.lit("### QUELLE [1]: "), F.lit("\n### QUELLE [2]: b")
    kept = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") * (F.col("doc_id") % 5 + 6) / 10).cast("int"))
    fixed = F.concat(first, kept, F.when(F.contains("text", F.lit("e")), last).otherwise(""))
    return t.documents.filter("text is not null").select("doc_id", slots.accepted(F.concat(first, "text", last), fixed, F.lit(2)).alias("accepted"))


SIGNS = "ßéñwz"


@book.query("R18_missing_after_continuation", f"SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN NOT contains(text, '{c}') THEN '{k}' END" for k, c in enumerate(SIGNS, 1))}) AS missing {D}")
def missing_after_continuation(t):
    """Sections that a draft still lacks; it has one for each of the signs that its text holds."""
    heads = (F.when(F.contains("text", F.lit(c)), F.concat(F.lit(f"### QUELLE [{k}]: "), "text")) for k, c in enumerate(SIGNS, 1))
    draft = F.concat_ws("\n", *heads)
    return t.documents.filter("text is not null").select("doc_id", F.array_join(F.transform(J.missing_sections(draft, F.lit(len(SIGNS))), lambda x: x.cast("string")), ",").alias("missing"))


JUDGED = "SELECT (r - 1) // 4 AS batch, count(*) AS n, count(*) FILTER (NOT contains(text, 'ß')) = count(*) AS complete FROM (SELECT text, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r <= 100 GROUP BY 1"


@book.query("R20_judge_batch", JUDGED)
@book.query("D08_scores_to_batch", JUDGED)
def judge_batch(t):
    """The best hundred in batches of four; a batch with a missing verdict is not complete."""
    top = t.documents.filter("text is not null").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id", "text", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id")).alias("r"))
    verdicts = top.filter(~F.contains("text", F.lit("ß"))).select(F.col("doc_id").alias("judged"))
    both = top.join(verdicts, F.col("doc_id") == F.col("judged"), "left").withColumn("batch", F.floor((F.col("r") - 1) / 4))
    return both.groupBy("batch").agg(F.count("*").alias("n"), (F.count("judged") == F.count("*")).alias("complete"))


@book.query("R23_context_lines", sql(MESSAGES, "SELECT chat_id, string_agg('SOURCE_ID [' || turn || '] | ' || role || ' | ' || content, chr(10) ORDER BY turn) AS context FROM messages GROUP BY chat_id"))
def context_lines(t):
    line = F.format_string("SOURCE_ID [%d] | %s | %s", "turn", "role", "content")
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages(t).groupBy("chat_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("context"))


@book.query("R24_evidence_kind", sql(CHATS, "SELECT id, CASE WHEN model_name IN ('de', 'fr') THEN 'primary' ELSE 'secondary' END AS kind FROM chats"))
def evidence_kind(t):
    return chats(t).select("id", F.when(F.coalesce("model_name", F.lit("")).isin("de", "fr"), "primary").otherwise("secondary").alias("kind"))


@book.query("R07_trace", "SELECT doc_id, round(n_chars / 7.0::DOUBLE, 3)::DOUBLE AS score, replace(text[1:120], chr(10), ' ') AS preview FROM documents WHERE text IS NOT NULL")
def trace(t):
    return t.documents.filter("text is not null").select("doc_id", F.round(F.col("n_chars") / F.lit(7.0), 3).alias("score"), F.translate(F.substring("text", 1, 120), "\n", " ").alias("preview"))


@book.query("R03_chat_ids", "SELECT lang, count(DISTINCT source) AS n, CASE WHEN count(DISTINCT source) <= 10 THEN array_to_string(list_sort(list(DISTINCT source)), ',') END AS ids FROM documents GROUP BY lang")
def chat_ids(t):
    g = t.documents.groupBy("lang").agg(F.countDistinct("source").alias("n"), F.array_sort(F.collect_set("source")).alias("s"))
    return g.select("lang", "n", F.when(F.col("n") <= 10, F.array_join("s", ",")).alias("ids"))


@book.query("R28_title_input", sql(MESSAGES, "SELECT chat_id, string_agg(content[1:300], chr(10) ORDER BY turn) FILTER (turn < 4) AS input FROM messages GROUP BY chat_id"))
def title_input(t):
    parts = F.array_sort(F.collect_list(F.when(F.col("turn") < 4, F.struct("turn", F.substring("content", 1, 300).alias("x")))))
    return messages(t).groupBy("chat_id").agg(F.nullif(F.array_join(F.transform(parts, lambda p: p["x"]), "\n"), F.lit("")).alias("input"))


@book.query("R29_topic_input", sql(MESSAGES, "SELECT chat_id, coalesce(nullif(string_agg(content[1:500], chr(10) ORDER BY turn) FILTER (turn < 4 AND role = 'user'), ''), 'Analyse') AS input FROM messages GROUP BY chat_id"))
def topic_input(t):
    """What a topic is found from: the heads of the first user turns, or the default topic."""
    parts = F.array_sort(F.collect_list(F.when((F.col("turn") < 4) & (F.col("role") == "user"), F.struct("turn", F.substring("content", 1, 500).alias("x")))))
    said = F.nullif(F.array_join(F.transform(parts, lambda p: p["x"]), "\n"), F.lit(""))
    return messages(t).groupBy("chat_id").agg(F.coalesce(said, F.lit("Analyse")).alias("input"))


@book.query("R48_temperature", "SELECT doc_id, CASE lang WHEN 'de' THEN 0.3 WHEN 'en' THEN 0.7 WHEN 'fr' THEN 0.5 ELSE 0.6 END::DOUBLE AS temperature FROM documents")
@book.query("R72_domain_profile", "SELECT doc_id, CASE lang WHEN 'de' THEN 0.3 WHEN 'en' THEN 0.7 WHEN 'fr' THEN 0.5 ELSE 0.6 END::DOUBLE AS temperature FROM documents")
def temperature(t):
    parts = F.create_map(*(F.lit(x) for kv in {"de": 0.3, "en": 0.7, "fr": 0.5}.items() for x in kv))
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(parts, F.col("lang")), F.lit(0.6)).alias("temperature"))


@book.query("R74_text_of_parts", "SELECT doc_id, lang AS x FROM documents")
def text_of_parts(t):
    return t.documents.select("doc_id", F.try_element_at(F.array("lang", "source"), F.lit(1)).alias("x"))


@book.query("R78_model_for_task", "SELECT doc_id, CASE lang WHEN 'de' THEN 'gross' ELSE 'klein' END AS model FROM documents")
def model_for_task(t):
    """The model of a task; an unknown task gets the one for chats."""
    models = F.create_map(F.lit("synthesis"), F.lit("gross"), F.lit("chat"), F.lit("klein"))
    task = F.when(F.col("lang") == "de", "synthesis").when(F.col("lang") == "en", "chat").otherwise("unbekannt")
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(models, task), models["chat"]).alias("model"))


@book.query("R83_float_pack", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s FROM embeddings")
@book.query("R84_float_unpack", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s FROM embeddings")
def float_pack(t):
    return t.embeddings.select("vec_id", F.round(F.aggregate(F.col("embedding").cast("array<float>"), F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("s"))


@book.query("R91_pdf_title", "SELECT doc_id, 'T' || doc_id AS title FROM documents")
@book.query("R92_book_title", "SELECT doc_id, 'T' || doc_id AS title FROM documents")
def book_title(t):
    return t.documents.select("doc_id", F.trim(F.regexp_extract(F.concat(F.lit("**Titel:** T"), F.col("doc_id").cast("string"), F.lit("\nText")), r"\*\*Titel:\*\*\s*([^\n]+)", 1)).alias("title"))


QUOTED = "[text[1:30], text[length(text) // 2 + 1:length(text) // 2 + 30]]"


@book.query("N05_warning_tags", f"SELECT doc_id, len(list_filter(string_split('Anfang' || chr(10) || chr(10) || text, chr(10) || chr(10)), lambda p: len(list_filter({QUOTED}, lambda q: contains(p, q))) >= 2)) > 0 AS tagged {D}")
def warning_tags(t):
    """Paragraphs in which two or more quotations failed get a warning; here a text's head and middle."""
    quote = F.array(F.substring("text", 1, 30), F.substring(F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1, F.lit(30)))
    draft = F.concat(F.lit("Anfang\n\n"), "text")
    return t.documents.filter("text is not null").select("doc_id", F.contains(slots.warned(draft, quote), F.lit("<WARNUNG")).alias("tagged"))


@book.query("N06_validate_draft")
def validate_draft(t):
    """All findings of a draft: range, presence, bare references, missing sections."""
    from textloom.plans import kernels

    tags = judge.quote_tags(t).filter("code <> 'ok'").select("doc_id", F.when(F.col("code") == "C1", "C1").otherwise("C2?").alias("code"))
    fuzzy = kernels.fuzzy_window(t).filter("not accepted").select("doc_id", F.lit("C2").alias("code"))
    refs = judge.orphan_references(t).select("doc_id", "code")
    return tags.filter("code = 'C1'").union(fuzzy).union(refs).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@book.query("N08_correction_prompt", sql(judge.DRAFTS, f"SELECT doc_id, 'Korrigiere:' || chr(10) || string_agg('- ' || code || ' [' || source_id || ']', chr(10) ORDER BY code, source_id) AS prompt FROM (SELECT doc_id, source_id, CASE WHEN source_id > 3 THEN 'C1' WHEN NOT contains({judge.SQ.format('text')}, {judge.SQ.format('quote')}) THEN 'C2' END AS code FROM drafts UNION ALL SELECT doc_id, r, CASE WHEN r BETWEEN 1 AND 3 THEN 'C5' ELSE 'C6' END FROM drafts, (VALUES (1), (2), (9)) v(r)) WHERE code IS NOT NULL GROUP BY doc_id"))
def correction_prompt(t):
    """The findings of a draft as the lines of a correction."""
    tags = judge.quote_tags(t).filter("code <> 'ok'").select("doc_id", "source_id", F.when(F.col("code") == "C1", "C1").otherwise("C2").alias("code"))
    found = tags.unionByName(judge.orphan_references(t).select("doc_id", "source_id", "code"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("code", "source_id"))), lambda x: F.concat(F.lit("- "), x["code"], F.lit(" ["), x["source_id"].cast("string"), F.lit("]")))
    return found.groupBy("doc_id").agg(F.concat(F.lit("Korrigiere:\n"), F.array_join(lines, "\n")).alias("prompt"))


@book.query("R01_dry_run_answer")
def dry_run_answer(t):
    """The ranked context of an answer, without the model call: search, parity, budget, numbering."""
    from textloom.operators import ranking as R
    from textloom.plans import retrieve

    found = retrieve.hybrid_search(t)
    docs = t.documents.select("doc_id", F.col("source").alias("chat_id"), F.col("text").alias("content"))
    top = R.ranked(found.join(docs, "doc_id"), [F.desc("rrf"), F.col("doc_id")])
    kept = R.token_budget(top, 60000)
    first = kept.withColumn("f", F.min("rank").over(W.partitionBy("chat_id")))
    return first.select("doc_id", "rank", F.dense_rank().over(W.orderBy("f")).alias("source_id"), F.substring("content", 1, 120).alias("preview"))
