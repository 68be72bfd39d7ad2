"""Classification, scoring and verification over the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.functions import judge as J
from textloom.functions import lexicon as lx
from textloom.functions import text as T
from textloom.plans.book import Book
from textloom.plans.corpus import MESSAGES, messages, sql

book = Book()
WS = "[ \\t\\n\\x0B\\f\\r]"


def lit(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def has(of: str, needles) -> str:
    return "(" + " OR ".join(f"contains({of}, '{n}')" for n in needles) + ")"


# Titles and lines made from the documents, alike in both languages
TITLED = """titled AS (SELECT doc_id, text, CASE doc_id % 8 WHEN 0 THEN 'Chat Mai 2024' WHEN 1 THEN 'Notiz am 04122025 v3.' || (doc_id % 10) WHEN 2 THEN 'Brief 99999999 05102025' WHEN 3 THEN 'DeepSeek Arena' WHEN 4 THEN 'deepseek am 01022024' WHEN 5 THEN 'GPT-4o Analyse' WHEN 6 THEN 'Claude 3.5 Tagebuch' ELSE 'Dokument ' || doc_id END AS title,
  CASE doc_id % 5 WHEN 0 THEN 'DeepSeek-R1: ' WHEN 1 THEN 'ChatGPT-4o: ' WHEN 2 THEN 'claude (neu): ' ELSE '' END || text AS line FROM documents WHERE text IS NOT NULL)"""


def titled(t):
    i = F.col("doc_id")
    title = F.when(i % 8 == 0, "Chat Mai 2024").when(i % 8 == 1, F.concat(F.lit("Notiz am 04122025 v3."), (i % 10).cast("string"))).when(i % 8 == 2, "Brief 99999999 05102025").when(i % 8 == 3, "DeepSeek Arena").when(i % 8 == 4, "deepseek am 01022024").when(i % 8 == 5, "GPT-4o Analyse").when(i % 8 == 6, "Claude 3.5 Tagebuch").otherwise(F.concat(F.lit("Dokument "), i.cast("string")))
    line = F.concat(F.when(i % 5 == 0, "DeepSeek-R1: ").when(i % 5 == 1, "ChatGPT-4o: ").when(i % 5 == 2, "claude (neu): ").otherwise(""), F.col("text"))
    return t.documents.filter("text is not null").select("doc_id", "text", title.alias("title"), line.alias("line"))


DATE = "CASE doc_id % 8 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2025-12-04' WHEN 2 THEN '2025-10-05' WHEN 4 THEN '2024-02-01' END"


@book.query("J01_date_in_title", sql(TITLED, f"SELECT doc_id, {DATE} AS iso FROM titled"))
def date_in_title(t):
    return titled(t).select("doc_id", J.date_in_title(F.col("title")).alias("iso"))


@book.query("J02_version_in_title", sql(TITLED, "SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN '3.' || (doc_id % 10) WHEN 3 THEN '3.2' WHEN 4 THEN '2.5' WHEN 5 THEN '4o' WHEN 6 THEN '3.5' END AS version FROM titled"))
def version_in_title(t):
    return titled(t).select("doc_id", J.version_in_title(F.col("title"), F.lit("")).alias("version"))


@book.query("J03_metadata_date", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN '2025-05-01' ELSE NULL END AS iso FROM events")
@book.query("G07_chronological", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN '2025-05-01' ELSE NULL END AS iso FROM events")
def metadata_date(t):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.date_format("ts", "dd.MM.yyyy")).when(i % 4 == 1, "Mai 2025").when(i % 4 == 2, "o.D.").otherwise("")
    return t.events.select("event_id", F.date_format(J.metadata_date(raw), "yyyy-MM-dd").alias("iso")).orderBy(F.asc_nulls_first("iso"), "event_id")


@book.query("J05_keywords", f"SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(translate(text, '-_', '  '), '{WS}+'), lambda w: w <> ''), lambda w: regexp_replace(lower(w), '^[?\".,!:]+|[?\".,!:]+$', '', 'g')), lambda w: NOT list_contains({lit(lx.KEYWORD_STOPS)}, w) AND length(w) > 2), ' ') AS keywords FROM documents")
def keywords(t):
    return t.documents.select("doc_id", F.array_join(J.keywords(F.col("text")), " ").alias("keywords"))


@book.query("J06_citation_format", "SELECT doc_id, md5(concat_ws(' ', '[' || doc_id || ']', text, '[' || doc_id || ']')) AS cleaned_md5 FROM documents")
def citation_format(t):
    i = F.col("doc_id").cast("string")
    x = F.concat_ws(" ", F.concat(F.lit("[source_id: "), i, F.lit("]")), "text", F.concat(F.lit("[Quelle:"), i, F.lit("]")))
    return t.documents.select("doc_id", F.md5(J.citation_format(x)).alias("cleaned_md5"))


@book.query("J07_thought_and_speech", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x' || doc_id END AS thought, md5(text) AS speech_md5 FROM documents WHERE text IS NOT NULL")
def thought_and_speech(t):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("> **Thinking:** x"), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    thought, speech = J.thought_and_speech(raw)
    return t.documents.filter("text is not null").select("doc_id", thought.alias("thought"), F.md5(speech).alias("speech_md5"))


@book.query("J13_sanitize_term", "SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}_]', '', 'g') AS term FROM documents")
def sanitize_term(t):
    return t.documents.select("doc_id", F.regexp_replace("text", "[^\\p{L}\\p{N}_]", "").alias("term"))


@book.query("J14_normalize_whitespace", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS text_md5 FROM documents")
def normalize_whitespace(t):
    return t.documents.select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("text_md5"))


@book.query("J28_normalize_for_rhyme", f"SELECT DISTINCT w, CASE WHEN length(w) > 2 AND right(w, 1) = 'e' AND NOT contains('aeiouäöü', w[-2:-2]) THEN w[:-2] ELSE w END AS rhyme FROM (SELECT unnest(regexp_extract_all(lower(text), '[{lx.LETTERS}]+')) AS w FROM documents)")
def normalize_for_rhyme(t):
    w = F.col("w")
    mute = (F.length(w) > 2) & F.endswith(w, F.lit("e")) & (F.instr(F.lit("aeiouäöü"), F.substring(w, -2, 1)) == 0)
    d = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[{lx.LETTERS}]+"), F.lit(0))).alias("w")).distinct()
    return d.select("w", F.when(mute, F.left(w, F.length(w) - 1)).otherwise(w).alias("rhyme"))


@book.query("J30_strip_punctuation", "SELECT doc_id, translate(text, ',.;:!?(\"«»—–-…', '') AS bare FROM documents")
def strip_punctuation(t):
    return t.documents.select("doc_id", F.translate("text", ',.;:!?("«»—–-…', "").alias("bare"))


ECHO = f"list_distinct(list_filter(list_transform(regexp_extract_all({{}}, '[a-zA-ZäöüÄÖÜß]+'), lambda w: lower(w)), lambda w: NOT list_contains({lit(lx.ECHO_STOPS)}, w) AND length(w) >= 3))"


@book.query("J33_echo_tokens", "SELECT conv_id, turn, len(regexp_extract_all(text, '[a-zA-ZäöüÄÖÜß]+'))::BIGINT AS n_tokens FROM conversations")
def echo_tokens(t):
    return t.conversations.select("conv_id", "turn", F.regexp_count("text", F.lit("[a-zA-ZäöüÄÖÜß]+")).cast("long").alias("n_tokens"))


@book.query("J34_echo_content_words", f"SELECT conv_id, turn, len({ECHO.format('text')})::BIGINT AS n_words FROM conversations")
def echo_content_words(t):
    return t.conversations.select("conv_id", "turn", F.size(J.echo_words(F.col("text"))).cast("long").alias("n_words"))


@book.query("J35_text_hash", "SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def text_hash(t):
    return t.documents.filter("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))


@book.query("J36_cache_key", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS k FROM conversations GROUP BY conv_id")
def cache_key(t):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return t.conversations.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("k"))


@book.query("J37_claim_hash", "SELECT doc_id, sha256(lower(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) || doc_id)[1:16] AS h FROM documents WHERE text IS NOT NULL")
def claim_hash(t):
    return t.documents.filter("text is not null").select("doc_id", J.claim_hash(F.col("text"), F.col("doc_id")).alias("h"))


@book.query("M01_classify_speaker", sql(TITLED, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'DeepSeek-R1' WHEN 1 THEN 'ChatGPT-4o' WHEN 2 THEN 'claude' END AS raw, CASE WHEN doc_id % 5 < 3 THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence FROM titled"))
def classify_speaker(t):
    d = titled(t).select("doc_id", J.speaker_raw(F.col("line")).alias("raw"), F.floor(F.col("doc_id") / 10).alias("part"))
    w = W.partitionBy("part").orderBy("doc_id").rowsBetween(W.unboundedPreceding, 0)
    known = F.last("raw", ignorenulls=True).over(w)
    return d.select("doc_id", "raw", F.when(F.col("raw").isNotNull(), 0.95).when(known.isNotNull(), 0.6).otherwise(0.3).alias("confidence"))


@book.query("M02_speaker_hierarchy", sql(TITLED, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'DeepSeek' WHEN 1 THEN 'ChatGPT' WHEN 2 THEN 'claude' END AS family, CASE doc_id % 5 WHEN 0 THEN 'R1' WHEN 1 THEN '4o' END AS version FROM titled"))
def speaker_hierarchy(t):
    family, version = J.speaker_parts(F.col("raw"))
    return titled(t).select("doc_id", J.speaker_raw(F.col("line")).alias("raw")).select("doc_id", family.alias("family"), version.alias("version"))


EDGE = "[.,!?:;()\\[\\]\"''«»„]+"


@book.query("M03_entities", f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^{EDGE}|{EDGE}$', '', 'g')), lambda c: length(c) > 2 AND regexp_matches(c, '^\\p{{Lu}}')))), ',') AS entities FROM documents WHERE text IS NOT NULL")
def entities(t):
    return t.documents.filter("text is not null").select("doc_id", F.array_join(J.entities(F.col("text")), ",").alias("entities"))


TYPE = f"CASE WHEN contains(x, '?') AND ({has('lower(x)', lx.QUESTION_WORDS)} OR ends_with(regexp_replace(x, '{WS}+$', ''), '?')) THEN 'Frage' WHEN {has('lower(x)', lx.REFLECTION)} THEN 'Selbstreflexion' WHEN {has('lower(x)', lx.COMPARISON)} THEN 'Vergleich' ELSE 'Analyse' END"
MADE = "SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN ' was soll das?' WHEN 1 THEN ' Ich denke nach.' WHEN 2 THEN ' im Vergleich dazu' WHEN 3 THEN ' so?' ELSE '' END AS x FROM documents WHERE text IS NOT NULL"


def made(t):
    i = F.col("doc_id")
    end = F.when(i % 6 == 0, " was soll das?").when(i % 6 == 1, " Ich denke nach.").when(i % 6 == 2, " im Vergleich dazu").when(i % 6 == 3, " so?").otherwise("")
    return t.documents.filter("text is not null").select("doc_id", F.concat("text", end).alias("x"))


@book.query("M04_content_type", f"SELECT doc_id, {TYPE} AS kind FROM ({MADE})")
def content_type(t):
    return made(t).select("doc_id", J.content_type(F.col("x")).alias("kind"))


@book.query("M05_process_chunk", sql(TITLED, f"SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'DeepSeek-R1' WHEN 1 THEN 'ChatGPT-4o' WHEN 2 THEN 'claude' ELSE 'Unknown' END AS model_name, {TYPE.replace('(x', '(line').replace('x,', 'line,')} AS content_type FROM titled"))
def process_chunk(t):
    raw = J.speaker_raw(F.col("line"))
    return titled(t).select("doc_id", F.coalesce(raw, F.lit("Unknown")).alias("model_name"), J.content_type(F.col("line")).alias("content_type"))


#: Words of crisis after the text of some documents, and the mode by their language.
CRISIS_END = ("Ich bin verzweifelt und hoffnungslos.", "Alles ist sinnlos, ich weiß nicht mehr weiter.", "Ich will nicht mehr leben.", "Ich will einfach weg.", "verzweifelt, hoffnungslos, sinnlos, suizid")
CRISIS_MODE = {"de": "IFS_FIGHT", "en": "IFS_CONTROL", "es": "namaste"}


def re2(pattern: str) -> str:
    return pattern.replace("\\w", "[\\p{L}\\p{N}_]")


HITS = ", ".join(f"CASE WHEN regexp_matches(x, '{re2(p)}') THEN {w} END" for w, _, p in lx.CRISIS)
CRISIS = f"""crisis AS (SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN 2 ELSE 3 END AS threshold, lower(concat_ws(' ', text, CASE doc_id % 7 {" ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(CRISIS_END))} END)) AS x FROM documents),
hits AS (SELECT doc_id, threshold, list_filter([{HITS}], lambda w: w IS NOT NULL) AS h FROM crisis), scores AS (SELECT doc_id, threshold, coalesce(list_sum(h), 0)::INT AS score, list_reduce([0] || h, lambda s, w: CASE WHEN s >= threshold THEN s ELSE s + w END)::INT AS folded FROM hits)"""


def crisis_text(t):
    """Whole texts, most with a sentence of crisis at their end."""
    end, mode = F.lit(None).cast("string"), F.col("lang")
    for k, said in enumerate(CRISIS_END):
        end = F.when(F.col("doc_id") % 7 == k, said).otherwise(end)
    for lang, name in CRISIS_MODE.items():
        mode = F.when(F.col("lang") == lang, name).otherwise(mode)
    return t.documents.select("doc_id", F.concat_ws(" ", "text", end).alias("x"), mode.alias("mode"))


@book.query("M06_crisis_user_input", sql(CRISIS, "SELECT doc_id, folded AS score FROM scores"))
@book.query("R55_crisis_wrapper", sql(CRISIS, "SELECT doc_id, folded AS score FROM scores"))
@book.query("R65_crisis_user", sql(CRISIS, "SELECT doc_id, folded AS score FROM scores"))
def crisis_user_input(t):
    limit = J.crisis_threshold(F.col("mode"))
    return crisis_text(t).select("doc_id", J.folded_score(J.crisis_hits(F.col("x")), limit).cast("int").alias("score"))


@book.query("M07_crisis_model_output", sql(CRISIS, "SELECT doc_id, score FROM scores"))
@book.query("R66_crisis_model", sql(CRISIS, "SELECT doc_id, score FROM scores"))
def crisis_model_output(t):
    return crisis_text(t).select("doc_id", F.aggregate(J.crisis_hits(F.col("x")), F.lit(0), lambda s, w: s + w).alias("score"))


@book.query("M08_crisis_threshold", "SELECT doc_id, CASE lang WHEN 'de' THEN 2 WHEN 'es' THEN 2 ELSE 3 END::INT AS threshold FROM documents")
def crisis_threshold(t):
    return crisis_text(t).select("doc_id", J.crisis_threshold(F.col("mode")).alias("threshold"))


@book.query("R56_replace_output", sql(CRISIS, "SELECT doc_id, CASE WHEN score >= threshold THEN 'NOTFALL' ELSE 'frei' END AS shown FROM scores"))
@book.query("R57_emergency_text", sql(CRISIS, "SELECT doc_id, CASE WHEN score >= threshold THEN 'NOTFALL' ELSE 'frei' END AS shown FROM scores"))
def replace_output(t):
    score = F.aggregate(J.crisis_hits(F.col("x")), F.lit(0), lambda s, w: s + w)
    return crisis_text(t).select("doc_id", F.when(score >= J.crisis_threshold(F.col("mode")), "NOTFALL").otherwise("frei").alias("shown"))


PAIRS = f"pairs AS (SELECT id, content, lag(content) OVER (PARTITION BY chat_id ORDER BY turn) AS said, role FROM messages), e AS (SELECT id, {ECHO.format('content')} AS mine, {ECHO.format('said')} AS theirs FROM pairs WHERE role = 'model' AND said IS NOT NULL), o AS (SELECT id, CASE WHEN len(mine) = 0 THEN 0 ELSE len(list_intersect(mine, theirs)) / len(mine)::DOUBLE END::DOUBLE AS overlap FROM e)"


def overlaps(t):
    said = F.lag("content").over(W.partitionBy("chat_id").orderBy("turn"))
    m = messages(t).withColumn("said", said).filter("role = 'model' and said is not null")
    return m.select("id", J.echo_overlap(F.col("said"), F.col("content")).alias("overlap"))


@book.query("M09_echo_overlap", sql(f"{MESSAGES}, {PAIRS}", "SELECT id, round(overlap, 6) AS overlap FROM o"))
def echo_overlap(t):
    return overlaps(t).select("id", F.round("overlap", 6).alias("overlap"))


@book.query("M10_is_echo", sql(f"{MESSAGES}, {PAIRS}", "SELECT id, overlap >= 0.6 AS echo FROM o"))
@book.query("H07_word_set_intersection", sql(f"{MESSAGES}, {PAIRS}", "SELECT id, overlap >= 0.6 AS echo FROM o"))
def is_echo(t):
    return overlaps(t).select("id", (F.col("overlap") >= 0.6).alias("echo"))


PART_TEXT = "parts AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Stimme der Kontrolle: ' WHEN 1 THEN ' ifs_fight: ' WHEN 2 THEN 'Der Manager ' ELSE 'Sie ' END || text AS x FROM documents)"


def part_text(t):
    i = F.col("doc_id")
    x = F.concat(F.when(i % 4 == 0, "Stimme der Kontrolle: ").when(i % 4 == 1, " ifs_fight: ").when(i % 4 == 2, "Der Manager ").otherwise("Sie "), "text")
    return t.documents.select("doc_id", x.alias("x"))


@book.query("M11_parts_context", sql(PART_TEXT, f"SELECT doc_id, regexp_matches(coalesce(x, ''), '(?i){'|'.join(lx.PARTS_CONTEXT)}') AS context FROM parts"))
def parts_context(t):
    return part_text(t).select("doc_id", J.has_parts(F.col("x")).alias("context"))


@book.query("M12_part_of_text", sql(PART_TEXT, "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(x, '(?i){p}') THEN '{name}'" for name, (p, _) in lx.PARTS.items()) + " END AS part FROM parts"))
def part_of_text(t):
    return part_text(t).select("doc_id", J.part_of(F.col("x")).alias("part"))


@book.query("M13_role_label", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'MENSCH' WHEN 'assistant' THEN 'KI-MODELL' ELSE 'ROLLE-' || upper(role) END AS label FROM conversations")
def role_label(t):
    return t.conversations.select("conv_id", "turn", J.role_label(F.col("role"), F.col("text"), True).alias("label"))


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


QUERY_TEXT = f"""asked AS (SELECT doc_id, doc_id % 6 AS speakers, lower(concat_ws(' ', CASE doc_id % 5 WHEN 0 THEN 'Vergleiche die Positionen' WHEN 1 THEN 'Was bedeutet das?' WHEN 2 THEN 'Nenne Gedichte' WHEN 3 THEN 'entwicklung der Zahl' ELSE 'Wann?' END, text)) AS q FROM documents),
kinds AS (SELECT doc_id, q, CASE WHEN regexp_matches(q, '{any_of(lx.DISCOURSE)}') THEN 'DISCOURSE' WHEN regexp_matches(q, '{any_of(lx.EXEGESIS)}') THEN 'EXEGESIS' WHEN speakers >= 3 THEN 'DISCOURSE' ELSE 'EXEGESIS' END AS kind FROM asked)"""


def query_text(t):
    """Questions that quote a whole text."""
    i = F.col("doc_id")
    asked = F.when(i % 5 == 0, "Vergleiche die Positionen").when(i % 5 == 1, "Was bedeutet das?").when(i % 5 == 2, "Nenne Gedichte").when(i % 5 == 3, "entwicklung der Zahl").otherwise("Wann?")
    return t.documents.select("doc_id", F.concat_ws(" ", asked, "text").alias("q"), (i % 6).alias("speakers"))


@book.query("L21_query_class", sql(QUERY_TEXT, "SELECT doc_id, kind FROM kinds"))
def query_class(t):
    return query_text(t).select("doc_id", J.query_type(F.col("q"), F.col("speakers")).alias("kind"))


@book.query("L22_enforcer_rules", sql(QUERY_TEXT, "SELECT doc_id, kind = 'DISCOURSE' OR doc_id % 3 > 1 AS require_citations, CASE kind WHEN 'DISCOURSE' THEN 1 ELSE 0 END::INT AS min_citations, kind = 'DISCOURSE' AS allow_discourse_markers, TRUE AS strict_temporal_check FROM kinds"))
def enforcer_rules(t):
    kind = J.query_type(F.col("q"), F.col("speakers"))
    return query_text(t).select("doc_id", J.enforcer_rules(kind, F.col("doc_id") % 3).alias("r")).select("doc_id", "r.*")


@book.query("L23_rerank_query_type", sql(QUERY_TEXT, f"SELECT doc_id, CASE WHEN {has('q', lx.LITERARY)} THEN 'literary' WHEN {has('q', lx.ANALYTICAL)} THEN 'analytical' ELSE 'factual' END AS kind FROM kinds"))
def rerank_query_type(t):
    return query_text(t).select("doc_id", J.rerank_type(F.col("q")).alias("kind"))


ROUTED = "SELECT doc_id, CASE WHEN lang <> 'fr' AND n_chars % 140 BETWEEN 5 AND 100 THEN n_chars % 140 ELSE 20 END::INT AS top, CASE WHEN lang <> 'fr' AND n_chars % 13 <= 10 THEN n_chars % 13 / 10.0::DOUBLE ELSE 0.65 END::DOUBLE AS threshold FROM documents"


@book.query("L12_route_query", ROUTED)
@book.query("R02_router_context", ROUTED)
def route_query(t):
    """Limits and thresholds of a router's answer, made sane; an answer that cannot be read gives the defaults."""
    answer = F.concat(F.lit('Plan: {"top": '), (F.col("n_chars") % 140).cast("string"), F.lit(', "threshold": '), (F.col("n_chars") % 13 / 10.0).cast("string"), F.lit("}"))
    plan = t.documents.select("doc_id", J.json_of(F.when(F.col("lang") == "fr", "keine Ahnung").otherwise(answer)).alias("plan"))
    top, cut = F.get_json_object("plan", "$.top").try_cast("int"), F.get_json_object("plan", "$.threshold").try_cast("double")
    return plan.select("doc_id", F.when(top.between(5, 100), top).otherwise(20).alias("top"), F.when(cut.between(0, 1), cut).otherwise(0.65).alias("threshold"))


@book.query("L17_document_label", sql(TITLED, "SELECT doc_id, CASE doc_id % 8 WHEN 1 THEN 'PRIMÄRQUELLE' WHEN 2 THEN 'PRIMÄRQUELLE' WHEN 6 THEN 'PRIMÄRQUELLE' ELSE 'ANALYSE' END AS label FROM titled"))
def document_label(t):
    return titled(t).select("doc_id", J.document_label(F.col("title")).alias("label"))


@book.query("L18_quote_pool", "SELECT lang, string_agg('[Z' || r || '] Quelle [' || doc_id || ']: \"' || q || '\"', chr(10) ORDER BY r) AS pool FROM (SELECT lang, doc_id, text[1:30] AS q, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY lang")
def quote_pool(t):
    q = t.documents.select("lang", "doc_id", F.substring("text", 1, 30).alias("q"), F.row_number().over(W.partitionBy("lang").orderBy("doc_id")).alias("r")).filter("r <= 5")
    line = F.concat(F.lit("[Z"), F.col("r").cast("string"), F.lit("] Quelle ["), F.col("doc_id").cast("string"), F.lit(']: "'), F.col("q"), F.lit('"'))
    parts = F.array_sort(F.collect_list(F.struct("r", line.alias("line"))))
    return q.groupBy("lang").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("pool"))


# Drafts: quotations of the documents, some of them bent
DRAFTS = "drafts AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN text[11:110] WHEN 1 THEN text[11:100] || ' und noch etwas' WHEN 2 THEN 'Frei erfunden ist dieses Zitat.' ELSE text[51:90] END AS quote, CASE WHEN doc_id % 10 = 9 THEN 7 ELSE doc_id % 3 + 1 END AS source_id FROM documents WHERE length(text) > 200 AND NOT contains(text, '<'))"


def drafts(t):
    i = F.col("doc_id")
    quote = F.when(i % 4 == 0, F.substring("text", 11, 100)).when(i % 4 == 1, F.concat(F.substring("text", 11, 90), F.lit(" und noch etwas"))).when(i % 4 == 2, "Frei erfunden ist dieses Zitat.").otherwise(F.substring("text", 51, 40))
    d = t.documents.filter((F.length("text") > 200) & ~F.contains("text", F.lit("<"))).select("doc_id", "text", quote.alias("quote"), F.when(i % 10 == 9, 7).otherwise(i % 3 + 1).cast("int").alias("source_id"))
    draft = F.concat(F.lit("### QUELLE [1]: Titel\nWie <ZITAT quelle=\""), F.col("source_id").cast("string"), F.lit("\">"), F.col("quote"), F.lit("</ZITAT> zeigt [2] und [9]"))
    return d.withColumn("draft", draft)


SQ = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@book.query("N19_verify_gate", sql(DRAFTS, "SELECT doc_id, contains(s, q) OR length(q) > 80 AND (contains(s, q[1:80]) OR contains(s, right(q, 80))) AS kept FROM (SELECT doc_id, trim(regexp_replace(translate(quote, chr(10) || chr(13), '  '), ' {2,}', ' ', 'g')) AS q, trim(regexp_replace(translate(text, chr(10) || chr(13), '  '), ' {2,}', ' ', 'g')) AS s FROM drafts)"))
@book.query("D11_quote_source_join", sql(DRAFTS, "SELECT doc_id, contains(s, q) OR length(q) > 80 AND (contains(s, q[1:80]) OR contains(s, right(q, 80))) AS kept FROM (SELECT doc_id, trim(regexp_replace(translate(quote, chr(10) || chr(13), '  '), ' {2,}', ' ', 'g')) AS q, trim(regexp_replace(translate(text, chr(10) || chr(13), '  '), ' {2,}', ' ', 'g')) AS s FROM drafts)"))
def verify_gate(t):
    q = drafts(t).select("doc_id", "quote")
    return q.join(t.documents.select("doc_id", "text"), "doc_id", "left").select("doc_id", J.gate(F.col("quote"), F.col("text")).alias("kept"))


@book.query("N01_quote_tags", sql(DRAFTS, f"SELECT doc_id, source_id::INT AS source_id, CASE WHEN source_id > 3 THEN 'C1' WHEN NOT contains({SQ.format('text')}, {SQ.format('quote')}) THEN 'fuzzy' ELSE 'ok' END AS code FROM drafts"))
def quote_tags(t):
    """Tagged quotations by what is left to check: range, presence, or a fuzzy comparison."""
    tags = drafts(t).select("doc_id", "text", F.explode(J.quotes(F.col("draft"))).alias("z")).select("doc_id", "text", "z.*")
    ok = F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("quote")))
    return tags.select("doc_id", "source_id", F.when(~F.col("source_id").between(1, 3), "C1").when(~ok, "fuzzy").otherwise("ok").alias("code"))


# Drafts with several outcomes: whole, with a section, broken off, with a wrong number, without any
VARIED = """bodies AS (SELECT doc_id, translate(text, '#[]<>', '     ') AS body FROM documents WHERE length(text) > 0),
varied AS (SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN '### QUELLE [1]: T' || chr(10) || body || ' [1].' || chr(10) || chr(10) || '### QUELLE [2]: T' || chr(10) || '<ZITAT quelle="2">' || body || '</ZITAT>.' || chr(10) || chr(10) || '### QUELLE [3]: T' || chr(10) || body || ' [3] und [1].'
  WHEN 1 THEN '### QUELLE [2]: T' || chr(10) || body || ' [2].' WHEN 2 THEN '### QUELLE [1]: T' || chr(10) || body || chr(10) || chr(10) || body || ' bricht'
  WHEN 3 THEN '### QUELLE [3]: T' || chr(10) || '<ZITAT quelle="8">' || body || '</ZITAT> und [3], [12]!' ELSE body END AS draft FROM bodies)"""


def varied(t) -> DataFrame:
    i, body = F.col("doc_id") % 5, F.translate("text", "#[]<>", "     ")
    head = lambda n: F.lit(f"### QUELLE [{n}]: T\n")
    quoted = lambda n: F.concat(F.lit(f'<ZITAT quelle="{n}">'), body, F.lit("</ZITAT>"))
    whole = F.concat_ws("\n\n", F.concat(head(1), body, F.lit(" [1].")), F.concat(head(2), quoted(2), F.lit(".")), F.concat(head(3), body, F.lit(" [3] und [1].")))
    broken = F.concat(head(1), body, F.lit("\n\n"), body, F.lit(" bricht"))
    draft = F.when(i == 0, whole).when(i == 1, F.concat(head(2), body, F.lit(" [2]."))).when(i == 2, broken).when(i == 3, F.concat(head(3), quoted(8), F.lit(" und [3], [12]!"))).otherwise(body)
    return t.documents.filter("length(text) > 0").select("doc_id", draft.alias("draft"))


BARE = "regexp_replace(draft, '<ZITAT quelle=\"[0-9]+\">[^<]*</ZITAT>', '', 'g')"
NUMBERS = "list_transform(regexp_extract_all({}, '{}', 1), lambda x: x::INTEGER)"
CITED = f"list_concat({NUMBERS.format('draft', chr(92) + '[([0-9]+)' + chr(92) + ']')}, {NUMBERS.format('draft', '<ZITAT quelle=.([0-9]+).>')})"


@book.query("N10_validate_citations", sql(VARIED, f"SELECT doc_id, len(ids) > 0 AND len(list_filter(ids, lambda i: i < 1 OR i > 3)) = 0 AS valid FROM (SELECT doc_id, {CITED} AS ids FROM varied)"))
def validate_citations(t):
    ids = F.concat(J.cited(F.col("draft")), F.transform(J.quotes(F.col("draft")), lambda z: z["source_id"]))
    return varied(t).select("doc_id", ((F.size(ids) > 0) & F.forall(ids, lambda i: i.between(1, 3))).alias("valid"))


@book.query("N04_orphan_references", sql(VARIED, f"SELECT doc_id, r AS source_id, CASE WHEN r BETWEEN 1 AND 3 THEN 'C5' ELSE 'C6' END AS code FROM (SELECT doc_id, unnest(list_distinct({NUMBERS.format(BARE, chr(92) + '[([0-9]+)' + chr(92) + ']')})) AS r FROM varied)"))
def varied_references(t):
    return orphans(varied(t))


def orphans(rows: DataFrame) -> DataFrame:
    """References outside of quotations, by whether there is such a source."""
    bare = F.regexp_replace("draft", r'(?s)<ZITAT quelle="[0-9]+">.*?</ZITAT>', "")
    refs = rows.select("doc_id", F.explode(F.array_distinct(J.cited(bare))).alias("source_id"))
    return refs.select("doc_id", "source_id", F.when(F.col("source_id").between(1, 3), "C5").otherwise("C6").alias("code"))


def orphan_references(t):
    return orphans(drafts(t))


@book.query("N07_detect_truncation", sql(VARIED, "SELECT doc_id, len(m) > 0 AS is_truncated, len(m) > 0 AND right(rtrim(draft), 1) NOT IN ('.', '!', '?', ':', ';', '»', '\"', chr(10)) AS mid_sentence, array_to_string(m, ',') AS missing FROM (SELECT doc_id, draft, list_filter(['1', '2', '3'], lambda n: NOT list_contains(regexp_extract_all(draft, '###\\s+QUELLE\\s+\\[([0-9]+)\\]', 1), n)) AS m FROM varied)"))
def detect_truncation(t):
    n = F.lit(3)
    d = varied(t).select("doc_id", J.truncated(F.col("draft"), n).alias("t"), J.missing_sections(F.col("draft"), n).alias("m"))
    return d.select("doc_id", "t.is_truncated", "t.mid_sentence", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("missing"))


MARKER = r"^(?:#{1,3}\s+QUELLE\s*\[[0-9]+\]|[0-9]+\.\s+(?:" + "|".join(lx.CLAIM_FIELDS) + r")|#{1,2}\s+GLOBALE\s+SYNTHESE|(?:" + "|".join(lx.SYNTHESIS_FIELDS) + "):)"


@book.query("N12_structural_marker", f"SELECT doc_id, regexp_matches(regexp_replace(concat_ws(' ', CASE doc_id % 5 WHEN 0 THEN '### QUELLE [3]:' WHEN 1 THEN ' 1. BEFUND:' WHEN 2 THEN 'KONVERGENZEN:' WHEN 3 THEN 'Ein Satz [1].' END, text), '^{WS}+', ''), '{MARKER}') AS marker FROM documents")
def structural_marker(t):
    """Claims that begin like a line of a structured answer, before whole texts."""
    i = F.col("doc_id")
    x = F.concat_ws(" ", F.when(i % 5 == 0, "### QUELLE [3]:").when(i % 5 == 1, " 1. BEFUND:").when(i % 5 == 2, "KONVERGENZEN:").when(i % 5 == 3, "Ein Satz [1]."), "text")
    return t.documents.select("doc_id", J.structural_marker(x).alias("marker"))


@book.query("N17_review_sample", "SELECT doc_id FROM documents WHERE ('0x' || sha256(lower(source) || doc_id)[1:8])::BIGINT % 5 = 0")
def review_sample(t):
    """One claim in five by its hash, so a repeated run samples the same claims."""
    return t.documents.filter(F.conv(F.substring(J.claim_hash(F.col("source"), F.col("doc_id")), 1, 8), 16, 10).cast("long") % 5 == 0).select("doc_id")


@book.query("N20_rendered_tags", sql(DRAFTS, "SELECT doc_id, md5('### QUELLE [1]: Titel' || chr(10) || 'Wie *„' || quote || '\"* [' || source_id || '] zeigt [2] und [9]') AS shown_md5 FROM drafts"))
def rendered_tags(t):
    return drafts(t).select("doc_id", F.md5(J.rendered(F.col("draft"))).alias("shown_md5"))


@book.query("N21_fact_sentences", f"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(57345), 'g'), chr(57345)))::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def fact_sentences(t):
    return t.documents.filter("text is not null").select("doc_id", F.size(F.split(F.regexp_replace("text", f"([.!?]){WS}+", f"$1{T.CUT}"), T.CUT)).cast("long").alias("n"))


@book.query("D09_claims_sources_join", sql(DRAFTS, "SELECT d.doc_id, r AS source_id, md5(s.text) AS source_md5 FROM drafts d, (VALUES (1), (2), (9)) v(r) JOIN documents s ON s.doc_id = r"))
@book.query("N18_verify_facts", sql(DRAFTS, "SELECT d.doc_id, r AS source_id, md5(s.text) AS source_md5 FROM drafts d, (VALUES (1), (2), (9)) v(r) JOIN documents s ON s.doc_id = r"))
def claims_sources(t):
    bare = F.regexp_replace("draft", r'(?s)<ZITAT quelle="[0-9]+">.*?</ZITAT>', "")
    claims = drafts(t).select("doc_id", F.explode(F.array_distinct(J.cited(bare))).alias("source_id"))
    sources = t.documents.select(F.col("doc_id").cast("int").alias("source_id"), F.md5("text").alias("source_md5"))
    return claims.join(sources, "source_id").select("doc_id", "source_id", "source_md5")


@book.query("J42_post_process", sql(DRAFTS, "SELECT doc_id, md5(trim('### QUELLE [1]: Titel' || chr(10) || 'Wie <ZITAT quelle=\"' || source_id || '\">x</ZITAT> zeigt [2] und')) AS text_md5 FROM drafts"))
def post_process(t):
    short = F.regexp_replace("draft", r"(?s)>.*?</ZITAT>", ">x</ZITAT>")
    return drafts(t).select("doc_id", F.md5(J.only_valid_references(short, [1, 2, 3])).alias("text_md5"))


NOTE = "concat_ws(' ', text, CASE doc_id % 3 WHEN 0 THEN 'Note: 0,75' WHEN 1 THEN 'keine' ELSE '3' END)"


@book.query("R21_judge_answer", f"SELECT doc_id, least(1.0, coalesce(try_cast(replace(regexp_extract({NOTE}, '([0-9]+(?:[.,][0-9]+)?)', 1), ',', '.') AS DOUBLE), 0.5))::DOUBLE AS score FROM documents")
def judge_answer(t):
    i = F.col("doc_id")
    raw = F.concat_ws(" ", "text", F.when(i % 3 == 0, "Note: 0,75").when(i % 3 == 1, "keine").otherwise("3"))
    return t.documents.select("doc_id", J.first_decimal(raw).alias("score"))


VALUE = "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE doc_id::VARCHAR END AS a, CASE doc_id % 4 WHEN 3 THEN NULL ELSE md5(text) END AS text_md5 FROM documents WHERE text IS NOT NULL"


@book.query("J10_json_in_answer", VALUE)
@book.query("J09_extraction_json", VALUE)
def json_in_answer(t):
    """An object that holds a whole text, bare, fenced, amid prose or missing."""
    i = F.col("doc_id")
    obj = F.to_json(F.struct(i.alias("a"), F.col("text").alias("t")))
    raw = F.when(i % 4 == 0, obj).when(i % 4 == 1, F.concat(F.lit("Hier: ```json\n"), obj, F.lit("\n```"))).when(i % 4 == 2, F.concat(F.lit("Antwort "), obj, F.lit(" fertig"))).otherwise("nichts")
    d = t.documents.filter("text is not null").select("doc_id", J.json_of(raw).alias("value"))
    return d.select("doc_id", F.get_json_object("value", "$.a").alias("a"), F.md5(F.get_json_object("value", "$.t")).alias("text_md5"))


SAID = "lower(regexp_replace(text, '[^A-Za-zÄÖÜäöüß]+', ' ', 'g'))"


@book.query("J43_section", f"SELECT doc_id, md5(rtrim('Inhalt ' || {SAID})) AS fazit_md5 FROM documents WHERE text IS NOT NULL")
@book.query("J45_fazit", f"SELECT doc_id, md5(rtrim('Inhalt ' || {SAID})) AS fazit_md5 FROM documents WHERE text IS NOT NULL")
def fazit(t):
    said = F.lower(F.regexp_replace("text", "[^A-Za-zÄÖÜäöüß]+", " "))
    run = F.concat(F.lit("# Kopf\nx\n## **FAZIT**\nInhalt "), said, F.lit("\n\n## Weiter\ny"))
    return t.documents.filter("text is not null").select("doc_id", F.md5(F.rtrim(J.section(run, "FAZIT"))).alias("fazit_md5"))
