"""The remaining rows of the inventory: framing before a model call, checks after it, small helpers."""

from __future__ import annotations

import io
import json
import zipfile
from html import escape

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.functions import judge as J
from textloom.functions import metaruns as M
from textloom.functions import scripts
from textloom.functions import text as T
from textloom.functions.lexicon import LETTERS
from textloom.operators import corpus as C
from textloom.operators import ranking as R
from textloom.plans import judge, kernels, meta, retrieve, stats
from textloom.plans import corpus as P
from textloom.plans.book import Book
from textloom.plans.corpus import CHATS, CHUNKS, MESSAGES, chats, chunks, messages, sql
from textloom.sources import dom, importers

book = Book()


# Files
def _epub(text: str) -> bytes:
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="c.opf"/></rootfiles></container>')
        z.writestr("c.opf", '<package xmlns="urn:o" xmlns:dc="urn:dc"><metadata><dc:title>Buch</dc:title></metadata><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></package>')
        z.writestr("a.xhtml", f"<html><body><p>{escape(text)}</p></body></html>")
    return box.getvalue()


@book.query("A18_epub")
@book.query("R92_epub_title")
def epub(t):
    """Each text as a book of one chapter, read back by the importer."""


    def run(x):
        out = importers.epub(_epub(x))
        return len(out), sum(len(m["content"]) for m in out)

    return kernels.mapped(t.documents.filter("text is not null").select("doc_id", "text"), run, "n_messages long, n_chars long")


@book.query("A19_fb2")
@book.query("R93_fb2_title")
def fb2(t):
    def run(x):
        clean = "".join(c for c in x if c >= " " or c == "\n")
        out = importers.fb2(f"<FictionBook><description><book-title>T</book-title></description><body><p>{escape(clean)}</p></body></FictionBook>".encode())
        return len(out), sum(len(m["content"]) for m in out)

    return kernels.mapped(t.documents.filter("text is not null").select("doc_id", "text"), run, "n_messages long, n_chars long")


@book.query("A26_parser_configs", "SELECT * FROM (VALUES ('glm', 'div.glm-chat-item'), ('hotbot', 'div.tyn-qa-item')) v(platform, block)")
@book.query("A27_validate_configs", "SELECT * FROM (VALUES ('glm', 'div.glm-chat-item'), ('hotbot', 'div.tyn-qa-item')) v(platform, block)")
def parser_configs(t):
    for cfg in importers.CONFIGS.values():
        cfg.check()
    rows = [(name, cfg.block) for name, cfg in importers.CONFIGS.items()]
    return t.spark.createDataFrame(rows, "platform string, block string").filter("platform in ('glm', 'hotbot')")


@book.query("A34_importer_registry", "SELECT 22::BIGINT AS n")
@book.query("R98_list_platforms", "SELECT 22::BIGINT AS n")
def registry(t):
    return t.spark.createDataFrame([(name,) for name in importers.IMPORTERS], "platform string").agg(F.count("*").alias("n"))


THOUGHT = "SELECT page_id, '> **Thinking:**' || chr(10) || '> erst' || chr(10) || '> dann ' || url || chr(10) || chr(10) AS thought FROM pages WHERE url IS NOT NULL"


@book.query("A29_thinking_block", THOUGHT)
@book.query("R90_thinking_variant", THOUGHT)
def thinking_block(t):
    html = F.concat(F.lit('<div><div class="thinking-content">Thought for 5 seconds<p>erst</p><p>dann '), "url", F.lit("</p></div></div>"))
    return kernels.mapped(t.pages.filter("url is not null").select("page_id", html.alias("h")), lambda h: (importers.thinking(dom.parse(h)),), "thought string")


@book.query("A38_get_all_chunks", sql(P.REGISTRY, "SELECT seq, chunk_id FROM registry"))
def get_all_chunks(t):
    return P.registry(t).select("seq", "chunk_id")


@book.query("A40_anchor_list", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE trim(line) <> ''")
def anchor_list(t):
    return t.benchmark.select(F.explode(T.lines(F.col("text"))).alias("line")).agg(F.count("*").alias("n"))


@book.query("R59_anchor_prompt", "SELECT item_id, CASE WHEN trim(text) = '' THEN '' ELSE '=== ANKER ===' || chr(10) || trim(text) || chr(10) || '=== ENDE ===' END AS block FROM benchmark WHERE text IS NOT NULL")
def anchor_prompt(t):
    """An anchor list wrapped for a prompt; an empty one gives nothing."""
    text = F.trim("text")
    return t.benchmark.filter("text is not null").select("item_id", F.when(text == "", "").otherwise(F.concat(F.lit("=== ANKER ===\n"), text, F.lit("\n=== ENDE ==="))).alias("block"))


# Sinks
@book.query("B13_csv_rows", "SELECT event_id, event_id || ',' || event_type AS csv FROM events")
def csv_rows(t):
    return t.events.select("event_id", F.to_csv(F.struct("event_id", "event_type")).alias("csv"))


@book.query("B17_render_run", f"SELECT doc_id, '# Lauf ' || doc_id || chr(10) || chr(10) || '**Variante:** ' || CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || chr(10) || chr(10) || 'Kern ' || {meta.SAYS} AS markdown FROM documents WHERE text IS NOT NULL")
def render_run(t):
    d = meta.dissect_runs(t)
    return d.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("# Lauf "), F.col("doc_id").cast("string")), F.concat(F.lit("**Variante:** "), "variant"), "kern").alias("markdown"))


@book.query("R94_simple_metadata", sql(CHATS, "SELECT id, coalesce(model_name, '') AS model_name FROM chats"))
def simple_metadata(t):
    return chats(t).select("id", F.coalesce("model_name", F.lit("")).alias("model_name"))


@book.query("R97_unknown_roles", sql(MESSAGES, "SELECT id, CASE WHEN role IN ('user', 'model') THEN role ELSE 'user' END AS role FROM messages WHERE trim(content) <> ''"))
def unknown_roles(t):
    return messages(t).filter("trim(content) <> ''").select("id", F.when(F.col("role").isin("user", "model"), F.col("role")).otherwise("user").alias("role"))


# Joins
@book.query("D10_source_ids", "SELECT d.doc_id, s.source_id FROM documents d JOIN (SELECT source, dense_rank() OVER (ORDER BY min(doc_id)) AS source_id FROM documents GROUP BY source) s USING (source)")
@book.query("R04_source_texts", "SELECT d.doc_id, s.source_id FROM documents d JOIN (SELECT source, dense_rank() OVER (ORDER BY min(doc_id)) AS source_id FROM documents GROUP BY source) s USING (source)")
def source_ids(t):
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("f"))
    numbers = R.numbered(first, F.col("f"), F.col("source"), name="source_id")  # no two sources begin with one document
    return t.documents.select("doc_id", "source").join(numbers.select("source", "source_id"), "source").select("doc_id", "source_id")


@book.query("D13_label_suggestions", sql(CHUNKS, "SELECT chunk_id, coalesce(s, 'Unbekannt') AS speaker FROM chunks LEFT JOIN (SELECT doc_id::VARCHAR AS c, lang AS s FROM documents WHERE lang <> 'en') ON c = chat_id"))
@book.query("R27_suggestion_input", sql(CHUNKS, "SELECT chunk_id, coalesce(s, 'Unbekannt') AS speaker FROM chunks LEFT JOIN (SELECT doc_id::VARCHAR AS c, lang AS s FROM documents WHERE lang <> 'en') ON c = chat_id"))
def label_suggestions(t):
    said = t.documents.filter("lang <> 'en'").select(F.col("doc_id").cast("string").alias("c"), F.col("lang").alias("s"))
    c = chunks(t)
    return c.join(said, c["chat_id"] == said["c"], "left").select("chunk_id", F.coalesce("s", F.lit("Unbekannt")).alias("speaker"))


book.query("D14_line_band_join", stats.book.oracles["K08_vowel_echoes"])(stats.vowel_echoes)
book.query("F16_next_line", stats.book.oracles["K10_enjambement"])(stats.enjambement)
book.query("R05_chat_title", P.book.oracles["D04_title_join"])(P.title_join)
book.query("R81_duplicate_probe", P.book.oracles["D03_dedup_anti_join"])(P.dedup_anti_join)
book.query("R82_cache_lookup", P.book.oracles["D12_cache_probe"])(P.cache_probe)
book.query("R77_session_summary", P.book.oracles["E13_session_totals"])(P.session_totals)
book.query("R76_drain_statistics", P.book.oracles["E13_session_totals"])(P.session_totals)
book.query("R16_language_binding", stats.book.oracles["J08_language"])(stats.language)
book.query("I19_set_index", retrieve.book.oracles["L06_bm25_index"])(lambda t: retrieve.bm25_index(t).cache())
book.query("R85_index_lookup", retrieve.book.oracles["L06_bm25_index"])(retrieve.bm25_index)


@book.query("I20_invalidate_index", retrieve.book.oracles["L06_bm25_index"])
@book.query("R86_invalidate_cache", retrieve.book.oracles["L06_bm25_index"])
def invalidate_index(t):
    kept = retrieve.bm25_index(t).cache()
    kept.unpersist()
    return kept


@book.query("E15_content_types", f"WITH {CHUNKS} SELECT DISTINCT {judge.TYPE.replace('(x', '(content').replace('x,', 'content,')} AS kind FROM chunks")
def content_types(t):
    return chunks(t).select(J.content_type(F.col("content")).alias("kind")).distinct()


@book.query("F10_last_speaker_before", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'B' WHEN doc_id % 3 = 1 THEN 'A' END AS speaker FROM documents WHERE text IS NOT NULL")
def last_speaker_before(t):
    """The last speaker named before a chunk's end prefixes the chunk."""
    i = F.col("doc_id") % 3
    x = F.concat(F.when(i < 2, "Modell: A\n").otherwise(""), F.when(i == 0, "Modell: B\n").otherwise(""), F.col("text"))
    named = F.regexp_extract_all(x, F.lit(C.SPEAKER), F.lit(1))
    return t.documents.filter("text is not null").select("doc_id", F.trim(F.try_element_at(named, F.lit(-1))).alias("speaker"))


@book.query("G05_candidate_cut", f"WITH {retrieve.VEC} SELECT vec_id FROM dense ORDER BY score DESC, vec_id LIMIT 100")
def candidate_cut(t):
    return retrieve.dense(t).orderBy(F.desc("score"), "vec_id").limit(100).select("vec_id")


# Statistics
@book.query("R31_first_line_author", f"SELECT doc_id, CASE WHEN length(w) >= 2 AND upper(w) <> 'UNBEKANNT' THEN w END AS author FROM (SELECT doc_id, regexp_extract(l[1], '([{LETTERS}]+)[^{LETTERS}]*$', 1) AS w FROM (SELECT doc_id, {stats.SQL_LINES} AS l FROM documents WHERE text IS NOT NULL) WHERE len(l) > 0)")
def first_line_author(t):
    """The model sees the first five lines; the stand-in names the last word of the first one. Unknown and too short names are rejected."""
    head = F.slice(T.lines(F.col("text")), 1, 5)
    rows = t.documents.filter("text is not null").select("doc_id", head.alias("l")).filter(F.size("l") > 0)
    word = F.regexp_extract(F.col("l")[0], f"([{LETTERS}]+)[^{LETTERS}]*$", 1)
    return rows.select("doc_id", word.alias("w")).select("doc_id", F.when((F.length("w") >= 2) & (F.upper("w") != "UNBEKANNT"), F.col("w")).alias("author"))


@book.query("K21_greek_verse_detail")
def greek_verse_detail(t):
    """The record of a Greek verse text: stanzas, sound, enjambement, rhythm, skeletons and echoes; epic verse has no end rhyme."""

    def run(x):
        lines = scripts.verses(x)
        n, share = scripts.greek_enjambement(lines)
        trivial, echoes = scripts.vowel_echoes(lines, scripts.greek_end_vowel)
        record = {
            "stanzas": scripts.greek_stanzas(x), "rhyme": {"pairs": [], "notation": "", "type": "Kein Reim"}, "alliterations": scripts.greek_alliterations(lines), "enjambement": {"n": n, "percentage": share},
            "rhythm": scripts.greek_rhythm(lines), "skeletons": [scripts.greek_skeleton(s) for s in lines], "echoes": {"trivial": trivial, "n": echoes},
        }
        return (json.dumps(record, ensure_ascii=False),)

    return kernels.mapped(kernels.script_rows(t), run, "detail string")


@book.query("K13_empty_verse", "SELECT doc_id, 0::INT AS stanza_count, 'Kein Reim' AS rhyme_type FROM documents")
def empty_verse(t):
    none = F.struct(F.lit(0).alias("stanza_count"), F.lit("Kein Reim").alias("rhyme_type"))
    return t.documents.select("doc_id", none.alias("v")).select("doc_id", "v.*")


# Retrieval around the model
@book.query("L14_score_and_rerank", f"WITH {retrieve.VEC}, top AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 100), n AS (SELECT count(*) FILTER (score >= 0.99) AS n FROM top) SELECT vec_id FROM top, n WHERE score >= CASE WHEN n < 5 THEN 0.35 ELSE 0.99 END")
def score_and_rerank(t):
    """Fewer than five rows above the threshold relax it."""
    top = retrieve.dense(t).orderBy(F.desc("score"), "vec_id").limit(100)
    n = F.count_if(F.col("score") >= 0.99).over(W.partitionBy())
    return top.withColumn("n", n).filter(F.col("score") >= F.when(F.col("n") < 5, 0.35).otherwise(0.99)).select("vec_id")


@book.query("L20_expand_query", "SELECT doc_id, CASE lang WHEN 'de' THEN text || ' ' || replace(text, 'ung', 'tion') WHEN 'fr' THEN text || ' ' || replace(text, 'é', 'e') ELSE text END AS query FROM documents WHERE text IS NOT NULL")
def expand_query(t):
    """A query and its translation; without one, as where the translator fails, the query stays as it is."""
    translated = F.when(F.col("lang") == "de", F.replace("text", F.lit("ung"), F.lit("tion"))).when(F.col("lang") == "fr", F.replace("text", F.lit("é"), F.lit("e")))
    return t.documents.filter("text is not null").select("doc_id", F.concat_ws(" ", "text", translated).alias("query"))


@book.query("R25_validate_evidence", sql(MESSAGES, "SELECT chat_id, turn, CASE WHEN turn % 5 = 4 THEN TRUE ELSE content NOT LIKE '%?%' END AS kept FROM messages WHERE role = 'model'"))
def validate_evidence(t):
    """Evidence that the validator contradicts goes; where its answer cannot be read, evidence passes."""
    answer = F.when(F.col("turn") % 5 == 4, F.lit("kaputt")).otherwise(F.to_json(F.struct(F.contains("content", F.lit("?")).alias("contradicted"))))
    read = F.get_json_object(J.json_of(answer), "$.contradicted")
    return messages(t).filter("role = 'model'").select("chat_id", "turn", (F.coalesce(read, F.lit("false")) != "true").alias("kept"))


# Streams
@book.query("O01_token_stream", "SELECT conv_id, turn, len(string_split(text, ' '))::BIGINT AS n FROM conversations")
@book.query("R49_stream_variant", "SELECT conv_id, turn, len(string_split(text, ' '))::BIGINT AS n FROM conversations")
@book.query("R53_stream_variant", "SELECT conv_id, turn, len(string_split(text, ' '))::BIGINT AS n FROM conversations")
@book.query("R70_llm_streaming", "SELECT conv_id, turn, len(string_split(text, ' '))::BIGINT AS n FROM conversations")
def token_stream(t):
    """A turn as the pieces that a streamed answer is shown in."""
    pieces = t.conversations.select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("pos", "piece"))
    return pieces.groupBy("conv_id", "turn").agg(F.count("*").alias("n"))


# Prompts
@book.query("R45_free_question", "SELECT doc_id, 'Summen: 480, ' || (6 + doc_id) AS prompt FROM documents WHERE text IS NOT NULL")
def free_question(t):
    """The sums of the sound table go into the prompt, so that no model has to add."""
    totals = F.transform(M.sound_sums(F.col("x")), lambda s: s["total"].cast("string"))
    return meta.runs(t).select("doc_id", F.concat(F.lit("Summen: "), F.array_join(totals, ", ")).alias("prompt"))


@book.query("R09_best_of", sql(MESSAGES, "SELECT chat_id, md5(string_agg('## Iteration ' || (turn + 1) || chr(10) || content, chr(10) || chr(10) ORDER BY turn)) AS input_md5 FROM messages GROUP BY chat_id"))
def best_of(t):
    line = F.concat(F.lit("## Iteration "), (F.col("turn") + 1).cast("string"), F.lit("\n"), "content")
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("x"))))
    return messages(t).groupBy("chat_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["x"]), "\n\n")).alias("input_md5"))


@book.query("R11_style_profiles", "SELECT doc_id, length(text) > 50 AS kept, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) < 80 AS short FROM documents WHERE length(text) >= 50")
@book.query("R12_style_block", "SELECT doc_id, length(text) > 50 AS kept, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) < 80 AS short FROM documents WHERE length(text) >= 50")
def style_profiles(t):
    return t.documents.filter(F.length("text") >= 50).select("doc_id", (F.length("text") > 50).alias("kept"), (F.size(T.fields(F.col("text"))) < 80).alias("short"))


VERDICT = "SELECT doc_id, coalesce(contains(text, 'ß'), FALSE) AS valid FROM documents"


@book.query("R13_fact_match", VERDICT)
@book.query("R14_fact_match_multi", VERDICT)
@book.query("R22_verdict_view", VERDICT)
def fact_match(t):
    """A verdict on a text that is missing or malformed counts as invalid."""
    has = lambda c: F.contains("text", F.lit(c))
    answer = F.when(has("ß"), '{"valid": true}').when(has("é"), '{"x": 1}').when(has("ñ"), "Fehler").otherwise('Nein: {"valid": false}')
    return t.documents.select("doc_id", F.coalesce(F.get_json_object(J.json_of(answer), "$.valid") == "true", F.lit(False)).alias("valid"))


@book.query("R30_style_title", "SELECT doc_id, source AS title, lang AS conciseness FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
def style_title(t):
    """Title and conciseness, named after a whole text."""
    x = F.concat("text", F.lit("\nSTIL-TITEL: "), "source", F.lit("\nPRÄGNANZ: "), "lang", F.lit("\n"))
    d = t.documents.filter("text is not null and source is not null and lang is not null").select("doc_id", x.alias("x"))
    return d.select("doc_id", F.regexp_extract("x", r"STIL-TITEL:\s*([^\n]+)", 1).alias("title"), F.regexp_extract("x", r"PRÄGNANZ:\s*([^\n]+)", 1).alias("conciseness"))


book.query("R37_run_meta", meta.book.oracles["A39_dissect_runs"])(meta.dissect_runs)


@book.query("R63_session_defaults", "SELECT * FROM (VALUES ('history', '[]'), ('turns', '3')) v(name, value)")
@book.query("R64_reset_session", "SELECT * FROM (VALUES ('history', '[]'), ('turns', '3')) v(name, value)")
def session_defaults(t):
    defaults = F.create_map(F.lit("turns"), F.lit("0"), F.lit("history"), F.lit("[]"))
    given = F.create_map(F.lit("turns"), F.lit("3"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(given), k)), given)
    return t.spark.range(1).select(F.explode(merged).alias("name", "value"))


@book.query("R79_probe_back_off", "SELECT * FROM (VALUES (0, 1.5::DOUBLE, 2.0::DOUBLE), (1, 3.0, 4.0), (2, 6.0, 8.0)) v(attempt, empty_wait, error_wait)")
def back_off(t):
    k = F.col("id").cast("int")
    return t.spark.range(3).select(k.alias("attempt"), (1.5 * F.pow(F.lit(2.0), k)).alias("empty_wait"), (2 * F.pow(F.lit(2.0), k)).alias("error_wait"))


@book.query("R80_schema_columns", "SELECT 'chats' AS name, 6::BIGINT AS n UNION ALL SELECT 'messages', 5 UNION ALL SELECT 'registry', 4 UNION ALL SELECT 'reviews', 4")
def schema_columns(t):
    found = {"chats": chats(t), "messages": messages(t), "registry": P.registry(t), "reviews": C.reviews(t.labels)}
    return t.spark.createDataFrame([(k, len(v.columns)) for k, v in found.items()], "name string, n long")


def deepseek(name: str, html: str, expected: list[tuple[str, str]]) -> None:
    rows = " UNION ALL ".join(f"SELECT page_id, {i}::BIGINT AS pos, '{role}' AS role, '{text}' AS content FROM pages" for i, (role, text) in enumerate(expected))

    @book.query(name, rows)
    def run(t):
        files = t.pages.select("page_id", F.lit(html).alias("content"), F.lit("deepseek").alias("platform"))
        return importers.flat(importers.read_messages(files, "page_id", "content", "platform")).select(F.col("id").alias("page_id"), F.col("pos").cast("long").alias("pos"), "role", "content")


deepseek("R87_leaf_heuristic", '<div class="ds-theme"><p>Frage eins</p><p>Copy</p><p>Antwort eins</p></div>', [("user", "Frage eins"), ("model", "Antwort eins")])
deepseek("R88_block_fallback", "<p>Ein Block mit genug Text darin</p><p>Noch ein Block mit genug Text</p>", [("user", "Ein Block mit genug Text darin"), ("model", "Noch ein Block mit genug Text")])
deepseek("R89_user_by_class", '<div class="ds-message user-row">Frage</div><div class="ds-message">Antwort</div>', [("user", "Frage"), ("model", "Antwort")])
