"""Rules that need Python, run in Arrow batches: verse, compounds, scripts, fuzzy quotations, imports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from textloom.functions import compounds, fuzzy, scripts, text as T, verse
from textloom.plans.book import Book
from textloom.plans.judge import drafts
from textloom.sources import dom, importers

book = Book()
SLICE = 64  # texts that a Python step holds the results of


def mapped(rows: DataFrame, fn: Callable[..., tuple], schema: str) -> DataFrame:
    """Rows (id, arguments) to (id, results) by a Python function, batch by batch."""
    ddl = S.StructType.fromDDL(f"{rows.schema[0].name} {rows.schema[0].dataType.simpleString()}, {schema}")
    target = pa.schema([(f.name, _arrow(f.dataType)) for f in ddl.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):  # else the results of thousands of texts are held at once
                part = batch.slice(at, SLICE)
                out = [fn(*row) for row in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(target)[1:], strict=True))], schema=target)

    return rows.mapInArrow(run, ddl)


def _arrow(kind: S.DataType) -> pa.DataType:
    simple = {S.LongType: pa.int64(), S.IntegerType: pa.int32(), S.DoubleType: pa.float64(), S.BooleanType: pa.bool_(), S.StringType: pa.string()}
    return pa.list_(_arrow(kind.elementType)) if isinstance(kind, S.ArrayType) else simple[type(kind)]


def texts(t) -> DataFrame:
    return t.documents.filter("text is not null").select("doc_id", T.without_verse_numbers(F.col("text")).alias("text"))


@book.query("K06_rhyme_scheme")
@book.query("D16_rhyme_join")
def rhyme_scheme(t):
    def run(text):
        r = verse.rhyme_scheme(text)
        return r["type"], len(r["pairs"]), r["notation"]

    return mapped(texts(t), run, "rhyme_type string, n_pairs long, notation string")


@book.query("K09_sound_patterns")
@book.query("D15_alliteration_join")
@book.query("H08_internal_rhyme_pairs")
def sound_patterns(t):
    def run(text):
        r = verse.sound_patterns(text)
        return r["n_alliterations"], r["n_assonances"], r["n_internal_rhymes"], json.dumps(r["alliterations"][:5], ensure_ascii=False)

    return mapped(texts(t), run, "n_alliterations long, n_assonances long, n_internal_rhymes long, sample string")


@book.query("K04_compounds")
@book.query("H06_compound_merge")
def compound_words(t):
    rows = t.documents.filter("text is not null").select("doc_id", F.col("text"), T.sentences(F.col("text")).alias("s"))

    def run(text, sentences):
        found = compounds.compounds(T.PLAIN_WORD.findall(text.lower()), sentences)
        return len(found), [f"{c['word']}:{c['kind']}:{c['count']}" for c in found]

    return mapped(rows, run, "n_compounds long, compounds array<string>")


@book.query("K01_analyze_text")
def analyze_text(t):
    """The record of a text's statistics; Greek and Hebrew texts take their own path."""
    def run(text, latin):
        r = scripts.analyze(text)
        return (r["language"], json.dumps(r, ensure_ascii=False)) if r else ("latin", latin)

    d = t.documents.filter("text is not null").select("doc_id", T.without_metadata(F.col("text")).alias("text"))
    d = d.select("doc_id", "text", T.words(F.col("text")).alias("w"), F.size(T.sentences(F.col("text"))).alias("n"))  # once, below their use
    w = F.col("w")
    stats = F.struct(F.length("text").alias("chars"), F.size(w).alias("words"), F.col("n").alias("sentences"), F.round(T.type_token_ratio(w), 3).alias("ttr"), F.round(T.standardized_ttr(w), 3).alias("sttr"), T.morphological_complexity(w).alias("morphology"))
    return mapped(d.select("doc_id", "text", F.to_json(stats).alias("latin")), run, "language string, stats string")


GREEK = "μῆνιν ἄειδε θεὰ Πηληϊάδεω Ἀχιλῆος\nοὐλομένην, ἣ μυρί᾽ Ἀχαιοῖς ἄλγε᾽ ἔθηκε,\nπολλὰς δ᾽ ἰφθίμους ψυχὰς Ἄϊδι προΐαψεν\nἡρώων, αὐτοὺς δὲ ἑλώρια τεῦχε κύνεσσιν."
HEBREW = "בְּרֵאשִׁית בָּרָא אֱלֹהִים אֵת הַשָּׁמַיִם וְאֵת הָאָרֶץ׃\nוְהָאָרֶץ הָיְתָה תֹהוּ וָבֹהוּ׃"


def script_rows(t):
    """Whole texts; the tables hold no Greek or Hebrew, so two thirds end with such a passage."""
    i = F.col("doc_id")
    more = F.when(i % 3 == 0, "\n" + GREEK).when(i % 3 == 1, "\n" + HEBREW).otherwise("")
    return t.documents.filter("text is not null").select("doc_id", F.concat("text", more).alias("text"))


@book.query("J15_is_greek", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'greek' WHEN 1 THEN 'hebrew' ELSE 'other' END AS script FROM documents WHERE text IS NOT NULL")
@book.query("J16_is_hebrew", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'greek' WHEN 1 THEN 'hebrew' ELSE 'other' END AS script FROM documents WHERE text IS NOT NULL")
def script_of(t):
    return mapped(script_rows(t), lambda x: (scripts.script_of(x),), "script string")


def per_script(name: str, fn: Callable[[str], tuple], schema: str) -> None:
    book.query(name)(lambda t: mapped(script_rows(t), fn, schema))


per_script("J17_normalize_greek", lambda x: (" ".join(map(scripts.greek_form, x.split())),), "forms string")
per_script("J20_tokenize_greek", lambda x: (scripts.greek_words(x),), "words array<string>")
per_script("J21_split_sentences_greek", lambda x: (len(scripts.greek_sentences(x)),), "n long")
per_script("J22_tokenize_hebrew", lambda x: (scripts.hebrew_words(x),), "words array<string>")
per_script("J23_split_sentences_hebrew", lambda x: (len(scripts.hebrew_sentences(x)),), "n long")
per_script("J24_strip_cantillation", lambda x: (scripts.hebrew_word(x),), "word string")
per_script("J29_greek_syllables", lambda x: (sum(map(scripts.greek_syllables, x.split())),), "n long")
per_script("J32_greek_clause", lambda x: ([scripts.greek_clause(s) for s in scripts.greek_sentences(x)],), "kinds array<string>")
per_script("K02_analyze_greek", lambda x: (json.dumps(scripts.analyze_greek(x), ensure_ascii=False),), "stats string")
per_script("K03_analyze_hebrew", lambda x: (json.dumps(scripts.analyze_hebrew(x), ensure_ascii=False),), "stats string")
per_script("K12_parallelism", lambda x: (json.dumps(scripts.parallelism([len(scripts.hebrew_words(s)) for s in x.split("\n") if s.strip()])),), "pairs string")
per_script("F17_line_length_ratio", lambda x: (scripts.parallelism([len(s.split()) for s in x.split("\n") if s.strip()])["parallel_pairs"],), "pairs long")
per_script("K14_greek_skeleton", lambda x: ([scripts.greek_skeleton(s) for s in scripts.verses(x)],), "skeletons array<string>")
per_script("K15_greek_echoes", lambda x: scripts.vowel_echoes(scripts.verses(x), scripts.greek_end_vowel), "trivial string, n long")
per_script("K16_greek_sound", lambda x: (scripts.greek_alliterations(scripts.verses(x)),), "n long")
per_script("K17_greek_verses", lambda x: (len(scripts.verses(x)),), "n long")
per_script("K18_greek_stanzas", lambda x: ("-".join(map(str, scripts.greek_stanzas(x))),), "pattern string")
per_script("K19_greek_enjambement", lambda x: scripts.greek_enjambement(scripts.verses(x)), "n long, percentage double")
per_script("K20_greek_rhythm", lambda x: (scripts.greek_rhythm(scripts.verses(x))["description"],), "rhythm string")
per_script("K22_greek_sentence_types", lambda x: ([scripts.greek_clause(s) for s in scripts.greek_sentences(x)].count("gemischt"),), "mixed long")


@book.query("N02_fuzzy_window")
def fuzzy_window(t):
    """Quotations that are not in their source word for word, with the best window's ratio."""
    d = drafts(t).filter(~F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("quote"))))
    rated = mapped(d.select("doc_id", "quote", "text"), lambda q, s: (fuzzy.best_window(q, s),), "ratio double")
    return rated.select("doc_id", F.round("ratio", 4).alias("ratio"), (F.col("ratio") >= fuzzy.THRESHOLD).alias("accepted"))


@book.query("N02_fuzzy_whole")
@book.query("N11_verify_quotes")
def fuzzy_whole(t):
    """As ``fuzzy_window``, but in whole sources."""
    d = drafts(t).filter(~F.contains(T.squeeze(F.col("text")), T.squeeze(F.col("quote"))))
    rated = mapped(d.select("doc_id", "quote", "text"), lambda q, s: (fuzzy.best_in_source(q, s),), "ratio double")
    return rated.select("doc_id", F.round("ratio", 4).alias("ratio"), F.col("ratio").isNotNull().alias("accepted"))


@book.query("N03_document_names")
@book.query("N13_fuzzy_ratio")
def document_names(t):
    d = t.documents.select("doc_id", F.concat(F.lit("Titel "), F.col("source")).alias("found"), F.concat(F.lit("Titel "), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("anders")).alias("expected"))
    return mapped(d, lambda a, b: (a == b or fuzzy.ratio(a, b) >= fuzzy.THRESHOLD,), "matches boolean")


@book.query("N14_best_source")
def best_source(t):
    group = F.floor(F.col("item_id") / 10).alias("answer")  # an answer cites ten sources
    pool = t.benchmark.groupBy(group).agg(F.array_sort(F.collect_list("text")).alias("pool"))
    d = t.benchmark.select("item_id", F.replace("text", F.lit(" t"), F.lit(" d")).alias("q"), group).join(pool, "answer").select("item_id", "q", "pool")
    return mapped(d, lambda q, s: fuzzy.best_source(q, s), "ratio double, source long").select("item_id", F.round("ratio", 4).alias("ratio"), "source")


@book.query("N15_validate_claim")
def validate_claim(t):
    """What remains of a verdict without a judge: the gate, upgraded by the fuzzy ratio."""
    from textloom.functions import judge as J

    d = drafts(t).select("doc_id", "quote", "text", J.gate(F.col("quote"), F.col("text")).alias("exact"))
    rated = mapped(d.select("doc_id", "quote", "text", "exact"), lambda q, s, ok: (True if ok else fuzzy.best_window(q, s) >= fuzzy.THRESHOLD, "direct" if ok else "paraphrase"), "valid boolean, kind string")
    return rated.select("doc_id", "valid", F.when(F.col("valid"), F.col("kind")).otherwise("false_quote").alias("kind"))


@book.query("N16_validate_claim_multisource")
def validate_claim_multisource(t):
    """Each quotation against three whole sources: the document that it is taken from and the two after it."""
    from textloom.functions import judge as J

    claims = drafts(t).select("doc_id", "quote", F.explode(F.sequence(F.col("doc_id"), F.col("doc_id") + 2)).alias("source"))
    sources = t.documents.filter("text is not null").select(F.col("doc_id").alias("source"), F.col("text").alias("said"))
    met = claims.join(sources, "source").select("doc_id", "source", "quote", "said", J.gate(F.col("quote"), F.col("said")).alias("exact"))
    rated = mapped(met.select("doc_id", "quote", "said", "exact", "source"), lambda q, s, ok, i: (1.0 if ok else fuzzy.best_in_source(q, s), i), "ratio double, source long")
    best = rated.groupBy("doc_id").agg(F.max(F.struct(F.col("ratio"), (-F.col("source")).alias("i"))).alias("b"))
    return best.select("doc_id", F.col("b.ratio").isNotNull().alias("valid"), F.when(F.col("b.ratio").isNotNull(), -F.col("b.i")).alias("source"), F.when(F.col("b.ratio") == 1, "direct").when(F.col("b.ratio").isNotNull(), "paraphrase").otherwise("false_quote").alias("kind"))


# Pages and files
@book.query("A01_detect_platform", "SELECT page_id, CASE WHEN n > 0 THEN 'grok' END AS platform, n / 4.0::DOUBLE AS confidence FROM (SELECT page_id, (CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(html), 'x.ai') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(html), 'grok.com') THEN 1 ELSE 0 END) AS n FROM pages)")
def detect_platform(t):
    html = F.concat("html", F.when(F.col("page_id") % 4 == 0, "<div class=message-bubble>").otherwise(""))
    name, share = importers.sniff(html, F.lit("html"))
    return t.pages.select("page_id", name.alias("platform"), share.alias("confidence"))


@book.query("A28_parse_html")
def parse_html(t):
    return mapped(t.pages.select("page_id", "html"), lambda h: (sum(1 for _ in dom.parse(h).nodes()),), "n_elements long")


@book.query("A30_html_to_markdown")
def html_to_markdown(t):
    def run(h):
        root = dom.parse(h)
        return (dom.markdown(root.first("article") or root),)

    return mapped(t.pages.select("page_id", "html"), run, "markdown string")


@book.query("A31_rich_markdown")
@book.query("A32_link_markdown")
def rich_markdown(t):
    return mapped(t.pages.select("page_id", "html"), lambda h: (dom.markdown(dom.parse(h), links=True, fences=True),), "markdown string")


SAMPLES = {
    "chatgpt": '<div data-message-author-role="user"><div class="whitespace-pre-wrap">Frage {}</div></div><div data-message-author-role="assistant"><div class="markdown">Antwort</div></div>',
    "claude": '<div data-testid="user-message"><p class="whitespace-pre-wrap">Frage {}</p></div><div class="font-claude-response">Antwort</div>',
    "deepseek": '<div data-um-id="1"><div class="fbb737a4">Frage {}</div></div><div><div class="ds-markdown">Antwort</div></div>',
    "gemini": '<user-query><div class="query-text">Frage {}</div></user-query><message-content><div class="markdown">Antwort</div></message-content>',
    "grok": '<div class="message-bubble rounded-br-lg bg-surface-l1"><div class="response-content-markdown">Frage {}</div></div><div class="message-bubble w-full max-w-none"><div class="response-content-markdown">Antwort</div></div>',
    "perplexity": '<span class="select-text">Frage {}</span><div class="prose dark:prose-invert">Antwort</div>',
    "kimi": '<div class="chat-content-item chat-content-item-user"><div class="text">You Frage {}</div></div><div class="chat-content-item"><div class="markdown">Antwort</div></div>',
    "lmarena": '<div class="lg:flex-row"><div class="bg-surface-primary relative flex w-full"><span class="truncate">m1</span><div class="prose">Antwort</div></div></div><div class="self-end"><div class="prose">Frage {}</div></div>',
    "glm": '<div class="glm-chat-item user-msg"><div class="msg-content">Frage {}</div></div><div class="glm-chat-item assistant-msg"><div class="msg-content">Antwort</div></div>',
    "hotbot": '<div class="tyn-qa-item tyn-qa-item-usr"><div class="tyn-qa-message">Frage {}</div></div><div class="tyn-qa-item tyn-qa-item-bot"><div class="tyn-qa-message">Antwort</div></div>',
    "chatgpt_config": '<article data-testid="conversation-turn-1"><div data-message-author-role="user"><div class="whitespace-pre-wrap">Frage {}</div></div></article><article data-testid="conversation-turn-2"><div data-message-author-role="assistant"><div class="markdown prose">Antwort</div></div></article>',
    "gemini_json": '{{"exportType": "combined", "dialogue": [{{"role": "user", "content": "Frage {}"}}, {{"role": "thought", "content": "x"}}, {{"role": "assistant", "content": "Antwort"}}]}}',
}
IDS = {"A02_config_import": "chatgpt_config", "A03_chatgpt": "chatgpt", "A04_claude": "claude", "A05_deepseek": "deepseek", "A06_gemini": "gemini", "A07_grok": "grok", "A08_perplexity": "perplexity", "A09_kimi": "kimi", "A10_lmarena": "lmarena", "A11_glm": "glm", "A12_hotbot": "hotbot", "A14_gemini_json": "gemini_json"}


#: What an answer of the exports holds, and what importers make of it that keep Markdown or plain lines.
ANSWER = "<p>Antwort {k} &amp; <b>fett</b></p><ul><li>eins</li><li>zwei</li></ul><pre><code>x = {k}</code></pre>"
MARKDOWN = "'Antwort ' || k || ' & **fett**' || chr(10) || chr(10) || '  * eins' || chr(10) || '  * zwei' || chr(10) || chr(10) || '```' || chr(10) || 'x = ' || k || chr(10) || '```'"
SAID = dict.fromkeys(SAMPLES, MARKDOWN) | {"grok": MARKDOWN.replace("chr(10) || '  * eins'", "chr(10) || chr(10) || '  * eins'"), "gemini_json": "'Antwort ' || k"}
SAID |= dict.fromkeys(("claude", "gemini", "kimi", "lmarena"), "'Antwort ' || k || ' &' || chr(10) || 'fett' || chr(10) || 'eins' || chr(10) || 'zwei' || chr(10) || 'x = ' || k")


def exports(t, platform: str) -> DataFrame:
    """An export a document, of one to three turns of a question and an answer with a list and code."""
    turn, head, between, tail = SAMPLES[platform].replace("{{", "{").replace("}}", "}"), "", "", ""
    if platform == "gemini_json":
        head, tail, between = turn[: turn.index("[") + 1], turn[turn.rindex("]") :], ", "
        turn = turn[len(head) : -len(tail)].replace('"Antwort"', '"Antwort {k}"').replace("{}", "{id}-{k} <a>")
    else:
        turn = turn.replace("Antwort", ANSWER).replace("{}", "{id}-{k} &lt;a&gt;")

    def filled(k):
        return F.replace(F.replace(F.lit(turn), F.lit("{k}"), k.cast("string")), F.lit("{id}"), F.col("doc_id").cast("string"))

    turns = F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 3 + 1)
    if platform == "lmarena":  # its exports begin with the last turn
        turns = F.reverse(turns)
    content = F.concat(F.lit(head), F.array_join(F.transform(turns, filled), between), F.lit(tail))
    return t.documents.select("doc_id", content.alias("content"), F.lit(platform).alias("platform"))


def imported(t, platform: str) -> DataFrame:
    """The messages of the exports, read by the platform's importer."""
    return importers.flat(importers.read_messages(exports(t, platform), "doc_id", "content", "platform")).select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "role", "content")


def sql_imported(platform: str) -> str:
    turns = "FROM (SELECT doc_id, unnest(range(1, doc_id % 3 + 2)) AS k FROM documents)"
    return f"SELECT doc_id, (2 * k - 2)::BIGINT AS pos, 'user' AS role, 'Frage ' || doc_id || '-' || k || ' <a>' AS content {turns} UNION ALL SELECT doc_id, 2 * k - 1, 'model', {SAID[platform]} {turns}"


for name, platform in IDS.items():
    book.query(name, sql_imported(platform))(lambda t, platform=platform: imported(t, platform))


@book.query("A33_validate", "SELECT doc_id, doc_id % 4 < 2 AS valid FROM documents")
def validate(t):
    """Imports of which some get a role that is none, or a blank message."""
    i = F.col("doc_id") % 4
    messages = imported(t, "chatgpt").select("doc_id", F.when((i == 2) & (F.col("pos") == 0), "narrator").otherwise(F.col("role")).alias("role"), F.when((i == 3) & (F.col("pos") == 1), "  ").otherwise(F.col("content")).alias("content"))
    whole = messages.groupBy("doc_id").agg(F.collect_list(F.struct("role", "content")).alias("m"))
    ok = (F.size("m") > 0) & F.forall("m", lambda m: m["role"].isin("user", "model", "system") & (F.trim(m["content"]) != ""))
    return whole.select("doc_id", ok.alias("valid"))


@book.query("B04_arena_fan_out", f"SELECT doc_id || '-0' AS chat_id, role, content FROM ({sql_imported('lmarena')})")
def arena_fan_out(t):
    return importers.arena_chats(importers.flat(importers.read_messages(exports(t, "lmarena"), "doc_id", "content", "platform"))).select("chat_id", "role", "content")


#: The model names that imports of a platform get by default.
DEFAULT_MODELS = {"grok": "Grok (xAI)", "perplexity": "Perplexity AI"}


def default_sink(name: str, platform: str) -> None:
    model = DEFAULT_MODELS[platform]
    kept = f"SELECT * FROM ({sql_imported(platform)}) WHERE doc_id % 5 <> 4 OR role = 'user' AND doc_id % 10 <> 9"

    @book.query(name, f"WITH k AS ({kept}), n AS (SELECT doc_id, count(*) AS n, string_agg(content, chr(10) ORDER BY pos) FILTER (r <= 3) AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM k) GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS message_count, CASE WHEN n > 0 THEN '{model}' END AS model_name, md5(head) AS title_md5 FROM documents LEFT JOIN n USING (doc_id)")
    def run(t):
        """One chat an export: its stored messages, the default model name and what the title is made from. Blank messages are not stored; a chat without messages goes."""
        i = F.col("doc_id")
        blank = (i % 5 == 4) & ((F.col("role") != "user") | (i % 10 == 9))
        stored = imported(t, platform).withColumn("content", F.when(blank, " ").otherwise(F.col("content"))).filter(F.trim("content") != "")
        ordered = F.array_sort(F.collect_list(F.struct("pos", "content")))
        chats = stored.groupBy("doc_id").agg(F.count("*").alias("n"), ordered.alias("m"))
        title = F.array_join(F.transform(F.slice("m", 1, 3), lambda m: m["content"]), "\n")
        return t.documents.select("doc_id").join(chats, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("message_count"), F.when(F.col("n") > 0, model).alias("model_name"), F.md5(title).alias("title_md5"))


default_sink("R95_grok_sink", "grok")
default_sink("R96_perplexity_sink", "perplexity")


@book.query("A13_wikisource")
def wikisource(t):
    page = F.concat(F.lit('<h1 id="firstHeading">T</h1><meta name="author" content="A"><div class="mw-parser-output"><nav>x</nav>'), F.col("text"), F.lit("</div>"))
    files = t.documents.select("doc_id", page.alias("content"), F.lit("wikisource").alias("platform"))
    return importers.flat(importers.read_messages(files, "doc_id", "content", "platform")).select(F.col("id").alias("doc_id"), "role", F.md5("content").alias("content_md5"))


@book.query("A20_markdown_note")
@book.query("A21_markdown_chat")
def markdown_chat(t):
    """Roles and digests of the messages; their texts stay in the Python step."""
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Kopf\nUser: a\nAssistant: b\nUser: "), F.col("text"))).otherwise(F.col("text"))
    read = importers.importer("markdown")

    def run(content):
        messages = read(content)
        return [m["role"] for m in messages], [hashlib.md5(m["content"].encode()).hexdigest() for m in messages]

    files = t.documents.filter("text is not null").select("doc_id", note.cast("binary").alias("content"))
    found = mapped(files, run, "role array<string>, content_md5 array<string>")
    return found.select("doc_id", F.posexplode(F.arrays_zip("role", "content_md5")).alias("pos", "m")).select("doc_id", "pos", "m.role", "m.content_md5")


@book.query("A22_message_density")
@book.query("A24_adaptive_chunk_size")
def density(t):
    return mapped(t.documents.filter("text is not null").select("doc_id", "text"), lambda x: (round(importers.message_density(x), 6), importers.adaptive_size(importers.message_density(x))), "density double, size long")


@book.query("A23_simple_chunking")
@book.query("A25_text_parser")
def simple_chunking(t):
    return mapped(t.documents.filter("text is not null").select("doc_id", "text"), lambda x: (len(importers.plain_text(x)), [len(p) for p in importers.snapped(x)]), "n long, sizes array<long>")


@book.query("A15_pdf_pages")
@book.query("A16_running_lines")
@book.query("A17_clean_page")
@book.query("E36_line_threshold")
def pdf_pages(t):
    """Pages as a PDF plug-in would give them: lines of a text between a head and a foot."""
    def run(x):
        pages = [f"Kopfzeile\n{line}\nSeite {i}" for i, line in enumerate(x.split("\n"), 1)]
        out = importers.pdf_pages(pages)
        return len(pages), len(out), any("Kopfzeile" in m["content"] for m in out)

    return mapped(t.documents.filter("text is not null").select("doc_id", "text"), run, "n_pages long, n_messages long, has_head boolean")
