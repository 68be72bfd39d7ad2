"""Chats, messages, registry and reviews: scans, filters, joins, counts, rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.operators import corpus as C
from textloom.operators import ranking as R
from textloom.plans.book import Book

book = Book()

CHATS = """chats AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE source || ' ' || doc_id END AS title, doc_id * 37 % 1000 AS updated,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS model_name, (CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 0 ELSE n_chars // 2800 + 1 END)::BIGINT AS chunk_count, doc_id % 4 AS skipped_chunks FROM documents)"""
MESSAGES = "messages AS (SELECT conv_id * 1000 + turn AS id, conv_id::VARCHAR AS chat_id, turn, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, text AS content FROM conversations)"
REVIEWS = "reviews AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE quality END AS human_valid, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 21) * 0.05::DOUBLE END AS confidence, 'v' || (doc_id % 2) AS version FROM labels)"
CHUNKS = """RECURSIVE spans AS (SELECT doc_id, text, 0 AS i, 0 AS lo, CASE WHEN 4000 < length(text) AND strpos(reverse(text[1:4000]), '.') BETWEEN 1 AND 1999 THEN 4000 - strpos(reverse(text[1:4000]), '.') + 1 ELSE 4000 END AS hi FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, i + 1, hi - 1200, CASE WHEN hi + 2800 < length(text) AND strpos(reverse(text[hi - 1199:hi + 2800]), '.') BETWEEN 1 AND 1999 THEN hi + 2800 - strpos(reverse(text[hi - 1199:hi + 2800]), '.') + 1 ELSE hi + 2800 END FROM spans WHERE hi - 1200 < length(text)),
chunks AS (SELECT doc_id || '_' || i AS chunk_id, doc_id::VARCHAR AS chat_id, i::BIGINT AS chunk_index, text[lo + 1:hi] AS content, sha256(text[lo + 1:hi]) AS content_hash FROM spans)"""


def chats(t):
    return C.chats(t.documents)


def messages(t):
    return C.messages(t.conversations)


def reviews(t):
    return C.reviews(t.labels)


def chunks(t):
    return C.chunks(t.documents)


def sql(views: str, body: str) -> str:
    return f"WITH {views}\n{body}"


# Scans
@book.query("A35_raw_messages", sql(MESSAGES, "SELECT id, role, length(content)::BIGINT AS n_chars FROM messages WHERE chat_id = '7'"))
def raw_messages(t):
    return messages(t).filter("chat_id = '7'").orderBy("turn").select("id", "role", F.length("content").cast("long").alias("n_chars"))


@book.query("A36_chat_history", sql(MESSAGES, "SELECT chat_id, turn, role, md5(content) AS content_md5, row_number() OVER (PARTITION BY chat_id ORDER BY turn)::BIGINT AS pos FROM messages"))
def chat_history(t):
    return messages(t).select("chat_id", "turn", "role", F.md5("content").alias("content_md5"), F.row_number().over(W.partitionBy("chat_id").orderBy("turn")).cast("long").alias("pos"))


@book.query("L01_chunk_text", sql(CHUNKS, "SELECT chunk_id, chunk_index, length(content)::BIGINT AS n_chars, content_hash FROM chunks"))
def chunk_text(t):
    return chunks(t).select("chunk_id", "chunk_index", F.length("content").cast("long").alias("n_chars"), "content_hash")


def registry(t):
    """Chunks in registry order; every ninth chunk has no stored vector."""
    rows = chunks(t).select("chunk_id", "chat_id", "chunk_index", "content_hash")
    return R.numbered(rows, F.col("chat_id").cast("long"), F.col("chunk_index")).drop("chunk_index")


REGISTRY = CHUNKS + ", registry AS (SELECT chunk_id, chat_id, content_hash, row_number() OVER (ORDER BY chat_id::BIGINT, chunk_index) AS seq FROM chunks)"


@book.query("A37_iter_all_chunks", sql(REGISTRY, "SELECT r.seq, r.chunk_id FROM registry r JOIN (SELECT chunk_id FROM chunks WHERE chunk_index % 9 <> 8) c USING (chunk_id)"))
def iter_all_chunks(t):
    return registry(t).join(chunks(t).filter("chunk_index % 9 <> 8").select("chunk_id"), "chunk_id").select("seq", "chunk_id")


# Projections and filters
@book.query("C01_chat_list", sql(CHATS, "SELECT id, coalesce(nullif(title, ''), 'Ohne Titel') AS title, updated, coalesce(chunk_count, 0) AS chunk_count FROM chats"))
def chat_list(t):
    return chats(t).select("id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Ohne Titel")).alias("title"), "updated", F.coalesce("chunk_count", F.lit(0).cast("long")).alias("chunk_count")).orderBy(F.desc("updated"), "id")


@book.query("C02_chats_metadata", sql(CHATS, "SELECT id, coalesce(nullif(title, ''), 'Ohne Titel') AS title, coalesce(model_name, 'Unbekannt') AS model_name FROM chats"))
def chats_metadata(t):
    return chats(t).select("id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Ohne Titel")).alias("title"), F.coalesce("model_name", F.lit("Unbekannt")).alias("model_name"))


@book.query("C03_analysis_list", "SELECT doc_id, text[1:200] AS preview FROM documents ORDER BY doc_id DESC LIMIT 50")
def analysis_list(t):
    return t.documents.orderBy(F.desc("doc_id")).limit(50).select("doc_id", F.substring("text", 1, 200).alias("preview"))


@book.query("C04_analysis_by_id", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k FROM events WHERE event_id = 42")
def analysis_by_id(t):
    return t.events.filter("event_id = 42").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(-1).cast("long")).alias("k"))


@book.query("C05_unreviewed", sql(REVIEWS, "SELECT id, version FROM reviews WHERE human_valid IS NULL ORDER BY id LIMIT 8 OFFSET 8"))
def unreviewed(t):
    return reviews(t).filter("human_valid is null").orderBy("id").offset(8).limit(8).select("id", "version")


@book.query("C06_chunks_deep", sql(REGISTRY, "SELECT chunk_id FROM (SELECT r.chunk_id, r.seq, c.content FROM (SELECT * FROM registry ORDER BY seq LIMIT 500) r JOIN chunks c USING (chunk_id)) WHERE contains(lower(content), 'the') ORDER BY seq LIMIT 50"))
def chunks_deep(t):
    first = registry(t).orderBy("seq").limit(500)
    return first.join(chunks(t).select("chunk_id", "content"), "chunk_id").filter(F.contains(F.lower("content"), F.lit("the"))).orderBy("seq").limit(50).select("chunk_id")


@book.query("C07_label_overview", sql(CHATS, "SELECT count(*) FILTER (coalesce(model_name, '') NOT IN ('', 'Unbekannt', 'None')) AS labelled, count(*) FILTER (coalesce(model_name, '') IN ('', 'Unbekannt', 'None')) AS unlabelled FROM chats"))
def label_overview(t):
    bare = F.coalesce("model_name", F.lit("")).isin("", "Unbekannt", "None")
    return chats(t).agg(F.count_if(~bare).alias("labelled"), F.count_if(bare).alias("unlabelled"))


PLATFORMS = ("kimi", "deepseek", "chatgpt", "claude", "gemini", "grok", "perplexity")


@book.query("C08_platform_from_title", sql(CHATS, "SELECT id, CASE " + " ".join(f"WHEN contains(lower(title), '{p}') THEN '{p}'" for p in ("src1", "src2", *PLATFORMS)) + " END AS label FROM chats"))
def platform_from_title(t):
    label = F.lit(None).cast("string")
    for name in reversed(("src1", "src2", *PLATFORMS)):
        label = F.when(F.contains(F.lower("title"), F.lit(name)), name).otherwise(label)
    return chats(t).select("id", label.alias("label"))


@book.query("C09_skipped_chunks", sql(CHATS, "SELECT id, skipped_chunks FROM chats WHERE skipped_chunks > 0"))
def skipped_chunks(t):
    return chats(t).filter("skipped_chunks > 0").orderBy(F.desc("skipped_chunks"), "id").select("id", "skipped_chunks")


@book.query("C10_parse_chat_date", "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS DATE), DATE '0001-01-01')::VARCHAR AS day FROM events")
def parse_chat_date(t):
    raw = F.when(F.col("event_id") % 5 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    day = F.coalesce(F.try_to_date(F.substring_index(raw, "T", 1), "yyyy-MM-dd"), F.to_date(F.lit("0001-01-01")))
    return t.events.select("event_id", F.date_format(day, "yyyy-MM-dd").alias("day"))


def imbalance(most, least, n):
    """(ratio, severity) of the largest against the smallest count."""
    ratio = F.when(n < 2, F.lit(1.0)).otherwise(most / least)
    return F.round(ratio, 6).alias("ratio"), F.when(n < 2, "none").when(ratio >= 10, "critical").when(ratio >= 5, "info").otherwise("none").alias("severity")


@book.query("C11_imbalance", "SELECT lang, round(CASE WHEN count(*) < 2 THEN 1.0 ELSE max(n) / min(n)::DOUBLE END, 6)::DOUBLE AS ratio, CASE WHEN count(*) < 2 THEN 'none' WHEN max(n) / min(n)::DOUBLE >= 10 THEN 'critical' WHEN max(n) / min(n)::DOUBLE >= 5 THEN 'info' ELSE 'none' END AS severity FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) GROUP BY lang")
def imbalance_by_language(t):
    per = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")).groupBy("lang").agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("k"))
    return per.select("lang", *imbalance(F.col("hi"), F.col("lo"), F.col("k")))


@book.query("C12_dense_predicates", sql(MESSAGES, "SELECT id FROM messages WHERE chat_id IN ('1', '2', '3') AND contains(lower(role), 'mod')"))
def dense_predicates(t):
    return messages(t).filter(F.col("chat_id").isin("1", "2", "3") & F.contains(F.lower("role"), F.lit("mod"))).select("id")


@book.query("C13_minimum_length", sql(MESSAGES, "SELECT id FROM messages WHERE length(trim(content)) >= 50"))
def minimum_length(t):
    return messages(t).filter(F.length(F.trim("content")) >= 50).select("id")


@book.query("C14_metadata_types", sql(CHATS, "SELECT id, coalesce(model_name, '') AS model_name, coalesce(chunk_count::VARCHAR, '') AS chunk_count FROM chats"))
def metadata_types(t):
    return chats(t).select("id", F.coalesce("model_name", F.lit("")).alias("model_name"), F.coalesce(F.col("chunk_count").cast("string"), F.lit("")).alias("chunk_count"))


# Joins
def fts(df, id_col, content_col, terms):
    """Ids of rows in which every term begins some word, with the number of such words."""
    words = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(content_col), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("w"))
    term = F.lit(None).cast("string")
    for x in reversed(terms):
        term = F.when(F.startswith("w", F.lit(x)), x).otherwise(term)
    hits = words.select(id_col, term.alias("term")).filter("term is not null")
    return hits.groupBy(id_col).agg(F.count("*").alias("n_hits"), F.countDistinct("term").alias("k")).filter(F.col("k") == len(terms)).drop("k")


SQL_FTS = """SELECT {id}, count(*)::BIGINT AS n_hits FROM (SELECT {id}, CASE WHEN starts_with(w, 'thn') THEN 1 WHEN starts_with(w, 'ere') THEN 2 END AS term FROM (SELECT {id}, unnest(regexp_extract_all(lower({content}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {of})) WHERE term IS NOT NULL GROUP BY {id} HAVING count(DISTINCT term) = 2"""


@book.query("D01_messages_fts_join", sql(MESSAGES, f"SELECT chat_id, max(n_hits) AS n_hits FROM ({SQL_FTS.format(id='id', content='content', of='messages')}) h JOIN messages USING (id) GROUP BY chat_id"))
@book.query("L24_search_content", sql(MESSAGES, f"SELECT chat_id, max(n_hits) AS n_hits FROM ({SQL_FTS.format(id='id', content='content', of='messages')}) h JOIN messages USING (id) GROUP BY chat_id"))
def messages_fts(t):
    m = messages(t)
    return fts(m, "id", "content", ["thn", "ere"]).join(m.select("id", "chat_id"), "id").groupBy("chat_id").agg(F.max("n_hits").alias("n_hits"))


SQL_TITLES = "SELECT id, title FROM chats WHERE len(list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'), lambda w: starts_with(w, 'src1'))) > 0"


@book.query("D02_chats_fts_join", sql(CHATS, SQL_TITLES))
@book.query("L25_search_title", sql(CHATS, SQL_TITLES))
def chats_fts(t):
    c = chats(t)
    return fts(c, "id", "title", ["src1"]).join(c.select("id", "title"), "id").select("id", "title")


@book.query("D03_dedup_anti_join", "SELECT doc_id FROM documents a WHERE NOT EXISTS (SELECT 1 FROM documents b WHERE b.lang = 'en' AND sha256(b.text) = sha256(a.text)) AND lang <> 'en'")
def dedup_anti_join(t):
    hashed = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    return hashed.filter("lang <> 'en'").join(hashed.filter("lang = 'en'").select("h"), "h", "left_anti").select("doc_id")


@book.query("D04_title_join", sql(f"RECURSIVE {CHATS}, {CHUNKS.removeprefix('RECURSIVE ')}", "SELECT chunk_id, coalesce(nullif(title, ''), 'Doc ' || right(c.chat_id, 8)) AS title FROM chunks c LEFT JOIN (SELECT id, title FROM chats WHERE model_name IS NOT NULL) x ON x.id = c.chat_id"))
def title_join(t):
    known = chats(t).filter("model_name is not null").select("id", "title")
    c = chunks(t)
    return c.join(known, c["chat_id"] == known["id"], "left").select("chunk_id", F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Doc "), F.right("chat_id", F.lit(8)))).alias("title"))


@book.query("D05_registry_join", sql(REGISTRY, "SELECT r.seq, c.chunk_id FROM registry r JOIN chunks c ON c.chunk_id = r.chunk_id WHERE c.chunk_index % 9 <> 8"))
def registry_join(t):
    return registry(t).join(chunks(t).filter("chunk_index % 9 <> 8").select("chunk_id"), "chunk_id").select("seq", "chunk_id")


@book.query("D07_missing_documents", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es' AND n_chars < 500)")
@book.query("H03_set_difference", "SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE lang = 'es' AND n_chars < 500")
def missing_documents(t):
    return t.documents.select("source").distinct().join(t.documents.filter("lang = 'es' and n_chars < 500").select("source"), "source", "left_anti")


@book.query("D12_cache_probe", "SELECT a.doc_id, b.h IS NOT NULL AS hit FROM documents a LEFT JOIN (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'fr') b ON b.h = sha256(a.text)")
def cache_probe(t):
    hashed = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("h"))
    known = hashed.filter("lang = 'fr'").select(F.col("h").alias("k")).distinct()
    return hashed.join(known, F.col("h") == F.col("k"), "left").select("doc_id", F.col("k").isNotNull().alias("hit"))


@book.query("D18_delete_last_message", sql(MESSAGES, "SELECT id FROM messages m WHERE turn < (SELECT max(turn) FROM messages n WHERE n.chat_id = m.chat_id)"))
def delete_last_message(t):
    last = F.max("turn").over(W.partitionBy("chat_id"))
    return messages(t).withColumn("last", last).filter("turn < last").select("id")


# Counts
@book.query("E01_chat_count", sql(CHATS, "SELECT count(*) AS n FROM chats"))
def chat_count(t):
    return chats(t).agg(F.count("*").alias("n"))


@book.query("E02_message_count", sql(MESSAGES, "SELECT count(*) AS n FROM messages"))
def message_count(t):
    return messages(t).agg(F.count("*").alias("n"))


@book.query("E03_orphan_chat_count", sql(CHATS, "SELECT count(*) AS n FROM chats WHERE coalesce(chunk_count, 0) = 0"))
def orphan_chats(t):
    return chats(t).agg(F.count_if(F.coalesce("chunk_count", F.lit(0)) == 0).alias("n"))


@book.query("E04_hashed_chunk_count", sql(CHUNKS, "SELECT count(content_hash) AS n FROM chunks"))
def hashed_chunks(t):
    return chunks(t).agg(F.count("content_hash").alias("n"))


@book.query("E05_unique_hash_count", sql(CHUNKS, "SELECT count(DISTINCT content_hash) AS n FROM chunks"))
def unique_hashes(t):
    return chunks(t).agg(F.countDistinct("content_hash").alias("n"))


def week_label(ts):
    """Year and Monday-first week of the year, 00 to 53."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


@book.query("E06_chunk_timeline", "SELECT strftime(ts, '%Y-W%W') AS week, count(*) AS n FROM events GROUP BY 1")
@book.query("O09_weekly_timeline", "SELECT strftime(ts, '%Y-W%W') AS week, count(*) AS n FROM events GROUP BY 1")
def timeline(t):
    return t.events.groupBy(week_label(F.col("ts")).alias("week")).agg(F.count("*").alias("n")).orderBy("week")


@book.query("E07_registry_count", sql(CHUNKS, "SELECT chat_id, count(*) AS n FROM chunks GROUP BY chat_id"))
def registry_count(t):
    return chunks(t).groupBy("chat_id").agg(F.count("*").alias("n"))


@book.query("E08_update_chunk_count", sql(f"RECURSIVE {CHATS}, {CHUNKS.removeprefix('RECURSIVE ')}", "SELECT id, (SELECT count(*) FROM chunks c WHERE c.chat_id = chats.id AND c.chunk_index % 2 = 1) AS chunk_count FROM chats"))
def update_chunk_count(t):
    counted = chunks(t).filter("chunk_index % 2 = 1").groupBy("chat_id").agg(F.count("*").alias("n"))
    c = chats(t).select("id")
    return c.join(counted, c["id"] == counted["chat_id"], "left").select("id", F.coalesce("n", F.lit(0).cast("long")).alias("chunk_count"))


@book.query("E09_unreviewed_count", sql(REVIEWS, "SELECT count(*) AS n FROM reviews WHERE human_valid IS NULL"))
def unreviewed_count(t):
    return reviews(t).agg(F.count_if(F.col("human_valid").isNull()).alias("n"))


@book.query("E10_human_review_count", sql(REVIEWS, "SELECT count(human_valid) AS n FROM reviews"))
def human_review_count(t):
    return reviews(t).agg(F.count("human_valid").alias("n"))


@book.query("E11_calibration_data", sql(REVIEWS, "SELECT id, confidence, human_valid FROM reviews WHERE human_valid IS NOT NULL AND version = 'v1'"))
def calibration_data(t):
    return reviews(t).filter("human_valid is not null and version = 'v1'").select("id", "confidence", "human_valid")


def calibration(rows, n_bins=5):
    """Bins (bin, count, accuracy, avg_confidence, ece): the error is of the rounded bin values."""
    width = F.lit(1.0) / F.lit(float(n_bins))
    used = rows.filter(F.col("confidence").isNotNull() & ~F.isnan("confidence"))
    at = used.select(F.when(F.col("confidence") >= 1, n_bins - 1).otherwise(F.floor(F.col("confidence") / width)).cast("int").alias("bin"), "confidence", "human_valid")
    found = at.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("human_valid"), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    bins = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    whole = bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("avg_confidence"))) / F.sum("n"), 4).alias("ece"))
    return bins.crossJoin(whole)  # by one row


@book.query(
    "E12_expected_calibration_error",
    sql(REVIEWS, """, u AS (SELECT CASE WHEN confidence >= 1 THEN 4 ELSE floor(confidence / (1.0::DOUBLE / 5.0::DOUBLE)) END::INT AS bin, * FROM reviews WHERE human_valid IS NOT NULL AND confidence IS NOT NULL),
f AS (SELECT bin, count(*) AS n, round(avg(human_valid), 4) AS accuracy, round(avg(confidence), 4) AS avg_confidence FROM u GROUP BY bin),
b AS (SELECT r.range::INT AS bin, coalesce(n, 0) AS n, accuracy, avg_confidence FROM range(5) r LEFT JOIN f ON f.bin = r.range)
SELECT b.*, (SELECT round(sum(n * abs(accuracy - avg_confidence)) / sum(n), 4) FROM b) AS ece FROM b""").replace("\n, u AS", ", u AS"),
)
def ece(t):
    return calibration(reviews(t).filter("human_valid is not null"))


@book.query("E13_session_totals", "SELECT event_type, count(*) AS n, sum(coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 100 END, 0))::BIGINT AS tokens FROM events GROUP BY event_type")
@book.query("O08_call_statistics", "SELECT event_type, count(*) AS n, sum(coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 100 END, 0))::BIGINT AS tokens FROM events GROUP BY event_type")
def session_totals(t):
    tokens = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 100)
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"))


@book.query("E14_unique_speakers", sql(CHATS, "SELECT DISTINCT coalesce(model_name, 'Unknown') AS speaker FROM chats"))
def unique_speakers(t):
    return chats(t).select(F.coalesce("model_name", F.lit("Unknown")).alias("speaker")).distinct().orderBy("speaker")


@book.query("E16_chunk_imbalance", sql(f"RECURSIVE {CHATS}, {CHUNKS.removeprefix('RECURSIVE ')}", "SELECT count(*) AS n_docs, max(n)::BIGINT AS most, min(n)::BIGINT AS least, round(max(n) / min(n)::DOUBLE, 6)::DOUBLE AS ratio, CASE WHEN max(n) / min(n)::DOUBLE >= 10 THEN 'critical' WHEN max(n) / min(n)::DOUBLE >= 5 THEN 'info' ELSE 'none' END AS severity FROM (SELECT title, count(*) AS n FROM chunks JOIN chats ON id = chat_id GROUP BY title)"))
def chunk_imbalance(t):
    c = chats(t).select(F.col("id").alias("chat_id"), "title")
    per = chunks(t).join(c, "chat_id").groupBy("title").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_docs"), F.max("n").alias("most"), F.min("n").alias("least"))
    return per.select("n_docs", "most", "least", *imbalance(F.col("most"), F.col("least"), F.col("n_docs")))


@book.query("E18_sources_by_document", sql(CHUNKS, "SELECT chat_id, count(*) AS n, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS content_md5 FROM chunks GROUP BY chat_id"))
@book.query("E19_document_text", sql(CHUNKS, "SELECT chat_id, count(*) AS n, md5(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index)) AS content_md5 FROM chunks GROUP BY chat_id"))
def document_text(t):
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks(t).groupBy("chat_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n")).alias("content_md5"))


@book.query("E20_share_per_document", "SELECT source, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM documents GROUP BY source")
def share_per_document(t):
    per = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return per.select("source", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 1).alias("share"))


# Paging
@book.query("G01_chunk_page", sql(REGISTRY, "SELECT chunk_id, seq FROM registry WHERE seq > 120 ORDER BY seq LIMIT 50"))
def chunk_page(t):
    return registry(t).filter("seq > 120").orderBy("seq").limit(50).select("chunk_id", "seq")


@book.query("G02_offset_page", sql(CHATS, "SELECT id, updated FROM chats ORDER BY updated DESC, id LIMIT 50 OFFSET 100"))
def offset_page(t):
    return chats(t).orderBy(F.desc("updated"), "id").offset(100).limit(50).select("id", "updated")


@book.query("G08_relative_time", "SELECT bucket, count(*) AS n FROM (SELECT CASE d WHEN 0 THEN 'Heute' WHEN 1 THEN 'Gestern' ELSE CASE WHEN d BETWEEN 2 AND 7 THEN 'Letzte 7 Tage' ELSE 'Älter' END END AS bucket FROM (SELECT date_diff('day', ts::DATE, DATE '2024-01-20') AS d FROM events)) GROUP BY bucket")
def relative_time(t):
    d = F.datediff(F.to_date(F.lit("2024-01-20")), F.to_date("ts"))
    bucket = F.when(d == 0, "Heute").when(d == 1, "Gestern").when(d.between(2, 7), "Letzte 7 Tage").otherwise("Älter")
    return t.events.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@book.query("G09_label_sort", sql(CHATS, "SELECT id, coalesce(try_cast(nullif(regexp_extract(title, '[0-9]+'), '') AS BIGINT), 999) AS number FROM chats"))
@book.query("J04_number_from_title", sql(CHATS, "SELECT id, coalesce(try_cast(nullif(regexp_extract(title, '[0-9]+'), '') AS BIGINT), 999) AS number FROM chats"))
def label_sort(t):
    number = F.coalesce(F.regexp_extract("title", "[0-9]+", 0).try_cast("long"), F.lit(999).cast("long"))
    return chats(t).select("id", number.alias("number")).orderBy("number", "id")


# Set operations
@book.query("H01_union_titles_first", sql(f"{CHATS}, {MESSAGES}", f"SELECT id, min(p)::BIGINT AS priority FROM (SELECT id, 0 AS p FROM ({SQL_TITLES}) UNION ALL SELECT chat_id, 1 FROM ({SQL_FTS.format(id='id', content='content', of='messages')}) h JOIN messages USING (id)) GROUP BY id"))
def union_titles_first(t):
    both = chats_fts(t).select("id", F.lit(0).cast("long").alias("p")).union(messages_fts(t).select("chat_id", F.lit(1).cast("long")))
    return both.groupBy("id").agg(F.min("p").alias("priority"))


@book.query("H02_bag_union", "SELECT source FROM documents UNION ALL SELECT lang FROM documents")
def bag_union(t):
    return t.documents.select("source").unionAll(t.documents.select("lang"))


@book.query("H04_quote_dedup", "SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang, text[1:100]")
def quote_dedup(t):
    return t.documents.groupBy("lang", F.substring("text", 1, 100).alias("head")).agg(F.min("doc_id").alias("doc_id")).select("lang", "doc_id")


@book.query("H05_exact_dedup", "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(t):
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# Rewrites: each gives the table as it is after the change
@book.query("I08_mark_reviewed", sql(REVIEWS, "SELECT id, CASE WHEN confidence > 0.5 THEN 1 ELSE human_valid END AS human_valid FROM reviews"))
def mark_reviewed(t):
    return reviews(t).select("id", F.when(F.col("confidence") > 0.5, 1).otherwise(F.col("human_valid")).alias("human_valid"))


@book.query("I09_register_chunks", sql(CHUNKS, "SELECT chunk_id FROM chunks WHERE chunk_index = 0 UNION SELECT chunk_id FROM chunks WHERE chunk_index <= 1"))
@book.query("I18_append_index", sql(CHUNKS, "SELECT chunk_id FROM chunks WHERE chunk_index <= 1"))
def register_chunks(t):
    old = chunks(t).filter("chunk_index = 0").select("chunk_id")
    new = chunks(t).filter("chunk_index <= 1").select("chunk_id")
    return old.union(new.join(old, "chunk_id", "left_anti"))


@book.query("I10_unregister_chunks", sql(CHUNKS, "SELECT chunk_id FROM chunks WHERE chat_id <> '12'"))
@book.query("I13_delete_chat_embeddings", sql(CHUNKS, "SELECT chunk_id FROM chunks WHERE chat_id <> '12'"))
def unregister_chunks(t):
    return chunks(t).filter("chat_id <> '12'").select("chunk_id")


@book.query("I11_backfill_registry", sql(REGISTRY, "SELECT seq, chunk_id FROM registry"))
def backfill_registry(t):
    return registry(t).select("seq", "chunk_id")


@book.query("I12_rebuild_fts", sql(f"{CHATS}, {MESSAGES}", "SELECT (SELECT sum(len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))) FROM messages)::BIGINT AS n_message_terms, (SELECT sum(len(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'))) FROM chats)::BIGINT AS n_title_terms"))
@book.query("O03_inverted_index", sql(f"{CHATS}, {MESSAGES}", "SELECT (SELECT sum(len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'))) FROM messages)::BIGINT AS n_message_terms, (SELECT sum(len(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+'))) FROM chats)::BIGINT AS n_title_terms"))
def rebuild_fts(t):
    def count(df, c, name):
        return df.agg(F.sum(F.regexp_count(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"))).cast("long").alias(name))

    return count(messages(t), "content", "n_message_terms").crossJoin(count(chats(t), "title", "n_title_terms"))  # by one row


@book.query("I14_update_chunk_metadata", sql(CHATS, "SELECT id, CASE WHEN id = '4' THEN 'x' ELSE coalesce(model_name, '') END AS speaker, title FROM chats"))
@book.query("I15_apply_batch_updates", sql(CHATS, "SELECT id, CASE WHEN id = '4' THEN 'x' ELSE coalesce(model_name, '') END AS speaker, title FROM chats"))
def update_chunk_metadata(t):
    meta = F.create_map(F.lit("speaker"), F.coalesce("model_name", F.lit("")), F.lit("title"), F.col("title"))
    changes = t.spark.createDataFrame([("4", {"metadata.speaker": "x"})], "key string, change map<string,string>")
    change = F.transform_keys(F.coalesce("change", F.create_map().cast("map<string,string>")), lambda k, _: F.regexp_replace(k, "^metadata\\.", ""))
    merged = F.map_concat(F.map_filter(meta, lambda k, _: ~F.array_contains(F.map_keys(change), k)), change)
    c = chats(t)
    return c.join(F.broadcast(changes), c["id"] == changes["key"], "left").select("id", merged.alias("m")).select("id", F.col("m.speaker").alias("speaker"), F.col("m.title").alias("title"))


@book.query("I16_upsert_settings", "SELECT * FROM (VALUES ('debug_mode', 'true'), ('temperature', '0.3'), ('top_p', '0.9')) v(name, value)")
@book.query("I17_load_settings", "SELECT * FROM (VALUES ('debug_mode', 'true'), ('temperature', '0.3'), ('top_p', '0.9')) v(name, value)")
def settings(t):
    defaults, stored = {"temperature": "0.2", "top_p": "0.9", "debug_mode": "false"}, {"temperature": "0.3", "debug_mode": "true"}
    def m(d):
        return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))

    merged = F.map_concat(F.map_filter(m(defaults), lambda k, _: ~k.isin(*stored)), m(stored))
    return t.spark.range(1).select(F.explode(merged).alias("name", "value"))


# Order-dependent operators
@book.query("F13_last_turns", sql(MESSAGES, "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS r FROM messages) WHERE r <= 3"))
@book.query("R62_turn_cap", sql(MESSAGES, "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS r FROM messages) WHERE r <= 3"))
def last_turns(t):
    return messages(t).withColumn("r", F.row_number().over(W.partitionBy("chat_id").orderBy(F.desc("turn")))).filter("r <= 3").select("id")


@book.query("F15_consecutive_duplicates", "SELECT doc_id FROM (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents) WHERE before IS NULL OR before <> text")
def consecutive_duplicates(t):
    rows = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return rows.withColumn("before", F.lag("h").over(W.partitionBy("source").orderBy("doc_id"))).filter("before is null or before <> h").select("doc_id")


SPEAKERS = sql(MESSAGES, "SELECT id, coalesce(last_value(CASE WHEN role = 'user' THEN nullif(regexp_extract(content, '^[^ \\n]+'), '') END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 'Unknown') AS speaker FROM messages")


def named_speakers(t) -> DataFrame:
    """Messages with ``said``: the first word of a user turn stands for a speaker that a text names."""
    return messages(t).withColumn("said", F.when(F.col("role") == "user", F.nullif(F.regexp_extract("content", "^[^ \\n]+", 0), F.lit(""))))


@book.query("F09_speaker_carry_forward", SPEAKERS)
def carry_forward(t):
    w = W.partitionBy("chat_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return named_speakers(t).select("id", F.coalesce(F.last("said", ignorenulls=True).over(w), F.lit("Unknown")).alias("speaker"))


# Sinks as rows
@book.query("B05_slices", "SELECT doc_id, i::BIGINT AS part, md5(text[i * 20000 + 1:i * 20000 + 20000]) AS part_md5 FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 20000 + 1)) AS i FROM documents WHERE length(text) > 0)")
def slices(t):
    d = t.documents.filter(F.length("text") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 20000).cast("int")), lambda i: F.substring("text", i * 20000 + 1, F.lit(20000)))
    return d.select("doc_id", F.posexplode(parts).alias("part", "x")).select("doc_id", F.col("part").cast("long").alias("part"), F.md5("x").alias("part_md5"))


@book.query("B09_chat_markdown", sql(MESSAGES, "SELECT chat_id, md5(string_agg('## ' || upper(role) || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM messages GROUP BY chat_id"))
def chat_markdown(t):
    line = F.concat(F.lit("## "), F.upper("role"), F.lit("\n\n"), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages(t).groupBy("chat_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n")).alias("markdown_md5"))


@book.query("B12_chunk_dump", sql(REGISTRY, "SELECT chunk_id FROM (SELECT * FROM registry ORDER BY seq LIMIT 1000) JOIN chunks USING (chunk_id) WHERE contains(lower(content), 'the')"))
def chunk_dump(t):
    return registry(t).orderBy("seq").limit(1000).join(chunks(t).select("chunk_id", "content"), "chunk_id").filter(F.contains(F.lower("content"), F.lit("the"))).select("chunk_id")
