"""Indexes and tables that are kept in a folder: built in batches, changed, compacted, searched."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import judge as J
from textloom.operators import postings, stores, vectors
from textloom.plans import corpus, retrieve
from textloom.plans.book import Book, Tables
from textloom.plans.corpus import CHATS, CHUNKS, MESSAGES, REVIEWS, sql
from textloom.plans.streams import stream
from textloom.session import remove, settle, shared_folder
from textloom.streaming import events as E

book = Book()
BUCKETS = 8


@contextmanager
def folder(t: Tables) -> Iterator[str]:
    """A folder of its own in the shared one, gone afterwards."""
    at = f"{shared_folder(t.spark)}/kept-{uuid.uuid4().hex}"
    try:
        yield at
    finally:
        remove(t.spark, at)


def inserts(t: Tables) -> DataFrame:
    return t.documents.filter("text is not null").select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("seq"), F.lit("insert").alias("op"), "text")


def appended(t: Tables, at: str) -> postings.Index:
    """The documents brought in by two batches, the second one delivered twice."""
    index = postings.Index(t.spark, at, BUCKETS)
    rows = inserts(t)
    for number, part in ((0, rows.filter("id % 3 > 0")), (1, rows.filter("id % 3 = 0")), (1, rows.filter("id % 3 = 0"))):
        index.apply(part, number)
    return index


@book.query("L07_kept_bm25", f"WITH {retrieve.BM25} SELECT doc_id, score FROM bm25 WHERE score > 0")
def kept_bm25(t):
    """BM25 from the buckets of the asked terms; the corpus is not counted again."""
    with folder(t) as at:
        return settle(appended(t, at).bm25(retrieve.QUERY.split(" ")).filter("score > 0").select(F.col("id").alias("doc_id"), "score"))


@book.query("I18_appended_index", f"WITH {retrieve.BM25} SELECT t, df FROM dfs")
def appended_index(t):
    with folder(t) as at:
        return settle(appended(t, at).vocabulary())


#: What the documents are after the changes of ``changed``.
CHANGED = "now AS (SELECT doc_id, CASE WHEN doc_id % 14 = 0 THEN 'wieder da ' || text WHEN doc_id % 5 = 1 THEN text || ' the of neu' ELSE text END AS text FROM documents WHERE text IS NOT NULL AND (doc_id % 7 <> 0 OR doc_id % 14 = 0))"


def changed(t: Tables, at: str) -> postings.Index:
    """Inserts as a stream, then updates and deletes, compaction in between, then texts that come back."""
    index = postings.Index(t.spark, f"{at}/index", BUCKETS)
    stream(t, "documents").select("doc_id", "text").writeStream.foreachBatch(index.appender()).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows, next_batch = inserts(t), max(index.batches()[1]) + 1
    more = rows.filter("id % 5 = 1").select("id", F.lit(1).cast("long").alias("seq"), F.lit("update").alias("op"), F.concat("text", F.lit(" the of neu")).alias("text"))
    gone = rows.filter("id % 7 = 0").select("id", F.lit(2).cast("long").alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("text"))
    index.apply(more.union(gone), next_batch)
    index.compact()
    back = rows.filter("id % 14 = 0").select("id", F.lit(3).cast("long").alias("seq"), F.lit("insert").alias("op"), F.concat(F.lit("wieder da "), "text").alias("text"))
    for _ in range(2):  # delivered twice
        index.apply(back, next_batch + 1)
    index.apply(more, next_batch)  # and one that the compaction has folded in
    return index


@book.query("O03_changed_index", f"WITH {CHANGED}, {retrieve.BM25.replace('FROM documents', 'FROM now')} SELECT doc_id, score FROM bm25")
def changed_index(t):
    with folder(t) as at:
        return settle(changed(t, at).bm25(retrieve.QUERY.split(" ")).select(F.col("id").alias("doc_id"), "score"))


@book.query("O02_incremental_index", f"SELECT doc_id, count(DISTINCT t) AS n_terms FROM (SELECT doc_id, unnest({retrieve.SQL_TERMS}) AS t FROM documents) GROUP BY doc_id")
def incremental_index(t):
    """Documents arrive as a stream; each batch adds its postings to the index."""
    with folder(t) as at:
        index = postings.Index(t.spark, f"{at}/index", BUCKETS)
        stream(t, "documents").select("doc_id", "text").writeStream.foreachBatch(index.appender()).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return settle(index.table("postings").groupBy(F.col("id").alias("doc_id")).agg(F.sum("sign").alias("n_terms")))


@book.query("O05_speaker_state", corpus.SPEAKERS)
def speaker_state(t):
    """The same as a stream whose files hold the turns of a chat out of order."""
    rows = corpus.named_speakers(t).select("chat_id", "id", F.timestamp_seconds(F.col("turn") + 10**9).alias("ts"), "said")
    end = t.spark.range(1).select(F.lit("").alias("chat_id"), F.lit(-1).cast("long").alias("id"), F.timestamp_seconds(F.lit(2 * 10**9)).alias("ts"), F.lit(None).cast("string").alias("said"))
    with folder(t) as at:
        parts = [rows.filter(F.col("id") % 3 == i) for i in (1, 2, 0)] + [end]
        return settle(E.drain(E.carry_forward(E.replay(parts, f"{at}/turns"), late="1 day"), "append").filter("id >= 0").select("id", "speaker"))


# Tables that are changed where they lie
def messages_after(t: Tables, change) -> DataFrame:
    """The messages, kept by chat, after a change, read back."""
    with folder(t) as at:
        rows = corpus.messages(t)
        kept = stores.Buckets(t.spark, at, rows.schema, "chat_id", BUCKETS)
        kept.create(rows)
        change(kept)
        return settle(kept.rows())


@book.query("I01_delete_chat", sql(f"{CHUNKS}, {CHATS}, {MESSAGES}", "SELECT 'chats' AS name, id AS key FROM chats WHERE id NOT IN ('3', '5') UNION ALL SELECT 'messages', id::VARCHAR FROM messages WHERE chat_id NOT IN ('3', '5') UNION ALL SELECT 'chunks', chunk_id FROM chunks WHERE chat_id NOT IN ('3', '5')"))
def delete_chat(t):
    """Registry, messages and chat go one after the other; a call that is repeated finds nothing left."""
    with folder(t) as at:
        tables = {"chunks": (corpus.chunks(t).select("chat_id", "chunk_id"), "chat_id", "chunk_id"), "messages": (corpus.messages(t), "chat_id", "id"), "chats": (corpus.chats(t), "id", "id")}
        kept = {name: stores.Buckets(t.spark, f"{at}/{name}", rows.schema, key, BUCKETS) for name, (rows, key, _) in tables.items()}
        for name, (rows, _, _) in tables.items():
            kept[name].create(rows)
        for _ in range(2):
            stores.cascade(list(kept.values()), ["3", "5"])
        parts = [kept[name].rows().select(F.lit(name).alias("name"), F.col(shown).cast("string").alias("key")) for name, (_, _, shown) in tables.items()]
        return settle(parts[0].union(parts[1]).union(parts[2]))


@book.query("I02_update_message", sql(MESSAGES, "SELECT id, CASE WHEN id = 7000 THEN 'neu' ELSE content END AS content FROM messages"))
def update_message(t):
    return messages_after(t, lambda kept: kept.update(["7"], {"content": F.lit("neu")}, F.col("id") == 7000)).select("id", "content")


@book.query("I03_delete_after", sql(MESSAGES, "SELECT id FROM messages WHERE NOT (chat_id = '7' AND turn > 1)"))
def delete_after(t):
    return messages_after(t, lambda kept: kept.delete(["7"], F.col("turn") > 1)).select("id")


@book.query("I04_delete_message", sql(MESSAGES, "SELECT id FROM messages WHERE id <> 7000"))
def delete_message(t):
    return messages_after(t, lambda kept: kept.delete(["7"], F.col("id") == 7000)).select("id")


@book.query("I05_delete_messages", sql(MESSAGES, "SELECT id FROM messages WHERE id NOT IN (7000, 7001, 8000)"))
def delete_messages(t):
    return messages_after(t, lambda kept: kept.delete(["7", "8"], F.col("id").isin(7000, 7001, 8000))).select("id")


#: Columns of a chat that a caller may change.
CHANGEABLE = ("title", "model_name")


def chats_after(t: Tables, key: str, values: dict[str, str]) -> DataFrame:
    with folder(t) as at:
        rows = corpus.chats(t)
        kept = stores.Buckets(t.spark, at, rows.schema, "id", BUCKETS)
        kept.create(rows)
        kept.update([key], {c: F.lit(v) for c, v in values.items() if c in CHANGEABLE})
        return settle(kept.rows())


@book.query("I06_rename_chat", sql(CHATS, "SELECT id, CASE WHEN id = '4' THEN 'Neu' ELSE title END AS title FROM chats"))
def rename_chat(t):
    return chats_after(t, "4", {"title": "Neu"}).select("id", "title")


@book.query("I07_update_chat_metadata", sql(CHATS, "SELECT id, title, CASE WHEN id = '4' THEN 'claude' ELSE model_name END AS model_name, updated FROM chats"))
def update_chat_metadata(t):
    return chats_after(t, "4", {"model_name": "claude", "updated": "1"}).select("id", "title", "model_name", "updated")


# Rows that are taken once
@book.query("B15_insert_or_ignore", sql(REVIEWS, "SELECT id, version FROM reviews WHERE version = 'v0' UNION SELECT id, 'v0' FROM reviews WHERE confidence > 0.5"))
def insert_or_ignore(t):
    """Reviews by id and version, the second batch delivered twice."""
    rows = corpus.reviews(t)
    with folder(t) as at:
        kept = stores.Ignoring(t.spark, at, "id long, version string", ["id", "version"], ["id"])
        kept.put(rows.filter("version = 'v0'"), 0)
        for _ in range(2):
            kept.put(rows.filter("confidence > 0.5").select("id", F.lit("v0").alias("version")), 1)
        return settle(kept.rows().select("id", "version"))


@book.query("B16_cache_embedding", "SELECT sha256(vec_id::VARCHAR) AS h, len(embedding)::BIGINT AS n FROM embeddings")
def cache_embedding(t):
    """Embeddings by the hash of what was embedded; asked for in overlapping batches, each is stored once."""
    rows = t.embeddings.select(F.sha2(F.col("vec_id").cast("string"), 256).alias("h"), "embedding", "vec_id")
    with folder(t) as at:
        kept = stores.Ignoring(t.spark, at, "h string, embedding array<float>", ["h"], ["h"])
        for number, part in enumerate((rows.filter("vec_id % 3 < 2"), rows.filter("vec_id % 3 > 0"), rows)):
            kept.put(part, number)
        return settle(kept.rows().select("h", F.size("embedding").cast("long").alias("n")))


@book.query("D17_version_probe", "SELECT doc_id FROM documents WHERE ('0x' || sha256(lower(source) || doc_id)[1:8])::BIGINT % 5 = 0 AND doc_id % 3 <> 0")
def version_probe(t):
    """Sampled claims that have no verdict of this version yet."""
    claims = t.documents.select("doc_id", J.claim_hash(F.col("source"), F.col("doc_id")).alias("claim_hash")).filter("claim_hash is not null")
    with folder(t) as at:
        kept = stores.Ignoring(t.spark, at, "claim_hash string, version string", ["claim_hash", "version"], ["claim_hash"])
        kept.put(claims.filter("doc_id % 3 = 0").select("claim_hash", F.lit("v2").alias("version")), 0)
        kept.put(claims.filter("doc_id % 3 = 1").select("claim_hash", F.lit("v1").alias("version")), 1)
        known = kept.rows().filter("version = 'v2'").select("claim_hash")
        sampled = claims.filter(F.conv(F.substring("claim_hash", 1, 8), 16, 10).cast("long") % 5 == 0)
        return settle(sampled.join(known, "claim_hash", "left_anti").select("doc_id"))


@book.query("O07_verdict_cache", "SELECT h FROM (SELECT md5(source || lang) AS h, min(doc_id) AS f FROM documents GROUP BY 1) ORDER BY f DESC, h LIMIT 50")
def verdict_cache(t):
    """A cache of fifty verdicts: the ones inserted first go, a hit does not move."""
    asked = t.documents.select(F.md5(F.concat("source", "lang")).alias("h"), F.col("doc_id").alias("at"))
    with folder(t) as at:
        kept = stores.Ignoring(t.spark, at, "h string, at long", ["h"], ["at"], most=50)
        for _ in range(2):
            kept.put(asked, 0)
        return settle(kept.rows().select("h"))


NEAREST = """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query, b.vec_id AS id, round(list_dot_product(a.v, b.v), 9) AS score FROM u a, u b WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM s)
SELECT query, id, rank FROM r WHERE rank <= 10"""


@book.query("L05_indexed_search", NEAREST)
def indexed_search(t):
    """The ten nearest of every twentieth vector, by cells; cells that the bounds rule out are not read."""
    with folder(t) as at:
        index = vectors.Index(t.spark, at)
        index.build(t.embeddings, cells=32)
        found = index.search(t.embeddings.filter("vec_id % 20 = 0"), 10, probes=8, exact=True)
        return settle(found.select("query", "id", "rank"))
