"""Ranking and retrieval: BM25, cosine, rank fusion, fairness rules, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.functions import text as T
from textloom.operators import ranking as R
from textloom.operators import slots
from textloom.plans.book import Book
from textloom.plans.corpus import CHUNKS, chunks

book = Book()
QUERY = "the thion of ereand"
WSPLIT = "[ \\t\\n\\x0B\\f\\r]+"
SQL_TERMS = f"list_filter(regexp_split_to_array(lower(text), '{WSPLIT}'), lambda w: w <> '')"
BM25 = f"""toks AS MATERIALIZED (SELECT doc_id, {SQL_TERMS} AS w FROM documents WHERE text IS NOT NULL),
n AS MATERIALIZED (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
dfs AS MATERIALIZED (SELECT t, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS t FROM toks) GROUP BY t),
idf0 AS MATERIALIZED (SELECT t, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM dfs, n),
mean AS MATERIALIZED (SELECT avg(idf) AS mean FROM idf0),
idf AS MATERIALIZED (SELECT t, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM idf0, mean),
q AS (SELECT unnest(string_split('{QUERY}', ' ')) AS t),
tf AS (SELECT doc_id, t, count(*) AS f FROM (SELECT doc_id, unnest(w) AS t FROM toks) JOIN (SELECT DISTINCT t FROM q) USING (t) GROUP BY doc_id, t),
bm25 AS (SELECT doc_id, round(sum(idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score FROM tf JOIN q USING (t) JOIN idf USING (t) JOIN toks USING (doc_id), n GROUP BY doc_id)"""


def bm25(t) -> DataFrame:
    return R.bm25(t.documents.filter("text is not null").select("doc_id", "text"), QUERY.split(" "))


@book.query("L06_bm25_index", f"WITH {BM25} SELECT t, df, round(idf, 6)::DOUBLE AS idf FROM dfs JOIN idf USING (t)")
def bm25_index(t):
    docs = t.documents.filter("text is not null").select("text")
    return R.idf(R.document_frequencies(docs), docs.agg(F.count("*").alias("n_docs"))).select("t", "df", F.round("idf", 6).alias("idf"))


@book.query("L07_bm25", f"WITH {BM25} SELECT doc_id, score FROM bm25 WHERE score > 0")
def bm25_scores(t):
    return bm25(t).filter("score > 0")


@book.query("G04_bm25_top", f"WITH {BM25} SELECT doc_id, score FROM (SELECT doc_id, score FROM bm25 ORDER BY score DESC, doc_id LIMIT 2000) JOIN (SELECT doc_id FROM documents WHERE lang IN ('de', 'en')) USING (doc_id) ORDER BY score DESC, doc_id LIMIT 30")
def bm25_top(t):
    """The best two thousand, of which those in scope, of which the first three times ten: the filter comes after the cut, as it is defined."""
    best = bm25(t).orderBy(F.desc("score"), "doc_id").limit(2000)
    scope = t.documents.filter(F.col("lang").isin("de", "en")).select("doc_id")
    return best.join(scope, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(30).select("doc_id", "score")


@book.query("G04_scoped_bm25_top", f"WITH {BM25} SELECT doc_id, score FROM bm25 JOIN (SELECT doc_id FROM documents WHERE lang IN ('de', 'en')) USING (doc_id) ORDER BY score DESC, doc_id LIMIT 30")
def scoped_bm25_top(t):
    """The exact way: the best thirty in scope, however many rank before them."""
    scope = t.documents.filter(F.col("lang").isin("de", "en")).select("doc_id")
    return bm25(t).join(scope, "doc_id", "left_semi").orderBy(F.desc("score"), "doc_id").limit(30).select("doc_id", "score")


VEC = "vec AS (SELECT vec_id, label, embedding, (SELECT embedding FROM embeddings WHERE vec_id = 7) AS q FROM embeddings), dense AS (SELECT vec_id, label, round(greatest(0, least(1, list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))))), 6) AS score FROM vec)"


def dense(t) -> DataFrame:
    """Cosine of every vector to vector 7; the query is one row."""
    q = t.embeddings.filter("vec_id = 7").select(F.col("embedding").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", "label", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@book.query("J39_guarded_cosine", f"WITH {VEC} SELECT vec_id, score FROM dense")
@book.query("J38_cosine", f"WITH {VEC} SELECT vec_id, score FROM dense")
def cosine(t):
    return dense(t).select("vec_id", "score")


@book.query("G03_dense_top_k", f"WITH {VEC} SELECT vec_id, score FROM dense ORDER BY score DESC, vec_id LIMIT 20")
def dense_top(t):
    return dense(t).orderBy(F.desc("score"), "vec_id").limit(20).select("vec_id", "score")


@book.query("F01_reciprocal_rank", f"WITH {VEC} SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM dense UNION ALL SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) FROM dense) GROUP BY vec_id")
@book.query("D06_rank_lists_union", f"WITH {VEC} SELECT vec_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM dense UNION ALL SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) FROM dense) GROUP BY vec_id")
def reciprocal_rank(t):
    d = dense(t)
    first = R.numbered(d.select("vec_id", "score"), F.desc("score"), F.col("vec_id"), name="rank")
    second = R.numbered(d.select("vec_id", "label"), F.col("label"), F.col("vec_id"), name="rank")
    return R.fuse(first.select("vec_id", "rank").union(second.select("vec_id", "rank")), "vec_id").select("vec_id", F.round("rrf", 9).alias("rrf"))


@book.query("F02_fairness_quota", f"WITH {VEC} SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM dense) WHERE r <= 20 ORDER BY score DESC, vec_id LIMIT 100")
def fairness_quota(t):
    return R.quota(dense(t), "label", [F.desc("score"), F.col("vec_id")], limit=50, n_docs=10).select("vec_id", "label")


@book.query(
    "F03_vip",
    f"""WITH {VEC}, g AS (SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS r, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM dense),
v AS (SELECT *, label IN (1, 2, 3) AND k <= 3 AS vip FROM g), f AS (SELECT *, row_number() OVER (PARTITION BY vip ORDER BY r) AS place, count(*) FILTER (vip) OVER () AS n FROM v)
SELECT vec_id, vip FROM f WHERE vip OR place <= greatest(0, 15 - n)""",
)
def vip(t):
    return R.vip(dense(t), "label", [1, 2, 3], [F.desc("score"), F.col("vec_id")], limit=15).select("vec_id", "vip")


@book.query("F04_minimum_representation", f"WITH {VEC}, top AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 12), miss AS (SELECT DISTINCT label FROM dense WHERE label NOT IN (SELECT label FROM top)) SELECT vec_id FROM top UNION ALL SELECT arg_min(vec_id, (-score, vec_id)) FROM dense JOIN miss USING (label) GROUP BY label")
def minimum_representation(t):
    d = dense(t)
    top = d.orderBy(F.desc("score"), "vec_id").limit(12)
    missing = d.join(top.select("label").distinct(), "label", "left_anti")
    best = missing.groupBy("label").agg(F.min_by("vec_id", F.struct(-F.col("score"), "vec_id")).alias("vec_id"))
    return top.select("vec_id").union(best.select("vec_id"))


PARITY = f"""WITH {VEC}, pool AS (SELECT * FROM dense WHERE label IN (0, 1, 2, 3, 4, 5, 6)), top AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM (SELECT * FROM pool ORDER BY score DESC, vec_id LIMIT 60)),
per AS (SELECT label, count(*) AS original, ceil(log2(count(*)))::INT AS least FROM pool GROUP BY label),
av AS (SELECT label, (SELECT count(*) FROM top WHERE top.label = per.label) AS available FROM per),
budget AS (SELECT floor(60 * (1 + 0.5 * log2(7 / 5.0::DOUBLE)))::INT AS total),
cap AS (SELECT label, greatest(floor(total * (log2(available + 1) / (SELECT sum(log2(available + 1)) FROM av)))::INT, least) AS cap FROM av JOIN per USING (label), budget),
rest AS (SELECT top.*, k <= least AS sure FROM top JOIN per USING (label)),
filled AS (SELECT *, row_number() OVER (PARTITION BY sure ORDER BY score DESC, vec_id) AS g FROM rest),
kept AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sure DESC, score DESC, vec_id) AS place FROM filled WHERE sure OR g <= greatest(0, (SELECT total FROM budget) - (SELECT sum(least) FROM per)))
"""


def parity(t):
    pool = dense(t).filter("label < 7")
    return R.essence_parity(pool, pool.orderBy(F.desc("score"), "vec_id").limit(60), "label", "vec_id", 7)


for name in ("F05_log_minimum", "F06_quality_fill", "F07_allocation_cap", "L15_essence_parity"):
    book.query(name, PARITY + "SELECT kept.vec_id, kept.label, sure FROM kept JOIN cap USING (label) WHERE place <= cap")(lambda t: parity(t).select("vec_id", "label", "sure"))


@book.query("F11_first_chunk", f"WITH {CHUNKS} SELECT chat_id, min(chunk_index) AS chunk_index, count(*) - 1 AS rest FROM chunks GROUP BY chat_id")
def first_chunk(t):
    return chunks(t).groupBy("chat_id").agg(F.min("chunk_index").alias("chunk_index"), (F.count("*") - 1).alias("rest"))


@book.query("F12_document_numbers", f"WITH {VEC}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM dense ORDER BY r LIMIT 30) SELECT vec_id, dense_rank() OVER (ORDER BY f)::BIGINT AS source_id FROM (SELECT vec_id, min(r) OVER (PARTITION BY label) AS f FROM top)")
def document_numbers(t):
    top = R.top(dense(t), "vec_id", 30)
    first = top.withColumn("f", F.min("rank").over(W.partitionBy("label")))
    return first.select("vec_id", F.dense_rank().over(W.orderBy("f")).cast("long").alias("source_id"))


@book.query("F14_min_max_confidence", f"WITH {VEC}, top AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 40), m AS (SELECT min(score) AS lo, max(score) AS hi FROM top) SELECT vec_id, round(CASE WHEN hi - lo < 0.01 THEN 50.0 ELSE (score - lo) / (hi - lo) * 100 END, 4)::DOUBLE AS confidence FROM top, m")
@book.query("L10_confidence_scores", f"WITH {VEC}, top AS (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 40), m AS (SELECT min(score) AS lo, max(score) AS hi FROM top) SELECT vec_id, round(CASE WHEN hi - lo < 0.01 THEN 50.0 ELSE (score - lo) / (hi - lo) * 100 END, 4)::DOUBLE AS confidence FROM top, m")
def confidence(t):
    return R.confidence(dense(t).orderBy(F.desc("score"), "vec_id").limit(40)).select("vec_id", F.round("confidence", 4).alias("confidence")).orderBy(F.desc("confidence"), "vec_id")


@book.query("J40_confidence_color", f"WITH {VEC} SELECT vec_id, CASE WHEN score * 100 >= 80 THEN 'green' WHEN score * 100 >= 60 THEN 'orange' ELSE 'red' END AS color FROM dense")
def confidence_color(t):
    s = F.col("score") * 100
    return dense(t).select("vec_id", F.when(s >= 80, "green").when(s >= 60, "orange").otherwise("red").alias("color"))


@book.query("C12_scope_filter", f"WITH {VEC} SELECT vec_id FROM dense WHERE label IN (1, 4)")
def scope_filter(t):
    return dense(t).filter(F.col("label").isin(1, 4)).select("vec_id")


@book.query("L05_semantic_search", f"WITH {VEC} SELECT vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM dense WHERE label IN (1, 4, 6)) WHERE r <= 20 ORDER BY score DESC, vec_id LIMIT 20")
def semantic_search(t):
    return R.semantic_search(dense(t), "label", "vec_id", limit=10, scope=[1, 4, 6]).select("vec_id", "score")


DIM = 64
SIDES = {"passage": "SELECT doc_id, 'passage: ' || text AS x FROM documents WHERE text IS NOT NULL", "asked": "SELECT doc_id, 'query: ' || text AS x FROM documents WHERE text IS NOT NULL", "query": f"SELECT -1 AS doc_id, 'query: {QUERY}' AS x"}


def sql_vector(side: str) -> str:
    """Rows (doc_id, b, v) of the vectors of the stand-in model, without zeros."""
    words = SQL_TERMS.replace("text", "x")
    return f"SELECT doc_id, ('0x' || h[1:6])::BIGINT % {DIM} AS b, sum(CASE WHEN h[7] IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN 1 ELSE -1 END) AS v FROM (SELECT doc_id, md5(unnest({words})) AS h FROM ({SIDES[side]})) GROUP BY 1, 2"


DENSE_TEXT = f"pv AS ({sql_vector('passage')}), qv AS ({sql_vector('query')}), dense AS (SELECT p.doc_id, round(greatest(0.0, least(1.0, coalesce(sum(p.v * q.v)::DOUBLE, 0.0) / (sqrt(sum(p.v * p.v)::DOUBLE) * (SELECT sqrt(sum(v * v)::DOUBLE) FROM qv)))), 6) AS score FROM pv p LEFT JOIN qv q USING (b) GROUP BY p.doc_id HAVING sum(p.v * p.v) > 0)"
HYBRID = f"WITH {BM25}, {DENSE_TEXT}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM dense ORDER BY r LIMIT 60), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm25 ORDER BY r LIMIT 30), f AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id)"


@book.query("L08_hybrid_search", f"{HYBRID} SELECT doc_id, rrf FROM f ORDER BY rrf DESC, doc_id LIMIT 10")
@book.query("L09_hybrid_alias", f"{HYBRID} SELECT doc_id, rrf FROM f ORDER BY rrf DESC, doc_id LIMIT 10")
def hybrid_search(t):
    """Vectors of whole texts by the stand-in model and BM25, fused by their ranks."""
    return R.hybrid(dense_texts(t), bm25(t), "doc_id", limit=10).select("doc_id", F.round("rrf", 9).alias("rrf"))


def dense_texts(t) -> DataFrame:
    """(doc_id, score): cosine of each text's vector with the query's; no text is moved."""
    model = slots.counted_embedder(DIM)
    docs = t.documents.filter("text is not null").select("doc_id", "text")
    asked = F.array(*(F.lit(float(x)) for x in model([f"query: {QUERY}"])[0]))
    vectors = slots.embed_rows(docs, "text", model).filter(F.exists("embedding", lambda x: x != 0))
    return vectors.select("doc_id", F.round(T.cosine(F.col("embedding"), asked), 6).alias("score"))


def coordinates(t, prefix: str) -> DataFrame:
    """(doc_id, b, v): the vectors of whole texts without their zeros."""
    made = slots.embed_rows(t.documents.filter("text is not null").select("doc_id", "text"), "text", slots.counted_embedder(DIM), prefix)
    return made.select("doc_id", F.posexplode("embedding").alias("b", "v")).filter("v <> 0").select("doc_id", F.col("b").cast("long").alias("b"), F.col("v").cast("long").alias("v"))


@book.query("L02_embed_passages", f"SELECT doc_id, b, v::BIGINT AS v FROM ({sql_vector('passage')}) WHERE v <> 0")
def embed_passages(t):
    """The stand-in's vectors of all texts as passages."""
    return coordinates(t, "passage: ")


@book.query("L03_embed_queries", f"SELECT doc_id, b, v::BIGINT AS v FROM ({sql_vector('asked')}) WHERE v <> 0")
def embed_queries(t):
    """The same texts as queries: the prefix is part of what is embedded."""
    return coordinates(t, "query: ")


@book.query("L11_rescue_missing", f"{HYBRID}, top AS (SELECT doc_id FROM f ORDER BY rrf DESC, doc_id LIMIT 10), miss AS (SELECT DISTINCT source FROM documents WHERE source IN ('src0', 'src1', 'src2') AND source NOT IN (SELECT source FROM documents JOIN top USING (doc_id))) SELECT doc_id, rescued FROM (SELECT doc_id, FALSE AS rescued FROM top UNION ALL SELECT doc_id, TRUE FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM bm25 JOIN documents USING (doc_id) JOIN miss USING (source)) WHERE r <= 3)")
def rescue_missing(t):
    top = hybrid_search(t).select("doc_id")
    source = t.documents.select("doc_id", "source")
    missing = source.filter(F.col("source").isin("src0", "src1", "src2")).select("source").distinct().join(source.join(top, "doc_id").select("source"), "source", "left_anti")
    extra = bm25(t).join(source, "doc_id").join(missing, "source").withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).filter("r <= 3")
    return top.select("doc_id", F.lit(False).alias("rescued")).union(extra.select("doc_id", F.lit(True)))


@book.query("L13_rerank", f"WITH {VEC} SELECT vec_id, s FROM (SELECT vec_id, greatest(0.0, least(1.0, CASE WHEN (row_number() OVER (ORDER BY score DESC, vec_id) - 1) // 4 % 3 = 2 THEN coalesce(score, 0.5) ELSE label / 9.0::DOUBLE END)) AS s FROM dense ORDER BY score DESC, vec_id LIMIT 100) WHERE s >= 0.65 ORDER BY s DESC, vec_id LIMIT 25")
def rerank(t):
    """Batches of four; each third batch stands for one whose judge failed."""
    def judge(df: DataFrame) -> Column:
        return F.when(F.col("batch") % 3 != 2, F.col("label") / 9.0)

    return R.rerank(dense(t), judge, "vec_id", threshold=0.65, limit=25, pool=100).select("vec_id", "s")


@book.query("E35_rerank_statistics", f"WITH {VEC} SELECT count(*) AS total, count(*) FILTER (score >= 0.65) AS passed, count(*) FILTER (score < 0.65) AS rejected, round(avg(score), 4) AS avg_score FROM dense")
def rerank_statistics(t):
    return dense(t).agg(F.count("*").alias("total"), F.count_if(F.col("score") >= 0.65).alias("passed"), F.count_if(F.col("score") < 0.65).alias("rejected"), F.round(F.avg("score"), 4).alias("avg_score"))


@book.query("E17_imbalance_only", f"WITH {VEC}, c AS (SELECT label, count(*) AS n FROM (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 70) GROUP BY label) SELECT round(max(n) / min(n)::DOUBLE, 6)::DOUBLE AS ratio, CASE WHEN max(n) / min(n)::DOUBLE >= 10 THEN 'critical' WHEN max(n) / min(n)::DOUBLE >= 5 THEN 'info' ELSE 'none' END AS severity FROM c")
def imbalance_only(t):
    from textloom.plans.corpus import imbalance

    per = dense(t).orderBy(F.desc("score"), "vec_id").limit(70).groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("k"))
    return per.select(*imbalance(F.col("hi"), F.col("lo"), F.col("k")))


@book.query("L16_token_budget")
def token_budget(t):
    """Checked against a fold in plain Python by the tests."""
    best = chunks(t).orderBy(F.length("content").desc(), "chunk_id").limit(100)  # the results of one answer
    c = best.select("chat_id", "chunk_id", "content", F.row_number().over(W.orderBy(F.length("content").desc(), "chunk_id")).alias("rank"))
    return R.token_budget(c, 6000).select("chunk_id", "chat_id", "rank")


@book.query("F08_running_budget", "WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, length(text) // 4 AS k FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)), f AS (SELECT r, doc_id, k <= 6000 AS took, CASE WHEN k <= 6000 THEN k ELSE 0 END AS used FROM x WHERE r = 1 UNION ALL SELECT x.r, x.doc_id, used + x.k <= 6000, CASE WHEN used + x.k <= 6000 THEN used + x.k ELSE used END FROM f JOIN x ON x.r = f.r + 1) SELECT doc_id, took FROM f")
def running_budget(t):
    rows = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id", F.floor(F.length("text") / 4).cast("int").alias("k"))
    return R.greedy(rows, "doc_id", "k", 6000)


@book.query("C11_context_share", f"WITH {VEC} SELECT label, round(100.0 * count(*) / sum(count(*)) OVER (), 1)::DOUBLE AS share FROM (SELECT * FROM dense ORDER BY score DESC, vec_id LIMIT 50) GROUP BY label")
def context_share(t):
    per = dense(t).orderBy(F.desc("score"), "vec_id").limit(50).groupBy("label").agg(F.count("*").alias("n"))
    return per.select("label", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(W.partitionBy()), 1).alias("share"))


@book.query("Q21_gini", "WITH c AS (SELECT n, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS k, sum(n) OVER () AS s FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source)) SELECT round(sum((2 * i - k - 1) * n) / (max(k) * max(s))::DOUBLE, 6)::DOUBLE AS gini FROM c")
def gini(t):
    c = t.documents.filter("lang = 'de'").groupBy("source").agg(F.count("*").alias("n"))
    r = c.select("n", F.row_number().over(W.orderBy("n")).alias("i"))
    a = r.agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum(F.col("i") * F.col("n")).alias("w"))
    return a.select(F.round((2 * F.col("w") - (F.col("k") + 1) * F.col("s")) / (F.col("k") * F.col("s")), 6).alias("gini"))
