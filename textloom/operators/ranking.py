"""Ranking operators over rows that carry a score: fusion, quotas, budgets.

None of them collects rows to the driver; a list's order is a ``rank`` column with a total order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.functions import text as T
from textloom.session import settle

RRF = 60


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, f, dl): how often each white-space token occurs, and the length of its text."""
    terms = docs.select(id_col, T.fields(F.lower(text_col)).alias("w"))
    flat = terms.select(id_col, F.size("w").alias("dl"), F.explode("w").alias("t"))
    return flat.groupBy(id_col, "t").agg(F.count("*").alias("f"), F.first("dl").alias("dl"))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(t, df): in how many texts a token occurs; counts are summed before they are moved."""
    return docs.select(F.explode(F.array_distinct(T.fields(F.lower(text_col)))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))


def idf(df: DataFrame, n_docs: DataFrame, floor: float = 0.25) -> DataFrame:
    """(t, df, idf): Okapi weights of (t, df), negative ones lifted to a share of the mean.

    ``n_docs`` is one row with ``n_docs``, the number of texts.
    """
    raw = df.crossJoin(F.broadcast(n_docs.select("n_docs")))  # by one row
    raw = raw.select("t", "df", (F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    lifted = F.when(F.col("raw") < 0, floor * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("t", "df", lifted.alias("idf"))  # by one row


def bm25(docs: DataFrame, terms: Sequence[str], k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of the texts that hold a term; a term asked twice counts twice.

    Each text counts the asked terms where it lies; only its score-bearing rows go on.
    """
    asked = list(dict.fromkeys(terms))
    tokens = docs.select(id_col, T.fields(F.lower(text_col)).alias("w"))
    lengths = tokens.agg(F.avg(F.size("w")).alias("avgdl"), F.count("*").alias("n_docs"))
    held = tokens.select(id_col, F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(*asked)).alias("w")).filter(F.size("w") > 0)

    def counted(term: str) -> Column:
        return F.struct(F.lit(term).alias("t"), F.lit(terms.count(term)).alias("times"), F.size(F.filter("w", lambda x: x == term)).alias("f"))

    found = held.select(id_col, "dl", F.explode(F.array(*map(counted, asked))).alias("c")).select(id_col, "dl", "c.*").filter("f > 0")
    weights = idf(document_frequencies(docs, text_col), lengths).filter(F.col("t").isin(*asked))
    hits = found.join(F.broadcast(weights), "t").crossJoin(F.broadcast(lengths))  # weights: a row a term asked; lengths: one row
    norm = F.col("f") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("f") * (k1 + 1) / norm * F.col("times")
    return hits.groupBy(id_col).agg(F.round(F.sum(part), 6).alias("score"))


def numbered(rows: DataFrame, *order: Column, name: str = "seq") -> DataFrame:
    """Places 1, 2, ... of all rows in an order, without gathering them in one task.

    Rows are dealt by ranges of the order and counted there; each range is numbered on its
    own from the sum of the counts before it. The order has to be total.
    """
    dealt = settle(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = counts.select(F.col("__part").alias("__p"), before.alias("__before"))
    within = dealt.withColumn("__at", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    out = within.join(F.broadcast(starts), F.col("__part") == F.col("__p"))  # as many rows as partitions
    return out.withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__p", "__before", "__at")


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Ranks of rows that a limit has bounded before."""
    return rows.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def fuse(lists: DataFrame, id_col: str, k: int = RRF) -> DataFrame:
    """(id, rank) of any number of lists to (id, rrf)."""
    return lists.groupBy(id_col).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"))


def top(rows: DataFrame, id_col: str, limit: int, score: str = "score") -> DataFrame:
    """The best ``limit`` rows with their rank: the cut comes first, so only they are numbered."""
    return ranked(rows.orderBy(F.desc(score), id_col).limit(limit), [F.desc(score), F.col(id_col)])


def hybrid(dense: DataFrame, sparse: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Reciprocal-rank fusion of six times and three times ``limit`` candidates."""
    lists = top(dense, id_col, 6 * limit).select(id_col, "rank").union(top(sparse, id_col, 3 * limit).select(id_col, "rank"))
    return fuse(lists, id_col).orderBy(F.desc(F.round("rrf", 9)), id_col).limit(limit)


def quota(rows: DataFrame, doc: str, order: Sequence[Column], limit: int, n_docs: int) -> DataFrame:
    """At most max(20, 2 limit / n) rows a document, then the best 2 limit of all."""
    most = max(20, 2 * limit // n_docs)
    within = rows.withColumn("__r", F.row_number().over(W.partitionBy(doc).orderBy(*order)))
    return within.filter(F.col("__r") <= most).drop("__r").orderBy(*order).limit(2 * limit)


def semantic_search(rows: DataFrame, doc: str, id_col: str, limit: int, scope: Sequence | None = None) -> DataFrame:
    order = [F.desc("score"), F.col(id_col)]
    if scope and len(scope) <= 5:
        return quota(rows.filter(F.col(doc).isin(*scope)), doc, order, limit, len(scope))
    if scope:
        rows = rows.filter(F.col(doc).isin(*scope))
    return rows.orderBy(*order).limit(2 * limit)


def vip(rows: DataFrame, doc: str, asked: Sequence, order: Sequence[Column], limit: int, keep: int = 3) -> DataFrame:
    """The first rows of each asked document stay; others fill up to ``limit``. Adds ``vip``."""
    marked = rows.withColumn("__k", F.row_number().over(W.partitionBy(doc).orderBy(*order))).withColumn("vip", F.col(doc).isin(*asked) & (F.col("__k") <= keep))
    sure = marked.filter("vip")
    fill = marked.filter("not vip").orderBy(*order).limit(limit)
    room = sure.agg(F.greatest(F.lit(0), limit - F.count("*")).alias("__room"))
    filled = fill.withColumn("__p", F.row_number().over(W.orderBy(*order))).crossJoin(F.broadcast(room)).filter("__p <= __room")  # by one row
    return sure.drop("__k").unionByName(filled.drop("__k", "__p", "__room"))


def essence_parity(pool: DataFrame, chosen: DataFrame, doc: str, id_col: str, n_docs: int, base: int = 60) -> DataFrame:
    """Guaranteed logarithmic minimum a document, quality fill, then the logarithmic cap."""
    per = pool.groupBy(doc).agg(F.ceil(F.log2(F.count("*"))).cast("int").alias("least"))
    have = chosen.groupBy(doc).agg(F.count("*").alias("available"))
    weight = F.log2(F.coalesce("available", F.lit(0)) + 1)
    total = F.lit(base) if n_docs <= 5 else F.floor(base * (1 + 0.5 * F.log2(F.lit(n_docs) / F.lit(5.0)))).cast("int")
    per = per.join(have, doc, "left").withColumn("w", weight)
    sums = per.agg(F.sum("w").alias("all_w"), F.sum("least").alias("all_least"))
    per = per.crossJoin(F.broadcast(sums)).select(doc, "least", F.greatest(F.floor(total * (F.col("w") / F.col("all_w"))).cast("int"), F.col("least")).alias("cap"), F.greatest(F.lit(0), total - F.col("all_least")).alias("fill"))
    order = [F.desc("score"), F.col(id_col)]
    rows = chosen.join(per, doc).withColumn("sure", F.row_number().over(W.partitionBy(doc).orderBy(*order)) <= F.col("least"))
    rows = rows.withColumn("__g", F.row_number().over(W.partitionBy("sure").orderBy(*order))).filter("sure or __g <= fill")
    rows = rows.withColumn("__p", F.row_number().over(W.partitionBy(doc).orderBy(F.desc("sure"), *order)))
    return rows.filter("__p <= cap").drop("__g", "__p", "fill", "cap", "least")


def confidence(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores stretched to 0 to 100 over the rows; 50 where they hardly differ."""
    w = W.partitionBy()
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return rows.withColumn("confidence", F.when(hi - lo < 0.01, F.lit(50.0)).otherwise((F.col(score) - lo) / (hi - lo) * 100))


def rerank(rows: DataFrame, judge: Callable[[DataFrame], Column], id_col: str, threshold: float, limit: int, pool: int = 100, batch: int = 4) -> DataFrame:
    """Best ``pool`` rows judged in batches; a batch without verdict keeps its own score."""
    first = top(rows, id_col, pool).withColumn("batch", F.floor((F.col("rank") - 1) / batch))
    s = F.coalesce(judge(first), F.col("score"), F.lit(0.5))
    judged = first.withColumn("s", F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))
    return judged.filter(F.col("s") >= threshold).orderBy(F.desc("s"), id_col).limit(limit)


def greedy(rows: DataFrame, order_col: str, cost: str, budget: int) -> DataFrame:
    """(order, took): rows are taken in order while they fit; a row too large is skipped.

    A fold over one list: meant for the rows of one answer, which a query bounds.
    """
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(order_col, cost))).alias("l"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<struct<{order_col}:{rows.schema[order_col].dataType.simpleString()},took:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x[cost] <= budget
        return F.struct(F.when(fits, s["used"] + x[cost]).otherwise(s["used"]).cast("int").alias("used"), F.concat(s["out"], F.array(F.struct(x[order_col].alias(order_col), fits.alias("took")))).alias("out"))

    return listed.select(F.explode(F.aggregate("l", start, step, lambda s: s["out"])).alias("x")).select("x.*")


def token_budget(rows: DataFrame, budget: int, doc: str = "chat_id", content: str = "content") -> DataFrame:
    """Rows (with ``rank``) within a token budget: each document's first row within its
    logarithmic share, then the first rows put off, then the rest that fits."""
    rows = rows.withColumn("__k", F.floor(F.length(content) / 4).cast("int"))
    w = W.partitionBy(doc)
    rows = rows.withColumn("__n", F.count("*").over(w)).withColumn("__first", F.row_number().over(w.orderBy("rank")) == 1)
    share = rows.filter("__first").agg(F.sum(F.log(F.col("__n") + 1)).alias("__sum"))
    rows = rows.crossJoin(F.broadcast(share)).withColumn("__own", F.floor(budget * (F.log(F.col("__n") + 1) / F.col("__sum"))).cast("int"))  # by one row
    wave = F.when(F.col("__first") & (F.col("__k") <= F.col("__own")), 0).when(F.col("__first"), 1).otherwise(2)
    rows = rows.withColumn("__key", F.struct(wave.alias("wave"), "rank"))
    # The shares sum to the budget at most, so every first row within its share fits.
    took = greedy(rows.select("__key", "__k"), "__key", "__k", budget).filter("took").select("__key")
    return rows.join(took, "__key").drop("__k", "__n", "__first", "__sum", "__own", "__key")
