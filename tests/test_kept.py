"""Kept indexes: random changes, replays and compaction against a rebuild; recall and pruned scans of vectors."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import postings, vectors

WORDS = "a b c d e the of und ein der".split()


def scores(texts, terms, k1=1.5, b=0.75, floor=0.25):
    """Okapi scores of plain texts by id."""
    bags = {i: Counter(x.lower().split()) for i, x in texts.items()}
    df = Counter(t for bag in bags.values() for t in bag)
    raw = {t: math.log(len(bags) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    length = {i: sum(bag.values()) for i, bag in bags.items()}
    avg = sum(length.values()) / len(length)
    out = {}
    for i, bag in bags.items():
        parts = [(floor * mean if raw[t] < 0 else raw[t]) * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * length[i] / avg)) for t in terms if bag[t]]
        if parts:
            out[i] = sum(parts)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_changes_equal_a_rebuild(spark, tmp_path, seed):
    rng = random.Random(seed)
    index, texts = postings.Index(spark, str(tmp_path / "index"), 3), {}
    done = []
    for number in range(4):
        rows = []
        for seq in range(25):
            i, op = rng.randrange(30), rng.choice(["insert", "update", "delete"])
            text = None if op == "delete" else " ".join(rng.choices(WORDS, k=rng.randrange(0, 9)))
            rows.append((i, seq, op, text))
        rows.append((None, 99, "insert", "a b"))
        for i, _, op, text in rows[:-1]:
            if op == "delete":
                texts.pop(i, None)
            else:
                texts[i] = text
        changes = spark.createDataFrame(rows, postings.CHANGE)
        index.apply(changes, number)
        done.append(changes)
        if rng.random() < 0.4:
            index.apply(changes, number)  # delivered again
        if number == 2:
            index.compact()
            index.apply(done[1], 1)  # folded in already
            assert index.batches() == (1, [2])
    want = scores(texts, ["the", "of", "the", "zz"])
    got = {r["id"]: r["score"] for r in index.bm25(["the", "of", "the", "zz"]).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)
    df = Counter(t for x in texts.values() for t in set(x.lower().split()))
    assert {r["t"]: r["df"] for r in index.vocabulary().collect()} == df
    live = index.table("postings").groupBy("t", "id").agg(F.sum("sign").alias("n")).filter("n <> 0").collect()
    assert {(r["t"], r["id"], r["n"]) for r in live} == {(t, i, 1) for i, x in texts.items() for t in set(x.lower().split())}


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = postings.Index(spark, str(tmp_path / "index"), 16)
    assert index.bm25(["a"]).count() == 0
    index.apply(spark.createDataFrame([(i, 0, "insert", f"wort{i} the of") for i in range(60)], postings.CHANGE), 0)
    found = index.postings(["wort7"])
    assert [tuple(r) for r in found.collect()] == [("wort7", 7, 1, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan[plan.index("PartitionFilters") :]
    held = index.table("postings").select("bucket").distinct().count()
    assert held > 8 and index.table("postings").filter(F.col("bucket") == index.table("postings").filter("t = 'wort7'").first()["bucket"]).count() < 200


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("sent", [postings.SENT, 0])
def test_postings_are_not_shuffled(spark, tmp_path, monkeypatch, sent):
    """A batch and a compaction shuffle texts and terms, and the postings of changed texts at most."""
    monkeypatch.setattr(postings, "SENT", sent)
    index, words = postings.Index(spark, str(tmp_path / "index"), 3), [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words) for i in range(60)}
    spark.createDataFrame([(i, 0, "insert", x) for i, x in texts.items()], postings.CHANGE).coalesce(1).write.parquet(f"{tmp_path}/rows")
    before = shuffled(spark)
    index.apply(spark.read.parquet(f"{tmp_path}/rows"), 0)
    once = shuffled(spark) - before
    assert once < 60 * 401 / 2
    changes = [(1, 0, "update", "w1 neu"), (2, 0, "delete", None), (3, 0, "insert", ""), (99, 0, "delete", None)]
    index.apply(spark.createDataFrame(changes, postings.CHANGE), 1)
    before = shuffled(spark)
    index.compact()
    assert not sent or shuffled(spark) - before < 60 * 401 / 2
    texts = texts | {1: "w1 neu", 3: ""}
    del texts[2]
    live = {(r["t"], r["id"], r["f"], r["dl"], r["sign"]) for r in index.table("postings").collect()}
    assert live == {(t, i, 1, len(x.split()), 1) for i, x in texts.items() for t in x.split()}
    want, got = scores(texts, ["w1", "neu"]), {r["id"]: r["score"] for r in index.bm25(["w1", "neu"]).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def embeddings(n, dim, groups, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return [middle[i % groups] + 0.5 * rng.normal(size=dim) for i in range(n)]


def nearest(rows, k):
    v = np.stack([x / np.linalg.norm(x) for x in rows])
    out = {}
    for i in range(0, len(v), 20):
        s = np.round(v @ v[i], 9)
        out[i] = [int(j) for j in np.lexsort((np.arange(len(v)), -s))[:k]]
    return out


def test_vectors_are_found_exactly_and_with_recall(spark, tmp_path):
    rows = embeddings(1200, 16, 24)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(rows)] + [(5000, None), (5001, [0.0] * 16)], "vec_id long, embedding array<double>")
    index = vectors.Index(spark, str(tmp_path / "index"))
    index.build(df, cells=24, sample=600)
    assert index.vectors().count() == 1200
    asked, want = df.filter("vec_id % 20 = 0"), nearest(rows, 10)

    def found(**how):
        out = {}
        for r in index.search(asked, 10, **how).collect():
            out.setdefault(r["query"], []).append((r["rank"], r["id"]))
        return {q: [i for _, i in sorted(x)] for q, x in out.items() if q < 5000}

    assert found(probes=1, exact=True) == want
    probes = index.probes_for(asked.limit(20), 10, recall=0.97)
    some = found(probes=probes)
    recall = sum(len(set(some[q]) & set(want[q])) for q in want) / (10 * len(want))
    assert recall >= 0.9 and probes <= 8  # of 24 cells
    plan = index.search(asked, 10, probes=probes)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "cell" in plan[plan.index("PartitionFilters") :]


def test_bounds_hold_for_every_vector(spark, tmp_path):
    rows = embeddings(300, 8, 5)
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    index = vectors.Index(spark, str(tmp_path / "index"))
    index.build(df, cells=6)
    asked = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), vectors.unit(F.col("embedding")).alias("q"))
    met = index.vectors().join(index.bounds(asked), "cell").select((vectors.dot(F.col("v"), F.col("q")) - F.col("most")).alias("over"))
    assert met.agg(F.max("over")).first()[0] <= 1e-9


def test_empty_vector_table(spark, tmp_path):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = vectors.Index(spark, str(tmp_path / "index"))
    index.build(df)
    assert index.search(df, 5, exact=True).count() == 0


def test_nearest_vectors_meet_in_blocks(spark, tmp_path, monkeypatch):
    """Cells of many vectors are cut into blocks; ties go by id across them."""
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(120)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vectors.Index(spark, str(tmp_path))
    index.build(table, cells=3)
    found = {(r["query"], r["rank"]): r["id"] for r in index.search(table.filter("vec_id < 20"), 9, probes=1, exact=True).collect()}
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if any(x)}
    for q in (i for i in range(20) if i in v):
        best = sorted(v, key=lambda i: (-round(float(v[q] @ v[i]), 9), i))[:9]
        assert [found[q, n] for n in range(1, 10)] == best
