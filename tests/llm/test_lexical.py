"""Operator 12: ranks against a plain scorer, and what the tree opens."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import ALNUM, ODD, split, table
from textloom.llm import lexical


def brute(docs, items, k=20):
    """docs: (id, text); items: (id, text). Rows (item, rank, doc, score)."""
    bags = [(i, Counter(w), len(w)) for i, t in docs if (w := split(ALNUM, t))]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    wanted: dict = {}
    for i, t in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        wanted.setdefault(i, []).extend(split(ALNUM, t))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms if bag[t])
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, score) for rank, (_, _, i, score) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def words(rng, n, pool):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % pool}" for _ in range(n))


@pytest.mark.parametrize("seed, block", [(1, 1 << 20), (2, 40), (3, 1 << 20)])
def test_ranks_match_a_plain_scorer(spark, seed, block):
    rng = random.Random(seed)
    texts = [t for t in ODD if not t or len(t) < 1000] + [words(rng, rng.randrange(0, 40), 60) for _ in range(300)]
    texts += [texts[-1]] * 30 + ["w1 w2"] * 25  # ties beyond the number of ranks
    ids = [rng.randrange(-50, 200) if rng.random() < 0.2 else 1000 - i for i in range(len(texts))]
    ids[20] = None
    items = [(i, words(rng, rng.choice([1, 3, 12]), 60)) for i in range(8)] + [(3, None), (None, "w1"), (9, ""), (10, "nowhere"), (11, "w1 w1 W2"), (11, "w1 w1 W2"), (11, "w5"), (12, texts[-40])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = lexical.rank(table(spark, texts, ids), bench, block_bytes=block)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(list(zip(ids, texts)), items)


def test_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([("a", "long x"), ("b", "text")], "name string, said string")
    docs = table(spark, ODD)
    rows = lexical.rank(docs, bench, item_id="name", item_text="said", k=3).collect()
    assert sorted(map(tuple, rows), key=repr) == brute(list(enumerate(ODD)), [("a", "long x"), ("b", "text")], 3)
    assert lexical.rank(docs.limit(0), bench, item_id="name", item_text="said").count() == 0
    assert lexical.rank(docs, bench.limit(0), item_id="name", item_text="said").count() == 0


def test_the_tree_finds_the_best_and_opens_few_nodes():
    rng = random.Random(5)
    texts = [words(rng, 30, 400) for _ in range(6000)]
    texts[4711] = "rare words stand here only " + texts[4711]
    bags = [split(ALNUM, t) for t in texts]
    df = Counter(t for bag in bags for t in set(bag))
    block = lexical.Block.of([(1, [b"rare words stand here only"]), (2, [b"w1 w7 w350"])])
    names = {int(h): t for t in df for h in lexical.wordkit.words(t.encode(), lexical.wordkit.ALNUM)}
    counts = np.array([df[names[int(h)]] for h in block.terms])
    total = sum(map(len, bags))
    made = list(lexical.segments(enumerate(t.encode() for t in texts), block.terms, lexical.weights(counts, len(texts)), len(texts), total))
    assert sum(len(s.ids) for s in made) <= 6000 and max(len(s.levels) for s in made) >= 3
    for s in made:  # a node's maximum bounds all below it
        for low, high in zip(s.levels, s.levels[1:]):
            assert (np.repeat(high, lexical.FAN, axis=0)[: len(low)] >= low).all()
    leaves = sum(len(s.levels[0]) for s in made)
    wanted = brute(list(enumerate(texts)), [(1, "rare words stand here only"), (2, "w1 w7 w350")], 1)
    for (name, terms, often), (_, _, doc, score) in zip(block.items, wanted):
        best, opened = [], 0
        for s in made:
            opened += s.search(terms, often, best, 1)
        assert best == [(score, -doc)] and opened < leaves / (4 if name == 1 else 1)


def test_segments_stay_within_their_cells():
    block = lexical.Block.of([(1, [b"a b c d"])])
    docs = [(i, b"a b " * (i % 3)) for i in range(1000)]
    made = list(lexical.segments(iter(docs), block.terms, np.ones(4, dtype=np.int64), 1000, 2000, cells=8))
    assert [i for s in made for i in s.ids] == [i for i, t in docs if t] and all(s.levels[0].size <= 8 for s in made)
