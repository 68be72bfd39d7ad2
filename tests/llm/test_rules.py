"""Operator 11: statistics and verdicts against plain Python, and the order of the cascade."""

import random
import re
from collections import Counter

import pytest

from tests.llm.test_operators import DOCS, NONSPACE, ODD, table
from textloom.llm import rules

SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    """(the shown statistics, kept), one rule after the other."""
    text = text or ""
    w = NONSPACE.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if NONSPACE.search(x)]
    chars, symbols, again = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    letters = sum(bool(re.search("[A-Za-z]|[^\x00-\x7f]", x)) for x in w)
    n = len(w)
    fails = [n < 50, 100 * len(inside) > 50 * n, n > 0 and not 3 * n <= chars <= 10 * n, 10 * symbols > n, 2 * again > len(lines), 5 * letters < 4 * n, 2 * len(re.findall("[A-Z]", text)) > len(re.findall("[A-Za-z]", text))]
    return (n, chars, symbols, again, len(inside)), not any(fails)


def texts(seed):
    rng = random.Random(seed)
    out = list(ODD)
    for _ in range(60):
        pool = [rng.choice(["wort", "Wort", "ünder", "x", "|", "17", "LAUT", "ab\x0bcd", "🙂", "a" * 14]) + str(i % 9) * rng.randrange(2) for i in range(rng.choice([3, 40, 300]))]
        out.append("".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "\t", " \n"]) for _ in range(rng.choice([5, 49, 50, 51, 120, 400]))))
    out += [" ".join(f"word{i}" for i in range(49)), " ".join(f"word{i}" for i in range(50)), "\n".join(["a line of four"] * 20), "Same same " * 60]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_statistics_and_verdicts_match_plain_python(spark, seed):
    rows = texts(seed)
    docs = table(spark, rows, [None if i == 3 else i for i in range(len(rows))])
    ordered = rules.order(rules.estimate(docs, per_task=20), given=SHOWN)
    out = rules.verdicts(docs, ordered, SHOWN)
    assert out.columns == ["doc_id", *SHOWN, "kept"]
    found = {r["doc_id"]: (tuple(r)[1:-1], r["kept"]) for r in out.collect()}
    assert found == {None if i == 3 else i: brute(x) for i, x in enumerate(rows)}
    kept = rules.keep(docs, ordered)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, ok) in found.items() if ok}
    assert any(ok for _, ok in found.values()) and not all(ok for _, ok in found.values())


def test_the_order_does_not_change_a_verdict():
    rng = random.Random(3)
    for text in texts(4):
        wanted = brute(text)[1]
        for _ in range(3):
            assert rules.passes({"data": (text or "").encode()}, rng.sample(rules.RULES, len(rules.RULES))) == wanted


def test_the_order_goes_by_rejections_per_second(spark):
    rule = lambda name, *needs: rules.Rule(name, needs, lambda *x: False)
    some = (rule("dear", "n_repeat_words"), rule("cheap", "n_symbols"), rule("rare", "n_capitals"), rule("like dear", "n_dup_lines"))
    rows = [("hashes", None, 5.0, 0), ("n_symbols", None, 1.0, 0), ("n_capitals", None, 1.0, 0), ("lines", None, 0.1, 0)]
    # bits: dear 1, cheap 2, rare 4, like dear 8; all that "like dear" rejects goes to "cheap" first
    rows += [(None, 1, 0.0, 30), (None, 2, 0.0, 40), (None, 10, 0.0, 60), (None, 4, 0.0, 1), (None, 0, 0.0, 500)]
    known = spark.createDataFrame(rows, "part string, rejected_by long, seconds double, texts long")
    assert [r.name for r in rules.order(known, some)] == ["like dear", "cheap", "dear", "rare"]
    assert rules.order(known, some, given=("n_repeat_words",))[0].name == "dear"  # what is there already costs nothing


def test_short_circuit_computes_no_more_than_it_needs():
    have = {"data": b"few words"}
    assert not rules.passes(have, list(rules.RULES)) and "hashes" not in have and "lines" not in have
    assert rules.parts_of(["n_repeat_words"]) == {"n_repeat_words", "hashes", "raw", "bounds"}


def test_estimates_count_the_sample(spark):
    docs = table(spark, ["few words"] * 30 + [" ".join(f"word{i}" for i in range(60))] * 10).coalesce(1)
    rows = rules.estimate(docs, per_task=35).collect()
    assert {r["rejected_by"]: r["texts"] for r in rows if r["part"] is None} == {1: 30, 0: 5}
    assert all(r["seconds"] > 0 for r in rows if r["part"] is not None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    ordered = rules.order(rules.estimate(docs))
    assert sorted(r.name for r in ordered) == sorted(r.name for r in rules.RULES)
    assert rules.verdicts(docs, ordered, SHOWN).count() == 0 and rules.keep(docs, ordered).count() == 0
