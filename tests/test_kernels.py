"""Queries without SQL against plain restatements of their rules, on whole tables."""

import itertools
import json
import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

from textloom.functions import fuzzy, verse
from textloom.functions import lexicon as lx
from textloom.operators import slots
from textloom.plans import all_books

QUERIES = {name: make for book in all_books() for name, make in book.queries.items()}
WORD = re.compile(f"[{lx.LETTERS}]+(?:-[{lx.LETTERS}]+)*")


def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()}


def rounded(value, digits):
    return float(Decimal(repr(float(value))).quantize(Decimal(digits), ROUND_HALF_UP))


def test_text_records(spark, sf_dir):
    of = texts(spark, sf_dir)
    rows = {r["doc_id"]: r for r in QUERIES["K01_analyze_text"](spark, sf_dir).collect()}
    assert rows.keys() == of.keys() and {r["language"] for r in rows.values()} == {"latin"}
    for i, text in of.items():
        if "**" in text or "»" in text or "«" in text or "[" in text or text != text.strip():
            continue  # lines that importers put before a text are taken off
        stats, words = json.loads(rows[i]["stats"]), WORD.findall(text.lower())
        n = len(words)
        assert (stats["chars"], stats["words"]) == (len(text), n)
        ttr = len(set(words)) / n if n else 0.0
        whole = [len(set(words[at : at + 100])) / 100 for at in range(0, n // 100 * 100, 100)]
        assert stats["ttr"] == rounded(ttr, "0.001") and abs(stats["sttr"] - (sum(whole) / len(whole) if whole else ttr)) < 6e-4
        assert stats["morphology"] == (rounded(sum(map(len, words)) / n + sum(len(w) > 10 for w in words) / n * 3, "0.01") if n else 0.0)


def test_compounds_are_counted_in_whole_texts(spark, sf_dir):
    of = texts(spark, sf_dir)
    rows = {r["doc_id"]: r["compounds"] for r in QUERIES["K04_compounds"](spark, sf_dir).collect()}
    assert rows.keys() == of.keys()
    some = 0
    for i, found in rows.items():
        times = Counter(WORD.findall(of[i].lower()))
        lengths = [len(c.split(":")[0]) for c in found]
        assert lengths == sorted(lengths, reverse=True) and len(found) <= 15
        for c in found:
            word, kind, n = c.rsplit(":", 2)
            assert times[word] == int(n) and (kind != "lang" or len(word) >= 10)
            some += 1
        if len(found) < 15:  # nothing that is long enough is left out
            assert not {w for w in times if len(w) >= 12 and w.replace("-", "").isalpha() and w not in lx.DE_NO_COMPOUNDS} - {c.rsplit(":", 2)[0] for c in found}
    assert some


def test_internal_rhymes_match_all_pairs(spark, sf_dir):
    of = texts(spark, sf_dir)
    rows = {r["doc_id"]: r for r in QUERIES["K09_sound_patterns"](spark, sf_dir).collect()}
    every_word = re.compile(r"[\wЀ-ӿ]+")

    def only_suffix(a, b):
        return any(a.endswith(s) and b.endswith(s) and min(len(a), len(b)) > len(s) + 1 for s in lx.NOUN_SUFFIXES)

    small = [i for i in of if len(of[i]) < 1500 and not re.search(r"(?m)^\s*\d{1,4}[a-z]?\s*$", of[i])]
    assert len(small) > 20
    for i in small:
        n = 0
        for line in filter(None, map(str.strip, of[i].split("\n"))):
            words = list(dict.fromkeys(every_word.findall(line.lower())))
            if len(every_word.findall(line.lower())) > 1:
                forms = {w: verse.rhyme_form(w)[-3:] for w in words}
                n += sum(len(forms[a]) == 3 and forms[a] == forms[b] and not only_suffix(a, b) for a, b in itertools.combinations(words, 2))
        assert rows[i]["n_internal_rhymes"] == n


def test_fuzzy_windows(spark, sf_dir):
    of = texts(spark, sf_dir)
    rows = {r["doc_id"]: r for r in QUERIES["N02_fuzzy_window"](spark, sf_dir).collect()}
    assert rows
    for i, r in rows.items():
        quote = (of[i][10:100] + " und noch etwas" if i % 4 == 1 else "Frei erfunden ist dieses Zitat.").lower()
        source, step = of[i].lower()[:1536], max(len(quote) // 10, 20)
        starts = [*range(0, len(source) - len(quote) + 1, step), *([len(source) - len(quote)] if len(source) > len(quote) else [])]
        best = 0.0
        for at in starts:
            best = max(best, SequenceMatcher(None, quote, source[at : at + len(quote)]).ratio())
            if best >= 0.85:
                break
        assert r["ratio"] == rounded(best, "0.0001") and r["accepted"] == (best >= 0.85)


def test_counted_vectors_are_sums_over_words():
    import hashlib

    import numpy as np

    model = slots.counted_embedder(8)
    want = np.zeros(8)
    for word in "query: a b b c".split():
        h = hashlib.md5(word.encode()).hexdigest()
        want[int(h[:6], 16) % 8] += 1 if int(h[6], 16) & 1 else -1
    assert (model(["query: A b  b\tc"])[0] == want).all()


def test_greek_verse_records(spark, sf_dir):
    rows = {r["doc_id"]: json.loads(r["detail"]) for r in QUERIES["K21_greek_verse_detail"](spark, sf_dir).collect()}
    assert rows.keys() == texts(spark, sf_dir).keys()
    rhythm = {r["doc_id"]: r["rhythm"] for r in QUERIES["K20_greek_rhythm"](spark, sf_dir).collect()}
    skeletons = {r["doc_id"]: r["skeletons"] for r in QUERIES["K14_greek_skeleton"](spark, sf_dir).collect()}
    for i, record in rows.items():
        assert record["rhythm"]["description"] == rhythm[i] and record["skeletons"] == skeletons[i] and record["rhyme"]["type"] == "Kein Reim"


def brute_ratio(quote, source, enough=0.85):
    """Best ratio over all windows, each compared in full; None below ``enough``."""
    q, s = quote.lower(), source.lower()
    if len(q) < 20:
        windows = [s]
    else:
        step = max(len(q) // 10, 20)
        windows = [s[i : i + len(q)] for i in range(0, len(s) - len(q) + 1, step)] + ([s[len(s) - len(q) :]] if len(s) > len(q) else []) or ([s] if s else [])
    best = max((SequenceMatcher(None, q, w).ratio() for w in windows), default=0.0)
    return best if best >= enough else None


def test_whole_sources_are_searched_as_by_brute_force():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["the", "an", "er", "ß", "ou", "z"]) for _ in range(rng.randrange(1, 4)))
    met = 0
    for _ in range(250):
        source = " ".join(word() for _ in range(rng.randrange(0, 160)))
        at = rng.randrange(len(source) + 1)
        quote = list(source[at : at + rng.choice([5, 25, 60, 200, 300])] or "nirgends zu finden, ganz bestimmt")
        for _ in range(int(len(quote) * rng.choice([0, 0.03, 0.08, 0.12, 0.3]))):
            i = rng.randrange(len(quote))
            quote[i : i + rng.randrange(2)] = rng.choice(["", "x", "E", "qu"])
        quote = "".join(quote)
        want = brute_ratio(quote, source)
        assert fuzzy.best_in_source(quote, source) == want, (quote, source)
        met += want is not None and len(quote) >= 20
    assert 40 < met < 240
    for a, b in (("", ""), ("abc", ""), ("", "abc"), ("kitten", "sitting"), ("abcbdab", "bdcaba")):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert fuzzy.common_subsequence(a, b) == table[-1][-1]


def test_bent_quotations_in_whole_documents(spark, sf_dir):
    of = texts(spark, sf_dir)
    rows = {r["doc_id"]: r for r in QUERIES["N02_fuzzy_whole"](spark, sf_dir).collect()}
    assert rows
    for i, r in rows.items():
        x = of[i]
        quote = {0: x[10:110], 1: x[10:100] + " und noch etwas", 2: "Frei erfunden ist dieses Zitat.", 3: x[50:90]}[i % 4]
        want = brute_ratio(quote, x)
        assert r["accepted"] == (want is not None) and (want is None or abs(r["ratio"] - want) < 1e-4)
    many = {r["doc_id"]: r for r in QUERIES["N16_validate_claim_multisource"](spark, sf_dir).collect()}
    assert {"direct", "false_quote"} <= {r["kind"] for r in many.values()} <= {"direct", "paraphrase", "false_quote"}
    for i, r in many.items():
        assert r["valid"] == (r["source"] is not None) and (i % 4 == 2 or r["source"] == i or r["kind"] != "direct")


def test_a_step_holds_the_results_of_few_texts(spark, monkeypatch):
    """However many rows an Arrow batch has, results leave a Python step in slices."""
    from textloom.plans import kernels, stats

    for module in (kernels, stats):
        monkeypatch.setattr(module, "SLICE", 3)
    rows = spark.range(20).selectExpr("id as doc_id", "repeat('a b ', cast(id as int)) as x").coalesce(1)
    one = {r["doc_id"]: r["n"] for r in kernels.mapped(rows, lambda x: (len(x),), "n long").collect()}
    many = [(r["doc_id"], r["w"]) for r in stats.folded(rows, lambda x: ((w,) for w in x.split()), "w string").collect()]
    assert one == {i: 4 * i for i in range(20)} and sorted(many) == sorted((i, w) for i in range(20) for w in ["a", "b"] * i)


def test_counts_of_a_text_need_no_shuffle(spark, tmp_path):
    from textloom.plans import stats
    from textloom.plans.book import Tables

    spark.createDataFrame([(i, "a b a b und und") for i in range(9)], "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("E25_bigrams", "E25_trigrams", "E30_top_content_words", "E30_top_function_words", "K08_vowel_echoes"):
        plan = stats.book.queries[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and Tables(spark, str(tmp_path)).documents.count() == 9


def test_a_book_is_read_once(spark, tmp_path, monkeypatch):
    from textloom.plans import kernels, rest

    spark.createDataFrame([(1, "Ein Satz. " * 30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = []
    monkeypatch.setattr(kernels, "mapped", lambda rows, fn, schema: [fn(r["text"]) for r in rows.collect()])
    real = rest.importers.epub
    monkeypatch.setattr(rest.importers, "epub", lambda x: asked.append(1) or real(x))
    assert rest.book.queries["A18_epub"](spark, str(tmp_path))[0][0] == 1 and len(asked) == 1


def test_forms_of_a_word_are_kept():
    """Long texts repeat their words: each is normalised once."""
    from textloom.functions import scripts

    scripts.greek_words("μῆνιν ἄειδε")
    before = scripts._greek_token.cache_info().misses
    assert scripts.greek_words("μῆνιν ἄειδε " * 99) == scripts.greek_words("μῆνιν ἄειδε") * 99
    assert scripts._greek_token.cache_info().misses == before
    assert scripts.script_of("a\U0001d167" + "ἔνθα" * 9) == "greek"
