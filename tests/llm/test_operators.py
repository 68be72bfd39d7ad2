"""The ten operators against brute force, exact round trips and held-out labels."""

import hashlib
import html
import itertools
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.compare import database, same
from textloom.llm import chat, decontam, dedup, features, licenses, media, mixing, quality, queries, sharding, sitetree, toxicity, wordkit

ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NONSPACE = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, kept string, slot string"

ODD = [None, "", "   ", "a", "Ä ß ñ", "x" * 300000, "the same text of some words", "the same text of some words", "The SAME text of some words", "\x00 null \x00", "long " * 40000]


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "clash", "clash", "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


def split(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("kind, pattern", [(wordkit.ALNUM, ALNUM), (wordkit.NONSPACE, NONSPACE)])
@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=80))
def test_hashed_words_stand_for_words(kind, pattern, text):
    found, words = wordkit.words(text.encode(), kind), split(pattern, text)
    assert len(found) == len(words)
    for (a, x), (b, y) in itertools.combinations(zip(words, found.tolist()), 2):
        assert (a == b) == (x == y)


def test_words_across_segments():
    text = ("word " * 120000 + "y" * 600000 + " end").encode()
    assert len(wordkit.words(text, wordkit.ALNUM)) == 120002


# 1 HTML extraction
ARTICLE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy</div><article><h1>Kopf &amp; Fu&szlig;</h1><p>Eins <b>zwei<br>drei<p>vier\n\n f&uuml;nf</article><div id=comments><p>toll</div><footer>x</footer>"


def test_extract_article_and_odd_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", ARTICLE), (2, None, None), (3, "odd", ""), (4, "http://b.example", "<p>nur &lt;Text"), (1, "http://a.example/x", ARTICLE)], "page_id long, url string, html string")
    rows = sitetree.extract(pages).collect()
    texts = sorted((r["page_id"], r["text"], r["n_chars"]) for r in rows)
    body = "Kopf & Fuß\n\nEins zwei drei\n\nvier fünf"
    assert texts == [(1, body, len(body)), (1, body, len(body)), (2, "", 0), (3, "", 0), (4, "nur <Text", 9)]
    assert sitetree.extract(pages.limit(0)).count() == 0


def test_site_noise_is_cut_by_entropy(spark):
    page = "<body><div class=top>Willkommen auf der Seite</div><div class=body><p>{0} erster Absatz mit vielen eigenen Wörtern {0}</p><p>zweiter {0} Absatz</p></div><div class=end>Alle Angaben ohne Gewähr</div>"
    pages = spark.createDataFrame([(i, "https://site.example/p", page.format(f"wort{i}")) for i in range(8)], "page_id long, url string, html string")
    rows = {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()}
    assert rows == {i: f"wort{i} erster Absatz mit vielen eigenen Wörtern wort{i}\n\nzweiter wort{i} Absatz" for i in range(8)}


def test_site_tree_judges_marked_branches(spark):
    page = "<body><article><h1>Titel {0}</h1><p>{0} erster Absatz mit vielen eigenen Wörtern</p><div class=box><p>Folgen Sie uns überall</p></div></article>"
    pages = spark.createDataFrame([(i % 12, "https://site.example/p", page.format(f"wort{i % 12}")) for i in range(24)], "page_id long, url string, html string")
    want = {i: f"Titel wort{i}\n\nwort{i} erster Absatz mit vielen eigenen Wörtern" for i in range(12)}
    for paths in (1 << 17, 0):  # sent to all tasks, joined by host and path
        rows = sitetree.extract(pages, broadcast_paths=paths).collect()
        assert len(rows) == 24 and {r["page_id"]: r["text"] for r in rows} == want
    copies = pages.filter("page_id = 3")
    assert "Folgen" in sitetree.extract(copies.union(copies).union(copies).union(copies)).first()["text"]


@pytest.mark.parametrize("n", [1, 2, 5, 9, 20, 200])
def test_marked_articles_on_series_of_pages(spark, n):
    """Varying text beside the article goes, and its shared heading stays, on however many pages; what the tree knows to be shared goes."""
    page = "<body><article><h1>Weekly report</h1><p>wort{0} erster Absatz</p><p class=n>Write to us</p></article><div class=x7><p>Read next: other story {0}</p></div><div class=who><p>Author {0} lives in {0}</p></div>"
    pages = spark.createDataFrame([(i, "https://site.example/p", page.format(i)) for i in range(n)], "page_id long, url string, html string")
    own = "" if n >= 9 else "\n\nWrite to us"
    assert {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()} == {i: f"Weekly report\n\nwort{i} erster Absatz{own}" for i in range(n)}


def brute_text(html, known, threshold=0.3, prior=2):
    """The choice of blocks as the docstrings state it, block by block."""
    blocks = [b for b in sitetree.parse(html).blocks if not b.noise]

    def belief(path, leaf, says):
        value, on = known.get((path, leaf), (1.0, 1))
        return (value * (on - 1) + says * prior) / (on + prior - 1)

    mass = {}
    for b in blocks:
        says = 1 if b.marked else 0.5
        if belief(b.path, True, says) >= threshold or b.marked and b.heading:
            key = "marked" if b.marked else b.parent
            mass.setdefault(key, []).append((len(b.text) - b.links) * (prior if b.marked else belief(b.parent, False, says)))
    main = max(mass, key=lambda k: round(sum(mass[k]), 6), default=None)
    if main == "marked":
        return "\n\n".join(b.text for b in blocks if b.marked and (b.heading or belief(b.path, True, 1) >= threshold))
    return "\n\n".join(b.text for b in blocks if belief(b.path, True, 0.5) >= threshold and ((not b.marked and b.parent == main) or b.links < 0.8 * len(b.text)))


def test_texts_match_a_brute_force_choice_and_the_tree_changes_them(spark):
    rng = random.Random(8)

    def block(i):
        text = rng.choice(["Immer gleich und lang genug", "oft gleich", f"eigen {i} {rng.random()}"])
        return rng.choice([f"<p class=c{rng.randrange(3)}>{text}</p>", f"<div class=d><a href=x>{text}</a></div>", f"<h2>{text}</h2>", f"<p>{text}"])

    pages = []
    for i in range(120):
        inner = "".join(block(i) for _ in range(rng.randrange(1, 5))) + "<p class=legal>Alle Rechte vorbehalten</p>" * rng.randrange(2)
        main = f"<article>{inner}</article>" if i % 3 else f"<div class=body>{inner}</div>"
        pages.append((i, f"https://h{i % 4}.example/p", f"<body>{block(i)}{main}<div class=end>{block(i)}</div>"))
    known = brute_importances([(f"h{i % 4}.example", html) for i, _, html in pages])
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: brute_text(html, {(p, leaf): v for (h, p, leaf), v in known.items() if h == f"h{i % 4}.example"}) for i, _, html in pages}
    for paths in (1 << 17, 0):
        assert {r["page_id"]: r["text"] for r in sitetree.extract(df, broadcast_paths=paths).collect()} == want
    assert sum(brute_text(html, {}) != want[i] for i, _, html in pages) > 30


def test_teaser_articles_do_not_hide_the_main_text(spark):
    page = "<body><div class=text><p>{0} Absatz mit vielen eigenen Wörtern, die nur auf dieser Seite stehen</p></div><article><p>Lesen Sie auch: Lösungen</p></article>"
    pages = spark.createDataFrame([(i, "https://site.example/p", page.format(f"wort{i}")) for i in range(8)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()} == {i: f"wort{i} Absatz mit vielen eigenen Wörtern, die nur auf dieser Seite stehen" for i in range(8)}


def test_noise_of_a_part_of_a_host_is_cut(spark):
    """A text on 4 of 12 pages, longer than the article, and one on a host of three pages."""
    legal = "<section class=x><p>" + "Alle Angaben ohne Gewähr. " * 20 + "</p></section>"
    html = lambda i, more: f"<body><div class=body><p>wort{i} erster Absatz mit eigenen Wörtern</p></div>{more}"
    rows = [(i, "https://a.example/p", html(i, legal if i < 4 else "")) for i in range(12)] + [(i, "https://b.example/p", html(i, legal)) for i in range(20, 23)]
    found = sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == {i: f"wort{i} erster Absatz mit eigenen Wörtern" for i, _, _ in rows}


def test_extraction_matches_the_generated_articles(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = {}
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<(?:b|/b|br)>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        wanted[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()} == wanted


def test_long_and_deep_pages_are_read_in_time():
    began = time.perf_counter()
    for html in ("<div>" * 100000 + "x", "<b><p>" * 60000 + "x", "<ul><li>" * 60000, "<i>" * 60000 + "</b>" * 60000, "<!" * 200000, '<a "' * 200000, "<!--" * 100000):
        sitetree.parse(html)
    assert time.perf_counter() - began < 20


def brute_importances(pages, damping=0.9):
    """Importance of (host, path, leaf) of paths on two or more different pages, by its definition."""
    import math

    trees = {}
    for host, html in pages:
        page = sitetree.parse(html)
        blocks = [b for b in page.blocks if not b.noise]
        inner = {b.parent for b in blocks}
        nodes = {(b.path, b.parent, True, b.text) for b in blocks} | {(p, p, False, s) for p, s in page.styles if p in inner}
        trees.setdefault((host, tuple(b.text for b in blocks)), set()).update(nodes)
    where = {}
    for (host, says), nodes in trees.items():
        for path, parent, leaf, content in nodes:
            where.setdefault((host, path, parent, leaf), {}).setdefault(content, set()).add(says)
    out, under = {}, {}
    for (host, path, parent, leaf), contents in where.items():
        counts = [len(x) for x in contents.values()]
        total, on = sum(counts), len(set().union(*contents.values()))
        mean_log = sum(k * math.log(k) for k in counts) / total
        if on < 2:
            value = 1.0
        elif leaf:
            value = 1 - mean_log / math.log(on)
        else:
            value = min(1.0, max(0.0, (math.log(total) - mean_log) / math.log(on)))
        out[host, path, leaf, parent] = value, on
        if leaf:
            under.setdefault((host, parent), []).append((value, on))
    final = {}
    for (host, path, leaf, parent), (value, on) in out.items():
        if not leaf and (host, path) in under:
            children = sum(n for _, n in under[host, path])
            mean = sum(v * n for v, n in under[host, path]) / children
            damp = damping ** (children / on)
            value = (1 - damp) * value + damp * mean
        elif not leaf:
            continue
        if on > 1:
            final[host, path, leaf] = round(value, 9), on
    return final


@pytest.mark.parametrize("seed", [1, 2])
def test_importances_match_brute_force(spark, seed):
    rng = random.Random(seed)

    def block(depth):
        if depth == 0 or rng.random() < 0.4:
            return f"<p class=c{rng.randrange(3)}>{rng.choice(['Immer gleich', f'eigen {rng.randrange(400)}', 'oft gleich'])}</p>"
        tag = rng.choice(["div", "section", "article", "ul"])
        return f"<{tag} class=k{rng.randrange(2)}>{''.join(block(depth - 1) for _ in range(rng.randrange(1, 4)))}</{tag}>"

    pages = [(f"h{i % 3}.example", "<body>" + "".join(block(3) for _ in range(3))) for i in range(40)]
    pages += pages[:5] + [("h0.example", None)]
    df = spark.createDataFrame([(f"http://{h}/x", html) for h, html in pages], "url string, html string")
    got = {(r["host"], r["path"], r["leaf"]): (r["importance"], r["on"]) for r in sitetree.importances(df).collect()}
    want = brute_importances([(h, html) for h, html in pages])
    assert got.keys() == want.keys() and len(got) > 50
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-9) for k in want)


def test_pages_feed_the_tree(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert sitetree.paths(pages).filter("leaf").count() > pages.count()


def test_extract_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", ARTICLE, "a", "b", "c")], "page_id long, url string, html string, text string, host string, tree string")
    assert sitetree.extract(pages).first()["text"].startswith("Kopf")


# 2 Media columns
def test_media_round_trip(spark):
    texts = [t for t in ODD] + ["x" * 192, "y" * 191, "é" * 96, "a\n<b>&c\n\nd"]
    rows = {r["doc_id"]: r for r in media.text_media(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_wave(padded)).hexdigest() and media.from_wave(media.to_wave(padded)) == padded
    assert rows[6]["feature"] == rows[7]["feature"] and media.text_media(table(spark, [])).count() == 0


def test_sequences_keep_order_and_captions(spark):
    page = '<p>vor<figure><img src="media:sha256/aa"><figcaption>Bild eins</figcaption></figure>mitte<img src="media:sha256/bb" alt="zwei"><p>nach'
    pages = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    store = spark.createDataFrame([("aa", b"1")], "digest string, payload binary")
    parts = media.resolve(media.sequences(pages, "id", "html"), store, "payload").orderBy("pos").collect()
    assert [(p["pos"], p["kind"], p["text"], p["caption"], p["payload"]) for p in parts] == [(0, "text", "vor", None, None), (1, "img", None, "Bild eins", bytearray(b"1")), (2, "text", "mitte", None, None), (3, "img", None, "zwei", None), (4, "text", "nach", None, None)]


def test_resolve_clashes_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, '<p>a<img src="media:sha256/aa"><img src="x.png"><p>b<audio src="media:sha256/aa">'), (1, "<p>c")], "id long, html string")
    store = spark.createDataFrame([("aa", "T", 5), ("aa", "T", 5), (None, "N", 1)], "digest string, text string, pos int")
    seqs = media.sequences(pages, "id", "html")
    rows = media.resolve(seqs, store, "text", "pos").collect()
    assert sorted((r["pos"], r["kind"], r["text"], r["media_text"], r["media_pos"]) for r in rows) == [(0, "text", "a", None, None), (0, "text", "c", None, None), (1, "img", None, "T", 5), (2, "img", None, None, None), (3, "text", "b", None, None), (4, "audio", None, "T", 5)]
    assert media.resolve(seqs.limit(0), store, "text").count() == 0 and media.resolve(seqs, store.limit(0), "text").count() == 6


def test_the_least_of_equal_digests_counts(spark):
    pages = spark.createDataFrame([(1, '<img src="media:sha256/aa"><p>b<img src="media:sha256/bb" alt="zwei"><img src="media:sha256/aa" alt="drei">')], "id long, html string")
    store = spark.createDataFrame([("aa", n, f"v{n}") for n in (9, 4, 7, 4, 30)] * 10 + [("bb", 1, "w")], "digest string, rank int, value string")
    for parts in (1, 2, 5, 8):
        rows = media.resolve(media.sequences(pages, "id", "html"), store.repartition(parts), "rank", "value").orderBy("pos").collect()
        assert [(r["kind"], r["caption"], r["rank"], r["value"]) for r in rows] == [("img", None, 4, "v4"), ("text", None, None, None), ("img", "zwei", 1, "w"), ("img", "drei", 4, "v4")]


# 3 License scans
def test_license_base_places_match_brute_force(spark):
    rng = random.Random(1)
    vocabulary = "mit license apache general public license MIT the x".split()
    texts = ODD + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    for r in licenses.scan(table(spark, texts)).collect():
        words = split(ALNUM, texts[r["doc_id"]])
        hits = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in hits})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def test_matching_statistics_are_the_longest_runs():
    rng = random.Random(2)
    templates = [[rng.randrange(4) for _ in range(12)] for _ in range(4)]
    automaton = licenses.Automaton(templates)
    phrases = [templates[0][2:4], templates[1][5:8], templates[1][6:8], templates[2]]
    automaton.mark(phrases)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    text = [rng.randrange(5) for _ in range(200)]
    for i, (_, length) in enumerate(automaton.statistics(text)):
        assert length == max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs))
    text += templates[2] + templates[1]
    found_runs, ends = automaton.scan(text, 3)
    assert sorted(ends) == sorted((i, n) for i in range(len(text)) for n, p in enumerate(phrases) if i + 1 >= len(p) and text[i + 1 - len(p) : i + 1] == p)
    for t, found in found_runs.items():
        for m in found:
            assert templates[t][m.place : m.place + m.n] == text[m.at : m.at + m.n]


def test_templates_give_their_labels():
    scanner = licenses.Scanner()
    for label, text in licenses.TEMPLATES:
        *_, labels, score, spans = scanner.scan(f"some words before. {text} and after".encode())
        assert label in labels.split(",") and score == pytest.approx(1) and max(s["share"] for s in spans) == 1


def brute_chain(found, gap):
    """Most words over all ascending chains, by trying every predecessor."""
    found = sorted(set(found), key=lambda m: (m.at, m.place))
    best = []
    for i, m in enumerate(found):
        top = m.n
        for j in range(i):
            p = found[j]
            lap = max(0, p.at + p.n - m.at, p.place + p.n - m.place)
            if p.at < m.at and p.place < m.place and lap < m.n and m.at - p.at - p.n <= gap and m.place - p.place - p.n <= gap:
                top = max(top, best[j] + m.n - lap)
        best.append(top)
    return max(best, default=0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.builds(licenses.Match, st.integers(0, 400), st.integers(0, 200), st.integers(1, 150)), max_size=30), st.integers(0, 8))
def test_chains_match_brute_force(found, gap):
    assert licenses.chain(found, gap)[0] == brute_chain(found, gap)


def test_one_changed_word_hardly_lowers_a_score():
    words = [f"w{i}" for i in range(200)]
    scanner = licenses.Scanner([("x", " ".join(words))], {})
    words[100] = "other"
    *_, labels, score, spans = scanner.scan(("before it " + " ".join(words) + " after").encode())
    assert labels == "x" and score == pytest.approx(0.995) and (spans[0]["lo"], spans[0]["hi"]) == (2, 202)


def test_license_scans_of_odd_tables(spark):
    assert licenses.scan(table(spark, ODD).limit(0)).count() == 0
    long = " ".join(text for _, text in licenses.TEMPLATES) + " word" * 200000
    rows = licenses.scan(table(spark, [long, long, None])).collect()
    assert rows[0]["labels"] == rows[1]["labels"] and {label for label, _ in licenses.TEMPLATES} <= set(rows[0]["labels"].split(",")) and rows[2]["spans"] == []


# 4 Chat formatting
@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.text(alphabet=st.sampled_from('\\<>"/ turn=l\n\x00ä'), max_size=30)), max_size=5))
def test_turns_read_back(turns):
    formatted = "".join(chat.format_turn(role, [{"type": "text", "text": text}])[0] for role, text in turns)
    assert [(r, t) for r, t, _ in chat.read_turns(formatted)] == turns


def test_attachments_are_ordered_and_counted():
    parts = [{"type": "text", "text": "a<b"}, {"type": "image", "ref": "i", "width": 1024, "height": 512}, {"type": "audio", "ref": "s", "seconds": 4}, {"type": "document", "ref": "d", "chars": 41}]
    formatted, seen = chat.format_turn("user", parts)
    assert formatted == '<turn role="user">a\\lb<image 1><audio 2><document 3></turn>\n'
    assert [(a.kind, a.ref, a.number, a.at, a.tokens) for a in seen.attachments] == [("image", "i", 1, 4, 85 + 340), ("audio", "s", 2, 13, 50), ("document", "d", 3, 22, 11)]


def test_parts_of_any_kind_are_defined(spark):
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,chars:int>>"
    part = lambda t, **more: {"type": t, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "chars": None} | more
    rows = [
        (1, 0, "user", [part("text", text="a"), None, part(None, text="<b>"), part("video", ref="v"), part("image", ref="i", width=-5, height=None), part("audio", ref="s", seconds=float("nan")), part("document", ref="d", chars=9)], "x"),
        (1, 1, "assistant", None, "x"),
        (2, 0, "assistant", [part("text", text="z" * 300000)], "x"),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kind}, formatted string")
    made = {(r["conv_id"], r["turn"]): r for r in chat.format_turns(df).collect()}
    assert made[1, 0]["formatted"] == '<turn role="user">a\\lb\\g<other 1><image 2><audio 3><document 4></turn>\n'
    assert [(a["kind"], a["ref"], a["tokens"]) for a in made[1, 0]["attachments"]] == [("other", "v", 1), ("image", "i", 255), ("audio", "s", 1), ("document", "d", 3)]
    out = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert (out[1]["n_turns"], out[1]["n_attachments"], out[1]["loss_chars"], out[2]["loss_chars"]) == (2, 4, 0, 300000)
    assert out[1]["expanded_tokens"] == 1 + 255 + 1 + 3 + 2


def test_conversations_match_brute_force(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (2, None, None, ""), (2, 0, "assistant", "ä" * 5), (2, 0, "assistant", "ä" * 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in chat.digests(chat.format_turns(chat.text_parts(df))).collect()}
    assert out.keys() == {1, 2, -7, None}
    for conv, r in out.items():
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1], chat.format_turn(x[2], [{"text": x[3]}])[0]))
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.format_turns(chat.text_parts(df.limit(0)))).count() == 0


# 5 Quality and 10 Toxicity
def test_sum_of_squares_identity():
    import numpy as np

    rng = np.random.default_rng(0)
    w, v = rng.normal(size=9), rng.normal(size=(9, 3))
    where, value = np.array([1, 4, 7]), np.array([0.5, -1, 2])
    pairs = sum(v[a] @ v[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(where, value), 2))
    assert quality.raw_score(where, value, (0.3, w, v)) == pytest.approx(0.3 + w[where] @ value + pairs)


def plain_statistics(text):
    """The structure statistics of a text, stated plainly."""
    import math

    raw = text.encode()
    words = split(NONSPACE, text)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, m = len(raw), max(1, len(words))
    count = lambda of: sum(chr(b) in of if isinstance(of, str) else of(b) for b in raw)
    upper = count(lambda b: 65 <= b <= 90)
    white = count(" \t\n\x0b\x0c\r")
    letters = upper + count(lambda b: 97 <= b <= 122)
    symbols = count("".join(chr(b) for b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))))
    pairs = {tuple(words[i : i + 2]) for i in range(len(words) - 1)}
    return [
        math.log1p(n) / 12, math.log1p(m) / 10, upper / max(1, letters), count("0123456789") / n, symbols / m / 4, count(".,:;?") / m, count(lambda b: b >= 128) / n, white / n, min(2.0, (n - white) / m / 10),
        len(set(words)) / m, len(pairs) / max(1, m - 1), math.log1p(len(lines)) / 6, len(set(lines)) / max(1, len(lines)), min(1.0, count("|") / m), min(1.0, count("!") / m), max((words.count(w) for w in words), default=0) / m,
    ]


def test_quality_scores_match_brute_force(spark):
    """All pairs of inputs one by one, on words and statistics found without the operator."""
    import math

    import numpy as np

    cfg = quality.Machine(dim=64, rank=3)
    rng = np.random.default_rng(3)
    size = cfg.dim + len(features.STATS)
    model = (0.1, rng.normal(size=size), rng.normal(0, 0.3, (size, 3)))
    texts = ["Ein Satz, zwei Worte! ein ein", "a|b|c 1 2 3\n\nZEILE zwei\nZEILE zwei", "ß ä é Ä x"]
    for r in quality.score(table(spark, texts), model, cfg).collect():
        text, x = texts[r["doc_id"]], {}
        for word in split(ALNUM, text):
            place = int(wordkit.words(word.encode(), wordkit.ALNUM)[0] % np.uint64(cfg.dim))
            x[place] = x.get(place, 0) + 1
        norm = math.sqrt(sum(math.log1p(v) ** 2 for v in x.values()))
        x = {k: math.log1p(v) / norm for k, v in x.items()} | {cfg.dim + i: v for i, v in enumerate(plain_statistics(text))}
        z = model[0] + sum(model[1][i] * v for i, v in x.items()) + sum(float(model[2][i] @ model[2][j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-9) and r["predicted"] == (r["score"] >= 0.3)


def test_toxicity_scores_match_brute_force(spark):
    """Severity from words and beginnings of words, each found without the operator."""
    import math

    import numpy as np

    cfg = toxicity.Ordinal(stems=range(4, 6))
    words = ["dumm", "idioten", "Wörter"]
    place = lambda h: int(h & np.uint64(cfg.dim - 1))
    of_word = {w: place(wordkit.words(w.lower().encode(), wordkit.ALNUM)[0]) for w in words}
    weights = {of_word["dumm"]: 1.5, of_word["idioten"]: 2.25}
    places = np.array(sorted(weights), dtype=np.int32)
    model = (places, np.array([weights[p] for p in places.tolist()]), np.array([0.5, 1.0, 3.0]))
    texts = ["so DUMM, dumm", "idioten dumm!", "nichts", None, "", "dumme idiotenhaft"]
    for r in toxicity.score(table(spark, texts), model, cfg).collect():
        known = {w.lower() for w in words[:2]} & set(split(ALNUM, texts[r["doc_id"]]))
        z = sum(weights[of_word[w]] for w in known)
        p = [1 / (1 + math.exp(t - z)) for t in (0.5, 1.0, 3.0)] if split(ALNUM, texts[r["doc_id"]]) else [0.0] * 3
        assert r["severity"] == pytest.approx(sum(p)) and r["p_toxic"] == pytest.approx(p[0]) and r["grade"] == sum(x >= 0.5 for x in p) and r["rejected"] == (p[0] >= 0.5)


def test_ordinal_fit_lessens_the_loss_to_its_least():
    """On one feature the fit agrees with a grid search over weight and thresholds."""
    import numpy as np

    toxic, row = np.array([0, 0, 0, 1, 1, 1, 0, 1]), np.array([3, 4, 5, 0])
    grade = np.array([0, 0, 0, 1, 2, 2, 0, 1])
    x = toxicity.Rows(toxic, row, np.zeros(4, dtype=int), np.array([7]), np.zeros(1))
    w, theta = toxicity.fit_ordinal(x, grade, toxicity.Ordinal(grades=2, steps=4000, l1=0), np.zeros(1), np.zeros(2))

    def loss(w, t):
        z = np.where(np.isin(np.arange(8), row), w, 0.0)
        p = np.stack([1 / (1 + np.exp(t[j] - z)) for j in (0, 1)])
        y = np.stack([grade >= 1, grade >= 2])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    best = min(loss(a, (b, c)) for a in np.arange(0, 6, 0.1) for b in np.arange(-3, 5, 0.1) for c in np.arange(-3, 6, 0.1) if b <= c)
    assert loss(w[0], theta) <= best + 1e-2


def test_training_rows_are_one_an_id(spark):
    docs = table(spark, ["a", "b", "c", None, "d"], [1, 1, 2, 3, None])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1), (4, 1)], "doc_id long, quality int")
    rows = features.labelled(docs, labels, "quality", 10, 1).collect()
    again = features.labelled(docs.repartition(3), labels, "quality", 10, 1).collect()
    assert sorted((r["id"], r["label"], bytes(r["text"])) for r in rows) == sorted((r["id"], r["label"], bytes(r["text"])) for r in again)
    assert sorted((r["id"], r["label"]) for r in rows) == [(1, 1), (2, 0)] and features.labelled(docs, labels, "quality", 1, 1).count() <= 1


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.95 and sum(r["predicted"] == r["quality"] for r in scored) / len(scored) > 0.93


@pytest.mark.parametrize("score, train", [(quality.score, quality.train), (toxicity.score, toxicity.train)])
def test_scores_of_odd_texts_and_tables(spark, score, train):
    docs = table(spark, ODD, [*range(len(ODD) - 1), None])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(1, 0, 0), (None, 1, 1), (99, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = train(docs, labels)
    rows = score(docs, model).collect()
    assert len(rows) == len(ODD)
    value = {r["doc_id"]: r[2] for r in rows}
    assert value[6] == value[7] and all(v == v for v in value.values())
    assert score(docs.limit(0), model).count() == 0
    train(docs, labels.limit(0))
    train(docs.limit(0), labels)


def test_held_out_is_the_crc_of_the_id(spark):
    rows = spark.range(200).select("id", quality.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_toxicity_separates_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    fit = labels.filter("doc_id % 4 <> 0")
    model = toxicity.train(docs, fit)
    assert (model[2][:-1] <= model[2][1:]).all()
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert not [r for r in rows if r["doc_id"] % 4 and r["rejected"] and not r["toxic"]]
    assert sum(r["rejected"] != (r["toxic"] == 1) for r in rows) <= 0.02 * len(rows)
    assert toxicity.keep_clean(docs, model).columns == docs.columns


# 6 Near duplicates
def brute_components(texts, ids, words, percent):
    def shingles(t):
        w = split(NONSPACE, t)
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i in range(len(texts)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [(ids[i], len(sets[i]), least.get(find(i)) if sets[i] else ids[i]) for i in range(len(texts))]


def families(rng):
    """Chains and stars of edited texts: some links hold only through a third text."""
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(2, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9000)}"
            texts.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    return texts


@pytest.mark.parametrize("seed, cfg", [(1, dedup.NearDup(3, 85, 5)), (2, dedup.NearDup()), (3, dedup.NearDup(3, 85, 5))])
def test_components_match_brute_force(spark, seed, cfg):
    rng = random.Random(seed)
    texts = families(rng) + [t for t in ODD if t is None or len(t) < 1000]
    ids = [i if i % 17 else None for i in range(len(texts))]
    rng.shuffle(texts)
    out = dedup.groups(table(spark, texts, ids), cfg)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=repr)
    assert found == sorted(brute_components(texts, ids, cfg.words, cfg.percent), key=repr)


def test_prefix_filter_loses_no_pair(spark):
    rng = random.Random(4)
    base = [rng.randrange(10**9) for _ in range(100)]
    sets = [sorted({*rng.sample(base, rng.randrange(80, 100)), *(rng.randrange(10**9) for _ in range(rng.randrange(0, 12)))}) for _ in range(40)]
    import numpy as np

    cfg = dedup.NearDup(3, 85, 5)
    rows = spark.createDataFrame([(i, i, np.array(s, dtype=np.int64).tobytes()) for i, s in enumerate(sets)], "node long, root long, found binary")
    a, b = dedup._multipliers(cfg)
    signatures = spark.createDataFrame([(i, dedup.pack(dedup.minima(np.array(s, dtype=np.uint64), a, b), 4).tolist()) for i, s in enumerate(sets)], "node long, sig array<long>")
    wanted = {(a, b) for a, b in itertools.combinations(range(40), 2) if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})}
    for hot, block in ((1 << 16, 1 << 24), (0, 1 << 24), (0, 16)):  # plain, by signatures, and dealt in squares
        assert wanted and wanted <= {(r["a"], r["b"]) for r in dedup._prefix_pairs(rows, signatures, cfg, hot, block).collect()}


def template_family(n, common, slots, seed=1):
    rng = random.Random(seed)
    return [" ".join([f"c{j}" for j in range(common)] + [f"s{j}v{rng.randrange(2)}" for j in range(slots)]) for _ in range(n)]


def test_families_near_the_threshold_are_not_compared_in_all_pairs(spark, monkeypatch):
    """Texts of one template, about 0.78 alike: few pairs are links, and few are looked at."""
    written = []
    plain = dedup._prefix_pairs
    monkeypatch.setattr(dedup, "_prefix_pairs", lambda *args: written.append(dedup.settle(plain(*args))) or written[-1])
    texts = template_family(300, 60, 14)
    cfg = dedup.NearDup(1, 85, 5)
    found = {r["doc_id"]: r["component_id"] for r in dedup.groups(table(spark, texts), cfg).collect()}
    assert found == {i: c for i, _, c in brute_components(texts, range(300), 1, 85)}
    assert written[0].count() < 20 * 300


def test_long_texts_join_components(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(9000)}" for _ in range(60000)]
    other = list(base)
    for i in range(0, 60000, 100):
        other[i] = "new"
    texts = [" ".join(base), " ".join(other), " ".join(base[:30000]), "x" * 300000, "x" * 300000, "long " * 40000, "long " * 50000]
    rows = dedup.groups(table(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == brute_components(texts, list(range(len(texts))), 5, 80)


def test_repeated_rows_change_no_component(spark):
    rng = random.Random(11)
    texts = families(rng)
    docs = table(spark, texts)
    again = {(r["doc_id"], r["component_id"]) for r in dedup.groups(docs.union(docs).union(docs)).collect()}
    assert again == {(r["doc_id"], r["component_id"]) for r in dedup.groups(docs).collect()}


def test_one_row_of_each_group_stays(spark):
    texts = ["a b c d e f g h i j"] * 3 + [None, None, "", "other words stand here now and then"] + ["a b c d e f g h i j"]
    docs = table(spark, texts, [5, 3, 3, 7, 7, 8, 9, None])
    kept = dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [3, 7, 7, 8, 9]
    assert dedup.keep_first(docs.limit(0)).count() == 0 and dedup.groups(docs.limit(0)).count() == 0


# 7 Mixing
def test_raking_meets_its_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cfg = mixing.Mix()
    rows = mixing.mix(docs, cfg).collect()
    total = sum(r["tokens"] for r in rows)
    for dim in mixing.DIMS:
        have, weighted = {}, {}
        for r in rows:
            have[r[dim]] = have.get(r[dim], 0) + r["tokens"]
            weighted[r[dim]] = weighted.get(r[dim], 0) + r["tokens"] * (r["weight"] or 0)
        powers = {k: v**cfg.temper for k, v in have.items()}
        for k in have:
            assert weighted[k] / total == pytest.approx(powers[k] / sum(powers.values()), rel=1e-2)
    assert sum(r["tokens"] * r["probability"] for r in rows) == pytest.approx(cfg.budget * total, rel=1e-3)
    assert 0.5 < sum(r["sampled"] for r in rows) / len(rows) < 1


def cell_docs(spark, cells):
    """A document a cell, of so many words."""
    return spark.createDataFrame([(i, "w " * n, *c) for i, (c, n) in enumerate(cells.items())], "doc_id long, text string, source string, lang string, topic string")


def test_correlated_dimensions_meet_their_marginals(spark):
    """Twenty sources, each almost wholly in one language and topic, one of them hot."""
    rng = random.Random(5)
    cells = {(f"s{i}", f"l{l}", f"t{t}"): 1 + round((400 if i == 0 else 40) * (97 if (l, t) == (i % 4, i % 5) else rng.random())) for i in range(20) for l in range(4) for t in range(5)}
    cfg = mixing.Mix()
    rows = mixing.mix(cell_docs(spark, cells), cfg, topic_col="topic").collect()
    total = sum(r["tokens"] for r in rows)
    for dim in mixing.DIMS:
        have, weighted = {}, {}
        for r in rows:
            have[r[dim]] = have.get(r[dim], 0) + r["tokens"]
            weighted[r[dim]] = weighted.get(r[dim], 0) + r["tokens"] * r["weight"]
        powers = {k: v**cfg.temper for k, v in have.items()}
        assert all(weighted[k] / total == pytest.approx(powers[k] / sum(powers.values()), rel=1e-3) for k in have)


def test_drawn_shares_meet_what_can_be_met(spark):
    cfg, rng = mixing.Mix(), random.Random(6)
    parts = {"s": [3, 1, 1, 1, 1, 1], "l": [60, 15, 15, 9], "t": [73, 18, 4, 4, 1]}
    cells = {(f"s{i}", f"l{j}", f"t{k}"): 1 + round(a * b * c * (0.9 + 0.2 * rng.random())) for i, a in enumerate(parts["s"]) for j, b in enumerate(parts["l"]) for k, c in enumerate(parts["t"])}
    rows = mixing.mix(cell_docs(spark, cells), cfg, topic_col="topic").collect()
    budget = cfg.budget * sum(r["tokens"] for r in rows)
    for dim in mixing.DIMS:
        have, drawn = {}, {}
        for r in rows:
            have[r[dim]] = have.get(r[dim], 0) + r["tokens"]
            drawn[r[dim]] = drawn.get(r[dim], 0) + r["tokens"] * r["probability"]
        wanted, free = {}, {k: v**cfg.temper for k, v in have.items()}
        while True:  # what a value has too few tokens for goes to the others
            part = {k: p / sum(free.values()) * (budget - sum(wanted.values())) for k, p in free.items()}
            short = [k for k in part if part[k] > have[k]]
            if not short:
                break
            for k in short:
                wanted[k] = have[k]
                del free[k]
        assert drawn == pytest.approx(wanted | part, rel=1e-3)


def test_raking_by_spark_agrees_with_arrays(spark):
    found = spark.createDataFrame([("a", "x", "p", 900), ("a", "y", "q", 60), ("b", "x", "q", 80), ("b", "y", "p", 70), (None, "y", "p", 40)], "source string, lang string, topic string, tokens long")
    (small, one), (large, two) = mixing.fitted(found, mixing.Mix(sweeps=2)), mixing.fitted(found, mixing.Mix(sweeps=2, broadcast_cells=0))
    key = lambda df: {r[:3]: r[3:] for r in df.select(*mixing.DIMS, "factor", "probability").collect()}
    a, b = key(small), key(large)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6) for k in a) and one == pytest.approx(two, rel=1e-3, abs=1e-6)


def brute_factors(cells, targets, sweeps=4000):
    """Iterative proportional fitting by its definition, on a dict of cells."""
    held = {k: float(n) for k, n in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            have = {}
            for k, x in held.items():
                have[k[d]] = have.get(k[d], 0.0) + x
            held = {k: x * targets[d][k[d]] / have[k[d]] for k, x in held.items()}
    return {k: held[k] / cells[k] for k in cells}


def test_weights_match_brute_force_and_given_targets(spark):
    rng = random.Random(8)
    cells = {(s, l, t): rng.randrange(5, 400) for s in ("a", "b", "c") for l in ("x", "y") for t in ("p", "q")}
    total = sum(cells.values())
    shares = [{"a": 0.2, "b": 0.3, "c": 0.5}, {"x": 0.6, "y": 0.4}, {"p": 0.1, "q": 0.9}]
    given = {dim: spark.createDataFrame([*(of.items()), ("none", 0.5)] if dim == "source" else list(of.items()), "value string, share double") for dim, of in zip(mixing.DIMS, shares)}
    want = brute_factors(cells, [{k: v * total for k, v in of.items()} for of in shares])
    for cfg in (mixing.Mix(strict=True, budget=0.05), mixing.Mix(budget=0.05, broadcast_cells=0, tolerance=1e-4)):
        rows = mixing.mix(cell_docs(spark, cells), cfg, topic_col="topic", targets=given).collect()
        assert {(r["source"], r["lang"], r["topic"]): r["weight"] for r in rows} == pytest.approx(want, rel=1e-3 if not cfg.strict else 1e-5)
    drawn = {}
    for r in rows:
        drawn[r["source"]] = drawn.get(r["source"], 0) + r["tokens"] * r["probability"] / total / 0.05
    assert drawn == pytest.approx(shares[0], rel=1e-3)


def test_a_value_without_a_target_is_not_drawn(spark):
    docs = cell_docs(spark, {("a", "x", "p"): 50, ("b", "x", "p"): 70, (None, "x", "p"): 30})
    given = {"source": spark.createDataFrame([("a", 1.0), (None, 1.0)], "value string, share double")}
    rows = {r["source"]: r for r in mixing.mix(docs, mixing.Mix(budget=0.2), topic_col="topic", targets=given).collect()}
    assert rows["b"]["weight"] < 1e-9 and rows["a"]["weight"] * 50 == pytest.approx(rows[None]["weight"] * 30, rel=1e-5)


def test_targets_that_cannot_be_met_stand_in_the_rows(spark):
    given = {"source": spark.createDataFrame([("a", 0.9), ("b", 0.1)], "value string, share double"), "lang": spark.createDataFrame([("x", 0.1), ("y", 0.9)], "value string, share double")}
    cells = {("a", "x", "t"): 1000, ("b", "y", "t"): 1000}
    rows = mixing.mix(cell_docs(spark, cells), topic_col="topic", targets=given).collect()
    assert {r["weight_error"] > 0.1 for r in rows} == {True} and len({r["weight_error"] for r in rows}) == 1
    grid = {(s, x, "t"): 1000 for s in "ab" for x in "xy"}
    met = mixing.mix(cell_docs(spark, grid), topic_col="topic", targets=given).first()
    assert met["weight_error"] <= 2e-6


def test_mixing_keeps_columns_of_any_name(spark):
    docs = table(spark, ["some words"] * 5).withColumnRenamed("shard", "__source").withColumnRenamed("kept", "tokens").withColumnRenamed("slot", "row")
    assert {(r["__source"], r["tokens"], r["row"]) for r in mixing.keep_drawn(docs, mixing.Mix(budget=1.0)).collect()} == {("clash", "clash", "clash")}


def test_mixing_odd_rows(spark):
    docs = table(spark, ODD, [*range(len(ODD) - 1), None])
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert len(rows) == len(ODD) and all(rows[i]["sampled"] for i in (0, 1, 2))
    kept = mixing.keep_drawn(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["sampled"] for r in rows.values())
    assert mixing.mix(docs.limit(0)).count() == 0


# 8 Sharding
@pytest.mark.parametrize("n, size", [(0, 64), (1, 64), (23, 64), (500, 4096), (500, 1 << 30)])
def test_shards_are_even_and_gapless(spark, n, size):
    docs = table(spark, [f"text {i}" * (i % 7) if i % 9 else None for i in range(n)], [i if i % 11 else None for i in range(n)])
    rows = sharding.plan(docs, bucket_bytes=size).collect()
    assert len(rows) == n
    by = {}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 24
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    if n == 500:
        again = sharding.plan(docs.repartition(7), bucket_bytes=size).collect()
        key = lambda r: (repr(r["doc_id"]), r["text_crc32"], r["shard"], r["slot"])
        assert sorted(map(key, rows)) == sorted(map(key, again))


def test_shard_sizes_and_checksums(spark):
    rows = {r["doc_id"]: r for r in sharding.plan(table(spark, ODD)).collect()}
    for i, t in enumerate(ODD):
        raw = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    dealt = sharding.deal(table(spark, ODD))
    assert dealt.count() == len(ODD) and dict(dealt.dtypes)["shard"] == "int"
    assert sharding.deal(table(spark, ODD).limit(0)).count() == 0


def test_plan_says_where_deal_puts(spark):
    docs = table(spark, [f"text {i % 97}" for i in range(480)], [i % 60 if i % 7 else None for i in range(480)])
    docs = docs.union(docs.limit(50))
    places = lambda df: sorted(((r["doc_id"], r["shard"], r["slot"]) for r in df.collect()), key=repr)
    for size in (256, 1 << 20):
        planned, dealt = places(sharding.plan(docs, bucket_bytes=size)), sharding.deal(docs.repartition(5), bucket_bytes=size)
        assert len({x[1:] for x in planned}) == 530 and planned == places(dealt)
    assert set(dealt.columns) == {*docs.columns, "input_shard", "input_slot"}
    assert {(r["input_shard"], r["input_slot"], r["score"]) for r in dealt.collect()} == {("clash", "clash", "clash")}


def test_equal_records_fill_buckets_evenly(spark):
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    placed = sharding._places(sharding._keyed(rows, F.struct("doc_id"), "text"), 24, 17, 64)
    sizes = [r["count"] for r in placed.groupBy("bucket").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) > 400 and max(sizes) < 30


def test_swaps_are_a_permutation_that_is_not_sorted(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one = sharding._places(sharding._keyed(rows, F.struct("doc_id"), "text"), 24, 17, 1 << 30)
    assert sorted(r["place"] for r in one.collect()) == list(range(2000))
    other = sharding._places(sharding._keyed(rows, F.struct("doc_id"), "text"), 24, 18, 1 << 30)
    key = lambda df: {r["row"]["doc_id"]: r["place"] for r in df.collect()}
    a, b = key(one), key(other)
    assert sum(a[i] == b[i] for i in a) < 20


def test_no_setting_changes_a_place(spark):
    rows = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 40).alias("text"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("5", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found += [sorted((r["doc_id"], r["shard"], r["slot"]) for r in make(rows, bucket_bytes=4096).collect()) for make in (sharding.plan, sharding.deal)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] == found[3]


def test_order_in_buckets_is_mixed(spark):
    rows = sharding.plan(spark.range(2400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).filter("shard = 0").orderBy("slot").collect()
    ids = [r["doc_id"] for r in rows]
    rising = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 30 < rising < 70


# 9 Decontamination
def brute_hits(texts, items, window=10):
    benches = [(str(i) if i is not None else "", split(ALNUM, t)) for i, t in items]
    out = []
    for text in texts:
        w = split(ALNUM, text)
        hit, names = set(), set()
        for name, b in benches:
            n = min(window, len(b))
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in grams:
                    hit |= {*range(i, i + n)}
                    names.add(name)
        out.append((len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("seed, block", [(1, 1 << 20), (2, 60), (3, 1 << 20)])
def test_hits_match_brute_force(spark, seed, block):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd e f g".split() if rng.random() < 0.7 else [f"w{rng.randrange(40)}"])
    items = [(i if i else None, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(12)] + [(3, None), (4, "a b")]
    texts = [t for t in ODD if not t or len(t) < 1000]
    for _ in range(40):
        w = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            cut = items[rng.randrange(12)][1].split()
            w[rng.randrange(len(w) + 1) : 0] = cut[: rng.randrange(len(cut) + 1)] if rng.random() < 0.5 else cut
        texts.append(" ".join(w).upper() if rng.random() < 0.3 else "-".join(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, texts)
    out = decontam.report(decontam.scan(docs, bench, block_bytes=block))
    rows = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    wanted = brute_hits(texts, items)
    assert rows == dict(enumerate(wanted))
    joined = decontam.report(decontam.scan(docs, bench, joined_from=-1))
    assert {r["doc_id"]: tuple(r)[1:] for r in joined.collect()} == rows
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench, joined_from=-1).collect()) == [i for i, x in enumerate(wanted) if not x[4]]
    clean = decontam.clean(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [i for i, x in enumerate(wanted) if not x[4]]


def test_long_and_repeated_words_match_brute_force(spark):
    rng = random.Random(12)
    items = [(1, "a " * 2000), (2, "b c " * 300), (3, " ".join(f"w{rng.randrange(30)}" for _ in range(400)))]
    texts = ["a " * 50000, "b c " * 9000 + "a " * 9, " ".join(f"w{rng.randrange(30)}" for _ in range(20000)) + " " + items[2][1], "x" * 300000 + " " + "a " * 12]
    bench = spark.createDataFrame(items, "item_id long, text string")
    began = time.perf_counter()
    rows = {r["doc_id"]: tuple(r)[1:] for r in decontam.report(decontam.scan(table(spark, texts), bench)).collect()}
    assert time.perf_counter() - began < 20 and rows == dict(enumerate(brute_hits(texts, items)))


def test_empty_tables_of_decontamination(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = table(spark, ["a b"])
    assert decontam.report(decontam.scan(docs, bench.limit(0))).first()["n_words"] == 2
    assert decontam.report(decontam.scan(docs.limit(0), bench)).count() == 0


# Queries
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), database(sf_dir), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLES.keys()))
def test_queries_return_every_row(spark, sf_dir, name):
    source = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()


def test_statistics_have_their_names():
    assert len(features.structure(b"a b")) == len(features.STATS) == len(features.structure(None))
