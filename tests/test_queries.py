"""Every query of the library runs, and agrees with its SQL where there is some."""

import hashlib

import pytest

from tests.compare import database, same
from textloom.functions import scripts
from textloom.plans import all_books

QUERIES = {name: make for book in all_books() for name, make in book.queries.items()}
ORACLES = {name: sql for book in all_books() for name, sql in book.oracles.items()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), database(sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names_are_unique_and_oracles_belong_to_queries():
    assert ORACLES.keys() <= QUERIES.keys()


def test_script_and_chat_queries_read_whole_texts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").collect()}
    for name, column, make in (("J17_normalize_greek", "forms", lambda x: " ".join(map(scripts.greek_form, x.split()))), ("J20_tokenize_greek", "words", scripts.greek_words), ("J22_tokenize_hebrew", "words", scripts.hebrew_words), ("J24_strip_cantillation", "word", scripts.hebrew_word)):
        rows = {r["doc_id"]: r[column] for r in QUERIES[name](spark, sf_dir).collect()}
        assert rows.keys() == texts.keys()
        for i, x in texts.items():
            assert rows[i][: len(make(x))] == make(x) and (len(rows[i]) == len(make(x))) == (i % 3 == 2)
    last = {}
    for r in QUERIES["A20_markdown_note"](spark, sf_dir).collect():
        last[r["doc_id"]] = max(last.get(r["doc_id"], (-1, "")), (r["pos"], r["content_md5"]))
    plain = [i for i, x in texts.items() if i % 2 == 0 and "\n" not in x and len(x) > 50 and x == x.strip() and ":" not in x]
    assert plain and all(last[i][1] == hashlib.md5(texts[i].encode()).hexdigest() for i in plain)
