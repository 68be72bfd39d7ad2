"""Queries against their SQL over a few odd texts that the test tables do not hold."""

import duckdb
import numpy as np
import pytest

from tests.compare import database, same
from tests.test_queries import ORACLES, QUERIES
from textloom.operators import slots

#: Without a letter that is looked for, of one word, and 40 words of 41 letters, whose mean is 1.025.
TEXTS = ("É.", "É é.", "12.", "A.", "Re.", "", " ", " ".join(["a"] * 39 + ["ab"]), "Fazit", "De la. Und so.\n\nÉ", "x " * 30)


def cancels() -> str:
    """A word that takes the place of the embedder's prefix with the other sign."""
    model = slots.hashed_embedder(16)
    head = model(["passage:"])[0]
    return next(w for w in map("w{}".format, range(9999)) if np.allclose(model([w])[0], -head))


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    texts = [*TEXTS, cancels(), None]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?, ?)", [(i, x, "de", f"s{i % 2}", len(x or "")) for i, x in enumerate(texts)])
    con.execute(f"COPY d TO '{at}/documents.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", ["A39_dissect_runs", "B17_render_run", "B18_render_style", "E24_morphological_complexity", "E25_bigrams", "E25_trigrams", "E30_top_content_words", "E30_top_function_words", "J43_section", "J44_core_hypothesis", "J46_beweisfuehrung", "J47_freier_raum", "J48_hypothese", "K08_vowel_echoes", "L04_embed_batches", "R37_run_meta"])
def test_against_sql(spark, odd_dir, name):
    same(QUERIES[name](spark, odd_dir), database(odd_dir), ORACLES[name])
