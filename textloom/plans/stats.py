"""Text statistics over ``documents``: one row a text, or one row a text and item."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions import lexicon as lx
from textloom.functions import scripts
from textloom.functions import text as T
from textloom.plans.book import Book, Tables

book = Book()
SLICE = 64  # texts that a Python step holds the results of
ABBR = "|".join(a.replace(".", "\\.") for a in lx.ABBREVIATIONS)
WS = "[ \\t\\n\\x0B\\f\\r]"
SQL_WORDS = f"regexp_extract_all(lower(text), '[{lx.LETTERS}]+(?:-[{lx.LETTERS}]+)*')"


def sql_words(of: str) -> str:
    return SQL_WORDS.replace("text", of)


def sql_strip(of: str) -> str:
    return f"regexp_replace({of}, '^{WS}+|{WS}+$', '', 'g')"


SQL_SENTENCES = (
    f"list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace(text, '({ABBR}|[0-9]+)\\.', '\\1' || chr(57344), 'g'), "
    f"'([.!?]){WS}+([A-ZÄÖÜА-ЯЁ«»\"''])', '\\1' || chr(57345) || '\\2', 'g'), chr(57344), '.'), chr(57345)), lambda s: {sql_strip('s')}), lambda s: length(s) > 3)"
)
SQL_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')"
WITH = f"WITH d AS (SELECT doc_id, text, {SQL_WORDS} AS w, {SQL_SENTENCES} AS s, {SQL_LINES} AS l FROM documents WHERE text IS NOT NULL)\n"
FUNCTION_WORDS = ", ".join(f"'{w}'" for w in dict.fromkeys(lx.DE_FUNCTION_WORDS + lx.RU_FUNCTION_WORDS))


def base(t: Tables, *columns: str) -> DataFrame:
    """doc_id, text and the asked arrays: w (words), s (sentences), l (lines)."""
    made = {"w": T.words(F.col("text")), "s": T.sentences(F.col("text")), "l": T.lines(F.col("text"))}
    return t.documents.filter("text is not null").select("doc_id", "text", *(made[c].alias(c) for c in columns))


def r6(c: Column) -> Column:
    return T.rounded(c, 6)


@book.query("J18_tokenize", WITH + "SELECT doc_id, len(w)::BIGINT AS n_words, w[1] AS first_word, w[-1] AS last_word, md5(array_to_string(w, ' ')) AS words_md5 FROM d")
def tokenize(t):
    w = F.col("w")
    return base(t, "w").select("doc_id", F.size(w).cast("long").alias("n_words"), F.try_element_at(w, F.lit(1)).alias("first_word"), F.try_element_at(w, F.lit(-1)).alias("last_word"), F.md5(F.array_join(w, " ")).alias("words_md5"))


@book.query("J19_split_sentences", WITH + "SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM d")
def split_sentences(t):
    return base(t, "s").select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@book.query("J25_classify_words", WITH + f"SELECT doc_id, len(list_filter(w, lambda x: x NOT IN ({FUNCTION_WORDS})))::BIGINT AS n_content, len(list_filter(w, lambda x: x IN ({FUNCTION_WORDS})))::BIGINT AS n_function FROM d")
def classify_words(t):
    return base(t, "w").select("doc_id", F.size(F.filter("w", lambda x: ~T.is_function_word(x))).cast("long").alias("n_content"), F.size(F.filter("w", T.is_function_word)).cast("long").alias("n_function"))


@book.query("E22_type_token_ratio", WITH + "SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(len(list_distinct(w)) / len(w)::DOUBLE, 6) END::DOUBLE AS ttr FROM d")
def type_token_ratio(t):
    return base(t, "w").select("doc_id", r6(T.type_token_ratio(F.col("w"))).alias("ttr"))


@book.query(
    "E23_standardized_ttr",
    WITH + "SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 WHEN len(w) < 100 THEN len(list_distinct(w)) / len(w)::DOUBLE ELSE list_avg(list_transform(range(0, len(w) // 100), lambda i: len(list_distinct(w[i * 100 + 1:i * 100 + 100])) / 100.0::DOUBLE)) END::DOUBLE, 6) AS sttr FROM d",
)
def standardized_ttr(t):
    return base(t, "w").select("doc_id", r6(T.standardized_ttr(F.col("w"))).alias("sttr"))


@book.query(
    "E24_morphological_complexity",
    WITH + "SELECT doc_id, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(length(array_to_string(w, '')) / len(w)::DOUBLE + len(list_filter(w, lambda x: length(x) > 10)) / len(w)::DOUBLE * 3, 2) END::DOUBLE AS complexity FROM d",
)
def morphological_complexity(t):
    return base(t, "w").select("doc_id", T.morphological_complexity(F.col("w")).cast("double").alias("complexity"))


@book.query(
    "E28_punctuation",
    "SELECT doc_id, " + ", ".join(f"({' + '.join(f'''(length(text) - length(replace(text, '{m}', ''))) // {len(m)}''' for m in marks)})::BIGINT AS n_{name}" for name, marks in T.PUNCTUATION.items()) + " FROM documents WHERE text IS NOT NULL",
)
def punctuation(t):
    return base(t).select("doc_id", *(T.occurrences(F.col("text"), *marks).cast("long").alias(f"n_{name}") for name, marks in T.PUNCTUATION.items()))


SENT_LEN = f"list_transform(s, lambda x: len({sql_words('x')}))"


@book.query("E29_sentence_lengths", WITH + f"SELECT doc_id, round(list_avg(n), 1)::DOUBLE AS avg_length, list_sort(n)[len(n) // 2 + 1]::BIGINT AS median_length, list_max(n)::BIGINT AS max_length, list_min(n)::BIGINT AS min_length FROM (SELECT doc_id, CASE WHEN len(s) = 0 THEN [0] ELSE {SENT_LEN} END AS n FROM d)")
def sentence_lengths(t):
    n = F.when(F.size("s") == 0, F.array(F.lit(0))).otherwise(F.transform("s", lambda x: F.size(T.words(x))))
    d = base(t, "s").select("doc_id", n.alias("n"))
    n = F.col("n")
    return d.select("doc_id", T.rounded(T.mean(n), 1).alias("avg_length"), F.element_at(F.array_sort(n), (F.floor(F.size(n) / 2) + 1).cast("int")).cast("long").alias("median_length"), F.array_max(n).cast("long").alias("max_length"), F.array_min(n).cast("long").alias("min_length"))


STARTERS = "[" + ", ".join(f"'{w}'" for w in lx.CLAUSE_STARTERS) + "]"
PHRASES = "|".join(p.replace(" ", WS + "+") for p in lx.CLAUSE_PHRASES)
SQL_CLAUSE = f"""SELECT doc_id, x, CASE WHEN list_contains({STARTERS}, b[1]) THEN 'NS' WHEN regexp_matches(lower(x), '{PHRASES}') OR list_has_any(b, {STARTERS}) THEN 'gemischt' ELSE 'HS' END AS kind
FROM (SELECT doc_id, x, list_transform(list_filter(regexp_split_to_array(x, '{WS}+'), lambda y: y <> ''), lambda y: lower(translate(y, ',.;:!?("«»—–-…', ''))) AS b FROM (SELECT doc_id, unnest(s) AS x FROM d))"""


@book.query("J31_clause_type", WITH + f"SELECT kind, count(*)::BIGINT AS n FROM ({SQL_CLAUSE}) GROUP BY kind")
def clause_type(t):
    return base(t, "s").select(F.explode("s").alias("x")).select(T.clause_type(F.col("x")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@book.query("E21_sentence_types", WITH + f"SELECT d.doc_id, count(x) FILTER (kind = 'HS')::BIGINT AS hs, count(x) FILTER (kind = 'NS')::BIGINT AS ns, count(x) FILTER (kind = 'gemischt')::BIGINT AS mixed FROM d LEFT JOIN ({SQL_CLAUSE}) c USING (doc_id) GROUP BY d.doc_id")
def sentence_types(t):
    d = base(t, "s").select("doc_id", F.transform("s", T.clause_type).alias("k"))
    return d.groupBy("doc_id").agg(*(F.sum(F.size("k") - F.size(F.array_remove("k", k))).cast("long").alias(n) for n, k in (("hs", "HS"), ("ns", "NS"), ("mixed", "gemischt"))))


def folded(rows: DataFrame, fn: Callable[[Any], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows (doc_id, x) to the rows that a Python function finds in x. All figures are of one text, so a text is folded where it lies."""
    fields = S.StructType.fromDDL(f"doc_id long, {schema}")
    target = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = [(i, *x) for i, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in fn(value)]
                cols = list(zip(*out, strict=True)) or [[]] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return rows.mapInArrow(run, fields)


def most(counted: Iterable[tuple[Any, int]], k: int) -> list[tuple[Any, int]]:
    """The ``k`` highest counts, equal ones in their order."""
    return sorted(counted, key=lambda x: -x[1])[:k]


def top_grams(t: Tables, n: int) -> DataFrame:
    """The commonest runs of words of a text, equal counts in the order they first stand."""

    def run(lowered: str) -> Iterator[tuple]:
        words = T.PLAIN_WORD.findall(lowered)
        times = Counter(zip(*(words[i:] for i in range(n)), strict=False))
        for rank, (gram, k) in enumerate(most((x for x in times.items() if x[1] >= 2), 20), 1):
            yield " ".join(gram), k, rank

    return folded(base(t).select("doc_id", F.lower("text")), run, "gram string, n long, rank long")


def sql_grams(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return WITH + f"""SELECT doc_id, gram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM (
  SELECT doc_id, gram, count(*)::BIGINT AS n, min(i) AS pos FROM (SELECT doc_id, i, {gram} AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d)) GROUP BY doc_id, gram)) WHERE rank <= 20 AND n >= 2"""


book.query("E25_bigrams", sql_grams(2))(lambda t: top_grams(t, 2))
book.query("E25_trigrams", sql_grams(3))(lambda t: top_grams(t, 3))


@book.query(
    "E26_paragraphs",
    f"""WITH p AS (SELECT doc_id, text, list_transform(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> ''), lambda s: length(s)) AS n FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, CASE WHEN len(n) = 0 THEN [length(text)] ELSE n END AS n FROM p)
SELECT doc_id, len(n)::BIGINT AS n_paragraphs, round(list_avg(n), 1)::DOUBLE AS avg_chars, list_min(n)::BIGINT AS min_chars, list_max(n)::BIGINT AS max_chars, round(coalesce(list_stddev_pop(n), 0), 1)::DOUBLE AS length_stdev FROM q""",
)
def paragraph_stats(t):
    n = F.transform(T.paragraphs(F.col("text")), F.length)
    d = base(t).select("doc_id", F.when(F.size(n) == 0, F.array(F.length("text"))).otherwise(n).alias("n"))
    n = F.col("n")
    return d.select("doc_id", F.size(n).cast("long").alias("n_paragraphs"), T.rounded(T.mean(n), 1).alias("avg_chars"), F.array_min(n).cast("long").alias("min_chars"), F.array_max(n).cast("long").alias("max_chars"), T.rounded(T.deviation(n), 1).alias("length_stdev"))


VERSE = f"list_filter({SQL_LINES}, lambda s: NOT regexp_matches(s, '^[0-9]{{1,4}}[a-z]?$'))"


@book.query(
    "E27_verse_structure",
    f"""WITH v AS (SELECT doc_id, list_transform({VERSE}, lambda s: len(list_filter(regexp_split_to_array(s, '{WS}+'), lambda x: x <> ''))) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, len(n) AS k, CASE WHEN len(n) < 2 THEN 0 ELSE list_avg(n) END AS a, CASE WHEN len(n) < 2 THEN 0 ELSE list_stddev_pop(n) END AS s FROM v)
SELECT doc_id, k::BIGINT AS line_count, round(a, 1)::DOUBLE AS avg_words_per_line, round(s, 1)::DOUBLE AS stdev_words_per_line,
CASE WHEN k < 2 THEN 'kein' WHEN a < 12 AND s < 3 THEN 'stark' WHEN a < 12 OR s < 3 THEN 'mittel' ELSE 'kein' END AS signal_strength FROM m""",
)
def verse_structure(t):
    d = base(t).select("doc_id", F.transform(T.verse_lines(F.col("text")), lambda s: F.size(T.fields(s))).alias("n"))
    n = F.col("n")
    d = d.select("doc_id", F.size(n).alias("k"), F.when(F.size(n) < 2, F.lit(0.0)).otherwise(T.mean(n)).alias("a"), F.when(F.size(n) < 2, F.lit(0.0)).otherwise(T.deviation(n)).alias("s"))
    few, even = F.col("a") < 12, F.col("s") < 3
    signal = F.when(F.col("k") < 2, "kein").when(few & even, "stark").when(few | even, "mittel").otherwise("kein")
    return d.select("doc_id", F.col("k").cast("long").alias("line_count"), T.rounded(F.col("a"), 1).alias("avg_words_per_line"), T.rounded(F.col("s"), 1).alias("stdev_words_per_line"), signal.alias("signal_strength"))


def top_words(t: Tables, function: bool, k: int) -> DataFrame:
    """The commonest content or function words of a text, equal counts in the order they first stand."""
    known = frozenset(lx.DE_FUNCTION_WORDS + lx.RU_FUNCTION_WORDS)

    def run(lowered: str) -> Iterator[tuple]:
        times = Counter(T.PLAIN_WORD.findall(lowered))
        for rank, (word, n) in enumerate(most((x for x in times.items() if (x[0] in known) == function), k), 1):
            yield word, n, rank

    return folded(base(t).select("doc_id", F.lower("text")), run, "word string, n long, rank long")


def sql_top_words(negate: str, k: int) -> str:
    return WITH + f"""SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM (
  SELECT doc_id, word, count(*)::BIGINT AS n, min(i) AS pos FROM (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)) WHERE word {negate} IN ({FUNCTION_WORDS}) GROUP BY doc_id, word)) WHERE rank <= {k}"""


book.query("E30_top_content_words", sql_top_words("NOT", 10))(lambda t: top_words(t, False, 10))
book.query("E30_top_function_words", sql_top_words("", 5))(lambda t: top_words(t, True, 5))


@book.query("E31_corpus_summary", WITH + "SELECT count(*)::BIGINT AS source_count, sum(len(w))::BIGINT AS total_words, sum(len(s))::BIGINT AS total_sentences FROM d WHERE trim(text) <> ''")
def corpus_summary(t):
    return base(t, "w", "s").filter("trim(text) <> ''").agg(F.count("*").alias("source_count"), F.sum(F.size("w")).alias("total_words"), F.sum(F.size("s")).alias("total_sentences"))


@book.query(
    "E32_comparison_table",
    WITH + f"SELECT doc_id, length(text)::BIGINT AS chars, len(w)::BIGINT AS words, len(s)::BIGINT AS sentences, round(CASE WHEN len(s) = 0 THEN 0 ELSE list_avg({SENT_LEN}) END, 1)::DOUBLE AS avg_sentence, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w)::DOUBLE END, 3)::DOUBLE AS ttr, len(l)::BIGINT AS lines, (length(text) - length(replace(text, ',', '')))::BIGINT AS commas FROM d",
)
def comparison_table(t):
    d = base(t, "w", "s", "l")
    avg = F.when(F.size("s") == 0, F.lit(0.0)).otherwise(T.mean(F.transform("s", lambda x: F.size(T.words(x)))))
    return d.select("doc_id", F.length("text").cast("long").alias("chars"), F.size("w").cast("long").alias("words"), F.size("s").cast("long").alias("sentences"), T.rounded(avg, 1).alias("avg_sentence"), T.rounded(T.type_token_ratio(F.col("w")), 3).alias("ttr"), F.size("l").cast("long").alias("lines"), T.occurrences(F.col("text"), ",").cast("long").alias("commas"))


@book.query("J08_language", "SELECT doc_id, CASE WHEN length(text) >= 50 AND c + l > 0 AND c / (c + l)::DOUBLE > 0.30 THEN 'ru' ELSE 'de' END AS language FROM (SELECT doc_id, text, len(regexp_extract_all(text[1:2000], '[а-яА-ЯёЁ]')) AS c, len(regexp_extract_all(text[1:2000], '[a-zA-Z]')) AS l FROM documents WHERE text IS NOT NULL)")
def language(t):
    return base(t).select("doc_id", T.language(F.col("text")).alias("language"))


@book.query("J27_filter_verse_lines", f"SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches({sql_strip('s')}, '^[0-9]{{1,4}}[a-z]?$')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text_md5 FROM documents WHERE text IS NOT NULL")
def filter_verse_lines(t):
    return base(t).select("doc_id", F.md5(T.without_verse_numbers(F.col("text"))).alias("text_md5"))


STANZAS = f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: len(list_filter(string_split(b, chr(10)), lambda x: {sql_strip('x')} <> ''))), lambda n: n > 0)"


@book.query("K05_stanzas", f"SELECT doc_id, len(n)::BIGINT AS stanza_count, array_to_string(n, '-') AS stanza_pattern FROM (SELECT doc_id, {STANZAS} AS n FROM documents WHERE text IS NOT NULL)")
def stanzas(t):
    n = F.filter(F.transform(F.split("text", "\n\n"), lambda b: F.size(T.lines(b))), lambda n: n > 0)
    return base(t).select("doc_id", n.alias("n")).select("doc_id", F.size("n").cast("long").alias("stanza_count"), F.array_join(F.transform("n", lambda x: x.cast("string")), "-").alias("stanza_pattern"))


LINE_WORDS = "[\\p{L}\\p{N}_]+"


@book.query("K07_vowel_skeletons", WITH + f"SELECT doc_id, i::BIGINT AS line, k AS skeleton FROM (SELECT doc_id, i, array_to_string(list_filter(list_transform(regexp_extract_all(lower(l[i]), '{LINE_WORDS}'), lambda x: regexp_replace(x, '[^{lx.VOWELS}]', '', 'g')), lambda x: x <> ''), '-') AS k FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)) WHERE k <> ''")
def vowel_skeletons(t):
    rows = base(t, "l").select("doc_id", F.posexplode("l").alias("i", "x"))
    parts = F.filter(F.transform(F.regexp_extract_all(F.lower("x"), F.lit(LINE_WORDS), F.lit(0)), lambda w: F.regexp_replace(w, f"[^{lx.VOWELS}]", "")), lambda s: s != "")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.array_join(parts, "-").alias("skeleton")).filter("skeleton <> ''")


def last_vowel(line: Column) -> Column:
    """The last vowel of the last word of a line."""
    last = F.try_element_at(F.regexp_extract_all(F.lower(line), F.lit(LINE_WORDS), F.lit(0)), F.lit(-1))
    return F.nullif(F.right(F.regexp_replace(last, f"[^{lx.VOWELS}]", ""), F.lit(1)), F.lit(""))


@book.query(
    "K08_vowel_echoes",
    WITH + f"""SELECT doc_id, trivial_vowel, n_echoes FROM (
WITH e AS (SELECT doc_id, i, right(regexp_replace(regexp_extract_all(lower(l[i]), '{LINE_WORDS}')[-1], '[^{lx.VOWELS}]', '', 'g'), 1) AS v FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d WHERE len(l) >= 2)),
f AS (SELECT * FROM e WHERE v <> ''),
c AS (SELECT doc_id, v, count(*) AS n, min(i) AS first FROM f GROUP BY doc_id, v),
m AS (SELECT doc_id, CASE WHEN max(n) / sum(n)::DOUBLE > 0.5 THEN arg_max(v, n * 1000000 - first) END AS trivial_vowel FROM c GROUP BY doc_id)
SELECT m.doc_id, m.trivial_vowel, (SELECT count(*) FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.v = b.v AND b.i - a.i BETWEEN 1 AND 5 WHERE a.doc_id = m.doc_id AND (m.trivial_vowel IS NULL OR a.v <> m.trivial_vowel))::BIGINT AS n_echoes FROM m)""",
)
def vowel_echoes(t):
    """Pairs of lines at most five apart that end on one vowel, by the lines themselves: five lags, no self-join."""
    ends = base(t, "l").filter(F.size("l") >= 2).select("doc_id", F.transform("l", last_vowel).alias("v"))

    def run(vowels: list[str | None]) -> Iterator[tuple]:
        if any(vowels):
            yield scripts.vowel_echoes(vowels, lambda v: v)

    return folded(ends, run, "trivial_vowel string, n_echoes long")


CARRY = ", ".join(f"'{w}'" for w in lx.LINE_CARRIERS)


def runs_on(line: Column, following: Column) -> Column:
    """Whether a verse line goes on in the next: no end mark, and a small letter or a carrier follows."""
    first = F.regexp_replace(F.element_at(F.split(following, f"{WS}+"), 1), "[^\\p{L}\\p{N}_]", "")
    return ~F.right(line, F.lit(1)).isin(".", "!", "?", ";", ":") & (first.rlike("^\\p{Ll}") | F.lower(first).isin(*lx.LINE_CARRIERS))


@book.query(
    "K10_enjambement",
    WITH + f"""SELECT doc_id, count(*) FILTER (run)::BIGINT AS n_runs, round(100.0 * count(*) FILTER (run) / count(*), 1)::DOUBLE AS percentage FROM (
SELECT doc_id, l[i][-1:] NOT IN ('.', '!', '?', ';', ':') AND (regexp_matches(f, '^\\p{{Ll}}') OR lower(f) IN ({CARRY})) AS run
FROM (SELECT doc_id, l, i, regexp_replace(regexp_split_to_array(l[i + 1], '{WS}+')[1], '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS f FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM d))) GROUP BY doc_id""",
)
def enjambement(t):
    rows = base(t, "l").select("doc_id", F.explode(F.when(F.size("l") > 1, F.arrays_zip(F.slice("l", 1, F.size("l") - 1).alias("a"), F.slice("l", 2, F.size("l") - 1).alias("b")))).alias("p"))
    n = F.count(F.when(runs_on(F.col("p.a"), F.col("p.b")), 1))
    return rows.groupBy("doc_id").agg(n.alias("n_runs"), T.rounded(F.lit(100.0) * n / F.count("*"), 1).alias("percentage"))


V2 = lx.VOWELS + "AEIOUÄÖУЕЫАОЭЯИЮЁ"
SYLLABLES = f"list_transform(l, lambda x: list_sum(list_transform(regexp_extract_all(x, '{LINE_WORDS}'), lambda w: greatest(len(regexp_extract_all(w, '[{V2}]+')), 1))))"


def syllables(line: Column) -> Column:
    """Groups of vowels, at least one a word."""
    found = F.regexp_extract_all(line, F.lit(LINE_WORDS), F.lit(0))
    return F.aggregate(found, F.lit(0), lambda s, w: s + F.greatest(F.regexp_count(w, F.lit(f"[{V2}]+")), F.lit(1)))


@book.query(
    "K11_verse_rhythm",
    WITH + f"SELECT doc_id, round(list_avg(n), 1)::DOUBLE AS avg_syllables, round(coalesce(list_stddev_pop(n), 0), 1)::DOUBLE AS stdev_syllables, coalesce(list_stddev_pop(n), 0) < 1.5 AS is_regular FROM (SELECT doc_id, list_transform({SYLLABLES}, lambda x: coalesce(x, 0)) AS n FROM d WHERE len(l) > 0)",
)
def verse_rhythm(t):
    d = base(t, "l").filter(F.size("l") > 0).select("doc_id", F.transform("l", syllables).alias("n"))
    n = F.col("n")
    return d.select("doc_id", T.rounded(T.mean(n), 1).alias("avg_syllables"), T.rounded(T.deviation(n), 1).alias("stdev_syllables"), (T.deviation(n) < 1.5).alias("is_regular"))


CONTRAST = frozenset(lx.CONTRAST_MARKERS)
MARKERS = "[" + ", ".join(f"'{w}'" for w in lx.CONTRAST_MARKERS) + "]"


@book.query(
    "G06_hotspot_sentences",
    WITH + f"""SELECT doc_id, pos::BIGINT AS pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM (
WITH x AS (SELECT doc_id, pos, sent, {sql_words('sent')} AS v FROM (SELECT doc_id, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS sent FROM d)),
c AS (SELECT doc_id, sum(len(v)) AS total, avg(len(v)) AS mean FROM x GROUP BY doc_id),
f AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(v) AS word FROM x) GROUP BY doc_id, word),
r AS (SELECT y.doc_id, y.pos, count(*) FILTER (f.n <= greatest(2, c.total // 200)) AS rare FROM (SELECT doc_id, pos, unnest(v) AS word FROM x) y JOIN f USING (doc_id, word) JOIN c USING (doc_id) GROUP BY y.doc_id, y.pos),
k AS (SELECT x.doc_id, x.pos, len(v) / c.mean AS longer, r.rare / len(v)::DOUBLE AS rare,
  (length(sent) - length(translate(sent, ',;–:', ''))) / len(v)::DOUBLE AS marks,
  round(length(array_to_string(v, '')) / len(v)::DOUBLE + len(list_filter(v, lambda w: length(w) > 10)) / len(v)::DOUBLE * 3, 2) AS morph,
  list_has_any(v, {MARKERS}) AS contrast FROM x JOIN c USING (doc_id) JOIN r USING (doc_id, pos))
SELECT doc_id, pos, round(CASE WHEN longer > 1.3 THEN 0.30 WHEN longer > 1.1 THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN rare > 0.4 THEN 0.25 WHEN rare > 0.25 THEN 0.12 ELSE 0 END::DOUBLE
  + CASE WHEN marks > 0.25 THEN 0.20 WHEN marks > 0.15 THEN 0.10 ELSE 0 END::DOUBLE + CASE WHEN morph > 7.0 THEN 0.15 WHEN morph > 5.5 THEN 0.07 ELSE 0 END::DOUBLE + CASE WHEN contrast THEN 0.10 ELSE 0 END::DOUBLE, 3) AS score FROM k)) WHERE rank <= 5""",
)
def hotspot_sentences(t):
    """The five sentences of a text that stand out by length, rare words, marks, morphology and contrast.

    All figures are of one text, so a text is folded where it lies.
    """
    rows = base(t, "s").select("doc_id", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, sentences in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += ((i, *x) for x in hotspots(sentences))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["doc_id", "pos", "score", "rank"])

    return rows.mapInArrow(run, "doc_id long, pos long, score double, rank long")


def _rounded(value: float, digits: str) -> float:
    return float(Decimal(repr(value)).quantize(Decimal(digits), ROUND_HALF_UP))


def hotspots(sentences: list[str], most: int = 5) -> list[tuple[int, float, int]]:
    """(place from 1, score, rank) of the sentences that stand out most."""
    found = [(i, s, T.PLAIN_WORD.findall(s.lower())) for i, s in enumerate(sentences, 1)]
    times = Counter(w for _, _, ws in found for w in ws)
    total = sum(times.values())
    mean, seldom = total / max(1, len(found)), max(2, total // 200)
    scored = []
    for i, s, ws in found:
        n = len(ws)
        if not n:
            continue
        long_words = sum(len(w) > 10 for w in ws)
        marks = sum(map(s.count, ",;–:"))
        parts = (
            (n / mean, (1.3, 0.30), (1.1, 0.15)),
            (sum(times[w] <= seldom for w in ws) / n, (0.4, 0.25), (0.25, 0.12)),
            (marks / n, (0.25, 0.20), (0.15, 0.10)),
            (_rounded(sum(map(len, ws)) / n + long_words / n * 3, "0.01"), (7.0, 0.15), (5.5, 0.07)),
        )
        score = sum(a if value > hi else b if value > lo else 0.0 for value, (hi, a), (lo, b) in parts) + (0.10 if CONTRAST.intersection(ws) else 0.0)
        scored.append((i, _rounded(score, "0.001")))
    best = sorted(scored, key=lambda x: (-x[1], x[0]))[:most]
    return [(i, score, rank) for rank, (i, score) in enumerate(best, 1)]
