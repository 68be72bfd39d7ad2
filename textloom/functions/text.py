"""Text statistics as Column expressions: words, sentences, lines and what is counted on them.

Every function takes and gives Columns, so a plan that uses them stays in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import lexicon as lx

STOP = "\ue000"  # stands for a full stop that ends no sentence
CUT = "\ue001"  # stands for a sentence boundary
WHITE = " \t\n\x0b\f\r"


#: What ``words`` finds in lower-case text, for rules that run in Python.
PLAIN_WORD = re.compile(f"[{lx.LETTERS}]+(?:-[{lx.LETTERS}]+)*")


def words(text: Column) -> Column:
    """Lower-case runs of letters, hyphenated compounds as one word."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{lx.LETTERS}]+(?:-[{lx.LETTERS}]+)*"), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences of more than three characters; abbreviations and ordinals do not end one."""
    short = "|".join(re.escape(a) for a in lx.ABBREVIATIONS)
    kept = F.regexp_replace(text, rf"({short}|[0-9]+)\.", f"$1{STOP}")
    cut = F.regexp_replace(kept, rf"([.!?])[{WHITE}]+([A-ZÄÖÜА-ЯЁ«»\"'])", f"$1{CUT}$2")
    parts = F.split(F.translate(cut, STOP, "."), CUT)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, rf"^[{WHITE}]+|[{WHITE}]+$", "")), lambda s: F.length(s) > 3)


def lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", "")


def strip_lines(text: Column) -> Column:
    """Without white space before it and blank lines after it; the last line's own blanks stay."""
    return F.regexp_replace(text, rf"^[{WHITE}]+|\n[{WHITE}]*\z", "")


def rounded(number: Column, digits: int) -> Column:
    """To so many decimals by the double itself, as SQL rounds; ``F.round`` goes by its shortest decimal form."""
    number, unit = number.cast("double"), float(10**digits)
    return F.round(number * unit) / unit


def fields(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(text, rf"[{WHITE}]+"), lambda s: s != "")


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def is_function_word(word: Column) -> Column:
    return word.isin(*dict.fromkeys(lx.DE_FUNCTION_WORDS + lx.RU_FUNCTION_WORDS))


def type_token_ratio(found: Column) -> Column:
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(found)) / F.size(found))


def standardized_ttr(found: Column, segment: int = 100) -> Column:
    """Mean ratio over whole segments; the ratio itself for shorter texts."""
    n = F.floor(F.size(found) / segment).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.size(F.array_distinct(F.slice(found, i * segment + 1, segment))) / F.lit(float(segment)))
    mean = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / n
    return F.when(n == 0, type_token_ratio(found)).otherwise(mean)


def total_length(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda s, w: s + F.length(w))


def morphological_complexity(found: Column) -> Column:
    """Mean word length and three times the share of words of more than ten characters."""
    n = F.size(found)
    long_words = F.size(F.filter(found, lambda w: F.length(w) > 10))
    return F.when(n == 0, F.lit(0.0)).otherwise(rounded(total_length(found) / n + long_words / n * 3, 2))


def n_grams(found: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a space, in order."""
    last = F.size(found) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(found, i, n), " "))
    return F.when(last >= 1, grams).otherwise(F.array().cast("array<string>"))


def occurrences(text: Column, *marks: str) -> Column:
    """How often the marks occur, counted without overlap for each."""
    total = F.lit(0)
    for mark in marks:
        total = total + (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    return total.cast("int")


#: Name of the punctuation class and its marks.
PUNCTUATION = {"comma": (",",), "full_stop": (".",), "exclamation": ("!",), "question": ("?",), "colon": (":",), "semicolon": (";",), "dash": ("–", "—", "-"), "ellipsis": ("…", "...")}


def clause_type(sentence: Column) -> Column:
    """NS if a subordinator opens the sentence, gemischt if one occurs later, else HS."""
    bare = F.transform(fields(sentence), lambda w: F.lower(F.translate(w, ',.;:!?("«»—–-…', "")))
    phrases = "|".join(p.replace(" ", rf"[{WHITE}]+") for p in lx.CLAUSE_PHRASES)
    starters = literals(lx.CLAUSE_STARTERS)
    return F.when(F.array_contains(starters, F.try_element_at(bare, F.lit(1))), "NS").when(F.lower(sentence).rlike(phrases) | F.arrays_overlap(bare, starters), "gemischt").otherwise("HS")


def without_metadata(text: Column) -> Column:
    """Text without the title, excerpt and publication lines that importers put before it."""
    dash, open_, close = "[—–-]", "[«\"„]", "[»\"“]"
    for pattern, by in (
        (r"\*\*\[.*?\]\*\*[ \t\n\x0b\f\r]*", ""),
        (r"(?m)^.*[Aa]uszug.*$", ""),
        (rf"(?m)^.{{3,60}}{dash}\s*{open_}.*?{close}.*?\(\d{{4}}\)\s*$", ""),
        (rf"(?m)^.{{3,60}}{dash}\s*{open_}.*?{close}\s*$", ""),
        (r"(?m)^\((?:Опубликовано|Veröffentlicht|Published).*?\)\s*$", ""),
        (r"\n{3,}", "\n\n"),
        (r"(?m)^QUELLE\s+\d+:\s*.*$", ""),
        (r"(?m)^\[.{3,300}\]\s*$", ""),
        (r"(?m)^(?:Sprache|Language|Kapitel|Chapter|Source):.*$", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda s: s != "")


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def deviation(values: Column) -> Column:
    """Population standard deviation of an array."""
    m = mean(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(values))


def verse_lines(text: Column) -> Column:
    """Lines that are not bare verse numbers."""
    return F.filter(lines(text), lambda s: ~s.rlike("^[0-9]{1,4}[a-z]?$"))


def without_verse_numbers(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda s: ~strip(s).rlike("^[0-9]{1,4}[a-z]?$"))
    return F.regexp_replace(F.array_join(kept, "\n"), "\n{3,}", "\n\n")


def language(text: Column) -> Column:
    """ru if more than 30 % of Cyrillic and Latin letters of the first 2 000 are Cyrillic, else de."""
    head = F.substring(text, 1, 2000)
    cyrillic, latin = F.regexp_count(head, F.lit("[а-яА-ЯёЁ]")), F.regexp_count(head, F.lit("[a-zA-Z]"))
    return F.when((F.length(text) >= 50) & (cyrillic + latin > 0) & (cyrillic / (cyrillic + latin) > 0.30), "ru").otherwise("de")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]; 0 for missing, empty, unequal or zero vectors."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm))).otherwise(0.0)


def assembled(task: str, *sections: tuple[str, Column]) -> Column:
    """A prompt: the task, then headed sections in order; a section without text is left out."""
    headed = (F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {name}\n"), body)) for name, body in sections)
    return F.concat_ws("\n\n", F.lit(task), *headed)
