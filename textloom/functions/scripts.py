"""Statistics of polytonic Greek and pointed Hebrew texts.

Both need decomposed characters and word tables, so they run as Python in Arrow batches.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

from textloom.functions.compounds import compounds

_GREEK_WORD = re.compile(r"[\u0370-\u03FF\u1F00-\u1FFF]+")
_HEBREW_RUN = re.compile(r"[\u0590-\u05FF]+")
_ALPHA_RUN = re.compile(r"[a-zA-Z\u0370-\u03FF\u1F00-\u1FFF\u0400-\u04FF\u0590-\u05FF]+")
_MARKS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Mn") + "]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")
_ACCENTS = re.compile("[\u0591-\u05af]+")
_NUMBER = re.compile(r"\d+[a-z]?")
_ELIDED = re.compile(r"([\u0370-\u03FF\u1F00-\u1FFF]+)[\u1FBD\u1FFE\u1FFD']")
_POINTS = re.compile(r"[,.;:!?·᾽᾿῀῁῍῝῭]+")
GREEK_VOWELS = "αεηιουω"

# Elided forms and what they stand for.
ELISIONS = {
    "ενθ": "ἔνθα", "τοτ": "τότε", "ουκ": "οὐκ", "μηκ": "μὴκετι", "ουδ": "οὐδέ", "μηδ": "μὴδέ", "ουτ": "οὐτέ", "μητ": "μὴτέ", "αλλ": "ἀλλά",
    "επ": "ἐπί", "απ": "ἀπό", "κατ": "κατά", "παρ": "παρά", "υπ": "ὑπό", "εφ": "ἐπί", "αφ": "ἀπό", "δι": "διά", "μετ": "μετά", "οιν": "οἶνα",
    "εισ": "εἰσε", "δ": "δέ", "τ": "τέ", "γ": "γέ", "κ": "κι", "ν": "νύ", "ρ": "ῤα",
}
# Contracted words and their parts.
CRASES = {
    "καγω": ("καὶ", "ἐγώ"), "καγων": ("καὶ", "ἐγών"), "χω": ("καὶ", "ὁ"), "χη": ("καὶ", "ἡ"), "χοι": ("καὶ", "οἶ"), "κουκ": ("καὶ", "οὐκ"), "κουδε": ("καὶ", "οὐδέ"),
    "κουχ": ("καὶ", "οὐυχ"), "κουτε": ("καὶ", "οὐτέ"), "κωσ": ("καὶ", "ὡς"), "κην": ("καὶ", "ἤν"), "κει": ("καὶ", "εἶ"),
}
# Words, without accents, that open a subordinate clause, and phrases that do.
GREEK_STARTERS = frozenset("οτι ως ινα ει επει επειδη οτε οθεν μη πριν μεχρι οσπερ οστις οπη οπου οποτε οππως οπωσ οφρα τεως ος η ο οιου οποιος οσος οποσος ου ην αι ων οις ας ουσ ατε ειτε ητοι".split())
GREEK_PHRASES = re.compile(r"ει\s+μη|ως\s+ου|οπως\s+ου|οπως\s+αν|ως\s+αν|οταν\s+αν")
# Particles that lift a sentence's weight.
GREEK_PARTICLES = frozenset("αλλα αλλ μεν δε τε γαρ ουν".split())


def _unmarked(text: str) -> str:
    """Decomposed, without combining marks."""
    spread = unicodedata.normalize("NFD", text)
    if spread.isascii():
        return spread
    if _BEYOND.search(spread):  # rare, and a class of all planes is slow to match
        return "".join(c for c in spread if unicodedata.category(c) != "Mn")
    return _MARKS.sub("", spread)


@functools.lru_cache(maxsize=1 << 16)
def greek_form(word: str) -> str:
    """Lower case without accents, final sigma as sigma."""
    bare = _unmarked(word.lower())
    return unicodedata.normalize("NFC", bare).replace("ς", "σ")


def _letters(text: str, runs: re.Pattern[str]) -> int:
    return sum(map(len, runs.findall(text)))


def script_of(text: str) -> str:
    """greek or hebrew for a share of 0.3 or more than ten letters, else other."""
    kinds = (("greek", _GREEK_WORD), ("hebrew", _HEBREW_RUN))
    base = _unmarked(text)
    every = max(1, _letters(base, _ALPHA_RUN))
    for name, runs in kinds:
        if text.strip() and _letters(base, runs) / every >= 0.3:
            return name
    for name, runs in kinds:
        if _letters(text, runs) > 10:
            return name
    return "other"


def greek_words(text: str) -> list[str]:
    """White-space words with elisions and crases resolved, verse numbers and marks left out."""
    return [w for token in text.replace("\u2019", "\u1fbd").replace("\u02bc", "\u1fbd").split() for w in _greek_token(token)]


@functools.lru_cache(maxsize=1 << 16)
def _greek_token(token: str) -> tuple[str, ...]:
    if _NUMBER.fullmatch(token):
        return ()
    if parts := CRASES.get(greek_form(token)):
        return parts
    if m := _ELIDED.fullmatch(token):
        base = greek_form(m[1])
        return (ELISIONS.get(base) or (base if len(base) > 1 else token),)
    bare = _POINTS.sub("", token)
    return (bare,) if bare else ()


def greek_sentences(text: str) -> list[str]:
    parts = re.split(r"(?<=[.?!])\s+", text.replace(";", "?").replace("·", ".").replace("\u0387", "."))
    return [p.strip() for p in parts if p.strip()]


@functools.lru_cache(maxsize=1 << 16)
def greek_syllables(word: str) -> int:
    """Vowels with diphthongs as one; a diaeresis parts them, iota subscript joins."""
    if not word.strip():
        return 0
    spread = re.sub("([ιυ])\u0308", "I", re.sub("([ιυ])([\u0300\u0301\u0342]*)\u0308", "\\1\u0308\\2", unicodedata.normalize("NFD", word.lower())))
    kept = "".join(c for c in spread if unicodedata.category(c) != "Mn" or c == "\u0345")
    joined = re.sub("αι|ει|οι|υι|αυ|ευ|ου|ηυ|[αηω]\u0345", "V", kept)
    return max(1, len(re.findall("[αεηιουωIV]", joined)))


def greek_clause(sentence: str) -> str:
    forms = [greek_form(w) for w in sentence.split()]
    if forms and forms[0] in GREEK_STARTERS:
        return "NS"
    return "gemischt" if GREEK_PHRASES.search(sentence.lower()) or GREEK_STARTERS.intersection(forms) else "HS"


def verses(text: str) -> list[str]:
    return [s for s in (x.strip() for x in text.split("\n")) if s and not re.fullmatch(r"\d+[a-z]?", s)]


def greek_stanzas(text: str) -> list[int]:
    """Lines of each stanza; one long block is a stanza a line."""
    sizes = [n for n in (len(verses(b)) for b in text.split("\n\n")) if n]
    return [1] * sizes[0] if len(sizes) == 1 and sizes[0] > 5 else sizes


def greek_skeleton(line: str) -> str:
    return "-".join(v for v in ("".join(c for c in greek_form(w) if c in GREEK_VOWELS) for w in _GREEK_WORD.findall(line)) if v)


def greek_enjambement(lines: list[str]) -> tuple[int, float]:
    n = sum(x.rstrip()[-1] not in "·;.\u0387" for x in lines[:-1])
    return n, round(100 * n / (len(lines) - 1), 1) if len(lines) > 1 else 0.0


def _spread(values: list[float]) -> tuple[float, float]:
    m = sum(values) / max(1, len(values))
    return m, math.sqrt(sum((v - m) ** 2 for v in values) / max(1, len(values)))


def greek_rhythm(lines: list[str]) -> dict:
    counts = [sum(greek_syllables(w) for w in _GREEK_WORD.findall(x) if len(w) > 1) for x in lines]
    m, s = _spread(counts)
    regular = bool(counts) and s < 2
    n = round(m)
    told = "" if not counts else f"freier Rhythmus (σ {s:.1f})" if not regular else f"Hexameter ({n} Silben)" if 12 <= n <= 17 else f"regelmäßiger Vers ({n} Silben)" if 6 <= n <= 9 else f"regelmäßiger Rhythmus ({n} Silben)"
    return {"avg_syllables": round(m, 1), "stdev_syllables": round(s, 1), "is_regular": regular, "description": told}


def vowel_echoes(lines: list[str], end_vowel, apart: int = 5) -> tuple[str | None, int]:
    """(vowel of more than half of the line ends, pairs of near lines that end alike without it)."""
    ends = [(i, v) for i, v in enumerate(map(end_vowel, lines)) if v]
    top = Counter(v for _, v in ends).most_common(1)
    trivial = top[0][0] if top and top[0][1] > len(ends) / 2 else None
    return trivial, sum(0 < j - i <= apart and a == b != trivial for n, (i, a) in enumerate(ends) for j, b in ends[n + 1 : n + 1 + apart])


def greek_end_vowel(line: str) -> str | None:
    words = _GREEK_WORD.findall(line)
    return next((c for c in reversed(greek_form(words[-1])) if c in GREEK_VOWELS), None) if words else None


def greek_alliterations(lines: list[str]) -> int:
    """Lines and consonants that open two or more distinct longer words."""
    n = 0
    for line in lines:
        firsts: dict[str, set[str]] = {}
        for w in (greek_form(w) for w in _GREEK_WORD.findall(line)):
            if len(w) > 2 and w[0] not in GREEK_VOWELS:
                firsts.setdefault(w[0], set()).add(w)
        n += sum(len(ws) > 1 for ws in firsts.values())
    return n


def hebrew_word(word: str) -> str:
    """Without cantillation marks."""
    return unicodedata.normalize("NFC", _ACCENTS.sub("", unicodedata.normalize("NFD", word)))


@functools.lru_cache(maxsize=1 << 16)
def _hebrew_token(token: str) -> str:
    return hebrew_word(token).rstrip("\u05c3\u05c0,.;:!?")


def hebrew_words(text: str) -> list[str]:
    return [w for w in map(_hebrew_token, text.replace("\u05be", " ").split()) if w]


def hebrew_sentences(text: str) -> list[str]:
    parts = re.split(r"(?<=[.?!])\s+", text.replace("\u05c3", ".").replace("\u05c0", ","))
    return [p.strip() for p in parts if p.strip()]


def parallelism(sizes: list[int]) -> dict:
    """Neighbouring lines of like length."""
    pairs = [(a, b) for a, b in zip(sizes, sizes[1:], strict=False) if a > 0 and b > 0]
    like = sum(min(p) / max(p) >= 0.6 for p in pairs)
    return {"parallel_pairs": like, "total_pairs": len(pairs), "ratio": round(like / max(1, len(pairs)), 2)}


def _common(words: list[str], sentences: list[str], cut) -> dict:
    sizes = sorted(len(cut(s)) for s in sentences) or [0]
    n = len(words)
    parts = [len(set(words[i : i + 100])) / 100 for i in range(0, n - 99, 100)]
    ttr = len(set(words)) / max(1, n)
    return {"words": n, "sentences": len(sentences), "avg_length": round(sum(sizes) / len(sizes), 1), "median_length": sizes[len(sizes) // 2], "max_length": sizes[-1], "min_length": sizes[0], "ttr": round(ttr, 3), "sttr": round(sum(parts) / len(parts) if parts else ttr, 3)}


def analyze_greek(text: str) -> dict:
    sentences, raw = greek_sentences(text), greek_words(text)
    forms = [greek_form(w) for w in raw if len(w) > 1]
    lines = verses(text)
    m, s = _spread([len(greek_words(x)) for x in lines])
    signal = "stark" if m < 10 and len(lines) > 5 else "mittel" if m < 14 and len(lines) > 3 else "schwach"
    kinds = Counter(map(greek_clause, sentences))
    length = sum(map(len, forms)) / max(1, len(forms))
    trivial, echoes = vowel_echoes(lines, greek_end_vowel)
    weight = lambda x: len(w := greek_words(x)) + (2 if GREEK_PARTICLES.intersection(map(greek_form, w)) else 0)
    return {
        "language": "grc", **_common(forms, sentences, greek_words), "morphology": round(length + 3 * sum(len(w) > 10 for w in forms) / max(1, len(forms)), 2),
        "hs": kinds["HS"], "ns": kinds["NS"], "mixed": kinds["gemischt"], "lines": len(lines), "signal": signal, "stdev_words": round(s, 1),
        "stanzas": "-".join(map(str, greek_stanzas(text))), "enjambements": greek_enjambement(lines)[0], "rhythm": greek_rhythm(lines)["description"],
        "echoes": echoes, "trivial_vowel": trivial, "alliterations": greek_alliterations(lines), "hotspot": max(sentences, key=weight, default=""),
        "compounds": [c["word"] for c in compounds(forms, sentences, "el", 10)], "parallelism": None,
    }


def analyze_hebrew(text: str) -> dict:
    sentences, words = hebrew_sentences(text), hebrew_words(text)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    sizes = [len(hebrew_words(x)) for x in lines]
    m, _ = _spread(sizes)
    return {
        "language": "heb", **_common(words, sentences, hebrew_words), "morphology": round(10 * sum(len(w) > 6 for w in words) / max(1, len(words)), 1),
        "hs": len(sentences), "ns": 0, "mixed": 0, "lines": len(lines), "signal": "stark" if m < 10 and len(lines) > 8 else "schwach", "stdev_words": 0.0,
        "stanzas": "", "enjambements": 0, "rhythm": "", "echoes": 0, "trivial_vowel": None, "alliterations": 0, "hotspot": "",
        "compounds": [c["word"] for c in compounds(words, sentences, "he", 10)], "parallelism": parallelism(sizes)["ratio"],
    }


def analyze(text: str) -> dict | None:
    """Statistics of a Greek or Hebrew text, nothing for others."""
    return {"greek": analyze_greek, "hebrew": analyze_hebrew}.get(script_of(text), lambda _: None)(text)
