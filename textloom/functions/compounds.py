"""Compound words: hyphenated, prefixed, joined by maqqef, or simply long."""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter

from textloom.functions import lexicon as lx

JOINTS = frozenset(("und", "oder", "bzw", "resp"))


def without_marks(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c) != "Mn")


def acronym(part: str) -> bool:
    return len(part) > 1 and part.isupper()


def _hyphenated(word: str) -> list[str] | None:
    parts = word.split("-")
    fits = len(word) > 4 and len(parts) > 1 and all(len(p) >= 2 and not p.isdigit() for p in parts)
    return parts if fits and not all(p in JOINTS for p in parts) and not any(map(acronym, parts)) else None


#: Prefix and the least length of a word that has it.
_LEAST_DE = {p: max(10 if len(p) <= 3 else len(p) + 4, len(p) + 4) for p in lx.DE_PREFIXES}
_DE_PREFIXES = tuple(_LEAST_DE)


def _prefixed_de(word: str) -> bool:
    if not word.startswith(_DE_PREFIXES) or word in lx.DE_NO_COMPOUNDS:
        return False
    return any(word.startswith(p) and len(word) >= n for p, n in _LEAST_DE.items())


def _prefixed(word: str, prefixes: tuple[str, ...]) -> bool:
    return word.startswith(prefixes) and any(word.startswith(p) and len(word) > len(p) + 3 for p in prefixes)


@functools.lru_cache(maxsize=1 << 16)
def kind(word: str, language: str) -> tuple[str, list[str]] | None:
    """(kind, parts) of a lower-case word; the first rule that fits decides."""
    everything = language == "auto"
    if (everything or language in ("de", "ru")) and (parts := _hyphenated(word)):
        if everything or language == "de" or any("Ѐ" <= c <= "ӿ" for c in word):
            return "bindestrich", parts
    if (everything or language == "de") and _prefixed_de(word):
        return ("praefix" if len(word) < 20 else "lang"), []
    if (everything or language == "ru") and _prefixed(word, tuple(lx.RU_PREFIXES)):
        return ("praefix" if len(word) < 20 else "lang"), []
    if (everything or language == "el") and _prefixed(without_marks(word), tuple(lx.EL_PREFIXES)):
        return "greek_praefix", []
    if language == "he" and len(word) > 3 and any("֐" <= c <= "׿" for c in word):
        parts = word.replace("־", "-").split("-")
        if len(parts) > 1 and all(len(p) >= 2 for p in parts):
            return "hebrew_maqqef", parts
    if len(word) >= (10 if language == "he" else 12) and word.replace("-", "").isalpha() and not (language in ("de", "auto") and word in lx.DE_NO_COMPOUNDS):
        return "lang", []
    return None


def compounds(words: list[str], sentences: list[str], language: str = "auto", top: int = 15) -> list[dict]:
    """The longest compounds with their count and the first sentence that holds them."""
    times = Counter(words)
    found = {w: k for w in times if (k := kind(w, language))}
    rank = {"bindestrich": 0, "praefix": 1, "greek_praefix": 2, "hebrew_maqqef": 3, "lang": 4}
    # Longest first; equal lengths by the rule that found them, then by their place in the text.
    best = sorted(found, key=lambda w: (-len(w), rank[found[w][0]]))[:top]
    low = [(s.lower(), s) for s in sentences] if best else []
    out = []
    for w in best:
        context = next((s for lowered, s in low if w in lowered), "")[:150] or w
        out.append({"word": w, "kind": found[w][0], "length": len(w), "context": context, "parts": found[w][1], "count": times[w]})
    return out
