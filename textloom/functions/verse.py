"""Rhyme and sound figures of verse: rules with state, run on whole texts in Arrow batches."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable
from itertools import combinations, islice

from textloom.functions import lexicon as lx

VOWELS = frozenset(lx.VOWELS)
_WORD = re.compile(r"[\w\u0400-\u04FF]+")
_NOT_WORD = re.compile(r"[^\w\u0400-\u04FF]")
FUNCTION_WORDS = frozenset(lx.DE_FUNCTION_WORDS + lx.RU_FUNCTION_WORDS)
CAP = 50  # figures that are listed; the counts are of all


def lines_of(text: str) -> list[str]:
    return [s for s in (line.strip() for line in text.split("\n")) if s]


def stanzas_of(text: str) -> list[list[str]]:
    return [lines for lines in map(lines_of, text.split("\n\n")) if lines]


@functools.lru_cache(maxsize=1 << 16)
def rhyme_form(word: str) -> str:
    """Lower-case letters without a mute e after a consonant or a hard or soft sign."""
    w = _NOT_WORD.sub("", word.lower())
    if len(w) > 2 and w[-1] == "e" and w[-2] not in "aeiouäöü":
        w = w[:-1]
    return w[:-1] if w and w[-1] in "ьъ" else w


@functools.lru_cache(maxsize=1 << 16)
def _vowels(word: str) -> str:
    return "".join(c for c in word if c in VOWELS)


def _adjective_stem(word: str) -> tuple[str, bool]:
    """The word without adjective endings, taken off in their order, and whether there were any."""
    cut = False
    for ending in lx.ADJECTIVE_ENDINGS:
        if word.endswith(ending) and len(word) > len(ending) + 1:
            word, cut = word[: -len(ending)], True
    return word, cut


def rhymes(a: str, b: str) -> bool:
    """Whether two rhyme forms agree in ending, in their last two vowels or in adjective stems."""
    if min(len(a), len(b)) >= 2 and a[-2:] == b[-2:]:
        return True
    va, vb = _vowels(a), _vowels(b)
    if min(len(va), len(vb)) >= 2 and va[-2:] == vb[-2:]:
        return True
    (sa, ca), (sb, cb) = _adjective_stem(a), _adjective_stem(b)
    if min(len(sa), len(sb)) < 2:
        return False
    return sa[-2:] == sb[-2:] or ca and cb and sa[-1] == sb[-1] and sa[-1] in lx.SONORANTS


def _label_stanza(lines: list[str]) -> tuple[list[str], list[dict]]:
    """Labels of the lines; each line takes every free later line it rhymes with."""
    ends = [rhyme_form(line.split()[-1]) for line in lines]
    labels: list[str | None] = [None] * len(lines)
    pairs: list[dict] = []
    for i, end in enumerate(ends):
        if labels[i] is not None:
            continue
        for j in range(i + 1, len(ends)) if end else ():
            if labels[j] is None and ends[j] and rhymes(end, ends[j]):
                labels[i] = labels[j] = chr(ord("A") + len(pairs))
                pairs.append({"label": labels[j], "line_a": i + 1, "word_a": lines[i].split()[-1], "line_b": j + 1, "word_b": lines[j].split()[-1]})
        labels[i] = labels[i] or ("x" if end else ".")
    return [x or "x" for x in labels], pairs


def _stanza_type(labels: list[str]) -> str:
    if len(labels) >= 4:
        a, b, c, d = labels[:4]
        for name, fits in (("Kreuzreim", a == c and b == d), ("Paarreim", a == b and c == d), ("Umarmender Reim", a == d and b == c)):
            if fits:
                return name
    return "Gemischt"


def rhyme_scheme(text: str) -> dict:
    """notation, type and pairs; fewer than two pairs are no rhyme."""
    stanzas = stanzas_of(text)
    done = [_label_stanza(s) for s in stanzas]
    last = stanzas[-1] if stanzas else None
    notation: list[str] = []
    for lines, (labels, _) in zip(stanzas, done, strict=True):
        notation += labels + ([] if lines == last else ["|"])
    pairs = [p for _, found in done for p in found]
    kinds = Counter(_stanza_type(labels) for labels, _ in done)
    kind = kinds.most_common(1)[0][0] if len(pairs) >= 2 else "Kein Reim"
    return {"notation": " ".join(notation), "type": kind, "pairs": pairs}


def _initials(words: Iterable[str]) -> dict[str, list[str]]:
    """Content words, which are distinct, by their first consonant."""
    out: dict[str, list[str]] = {}
    for w in words:
        if first := _initial(w):
            out.setdefault(first, []).append(w)
    return out


@functools.lru_cache(maxsize=1 << 16)
def _initial(word: str) -> str | None:
    """The first consonant of a word that is no auxiliary."""
    return None if word in lx.AUXILIARIES else next((c for c in word if c in lx.CONSONANTS), None)


@functools.lru_cache(maxsize=1 << 16)
def _facts(word: str) -> tuple[bool, str | None, str]:
    """Whether it is a content word; its first two vowels (none for short words, empty for fewer vowels); the end of its rhyme form."""
    content = word not in FUNCTION_WORDS and len(word) > 1
    vowels = _vowels(word)[:2]
    return content, (vowels if len(vowels) == 2 else "") if content and len(word) > 2 else None, rhyme_form(word)[-3:]


@functools.lru_cache(maxsize=1 << 16)
def _suffixes(word: str) -> frozenset[str]:
    return frozenset(s for s in lx.NOUN_SUFFIXES if word.endswith(s) and len(word) > len(s) + 1)


def _pairs(words: list[str]) -> int:
    """Pairs of distinct words that do not only share a noun suffix, counted by the suffixes they have."""
    kinds = list(Counter(map(_suffixes, words)).items())
    apart = sum(n * (n - 1) // 2 for suffixes, n in kinds if not suffixes)
    return apart + sum(n * m for (a, n), (b, m) in combinations(kinds, 2) if not a & b)


def sound_patterns(text: str) -> dict:
    """Alliterations within and across lines, assonances within three words, internal rhymes."""
    lines = lines_of(text)
    initials: list[dict[str, list[str]]] = []
    alliterations: list[dict] = []
    assonances: list[dict] = []
    inner: list[dict] = []  # as many as are listed
    n_inner = 0
    for n, line in enumerate(lines, 1):
        every = _WORD.findall(line.lower())
        if len(every) < 2:
            initials.append({})
            continue
        facts = dict(zip(every, map(_facts, every), strict=True))  # distinct words in their order
        initials.append(_initials(w for w, (content, _, _) in facts.items() if content))
        alliterations += [{"line": n, "consonant": c, "words": ws} for c, ws in initials[-1].items() if len(ws) > 1]
        sounding = [w for w in every if facts[w][1] is not None]
        sounds = [facts[w][1] for w in sounding]
        for i, (a, va) in enumerate(zip(sounding, sounds, strict=True)):
            if va and va in sounds[i + 1 : i + 4]:
                assonances += [{"line": n, "vowels": va, "word_a": a, "word_b": b} for b, vb in zip(sounding[i + 1 : i + 4], sounds[i + 1 : i + 4], strict=True) if va == vb and a != b]
        by_form: dict[str, list[str]] = {}  # a pair of words counts once a line, so distinct words do
        for w, (_, _, end) in facts.items():
            by_form.setdefault(end, []).append(w)
        for form, words in by_form.items():
            if len(form) == 3 and len(words) > 1:
                n_inner += _pairs(words)
                if len(inner) >= CAP:
                    continue
                fitting = ({"line": n, "word_a": a, "word_b": b} for a, b in combinations(words, 2) if not _suffixes(a) & _suffixes(b))
                inner += islice(fitting, CAP - len(inner))
    known = {(x["consonant"], x["line"], frozenset(x["words"])) for x in alliterations}
    for gap in (1, 2):
        for i in range(len(lines) - gap):
            for c in sorted(initials[i].keys() & initials[i + gap].keys()):
                here = set(initials[i][c])
                fresh = [w for w in initials[i + gap][c] if w not in here]
                words = initials[i][c] + fresh
                if fresh and not any((c, n, frozenset(words)) in known for n in (i + 1, i + gap + 1)):
                    known.add((c, i + 1, frozenset(words)))
                    alliterations.append({"line": i + 1, "line_end": i + gap + 1, "consonant": c, "words": words})
    return {"alliterations": alliterations[:CAP], "assonances": assonances[:CAP], "internal_rhymes": inner, "n_alliterations": len(alliterations), "n_assonances": len(assonances), "n_internal_rhymes": n_inner}
