"""Similarity of strings by matching blocks, for quotations that are nearly right."""

from __future__ import annotations

import math
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np

THRESHOLD = 0.85


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio()


def best_window(quote: str, source: str, head: int | None = 1536, enough: float = THRESHOLD) -> float:
    """Best ratio of the quotation and windows of its length in the head of the source (None: in all of it).

    Short quotations are compared with the whole source. The search ends at a window that
    is good enough, so the value is a lower bound from there on.
    """
    q, s = quote.lower(), source.lower()
    if len(q) < 20:
        return SequenceMatcher(None, q, s).ratio()
    s = s[:head]
    starts = [*range(0, len(s) - len(q) + 1, max(len(q) // 10, 20))]
    if len(s) > len(q):
        starts.append(len(s) - len(q))
    best = 0.0
    for i in starts:
        best = max(best, SequenceMatcher(None, q, s[i : i + len(q)]).ratio())
        if best >= enough:
            break
    return best


def window_starts(n: int, length: int) -> list[int]:
    """Where the windows of a source begin, the last one at its very end."""
    starts = [*range(0, n - length + 1, max(length // 10, 20))]
    return starts + [n - length] if n > length else starts


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    out = codes[: max(0, len(codes) - k + 1)].astype(np.int64)
    for j in range(1, k):
        out = out << 21 | codes[j : len(codes) - k + 1 + j]
    return out


def shared_grams(quote: np.ndarray, source: np.ndarray, starts: np.ndarray, length: int, k: int) -> np.ndarray:
    """How many runs of ``k`` characters (with repeats) each window of the source shares with the quotation."""
    wanted, often = np.unique(_grams(quote, k), return_counts=True)
    grams = _grams(source, k)
    at = np.minimum(np.searchsorted(wanted, grams), max(0, len(wanted) - 1))
    which = np.where(wanted[at] == grams, at, -1) if len(wanted) and len(grams) else np.full(len(grams), -1)
    out = np.zeros(len(starts), dtype=np.int64)
    for i, n in enumerate(often):
        before = np.concatenate([[0], np.cumsum(which == i)])
        out += np.minimum(n, before[np.minimum(starts + length - k + 1, len(grams))] - before[np.minimum(starts, len(grams))])
    return out


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one word of bits a character of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def best_in_source(quote: str, source: str, enough: float = THRESHOLD) -> float | None:
    """Best ratio of the quotation and any window of the whole source, or None where no window reaches ``enough``.

    The ratio is 2 M / (length of both), where M characters lie in matching blocks. A window that
    reaches ``enough`` shares so many runs of one and of two characters with the quotation, and has so long a
    common subsequence, that most windows are ruled out by counting; the others are
    compared in full. Short quotations are compared with the whole source.
    """
    q, s = quote.lower(), source.lower()
    if len(q) < 20:
        found = SequenceMatcher(None, q, s).ratio()
        return found if found >= enough else None
    length = min(len(q), len(s))
    starts = np.array(window_starts(len(s), len(q)) or ([0] if s else []), dtype=np.int64)
    if not len(starts):
        return None
    least = math.ceil(enough * (len(q) + length) / 2 - 1e-9)  # characters in matching blocks
    gone, more = len(q) - least, length - least
    if gone < 0 or more < 0:
        return None
    codes, text = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for x in (q, s))
    fits = shared_grams(codes, text, starts, length, 1) >= least
    fits &= shared_grams(codes, text, starts, length, 2) >= len(q) - 1 - 2 * gone - more
    best = None
    for i in starts[fits].tolist():
        window = s[i : i + length]
        if common_subsequence(q, window) >= least:
            found = SequenceMatcher(None, q, window).ratio()
            if found >= enough and (best is None or found > best):
                best = found
    return best


def best_source(quote: str, sources: Iterable[str]) -> tuple[float, int]:
    """(ratio, index) of the most similar source; (0, -1) without any."""
    rated = [(ratio(quote, s), -i) for i, s in enumerate(sources)]
    best, index = max(rated, default=(0.0, 1))
    return best, -index
