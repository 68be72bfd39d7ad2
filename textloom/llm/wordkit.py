"""Words of UTF-8 texts as 64-bit hashes, found byte by byte with numpy.

Both word patterns of the contracts treat every non-ASCII code point alike, so a
test on single UTF-8 bytes finds the same words as the patterns do on code points.
"""

from __future__ import annotations

import hashlib

import numpy as np

SEGMENT = 1 << 18
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
U64 = np.uint64
#: Factor of the polynomial that ``grams`` hashes runs of words with.
GRAM = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every input bit over the word."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _kind(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Letters A-Z and a-z, digits and every non-ASCII byte.
ALNUM = _kind(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Everything but space, tab, line feed, vertical tab, form feed and carriage return.
NONSPACE = _kind(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CODE = mix((_LOWER.astype(U64) + U64(1)) * U64(0xD6E8FEB86659FD93))


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, made when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_MULT, -1, 1 << 64)
            for name, base in (("up", _MULT), ("down", inverse)):
                steps = np.full(max(n, SEGMENT + 1), base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def _segments(raw: np.ndarray, word: np.ndarray):
    """Pieces of about SEGMENT bytes that end at a byte outside of words."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + SEGMENT)
        while hi < n:
            gap = np.flatnonzero(~word[raw[hi : hi + SEGMENT]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(n, hi + SEGMENT)
        yield lo, hi
        lo = hi


def _runs(data: bytes | None, word: np.ndarray):
    """For each piece of a text: prefix sums of its bytes, inverse powers, and where words start and end."""
    raw = np.frombuffer(data or b"", dtype=np.uint8)
    for lo, hi in _segments(raw, word):
        part = raw[lo:hi]
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = word[part]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(start):
            up, down = _POWERS.upto(len(part) + 1)
            total = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(_CODE[part] * up[: len(part)], out=total[1:])
            yield total, down, start, end


def _hash(total: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(((total[end] - total[start]) * down[start]) ^ (end - start).astype(U64))


def words(data: bytes | None, word: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text in order, A-Z counted as a-z."""
    out = [_hash(*run) for run in _runs(data, word)]
    return np.concatenate(out) if out else np.empty(0, dtype=U64)


def words_and_stems(data: bytes | None, word: np.ndarray, lengths: range) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct words, and sorted distinct beginnings (of so many bytes) of longer words."""
    found, stems = [np.empty(0, dtype=U64)], [np.empty(0, dtype=U64)]
    for total, down, start, end in _runs(data, word):
        h, first = np.unique(_hash(total, down, start, end), return_index=True)
        found.append(h)
        start, end = start[first], end[first]
        for k in lengths:
            longer = start[end - start > k]
            stems.append(np.unique(_hash(total, down, longer, longer + k) ^ U64(0x5BD1E9955BD1E995)))
    return np.unique(np.concatenate(found)), np.unique(np.concatenate(stems))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, in order."""
    if len(h) < k:
        return np.empty(0, dtype=U64)
    acc = np.zeros(len(h) - k + 1, dtype=U64)
    for j in range(k):
        acc = acc * GRAM + h[j : len(h) - k + 1 + j]
    return mix(acc ^ U64(k))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; a shorter text is one shingle, no word none."""
    if not len(h):
        return h
    return np.unique(grams(h, min(k, len(h))))


def digest(sorted_set: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(sorted_set.tobytes(), digest_size=16).digest()
