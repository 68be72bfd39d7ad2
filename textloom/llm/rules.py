"""Quality rules as a short-circuit cascade (operator 11).

A rule rejects a text by a few of its statistics. Statistics are made of parts (word bounds,
hashes, lines ...) that rules share, and a text's part is computed when the first rule asks
for it. ``estimate`` runs all rules on a sample, the first ``per_task`` rows of every task,
and returns the seconds a part takes and how many sampled texts each set of rules rejects.
``order`` then takes, again and again, the rule with most rejections among the sampled texts
that the rules before it let pass, per second of the parts that are still to be computed.
``verdicts`` runs the rules in that order and stops at the first one that rejects. The order
decides the cost only: a text is kept if no rule rejects it, so the result is the same
whatever the clock said.

Words are runs of other bytes than space, tab, line feed, vertical tab, form feed and
carriage return; case counts. Words are compared by 64-bit hashes.

Nulls: a null text is the empty text, which has no words. An empty text, and any with too few
words, is rejected by ``few_words``; rules that divide by the number of words let it pass. A
null id is a value like any other; repeated rows come back as often as they came in. Texts of
any length are read whole. An empty table gives an empty result, and an order by cost alone
if nothing was sampled. ``verdicts`` reads the id and text columns only, so other columns
cannot clash; ``keep`` hands on all columns as they are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import wordkit

SAMPLE = 256  # rows of a task that the estimate reads


def _bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = wordkit.NONSPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hashes(data: bytes, raw: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of the words in order; the hash that ignores case and one of where capitals stand."""
    capital = np.flatnonzero((raw >= 0x41) & (raw <= 0x5A))
    case = np.zeros(len(bounds[0]), dtype=np.uint64)
    if len(capital):
        word = np.searchsorted(bounds[0], capital, side="right") - 1
        np.add.at(case, word, wordkit.mix((capital - bounds[0][word] + 1).astype(np.uint64)))
    return wordkit.words(data, wordkit.NONSPACE) ^ wordkit.mix(case)


def _repeated(h: np.ndarray, k: int = 3) -> int:
    """Words inside windows of ``k`` words that occur twice or more."""
    g = wordkit.grams(h, k)
    _, which, times = np.unique(g, return_inverse=True, return_counts=True)
    cover = np.zeros(len(h) + 1, dtype=np.int64)
    at = np.flatnonzero(times[which] > 1)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int(np.count_nonzero(np.cumsum(cover)))


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those among them that are equal to an earlier one."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _with_letter(raw: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> int:
    """Words that hold a letter (A-Z, a-z or any code point beyond ASCII)."""
    if not len(bounds[0]):
        return 0
    before = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    return int(np.count_nonzero(before[bounds[1]] > before[bounds[0]]))


_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])

#: What each part needs, and how it is computed.
PARTS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "raw": (("data",), lambda data: np.frombuffer(data, dtype=np.uint8)),
    "bounds": (("raw",), _bounds),
    "hashes": (("data", "raw", "bounds"), _hashes),
    "lines": (("data",), _lines),
    "n_words": (("bounds",), lambda bounds: len(bounds[0])),
    "word_chars": (("raw",), lambda raw: int(np.count_nonzero(wordkit.NONSPACE[raw] & ((raw & 0xC0) != 0x80)))),
    "n_symbols": (("raw",), lambda raw: int(np.count_nonzero(_SYMBOL[raw]))),
    "n_lines": (("lines",), lambda lines: lines[0]),
    "n_dup_lines": (("lines",), lambda lines: lines[1]),
    "n_repeat_words": (("hashes",), _repeated),
    "n_letter_words": (("raw", "bounds"), _with_letter),
    "n_capitals": (("raw",), lambda raw: int(np.count_nonzero((raw >= 0x41) & (raw <= 0x5A)))),
    "n_letters": (("raw",), lambda raw: int(np.count_nonzero(_LETTER[raw] & (raw < 0x80)))),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``rejects`` of the statistics ``needs``, in that order, is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., bool]


BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda repeated, n: 100 * repeated > 50 * n),
)
RULES = (
    *BASE,
    Rule("word_length", ("word_chars", "n_words"), lambda chars, n: n > 0 and not 3 * n <= chars <= 10 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda symbols, n: 10 * symbols > n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda repeated, n: 2 * repeated > n),
    Rule("few_letters", ("n_letter_words", "n_words"), lambda letters, n: 5 * letters < 4 * n),
    Rule("capitals", ("n_capitals", "n_letters"), lambda capitals, n: 2 * capitals > n),
)


def part(name: str, have: dict, spent: dict[str, float] | None = None):
    """One part of a text, computed with what it needs unless ``have`` holds it; ``spent`` adds up its own seconds."""
    if name not in have:
        needs, make = PARTS[name]
        args = [part(x, have, spent) for x in needs]
        began = time.perf_counter()
        have[name] = make(*args)
        if spent is not None:
            spent[name] = spent.get(name, 0.0) + time.perf_counter() - began
    return have[name]


def parts_of(names) -> set[str]:
    """All parts that the parts ``names`` are made of, themselves included."""
    return set().union(*({x} | parts_of(PARTS[x][0]) for x in names if x in PARTS))


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in column)


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, per_task: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """(part, seconds, rejected_by, texts) summed over the sample.

    Rows with a part say how long it took; rows with ``rejected_by``, a set of rules as bits,
    say how many texts are rejected by just these. A task stops reading after its share of the sample.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent: dict[str, float] = {}
        sets: dict[int, int] = {}
        left = per_task
        for batch in batches:
            for data in _texts(batch.column(0).slice(0, left)):
                have = {"data": data}
                bits = sum(bool(r.rejects(*(part(x, have, spent) for x in r.needs))) << i for i, r in enumerate(rules))
                sets[bits] = sets.get(bits, 0) + 1
            left -= batch.num_rows
            if left <= 0:
                break
        rows = [(name, s, None, 0) for name, s in spent.items()] + [(None, 0.0, bits, n) for bits, n in sets.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    names, types = ["part", "seconds", "rejected_by", "texts"], [pa.string(), pa.float64(), pa.int64(), pa.int64()]
    found = docs.select(F.encode(F.col(text_col), "UTF-8")).mapInArrow(measure, "part string, seconds double, rejected_by long, texts long")
    return found.groupBy("part", "rejected_by").agg(F.sum("seconds").alias("seconds"), F.sum("texts").alias("texts"))


def order(estimated: DataFrame, rules: tuple[Rule, ...] = RULES, given: tuple[str, ...] = ()) -> list[Rule]:
    """The rules by rejections per second, where ``given`` statistics are computed anyway.

    At most a row a part and one for each set of rules that a sampled text failed are read.
    """
    rows = estimated.collect()
    seconds = {r.part: r.seconds for r in rows if r.part is not None}
    sets = {r.rejected_by: r.texts for r in rows if r.part is None}
    left, done, out = list(range(len(rules))), parts_of(given), []
    while left:

        def gain(i: int) -> tuple[float, float, int]:
            cost = sum(seconds.get(x, 0.0) for x in parts_of(rules[i].needs) - done)
            rejected = sum(n for bits, n in sets.items() if bits >> i & 1)
            return (rejected / (cost + 1e-9), -cost, -i)

        best = max(left, key=gain)
        out.append(rules[best])
        left.remove(best)
        done |= parts_of(rules[best].needs)
        sets = {bits: n for bits, n in sets.items() if not bits >> best & 1}
    return out


def passes(have: dict, ordered: list[Rule]) -> bool:
    """Whether no rule rejects the text; stops at the first one that does."""
    return not any(r.rejects(*(part(x, have) for x in r.needs)) for r in ordered)


def verdicts(docs: DataFrame, ordered: list[Rule], given: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the statistics ``given`` and ``kept`` of every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in given]
            kept = []
            for data in _texts(batch.column(1)):
                have = {"data": data}
                for column, name in zip(columns, given, strict=True):
                    column.append(part(name, have))
                kept.append(passes(have, ordered))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.bool_())], names=[id_col, *given, "kept"])

    rows = docs.select(F.col(id_col), F.encode(F.col(text_col), "UTF-8"))
    schema = reduce(lambda s, name: s.add(name, "long"), given, rows.select(id_col).schema)
    return rows.mapInArrow(judge, schema.add("kept", "boolean"))


def keep(docs: DataFrame, ordered: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([passes({"data": x}, ordered) for x in _texts(pc.cast(batch.column(at), pa.binary()))], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
