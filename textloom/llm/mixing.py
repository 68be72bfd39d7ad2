"""Mixing sources to target weights by iterative proportional fitting (operator 7).

Token weights of the cells (source, language, topic) are raked until the weighted shares
of each source, language and topic meet their targets; by default a target is the share
found, raised to ``temper`` and made to sum to one, which flattens a hot source. Sweeps go
on until no marginal is further than ``tolerance`` from its target. Targets can be given as
tables (value, share), one a dimension; a value that such a table lacks has share 0. The inclusion
probabilities are raked likewise, to the same shares of the ``budget``: cells at probability
one stay there and the others make up for them. What a value has too few tokens for, even
with all of them drawn, goes to the other values of its dimension in proportion to their
targets. An error that no sweep can lessen stands in every row (``weight_error``,
``probability_error``: the largest relative error of a marginal), is logged, or raised if
``strict``. Each row is drawn by a seeded hash of its id and text.

The topic is told by the form of a text (fragment, table, shout, noise, long, prose)
unless a column is named. Cells are summed before they are moved; the raking works on
cells alone, so a hot source is one row a language and topic there.

Nulls: a null source, language or topic is a value of its own; a null text has no tokens
and is always kept, as are other rows without tokens. Repeated rows are drawn alike. Very
long texts count with all their tokens. An empty table gives an empty result. The input's
columns travel in one struct, so no name of theirs can clash.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import settle

WORD = "[^\\x20\\x09-\\x0D]+"
BOUNDS = (1e-12, 1e12)
DIMS = ("source", "lang", "topic")
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Mix:
    temper: float = 0.7
    budget: float = 0.75
    sweeps: int = 1000  # at most
    tolerance: float = 1e-6  # of each marginal, relative
    strict: bool = False
    seed: int = 7
    broadcast_cells: int = 100_000


def topic_of(words: Column, pipes: Column, capitals: Column, marks: Column) -> Column:
    """The form of a text, from the counts that ``measured`` makes."""
    return F.when(words < 20, "fragment").when(pipes * 5 >= words, "table").when(capitals * 2 >= words, "shout").when(marks * 3 >= words, "noise").when(words >= 1500, "long").otherwise("prose")


def measured(docs: DataFrame, cfg: Mix, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None) -> DataFrame:
    """(row, source, lang, topic, tokens, draw): all columns of a row, and a draw uniform in [0, 1)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(cfg.seed), F.col(id_col), F.col(text_col)), 11).cast("double") / 2.0**53
    counts = {"tokens": WORD} | ({} if topic_col else {"pipes": "\\|", "capitals": "[A-ZÀ-Þ]{2,}", "marks": "[#$%&*!]{2,}"})
    named = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": F.col(topic_col) if topic_col else F.lit(None), "draw": draw}
    # Counted one projection below their use, so that each pattern runs once a row.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(x.alias(n) for n, x in named.items()), *(F.regexp_count(text, F.lit(pattern)).cast("long").alias(n) for n, pattern in counts.items()))
    return rows.select("row", "source", "lang", (F.col("topic") if topic_col else topic_of(*(F.col(c) for c in counts))).alias("topic"), "tokens", "draw")


Targets = dict[str, DataFrame]


def cells_of(rows: DataFrame, targets: Targets | None = None) -> DataFrame:
    """(source, lang, topic, tokens) of the cells that hold tokens, and share_* of the dimensions with given targets."""
    cells = settle(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    for dim, given in (targets or {}).items():
        if dim not in DIMS:
            raise ValueError(f"no dimension {dim}")
        given = given.groupBy(F.col("value").alias("v")).agg(F.greatest(F.sum("share"), F.lit(0.0)).cast("double").alias("s"))
        cells = cells.join(given, cells[dim].eqNullSafe(given["v"]), "left").withColumn(f"share_{dim}", F.coalesce("s", F.lit(0.0))).drop("v", "s")
    return settle(cells) if targets else cells


def reached(budget: float, sums: Callable[[float], tuple[float, float]]) -> float:
    """The ``a`` with sum(min(t, a * p)) = budget; ``sums(a)`` gives the t at their cap and the p below."""
    a = -1.0
    held, free = sums(0.0)
    while free > 0 and (new := (budget - held) / free) > a * (1 + 1e-12):
        a = new
        held, free = sums(a)
    return a if free > 0 else math.inf


class Arrays:
    """Few cells, raked on the driver."""

    def __init__(self, cells: DataFrame, cfg: Mix) -> None:
        self.table, self.spark, self.cfg = cells.toArrow(), cells.sparkSession, cfg
        self.tokens = self.table["tokens"].to_numpy().astype(float)
        self.codes = [self.table[d].combine_chunks().dictionary_encode("encode").indices.to_numpy() for d in DIMS] + [np.zeros(len(self.tokens), int)]
        self.f = np.ones(len(self.tokens))
        self.columns: dict[str, np.ndarray] = {}

    def powers(self, d: int, t: np.ndarray) -> np.ndarray:
        """What the targets of a dimension are in proportion to."""
        name = f"share_{DIMS[d]}" if d < len(DIMS) else ""
        if name not in self.table.column_names:
            return t**self.cfg.temper
        p = np.zeros(len(t))
        p[self.codes[d]] = self.table[name].to_numpy()
        if not p.sum():
            raise ValueError(f"no target of {DIMS[d]} has tokens")
        return p

    def aim(self, budget: float, capped: bool) -> None:
        self.targets, self.floor = [], 1e-6 * budget
        for d, code in enumerate(self.codes):
            t = np.bincount(code, self.tokens)
            p = self.powers(d, t)
            a = reached(budget, lambda a: (t[a * p >= t].sum(), p[a * p < t].sum())) if capped else budget / p.sum()
            self.targets.append(np.minimum(t, np.minimum(a, 1e300) * p) if capped else a * p)

    def sweep(self, dims: list[int], capped: bool) -> None:
        for d in dims:
            code, target = self.codes[d], self.targets[d]
            have = np.bincount(code, self.tokens * (np.minimum(1, self.f) if capped else self.f))
            full = np.bincount(code, self.tokens * (self.f >= 1)) if capped else 0 * have
            free = have - full
            with np.errstate(all="ignore"):
                ratio = np.where((free > 1e-9 * have) & (target > full), (target - full) / free, target / have)
            self.f = np.clip(self.f * ratio[code], *BOUNDS)

    def residual(self, dims: list[int], capped: bool) -> float:
        x = self.tokens * (np.minimum(1, self.f) if capped else self.f)
        return max(float((np.abs(np.bincount(self.codes[d], x) - self.targets[d]) / np.maximum(self.targets[d], self.floor)).max()) for d in dims)

    def keep(self, name: str, capped: bool) -> None:
        self.columns[name] = np.minimum(1, self.f) if capped else self.f.copy()

    def frame(self) -> DataFrame:
        out = self.table.select(list(DIMS))
        for name, values in self.columns.items():
            out = out.append_column(name, pa.array(values))
        return self.spark.createDataFrame(out)


class Frames:
    """Any number of cells, raked by Spark; the lineage is cut after every step."""

    def __init__(self, cells: DataFrame, cfg: Mix) -> None:
        self.cfg, self.names = cfg, [*DIMS, "__all"]
        self.cells = cells.withColumns({"__all": F.lit(0), "f": F.lit(1.0)})
        self.floor = 0.0

    def aim(self, budget: float, capped: bool) -> None:
        cells = self.cells.drop(*(f"target_{d}" for d in self.names))
        self.floor = 1e-6 * budget
        for dim in self.names:
            given = f"share_{dim}" in cells.columns
            p = F.first(f"share_{dim}") if given else F.pow(F.sum("tokens").cast("double"), F.lit(self.cfg.temper))
            sums = settle(cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"), p.alias("p")))
            if given and not sums.agg(F.sum("p")).first()[0]:
                raise ValueError(f"no target of {dim} has tokens")
            held = lambda a: sums.agg(F.coalesce(F.sum(F.when(F.col("p") * a >= F.col("t"), F.col("t"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("p") * a < F.col("t"), F.col("p"))), F.lit(0.0))).first()  # noqa: E731, B023
            a = reached(budget, held) if capped else budget / sums.agg(F.sum("p")).first()[0]
            target = F.least("t", F.col("p") * min(a, 1e300)) if capped else F.col("p") * a
            sums = sums.select(F.col(dim).alias("v"), target.alias(f"target_{dim}"))
            cells = cells.join(sums, cells[dim].eqNullSafe(sums["v"])).drop("v")
        self.cells = settle(cells)

    def held(self, capped: bool) -> Column:
        return F.col("tokens") * (F.least(F.lit(1.0), F.col("f")) if capped else F.col("f"))

    def sums(self, dim: str, capped: bool) -> DataFrame:
        """(v, have, full): partial sums, so that one hot value is not one task."""
        full = F.sum(F.when(F.col("f") >= 1, F.col("tokens")).otherwise(0).cast("double")) if capped else F.lit(0.0)
        return self.cells.groupBy(F.col(dim).alias("v")).agg(F.sum(self.held(capped)).alias("have"), full.alias("full"), F.first(f"target_{dim}").alias("target"))

    def sweep(self, dims: list[int], capped: bool) -> None:
        for d in dims:
            dim, free = self.names[d], F.col("have") - F.col("full")
            ratio = F.when((free > 1e-9 * F.col("have")) & (F.col("target") > F.col("full")), (F.col("target") - F.col("full")) / free).otherwise(F.col("target") / F.col("have"))
            sums = self.sums(dim, capped).select("v", ratio.alias("ratio"))
            f = F.greatest(F.lit(BOUNDS[0]), F.least(F.lit(BOUNDS[1]), F.col("f") * F.col("ratio")))
            self.cells = settle(self.cells.join(sums, self.cells[dim].eqNullSafe(sums["v"])).withColumn("f", f).drop("v", "ratio"))

    def residual(self, dims: list[int], capped: bool) -> float:
        return max(self.sums(self.names[d], capped).agg(F.max(F.abs(F.col("have") - F.col("target")) / F.greatest("target", F.lit(self.floor)))).first()[0] for d in dims)

    def keep(self, name: str, capped: bool) -> None:
        self.cells = self.cells.withColumn(name, F.least(F.lit(1.0), F.col("f")) if capped else F.col("f"))

    def frame(self) -> DataFrame:
        return self.cells.select(*DIMS, "factor", "probability")


def rake(cells: Arrays | Frames, dims: list[int], capped: bool, cfg: Mix) -> float:
    """Sweeps until all marginals of ``dims`` are met; the largest relative error that is left.

    It gives up if 20 sweeps do not lessen the error by a hundredth, as where targets of two
    dimensions contradict each other.
    """
    errors = [cells.residual(dims, capped)]
    while errors[-1] > cfg.tolerance and len(errors) <= cfg.sweeps:
        cells.sweep(dims, capped)
        errors.append(cells.residual(dims, capped))
        if len(errors) > 40 and min(errors[-20:]) > 0.99 * min(errors[:-20]):
            break
    return errors[-1]


def fitted(found: DataFrame, cfg: Mix) -> tuple[DataFrame, dict[str, float]]:
    """``found`` with ``factor`` and ``probability`` of each cell, and the errors left of both."""
    n, whole = found.agg(F.count("*"), F.sum("tokens")).first()
    if not n:
        return found.select(*DIMS, F.lit(1.0).alias("factor"), F.lit(1.0).alias("probability")), {}
    cells, each, errors = (Arrays if n <= cfg.broadcast_cells else Frames)(found, cfg), [0, 1, 2], {}
    cells.aim(float(whole), False)
    errors["weight"] = rake(cells, each, False, cfg)
    cells.keep("factor", False)
    cells.aim(min(1.0, cfg.budget) * whole, True)
    rake(cells, [3], True, cfg)
    errors["probability"] = rake(cells, each, True, cfg)
    rake(cells, [3], True, cfg)  # the budget holds even where a marginal does not
    errors["probability"] = max(errors["probability"], cells.residual(each, True))
    cells.keep("probability", True)
    for name, error in errors.items():
        if error > 2 * cfg.tolerance and cfg.strict:
            raise ValueError(f"mixing: a marginal of the {name} is {error:.3g} off its target")
        if error > 2 * cfg.tolerance:
            log.warning("mixing: a marginal of the %s is %.3g off its target", name, error)
    return cells.frame(), errors


def drawn(rows: DataFrame, cfg: Mix, targets: Targets | None = None) -> DataFrame:
    """``rows`` with weight, probability and sampled of their cell, and the errors that the raking left."""
    made, errors = fitted(cells_of(rows, targets), cfg)
    found = settle(made).select(*(F.col(d).alias(f"c_{d}") for d in DIMS), F.col("factor").alias("weight"), "probability")
    cells = F.broadcast(found) if found.count() <= cfg.broadcast_cells else found
    on = [rows[d].eqNullSafe(found[f"c_{d}"]) for d in DIMS]
    keep = (F.col("tokens") == 0) | F.coalesce(F.col("draw") < F.col("probability"), F.lit(True))
    left = {f"{name}_error": F.lit(errors.get(name, 0.0)) for name in ("weight", "probability")}
    return rows.join(cells, on, "left").drop(*(f"c_{d}" for d in DIMS)).withColumns({"sampled": keep, **left})


def mix(docs: DataFrame, cfg: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: Targets | None = None) -> DataFrame:
    """Per row: doc_id, source, lang, topic, tokens, weight, probability, sampled, weight_error, probability_error."""
    used = docs.select(*dict.fromkeys(c for c in (id_col, text_col, source_col, lang_col, topic_col) if c))
    rows = measured(used, cfg, id_col, text_col, source_col, lang_col, topic_col).select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), *DIMS, "tokens", "draw")
    return drawn(settle(rows), cfg, targets).select("doc_id", *DIMS, "tokens", "weight", "probability", "sampled", "weight_error", "probability_error")  # the texts are read once


def keep_drawn(docs: DataFrame, cfg: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: Targets | None = None) -> DataFrame:
    """The rows of ``docs`` that are drawn; every column comes back as it was."""
    rows = measured(docs, cfg, id_col, text_col, source_col, lang_col, topic_col)
    return drawn(rows, cfg, targets).filter("sampled").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
