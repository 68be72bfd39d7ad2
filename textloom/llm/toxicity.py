"""Toxicity: cumulative-link ordinal regression on sparse text features (operator 10).

Grades 0 to 3 share one weight vector across the ordered thresholds:
P(grade >= j) = sigmoid(weights x - threshold_j). A score is the expected grade, the sum
of these probabilities. The label table only says toxic or not, so the grades of toxic
training rows come from how much evidence their words give: a first fit with one threshold
weighs it, the toxic rows are cut at its terciles, and the ordinal fit goes on from there.

Features are hashed words and the beginnings of longer words (so inflected forms share
one), each present or not, so one telling word counts in a long text as in a short one.
Features whose rows are not toxic for the most part are screened out before the fit, so the
grades of toxic rows say how much evidence there is, not what a judge of severity would.
It is fitted from at most ``bound`` labelled rows, one an id, which alone reach the driver.
Null, empty and wordless texts have no features and grade 0. Equal texts grade equally; very
long texts are read whole. Without toxic training rows nothing is rejected. An empty table
gives an empty result. Only named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import features, wordkit
from textloom.session import settle


@dataclass(frozen=True)
class Ordinal:
    """Production parameters; ``bound`` limits the labelled rows that are read for fitting."""

    dim: int = 1 << 30  # so many that features hardly share a place
    stems: range = range(4, 9)  # bytes of the beginnings of words
    bound: int = 8000
    sure: float = 0.3  # least share of toxic rows among those with a feature, by Wilson's lower bound
    steps: int = 600
    start: float = 0.5  # share of the log odds of a feature that its weight starts from
    l1: float = 1e-6
    grades: int = 3
    cut: float = 0.5
    seed: int = 10


def inputs(text: bytes | None, cfg: Ordinal) -> np.ndarray:
    """Distinct places of the features of a text."""
    found = np.concatenate(wordkit.words_and_stems(text, wordkit.ALNUM, cfg.stems))
    return np.unique((found & np.uint64(cfg.dim - 1)).astype(np.int32))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Training rows as flat arrays: entry i says that row ``row[i]`` has the feature ``used[col[i]]``."""

    toxic: np.ndarray
    row: np.ndarray
    col: np.ndarray
    used: np.ndarray
    odds: np.ndarray  # log odds of the features against those of all rows

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=len(self.toxic))

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, e[self.row], minlength=len(self.used))


def fit_ordinal(x: Rows, grade: np.ndarray, cfg: Ordinal, w: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds: Adam steps on the mean log loss from the given ones."""
    levels = len(theta)
    at_least = np.stack([(grade >= j + 1).astype(float) for j in range(levels)])
    m, s = np.zeros(len(w) + levels), np.zeros(len(w) + levels)
    for t in range(1, cfg.steps + 1):
        z = x.dot(w)
        e = (sigmoid(z[None, :] - theta[:, None]) - at_least) / max(1, len(x.toxic))
        g = np.concatenate([x.back(e.sum(axis=0)), -e.sum(axis=1)])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-5)
        w = w - step[: len(w)]
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.1 * cfg.l1 / (np.sqrt(s[: len(w)] / (1 - 0.99**t)) + 1e-5))
        theta = np.maximum.accumulate(theta - step[len(w) :])
    return w, theta


Model = tuple[np.ndarray, np.ndarray, np.ndarray]  # places in ascending order, their weights, the thresholds


def no_model(cfg: Ordinal) -> Model:
    """Grade 0 for every text."""
    return np.empty(0, dtype=np.int32), np.empty(0), np.full(cfg.grades, 30.0)


def fit(x: Rows, cfg: Ordinal) -> Model:
    """One threshold first, then all of them on grades of evidence."""
    share = x.toxic.mean()
    w, first = fit_ordinal(x, x.toxic, cfg, cfg.start * x.odds, np.array([1 - np.log(share / (1 - share))]))
    evidence = x.dot(w)
    cuts = np.quantile(evidence[x.toxic == 1], np.arange(1, cfg.grades) / cfg.grades)
    grade = np.where(x.toxic == 1, 1 + (evidence[:, None] > cuts).sum(axis=1), 0)
    w, theta = fit_ordinal(x, grade, cfg, w, np.maximum.accumulate(np.concatenate([first, cuts])))
    return x.used[w != 0], w[w != 0], theta


def train(docs: DataFrame, labels: DataFrame, cfg: Ordinal = Ordinal(), label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The fitted model. Features are made and screened on the executors; what they tell of at
    most ``bound`` labelled ids comes back."""
    rows = features.labelled(docs, labels, label, cfg.bound, cfg.seed, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([inputs(x.as_py(), cfg) for x in batch.column("text")], pa.list_(pa.int32()))], names=["id", "label", "place"])

    made = rows.select("id", "label", "text").mapInArrow(run, "id long, label int, place array<int>")
    made = settle(made.select(F.monotonically_increasing_id().alias("row"), "id", "label", "place"))
    marks = made.select("row", "id", "label").toArrow().sort_by([("id", "ascending"), ("row", "ascending")])
    toxic = np.minimum(marks.column("label").to_numpy(), 1)
    if not len(toxic) or not 0 < toxic.mean() < 1:
        return no_model(cfg)
    entries = made.select("row", F.explode("place").alias("place"), F.least("label", F.lit(1)).alias("label"))
    n, bad = F.col("n"), F.col("bad")
    p = bad / n
    low = (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)  # Wilson's bound at two deviations
    counts = entries.groupBy("place").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).filter("bad > 0").filter(low >= cfg.sure)
    telling = settle(counts)
    told = telling.toArrow().sort_by("place")
    if not told.num_rows:
        return no_model(cfg)
    used, n, bad = (told.column(c).to_numpy() for c in ("place", "n", "bad"))
    hits = entries.select("row", "place").join(telling.select("place"), "place").toArrow().sort_by([("row", "ascending"), ("place", "ascending")])
    names = marks.column("row").to_numpy()
    order = np.argsort(names)
    row = order[np.searchsorted(names[order], hits.column("row").to_numpy())]
    odds = np.log((bad + 0.2) / (n - bad + 0.2)) - np.log(toxic.mean() / (1 - toxic.mean()))
    return fit(Rows(toxic, row, np.searchsorted(used, hits.column("place").to_numpy()), used, odds), cfg)


def probabilities(text: bytes | None, model: Model, cfg: Ordinal) -> np.ndarray:
    """P(grade >= j) for each threshold."""
    places, weights, theta = model
    where = inputs(text, cfg)
    if not len(where):
        return np.zeros(cfg.grades)
    at = np.minimum(np.searchsorted(places, where), max(0, len(places) - 1))
    z = weights[at[places[at] == where]].sum() if len(places) else 0.0
    return sigmoid(z - theta)


def score(docs: DataFrame, model: Model, cfg: Ordinal = Ordinal(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (of grade 1 or more), grade and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [probabilities(x.as_py(), shared.value, cfg) for x in batch.column(1).cast(pa.large_binary())]
            cols = [batch.column(0), pa.array([float(x.sum()) for x in p], pa.float64()), pa.array([float(x[0]) for x in p], pa.float64()), pa.array([int((x >= cfg.cut).sum()) for x in p], pa.int32()), pa.array([bool(x[0] >= cfg.cut) for x in p], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "severity", "p_toxic", "grade", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Model, cfg: Ordinal = Ordinal(), text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; every column comes back as it was."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
            yield batch.filter(pa.array([bool(probabilities(x.as_py(), shared.value, cfg)[0] < cfg.cut) for x in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
