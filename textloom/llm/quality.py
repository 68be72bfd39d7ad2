"""Quality classifier: a factorisation machine (operator 5).

Inputs of a score are hashed words, structure statistics and metadata that the text itself
gives (its length, lines, share of non-ASCII bytes). Pairwise interactions have low rank
and are summed in linear time: half of (sum of v x)^2 - sum of (v x)^2 in each factor.
Label, language, source and id are no inputs.

It is fitted on the driver from at most ``bound`` labelled rows, one an id; rows whose
crc32(id as text) mod 5 is 0 never take part, neither in the fit nor in the choice of its
parameters: one in five of the training rows, drawn by a seed, is kept aside, and the epoch
with the least loss on these decides. Null and empty texts have features of zero and get
the score of the bias. Without labelled rows of both kinds the score is the share of label
1 (0.5 without any). Equal texts have equal scores; very long texts are read whole. An empty
table gives an empty result. Only named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import features


@dataclass(frozen=True)
class Machine:
    """Production parameters; ``bound`` limits the labelled rows that are read for fitting."""

    dim: int = 1 << 15
    rank: int = 6
    bound: int = 12000
    epochs: int = 12
    updates: int = 600  # at least; few rows are gone through more often
    rate: float = 0.2
    aside: float = 0.2  # share of the training rows that choose the epoch
    decay: float = 1e-4
    seed: int = 5


def inputs(text: bytes | None, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the non-zero inputs: words of unit length, then statistics."""
    where, often, n = features.hashed(text, dim)
    value = np.log1p(often)
    norm = np.sqrt((value * value).sum()) or 1.0
    stats = features.structure(text)
    return np.concatenate([where, dim + np.arange(len(stats))]), np.concatenate([value / norm, stats])


def raw_score(where: np.ndarray, value: np.ndarray, model: tuple) -> float:
    bias, w, v = model
    linear = (v[where] * value[:, None]).sum(axis=0)
    square = (v[where] ** 2 * (value * value)[:, None]).sum(axis=0)
    return float(bias + w[where] @ value + 0.5 * (linear @ linear - square.sum()))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _dense(part: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(used places, values, labels) of a few rows."""
    used, column = np.unique(np.concatenate([r[0] for r in part]), return_inverse=True)
    x = np.zeros((len(part), len(used)))
    x[np.repeat(np.arange(len(part)), [len(r[0]) for r in part]), column] = np.concatenate([r[1] for r in part])
    return used, x, np.array([r[2] for r in part], dtype=float)


def _loss(rows: list, model: tuple, eps: float = 1e-9) -> float:
    p = np.array([sigmoid(raw_score(where, value, model)) for where, value, _ in rows])
    y = np.array([r[2] for r in rows])
    return float(-np.mean(y * np.log(p + eps) + (1 - y) * np.log(1 - p + eps)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], cfg: Machine) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss, in a seeded order; the epoch that does best on rows kept aside."""
    rng = np.random.default_rng(cfg.seed)
    size = cfg.dim + len(features.STATS)
    share = float(np.mean([r[2] for r in rows])) if rows else 0.5
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, cfg.rank))
    bias = float(np.log(min(max(share, 0.01), 0.99) / (1 - min(max(share, 0.01), 0.99))))
    if not rows or not 0 < share < 1:
        return bias, w, np.zeros_like(v)
    order = rng.permutation(len(rows))
    aside = [rows[i] for i in order[: int(cfg.aside * len(rows))]]
    rows = [rows[i] for i in order[len(aside) :]]
    gb, gw, gv = 1e-2, np.full(size, 1e-2), np.full((size, cfg.rank), 1e-2)
    best = (np.inf, None)
    for _ in range(max(cfg.epochs, -(-cfg.updates // -(-len(rows) // 128)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            used, x, y = _dense([rows[i] for i in order[at : at + 128]])
            vu = v[used]
            xv, x2 = x @ vu, x * x
            z = bias + x @ w[used] + 0.5 * ((xv * xv).sum(1) - (x2 @ (vu * vu)).sum(1))
            e = (sigmoid(z) - y) / len(y)
            dw = x.T @ e + cfg.decay * w[used]
            dv = x.T @ (e[:, None] * xv) - vu * (x2.T @ e)[:, None] + cfg.decay * vu
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += e.sum() ** 2
            bias -= cfg.rate * e.sum() / np.sqrt(gb)
            w[used] -= cfg.rate * dw / np.sqrt(gw[used])
            v[used] -= cfg.rate * dv / np.sqrt(gv[used])
        loss = _loss(aside, (bias, w, v)) if aside else 0.0
        if not loss >= best[0] or best[1] is None:
            best = (loss, (bias, w.copy(), v.copy()))
    return best[1]


def held_out(id_col: str) -> Column:
    """True where crc32 of the id's text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, cfg: Machine = Machine(), label: str = "quality", id_col: str = "doc_id", text_col: str = "text"):
    """The fitted machine. Features are made on the executors, at most ``bound`` rows come back."""
    rows = features.labelled(docs, labels, label, cfg.bound, cfg.seed, id_col, text_col, keep=lambda c: ~held_out(id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [inputs(x.as_py(), cfg.dim) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x[0].astype(np.int32) for x in made], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in made], pa.list_(pa.float32()))], names=["id", "label", "place", "value"])

    table = rows.select("id", "label", "text").mapInArrow(run, "id long, label int, place array<int>, value array<float>").toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    place, value, mark = (table.column(c) for c in ("place", "value", "label"))
    return fit([(p.values.to_numpy(zero_copy_only=False).astype(np.int64), v.values.to_numpy(zero_copy_only=False).astype(float), m.as_py()) for p, v, m in zip(place, value, mark, strict=True)], cfg)


def score(docs: DataFrame, model: tuple, cfg: Machine = Machine(), cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [float(sigmoid(raw_score(*inputs(x.as_py(), cfg.dim), shared.value))) for x in batch.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
