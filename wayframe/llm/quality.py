"""Quality by a factorisation machine over hashed words, structure and size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import BINS, FIGURES, Adam, Sparse, bucket_of, sample_features, scored, sigmoid, spread, together
from .registry import query, table

BITS = 16
FOLDS = 3
FACTORS = 8
# Most labelled texts of each class that the machine is fitted on.
SAMPLE = 3_000
STEPS = 60
DECAY = 1e-4


def interactions(m: Sparse, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of all pairwise products, by half of (square of the sum minus sum of the squares), and the sums."""
    each = v[m.at] * m.x[:, None]
    total = m.sums(each)
    return 0.5 * ((total ** 2).sum(1) - m.sums(each ** 2).sum(1)), total


def fit(m: Sparse, y: np.ndarray, width: int, factors: int = FACTORS, steps: int = STEPS, decay: float = DECAY) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by logistic loss with both classes weighing the same."""
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    bias, w = 0.0, np.zeros(width)
    v = np.random.default_rng(5).normal(0, 0.05, (width, factors))
    if not len(y):
        return bias, w, v
    if not (y == 0).any() or not (y == 1).any():
        return (4.0 if (y == 1).any() else -4.0), w, v * 0
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    row = m.row()
    # Only columns that occur are moved.
    seen, at = np.unique(m.at, return_inverse=True)
    part, ws, vs = Sparse(m.start, at, m.x), np.zeros(len(seen)), v[seen]
    moves = Adam((), 0.1), Adam(len(seen), 0.1), Adam((len(seen), factors), 0.05)
    for _ in range(steps):
        pairs, total = interactions(part, vs)
        g = (sigmoid(bias + part.sums(ws[at] * m.x) + pairs) - y) * weight
        gx = g[row] * m.x
        gw = np.bincount(at, gx, len(seen))
        square = np.bincount(at, gx * m.x, len(seen))
        gv = np.stack([np.bincount(at, gx * total[row, k], len(seen)) for k in range(factors)], 1) - vs * square[:, None]
        bias -= float(moves[0].step(g.sum()))
        ws -= moves[1].step(gw + decay * ws)
        vs -= moves[2].step(gv + decay * vs)
    w[seen], v[seen] = ws, vs
    # Words that no labelled text holds say nothing.
    rest = np.ones(width, bool)
    rest[seen] = False
    v[rest] = 0
    return bias, w, v


def model(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = FOLDS, bits: int = BITS, sample: int = SAMPLE):
    """Fit on ``labels`` outside ``fold``, at most ``sample`` of each class drawn by a hash of the id; returns a scoring function."""
    known = labels.filter((bucket_of(F.col("doc_id"), folds) != fold) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    ids = None
    for y in (0, 1):
        one = known.filter(F.col("y") == y).orderBy(spread(F.col("doc_id"), 9), "doc_id").limit(sample)
        ids = one if ids is None else ids.unionByName(one)
    rows = sample_features(docs, ids, bits, structure=True, most=2 * sample)
    bias, w, v = fit(together(rows), np.array([r["y"] for r in rows], float), (1 << bits) + BINS * len(FIGURES))
    held = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), v.astype(np.float32)))  # 2.4 MB, whatever the input

    def score(m: Sparse) -> np.ndarray:
        ws, vs = held.value
        return sigmoid(bias + m.sums(ws[m.at] * m.x) + interactions(m, vs)[0])

    return score


def score(docs: DataFrame, labels: DataFrame, fold: int = 1, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document from its whole text.

    The classes weigh the same in fitting.  Empty and null texts are scored by their structure
    alone.  Repeated rows are scored each.  Without labels every score is 0.5; with one class
    only it is near that class.
    """
    out = scored(docs, model(docs, labels, fold, folds), BITS, structure=True)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), folds) == fold).alias("held_out"), "score", "predicted")


@query("op5_quality")
def op5(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
