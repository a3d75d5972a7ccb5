"""Toxicity by non-negative learning from confirmed toxic and unlabelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Adam, Sparse, bucket_of, rows_of, sample_features, scored, sigmoid, spread, together
from .registry import query, table

BITS = 18
FOLDS = 5
# Most texts the classifier is fitted on: confirmed toxic ones, and others whose labels are not looked at.
POSITIVES = 4_000
UNLABELLED = 8_000
STEPS = 400
DECAY = 2e-5
# How many standard errors a word's share of the toxic texts must lie from its share of the others to be looked at.
APART = 5.0


def telling(positive: Sparse, unlabelled: Sparse, width: int, apart: float = APART) -> np.ndarray:
    """Which hashed words are clearly more or less frequent in toxic texts; the rest would be learned by heart."""
    n, m = max(1, len(positive.start) - 1), max(1, len(unlabelled.start) - 1)
    a, b = (np.bincount(side.at, minlength=width) for side in (positive, unlabelled))
    both = (a + b + 1) / (n + m + 2)
    return np.abs(a / n - b / m) > apart * np.sqrt(both * (1 - both) * (1 / n + 1 / m))


def only(m: Sparse, keep: np.ndarray) -> Sparse:
    held = keep[m.at]
    return Sparse(np.concatenate([[0], np.cumsum(held)])[m.start], m.at[held], m.x[held])


def fit(positive: Sparse, unlabelled: Sparse, prior: float, width: int, steps: int = STEPS, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Weights and bias with the least non-negative risk.

    The risk of calling an unlabelled text clean holds ``prior`` times that of calling a toxic
    one clean.  With that part taken out it cannot be under 0; where the estimate is, only
    its way back up is followed.
    """
    w, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    if not len(positive.start) - 1:
        return w, bias
    keep = telling(positive, unlabelled, width)
    positive, unlabelled = only(positive, keep), only(unlabelled, keep)
    move, move_bias = Adam(width, 0.1), Adam((), 0.05)
    parts = [(m, max(1, len(m.start) - 1)) for m in (positive, unlabelled)]
    rows = [m.row() for m, _ in parts]
    for _ in range(steps):
        z = [m.sums(w[m.at]) + bias for m, _ in parts]
        p = [sigmoid(v) for v in z]
        # Logistic loss: of toxic texts called toxic and called clean, and of unlabelled ones called clean.
        clean = [np.logaddexp(0, v).sum() / n for v, (_, n) in zip(z, parts)]
        up = prior * (p[0] - 1) / parts[0][1]
        back = -prior * p[0] / parts[0][1], p[1] / parts[1][1]
        short = clean[1] - prior * clean[0] < 0
        g = [up - back[0], -back[1]] if short else [up + back[0], back[1]]
        grad = sum(np.bincount(m.at, v[r], width) for (m, _), r, v in zip(parts, rows, g)) + decay * w
        w -= move.step(grad) * (grad != 0)
        bias -= float(move_bias.step(np.float64(sum(v.sum() for v in g))))
    return w, bias


def model(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = FOLDS, bits: int = BITS,
          positives: int = POSITIVES, unlabelled: int = UNLABELLED):
    """Fit on ``labels`` outside ``fold``; returns a function from features to scores.

    The prior is the share of toxic rows among those labels, all of them counted.  The sample
    is drawn by a hash of the id, at most ``positives`` toxic and ``unlabelled`` other texts.
    Without a toxic label every score is the prior's.
    """
    known = labels.filter((bucket_of(F.col("doc_id"), folds) != fold) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    count = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("toxic")).first()
    prior = min(0.5, max(1e-4, (count["toxic"] + 0.5) / (count["n"] + 1)))
    toxic = known.filter("toxic = 1").select("doc_id").distinct().orderBy(spread(F.col("doc_id"), 7), "doc_id").limit(positives)
    others = docs.select("doc_id").filter(bucket_of(F.col("doc_id"), folds) != fold).distinct().orderBy(spread(F.col("doc_id"), 8), "doc_id").limit(unlabelled)
    ids = toxic.withColumn("y", F.lit(1)).unionByName(others.withColumn("y", F.lit(0)))
    rows = sample_features(docs, ids, bits, structure=False, most=positives + unlabelled)
    sides = [together([r for r in rows if r["y"] == y]) for y in (1, 0)]
    w, bias = fit(*sides, prior, 1 << bits)
    held = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))  # 1 MB, whatever the input
    return lambda m: sigmoid(m.sums(held.value[m.at]) + bias)


def score(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document from its whole text.

    Empty and null texts have no words and get the score of the bias.  Repeated rows are
    scored each; copies get equal scores.  Null labels are not learned from.
    """
    out = scored(docs, model(docs, labels, fold, folds), BITS, structure=False)
    return out.select("doc_id", (bucket_of(F.col("doc_id"), folds) == fold).alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = FOLDS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; nothing is shuffled for it."""
    rate, at = model(docs, labels, fold, folds), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo, hi, m in rows_of(batch.column(at), BITS, structure=False):
                yield batch.slice(lo, hi - lo).filter(pa.array(rate(m) < 0.5))

    return docs.mapInArrow(run, docs.schema)


@query("op7_toxicity")
def op7(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
