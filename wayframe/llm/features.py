"""Hashed words, structure and size of whole texts as sparse rows for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import lowered, pieces, token_hashes, tokens

# Bounds of the bins of each structure figure; fixed values.
SHARES = np.array([0.0005, 0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.65, 0.9])
SIZES = 2.0 ** np.arange(0, 24)
BINS = 32
FIGURES = ("marks", "digits", "capitals", "spaces", "lines", "words", "word_bytes", "line_words", "distinct", "bytes")


@dataclass
class Sparse:
    """Rows of a sparse matrix: row k has columns at[start[k]:start[k + 1]] with values x."""

    start: np.ndarray
    at: np.ndarray
    x: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums by row of one value (or one vector) for each entry; empty rows give 0."""
        shape = (len(self.start) - 1, *values.shape[1:])
        out = np.zeros(shape, np.float64)
        full = np.flatnonzero(np.diff(self.start) > 0)
        if len(full):
            out[full] = np.add.reduceat(values, self.start[full], axis=0)
        return out


def _figures(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The bin of each structure figure for each text, as columns 0 .. BINS * figures."""
    n = len(offsets) - 1

    def count(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    size = np.diff(offsets)
    whole = np.maximum(size, 1)
    digit = (data >= 48) & (data <= 57)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    marks = ~(digit | upper | lower | blank | (data >= 128))
    lines = count(data == 10) + 1
    words = np.bincount(row, minlength=n)
    each = [np.searchsorted(SHARES, count(f) / whole) for f in (marks, digit, upper, blank)]
    each += [np.searchsorted(SIZES, v) for v in (lines, words, 4 * size / np.maximum(words, 1), words / lines)]
    each += [np.searchsorted(SHARES, distinct / np.maximum(words, 1)), np.searchsorted(SIZES, size)]
    return np.stack([BINS * k + np.minimum(v, BINS - 1) for k, v in enumerate(each)], 1)


def rows_of(column: pa.Array, bits: int, structure: bool) -> Iterator[tuple[int, int, Sparse]]:
    """(first row, row after the last, features) for bounded runs of texts.

    A text has one entry for each hashed word it holds.  With ``structure`` it also has one
    for each figure's bin, before the words', and the words are scaled to a length of 1.
    """
    base = BINS * len(FIGURES) if structure else 0
    for lo, hi, data, offsets in pieces(column):
        n = hi - lo
        low = lowered(data)
        start, end, row = tokens(low, offsets, runs=True)
        bucket = (token_hashes(low, start, end) >> np.uint64(64 - bits)).astype(np.int64)
        pair = np.unique((row.astype(np.int64) << bits) | bucket)
        row_of, at = pair >> bits, (pair & ((1 << bits) - 1)) + base
        distinct = np.bincount(row_of, minlength=n)
        x = np.ones(len(at), np.float32)
        if structure:
            x /= np.sqrt(np.maximum(distinct, 1))[row_of]
            bins = _figures(data, offsets, row, distinct)
            k = bins.shape[1]
            row_of = np.concatenate([np.repeat(np.arange(n), k), row_of])
            order = np.argsort(row_of, kind="stable")
            at = np.concatenate([bins.ravel(), at])[order]
            x = np.concatenate([np.full(n * k, 1 / np.sqrt(k), np.float32), x])[order]
            distinct = distinct + k
        yield lo, hi, Sparse(np.concatenate([[0], np.cumsum(distinct)]), at, x)


def bucket_of(key: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def spread(key: Column, seed: int) -> Column:
    """An order by which a sample is drawn: the same for the same ids, whatever the partitions."""
    return F.xxhash64(key, F.lit(seed))


def sample_features(docs: DataFrame, ids: DataFrame, bits: int, structure: bool, most: int) -> list[tuple[int, bytes, bytes, int]]:
    """(doc_id, columns, values, y) of the chosen documents, at most ``most`` rows.

    ``ids`` (doc_id, y) is bounded by its maker.  An id may stand at many rows: each of its different
    texts is taken once, and the first ``most`` by hashes of id and text, so that what is broadcast and what comes
    back is bounded whatever the ids are.
    """
    mark = F.xxhash64("text").alias("_h")
    named = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    keys = named.select("doc_id", "y", mark).distinct().orderBy(spread(F.col("doc_id"), 9), "_h", "y").limit(most)
    chosen = (docs.select("doc_id", "text", mark).join(F.broadcast(keys), ["doc_id", "_h"])
              .dropDuplicates(["doc_id", "_h", "y"]).select("doc_id", "text", "y"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, m in rows_of(batch.column(1), bits, structure):
                cuts = list(zip(m.start[:-1], m.start[1:]))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[lo:hi], pa.array([m.at[a:b].astype(np.int32).tobytes() for a, b in cuts], pa.binary()),
                    pa.array([m.x[a:b].tobytes() for a, b in cuts], pa.binary()), batch.column(2)[lo:hi]], ["doc_id", "at", "x", "y"])

    rows = chosen.mapInArrow(build, f"doc_id {dict(docs.dtypes)['doc_id']}, at binary, x binary, y int").collect()
    return sorted(rows, key=lambda r: (r["doc_id"], r["at"]))


def together(rows: list) -> Sparse:
    at = [np.frombuffer(r["at"], np.int32) for r in rows]
    x = [np.frombuffer(r["x"], np.float32) for r in rows]
    none = [np.zeros(0, np.int32)]
    return Sparse(np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int64),
                  np.concatenate(at or none), np.concatenate(x or [np.zeros(0, np.float32)]))


def scored(docs: DataFrame, score, bits: int, structure: bool) -> DataFrame:
    """(doc_id, score, predicted) of every document; ``score`` gives values in [0, 1] for a Sparse."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, m in rows_of(batch.column(1), bits, structure):
                p = score(m)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Adam:
    """Step sizes by running means of the gradient and its square."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        return self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.99 ** self.t)) + 1e-9)
