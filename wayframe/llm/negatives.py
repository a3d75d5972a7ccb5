"""Hard negatives by the threshold algorithm on sorted components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut
from .registry import query, table

# Components of a block of candidates and of a block of anchors: what one task holds at a time.
CELLS = 1 << 20
ANCHOR_CELLS = 1 << 16
# Depth of the first round of sorted access, and its growth.
DEPTH = 32
GROW = 1.5
# Sums below this are the same in floating point as in whole numbers.
EXACT = 1 << 53


class Lists:
    """A block of candidates with one list per dimension, sorted by component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.ascontiguousarray(np.take_along_axis(rows, self.order.T.astype(np.int64), 0).T)
        self.largest = int(np.abs(rows).max(initial=0))
        self.floats = rows.astype(np.float64)

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Random access: the whole inner products of some rows."""
        if self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < EXACT:
            return (self.floats[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ anchor


def best(lists: Lists, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the first ``k`` fitting rows of each window of scores (least, most), both included.

    Each round reads every list further down by the same number of places: lists with a positive
    component of the anchor from their largest value, those with a negative one from their least,
    none where it is 0.  Rows that come up are scored whole.  The threshold is the anchor's product
    with the values last read; no row that has not come up can score more.  Rounds end once it is
    strictly below the k-th score of every window (equal scores go to smaller ids, so a row that
    ties with it may still count), where a window that is not full counts with its least score.
    """
    n = len(lists.ids)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    seen = np.zeros(n, bool)
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    depth, step = 0, DEPTH
    while depth < n:
        till = min(n, depth + step)
        come = np.concatenate([lists.order[up, n - till:n - depth].ravel(), lists.order[down, depth:till].ravel()]) if len(up) + len(down) else np.arange(n)
        new = np.zeros(n, bool)
        new[come] = True
        new &= ~seen
        seen |= new
        at = np.flatnonzero(new & fits)
        scores = lists.scores(at, anchor)
        for w, (least, most) in enumerate(windows):
            into = (scores >= least) & (scores <= most)
            ids, got = np.concatenate([kept[w][0], lists.ids[at[into]]]), np.concatenate([kept[w][1], scores[into]])
            first = np.lexsort((ids, -got))[:k]
            kept[w] = ids[first], got[first]
        # The last values read, as Python integers: they cannot overflow.
        threshold = (sum(int(a) * int(x) for a, x in zip(anchor[up], lists.sorted[up, n - till])) + sum(int(a) * int(x) for a, x in zip(anchor[down], lists.sorted[down, till - 1])))
        if all(threshold < (int(got[-1]) if len(got) == k else least) for (least, _), (_, got) in zip(windows, kept)) or not len(up) + len(down):
            break
        depth, step = till, int(step * GROW)
    return kept


def usable(vectors: DataFrame) -> DataFrame:
    """(dim, vec_id, label, _v): one row for each id, with whole-numbered components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # Beyond this a product of two rows might not fit in a long.
    held = F.forall("_x", lambda c: F.abs(c) * 256 < F.floor(F.sqrt(F.lit(2.0 ** 62) / F.size("_x"))))
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label").cast("bigint") + 1, F.lit(10))).otherwise(F.col("label").cast("bigint"))
    rows = (vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.alias("label"), x.alias("_x"))
            .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("_x").isNotNull() & (F.size("_x") > 0) & good).filter(held))
    whole = rows.select("vec_id", F.struct("label", F.transform("_x", lambda c: F.floor(c * 256).cast("bigint")).alias("_v")).alias("_row"))
    return whole.groupBy("vec_id").agg(F.min("_row").alias("_row")).select(F.size("_row._v").alias("dim"), "vec_id", "_row.label", "_row._v")


def _packed(rows: DataFrame, keys: dict[str, str], marks: Column | None = None) -> DataFrame:
    """One row for each group of ``keys``, which must hold a bounded number of rows: ids, labels, components and wanted windows as bytes."""
    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("vec_id").to_numpy(), kind="stable")
        values = [group.column(c).to_numpy()[order] for c in ("vec_id", "_label")]
        values += [group.column(c).combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order] for c in ("_v", "_marks")]
        head = {k: pa.array([group.column(k)[0].as_py()], group.schema.field(k).type) for k in keys}
        return pa.table(head | {c: pa.array([np.ascontiguousarray(v, np.int64).tobytes()], pa.binary()) for c, v in zip(("ids", "labels", "packed", "marks"), values)})

    none = F.array().cast("array<bigint>") if marks is None else marks
    schema = ", ".join(f"{k} {t}" for k, t in keys.items()) + ", ids binary, labels binary, packed binary, marks binary"
    return rows.select(*keys, "vec_id", F.col("label").alias("_label"), "_v", none.alias("_marks")).groupBy(*keys).applyInArrow(pack, schema)


def _dealt(rows: DataFrame, by: list[str], cells: int, name: str) -> DataFrame:
    """``rows`` with a number ``name`` that parts each group of ``by`` (with dim) by a hash of the id into bounded blocks."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.ceil(F.col("_n") * F.col("dim") / cells).cast("int").alias(f"{name}s"))
    return rows.join(counts, by).withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(f"{name}s")).cast("int"))


def _answers(found: DataFrame, same: bool, k: int) -> DataFrame:
    """Search every block of candidates for the anchors beside it."""
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists = None, None
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for row in range(batch.num_rows):
                dim = cols["dim"][row].as_py()
                of = {c: np.frombuffer(cols[c][row].as_py(), np.int64) for c in ("ids", "labels", "a_ids", "a_labels", "a_marks")}
                if key != (held := (dim, cols["ids"][row].as_py())):  # the rows of a block come one after another
                    key, lists = held, Lists(of["ids"], of["labels"], np.frombuffer(cols["packed"][row].as_py(), np.int64).reshape(-1, dim))
                anchors = np.frombuffer(cols["a_packed"][row].as_py(), np.int64).reshape(-1, dim)
                marks = of["a_marks"].reshape(len(anchors), -1)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for a, anchor in enumerate(anchors):
                    alike = lists.labels == of["a_labels"][a]
                    fits = alike & (lists.ids != of["a_ids"][a]) if same else ~alike
                    # -(-4 x // 5) is the least whole number that is not under 0.8 x.
                    tops = [int(m) for m in dict.fromkeys(marks[a].tolist()) if m >= 0]
                    windows = [(-(1 << 63), 1 << 63)] if same else [(-(-4 * m // 5), m) for m in tops]
                    for w, (ids, scores) in enumerate(best(lists, anchor, fits, windows, k) if windows else []):
                        for c, v in enumerate((np.full(len(ids), of["a_ids"][a]), np.full(len(ids), 0 if same else tops[w], np.int64), ids, scores)):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out], ["anchor_id", "top", "vec_id", "score"])
    return found.mapInArrow(answer, "anchor_id bigint, top bigint, vec_id bigint, score bigint")


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, k: int = 5, cells: int = CELLS, anchor_cells: int = ANCHOR_CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are its first
    rows of the same label by inner product of the whole-numbered components.  Negatives are the
    first ``k`` rows of other labels that score from 80 % of a positive's score to all of it.

    Each row goes into two kinds of blocks of a bounded number of components: by label, where
    anchors look for positives in the blocks of their own label only, and by id, where they look
    for negatives.  In each block the threshold algorithm (:func:`best`) reads sorted lists, and the
    blocks' first few are ranked together.  All rows are candidates at every size.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part,
    nor do those with a component whose square times the number of components (of floor(256 x))
    passes 2**62, as no long could hold the scores.  Vectors are compared within their number of
    components.  An id counts once: of different rows under one id the least (label, components)
    does.  Anchors without positives, or with only negative positive scores, give no row, as no score is
    both above 80 % and below 100 % of a negative number.  An empty table gives none.
    """
    rows = cut(usable(vectors))
    anchors = rows.filter(F.col("vec_id") % every == 0)

    found = _searched(rows, anchors, {"dim": "int", "label": "bigint"}, None, positives, cells, anchor_cells)
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    first = cut(found.withColumn("_place", place).filter(F.col("_place") <= positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))

    marks = first.filter(F.col("positive_score") >= 0).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("_tops"))
    padded = F.concat("_tops", F.array_repeat(F.lit(-1).cast("bigint"), F.lit(positives) - F.size("_tops")))
    found = _searched(rows, anchors.join(marks, "vec_id"), {"dim": "int"}, padded, k, cells, anchor_cells)
    place = F.row_number().over(W.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score", "top": "positive_score"})
    return first.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _searched(rows: DataFrame, anchors: DataFrame, by: dict[str, str], marks: Column | None, k: int, cells: int, anchor_cells: int) -> DataFrame:
    """Answers of all blocks of ``rows`` to the anchors that share ``by``; without ``marks`` the rows of the anchor's label are searched, else the others."""
    dealt = _dealt(rows, [*by], cells, "block")
    counts = dealt.groupBy(*by).agg(F.max("blocks").alias("blocks"))
    asked = _packed(_dealt(anchors, [*by], anchor_cells, "ablock"), by | {"ablock": "int"}, marks).join(counts, [*by])
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select(*by, "block", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "packed", "marks")])
    beside = _packed(dealt, by | {"block": "int"}).drop("marks").join(asked, [*by, "block"])
    return _answers(beside, marks is None, k)


SQL = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op12_threshold_negatives", SQL)
def op12(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
