"""Nearest vectors by counting hash collisions around each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table

# Projections, the share of them in which a vector must fall into the query's window, and the
# widening of the windows per round.
LINES = 96
COLLIDE = 0.6
WIDEN = 1.15
# The first window's half width, as a share of the projections' spread.
START = 0.3
# Rounds end when so many vectors for each wanted neighbour, and such a share of the shard,
# have collided often enough.  Set by the recall against brute force.
SURPLUS = 20
SHARE = 0.15
# Vectors of a shard and queries of a block: what one task holds at a time.
SHARD = 16_384
BLOCK = 1_024


def lines(dim: int, count: int = LINES) -> np.ndarray:
    """Random directions, the same for every task."""
    return np.random.default_rng([17, dim]).normal(size=(dim, count))


def near(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, distances) of the ``k`` nearest that collide with each query.

    Each line holds its projections sorted.  The window around a query's own projection has
    the same width on all lines and grows by a factor; a vector that lies in the window on
    enough lines is a candidate.  Rounds end when there are enough candidates, a fixed number
    for each neighbour and a fixed share of the shard, or when the windows hold everything.
    All candidates are measured.
    """
    count = len(vectors)
    a = lines(vectors.shape[1])
    at = vectors @ a
    order = np.argsort(at, axis=0, kind="stable")
    sorted_at = np.asfortranarray(np.take_along_axis(at, order, 0))
    order = np.asfortranarray(order)
    own = queries @ a
    count_lines = a.shape[1]
    need, wanted = int(np.ceil(COLLIDE * count_lines)), min(count - 1, max(SURPLUS * k, int(SHARE * count)))
    squares = (vectors ** 2).sum(1)
    spread = float(at.std()) or 1.0
    half, open_ = np.full(len(queries), spread * START), np.arange(len(queries))
    hits = np.zeros((len(queries), count), np.uint16)
    lo = np.stack([np.searchsorted(sorted_at[:, j], own[:, j]) for j in range(count_lines)], 1).reshape(-1, count_lines)
    hi = lo.copy()
    while len(open_):
        later = []
        was_lo, was_hi = lo[open_], hi[open_]
        for j in range(count_lines):
            lo[open_, j] = np.searchsorted(sorted_at[:, j], own[open_, j] - half[open_])
            hi[open_, j] = np.searchsorted(sorted_at[:, j], own[open_, j] + half[open_], "right")
        for row, q in enumerate(open_):
            # Only what the windows have gained since the last round is counted.
            gained = [order[x:y, j] for j in range(count_lines) for x, y in ((lo[q, j], was_lo[row, j]), (was_hi[row, j], hi[q, j])) if y > x]
            if gained:
                hits[q] += np.bincount(np.concatenate(gained), minlength=count).astype(np.uint16)
            found = np.flatnonzero((hits[q] >= need) & (ids != query_ids[q]))
            if len(found) >= wanted or (hi[q] - lo[q]).min() >= count:
                yield (q, *_measured(vectors, squares, ids, found, queries[q], k))
            else:
                later.append(q)
                half[q] *= WIDEN
        open_ = np.array(later, np.int64)


def _measured(vectors: np.ndarray, squares: np.ndarray, ids: np.ndarray, found: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of the candidates, by an estimate with room for its rounding and for ties first, then by the measure."""
    if len(found) > 4 * k:
        rough = squares[found] - 2 * (vectors[found] @ query)
        edge = np.partition(rough, k - 1)[k - 1]
        found = found[rough <= edge + 1e-9 * (1 + abs(edge) + squares[found].max())]
    far = np.sqrt(((vectors[found] - query) ** 2).sum(1))
    best = np.lexsort((ids[found], far))[:k]
    return ids[found][best], far[best]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is not null, not zero and whole, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("_v"))
            .filter(F.col("_v").isNotNull() & finite & F.exists("_v", lambda x: x != 0)))


def search(vectors: DataFrame, k: int = 10, every: int = 100, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all other vectors.

    The queries are the rows whose id is divisible by ``every``.  Vectors are dealt by a hash of
    the id into shards of about ``shard`` rows, queries into blocks of about ``block``; each
    block is sent to each shard as packed rows, so a task holds one shard and one block.  A
    shard answers with its nearest of each query, and these are ranked together.

    Vectors that are null, zero or hold a null, NaN or infinite component are left out, as
    queries too; vectors are only compared within their number of components.  Repeated rows
    are candidates each, but for a query's own id.  Ties go to the smaller id.
    """
    good = usable(vectors)
    count = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("int")), F.lit(0)).alias("q")).first()
    shards, blocks = max(1, -(-count["n"] // shard)), max(1, -(-count["q"] // block))
    dims = F.size("_v").alias("dim")
    dealt = good.select(dims, F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "_v")
    # A query id counts once: of different rows under it the least (components, values) is asked for.
    first = good.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.size("_v").alias("_n"), "_v")).alias("_q")).select("vec_id", F.col("_q._v").alias("_v"))
    asked = first.select(dims, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "_v")
    # Bounded groups: about ``shard`` vectors and ``block`` queries.
    packed = dealt.groupBy("dim", "shard").applyInArrow(_pack, "dim int, shard int, ids binary, packed binary")
    sent = (asked.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, ids binary, packed binary")
            .select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("ids").alias("q_ids"), F.col("packed").alias("q_packed")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                ids, q_ids = (np.frombuffer(batch.column(c)[row].as_py(), np.int64) for c in (1, 3))
                data, asked_data = (np.frombuffer(batch.column(c)[row].as_py(), np.float64).reshape(-1, dim) for c in (2, 4))
                out = list(near(data, ids, asked_data, q_ids, k))
                sizes = [len(i) for _, i, _ in out]
                none = [np.zeros(0, np.int64)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(q_ids[[q for q, _, _ in out]], sizes)), pa.array(np.concatenate([i for _, i, _ in out] or none)),
                    pa.array(np.concatenate([s for _, _, s in out] or none).astype(np.float64))], ["query_id", "vec_id", "score"])

    found = (packed.join(sent, ["dim", "shard"]).select("dim", "ids", "packed", "q_ids", "q_packed")
             .mapInArrow(answer, "query_id bigint, vec_id bigint, score double"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pack(group: pa.Table) -> pa.Table:
    """The rows of a group as one row: ids and components as bytes."""
    part = group.column_names[1]
    order = np.argsort(group.column("vec_id").to_numpy(), kind="stable")
    values = group.column("_v").combine_chunks().flatten().to_numpy().reshape(len(order), -1)
    ids = group.column("vec_id").to_numpy()[order].astype(np.int64)
    return pa.table({"dim": pa.array([group.column("dim")[0].as_py()], pa.int32()), part: pa.array([group.column(part)[0].as_py()], pa.int32()),
                     "ids": pa.array([ids.tobytes()], pa.binary()), "packed": pa.array([np.ascontiguousarray(values[order]).tobytes()], pa.binary())})


@query("op10_collision_neighbours")
def op10(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
