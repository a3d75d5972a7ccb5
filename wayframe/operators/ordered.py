"""Order-based operators that never put one key's rows into a single task.

A key may hold a large share of all rows, so a plain window over the key would sort them
in one task.  The operators here cut each key into blocks, solve each block, and carry
the few block results across (W-*, A-14, A-18, O-*).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut

# Consecutive rows of a key that one task may order.
BLOCK = 65_536
# Range buckets per level, and the rows one task may order in a bucket.
BUCKETS = 64
BUCKET_ROWS = 4_000_000


def _keyed(keys: list[str], column: str) -> tuple[list[str], dict[str, Column]]:
    """The keys, or one key for everything; it is computed from a column, as a constant would be joined without a key."""
    return (keys, {}) if keys else (["_all"], {"_all": F.pmod(F.hash(F.col(column)), F.lit(1))})


def value_buckets(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS, levels: int | None = None) -> DataFrame:
    """Add ``_bucket``: the range bucket of ``value`` within its key, with about even counts.

    Buckets are split again, level by level, until even a key that holds all rows leaves no
    bucket too large for a task; the number of levels follows the counted rows of the largest
    key.  The bounds (one short array per key and bucket) are written out, so that a re-run task
    sees the same ones.
    """
    out, most = _split(df, keys, value, buckets)
    if levels is None:
        levels = 1
        while most > BUCKET_ROWS * buckets ** levels:
            levels += 1
    for _ in range(levels - 1):
        finer, _ = _split(out.withColumnRenamed("_bucket", "_coarse"), [*keys, "_coarse"], value, buckets)
        out = finer.withColumn("_bucket", F.col("_coarse") * buckets + F.col("_bucket")).drop("_coarse")
    return out


def _split(df: DataFrame, keys: list[str], value: str, buckets: int) -> tuple[DataFrame, int]:
    cuts = [i / buckets for i in range(1, buckets)]
    bounds, seen = cut(df.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx(F.col(value), cuts, 1000)).alias("_bounds"), F.count(F.lit(1)).alias("_rows")), most=F.max("_rows"))
    return (df.join(bounds.drop("_rows"), keys, "left")
            .withColumn("_bucket", F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col(value))), F.lit(0)).cast("bigint"))
            .drop("_bounds"), seen["most"] or 0)


def positions(df: DataFrame, keys: list[str], order: list[Column], lead: str, descending: bool = False,
              name: str = "position", buckets: int = BUCKETS, levels: int | None = None) -> DataFrame:
    """Exact row number of each row within its key, in ``order`` whose first column is ``lead``.

    Rows are numbered inside range buckets of ``lead``; the counts of the buckets before
    give the rest (W-1, A-35).
    """
    keys, extra = _keyed(keys, lead)
    df = df.withColumns(extra)
    bucketed = value_buckets(df, keys, lead, buckets, levels)
    before = W.partitionBy(*keys).orderBy(F.col("_bucket").desc() if descending else F.col("_bucket")) \
        .rowsBetween(W.unboundedPreceding, -1)
    starts = (bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (bucketed.withColumn("_row", F.row_number().over(inside))
            .join(starts, [*keys, "_bucket"])
            .withColumn(name, (F.col("_row") + F.col("_start")).cast("bigint"))
            .drop("_row", "_start", "_bucket", *extra))


def quantiles(df: DataFrame, keys: list[str], value: str, picks: dict[str, tuple[str, float]],
              weight: str | None = None, buckets: int = BUCKETS, levels: int | None = None) -> DataFrame:
    """Exact quantiles by rank, one row per key.

    ``picks`` maps an output column to (rule, q).  Rules over values sorted ascending, n in all:

    * ``index``  value at index floor((n-1)*q)
    * ``upper``  value at index floor(n*q)
    * ``middle`` the two values that meet at q = 0.5, averaged
    * ``weighted`` first value whose running weight reaches q of the total

    Equal values are merged before anything is shuffled by key.
    """
    keys, extra = _keyed(keys, value)
    df = df.withColumns(extra).filter(F.col(value).isNotNull())
    amount = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    merged = df.groupBy(*keys, value).agg(amount.alias("_w"))
    bucketed = value_buckets(merged, keys, value, buckets, levels)
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_bw"))
    whole = W.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (per_bucket.withColumn("_start", F.coalesce(F.sum("_bw").over(before), F.lit(0.0)))
              .withColumn("_total", F.sum("_bw").over(whole)))
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    n = F.col("_total")

    def targets(rule: str, q: float) -> list[Column]:
        if rule == "index":
            return [F.floor((n - 1) * q) + 1]
        if rule == "upper":
            return [F.least(F.floor(n * q) + 1, n)]
        if rule == "middle":
            return [F.floor((n + 1) / 2), F.floor((n + 2) / 2)]
        return [n * q]

    def holds(t: Column) -> Column:
        return (F.col("_start") < t) & (F.col("_start") + F.col("_bw") >= t)

    wanted = None
    for rule, q in picks.values():
        for t in targets(rule, q):
            wanted = holds(t) if wanted is None else wanted | holds(t)
    # Only the buckets that hold a wanted rank are sorted.
    ranked = (bucketed.join(starts.filter(wanted), [*keys, "_bucket"])
              .withColumn("_to", F.col("_start") + F.sum("_w").over(inside))
              .withColumn("_from", F.col("_to") - F.col("_w")))
    aggs = []
    for name, (rule, q) in picks.items():
        # The last value of the bucket stands in when rounding of running weights stops just short of the rank.
        found = [F.coalesce(F.min(F.when((F.col("_from") < t) & (F.col("_to") >= t), F.col(value))),
                            F.max(F.when(holds(t), F.col(value)))) for t in targets(rule, q)]
        aggs.append((found[0] if len(found) == 1 else (found[0] + found[1]) / 2).alias(name))
    return ranked.groupBy(*keys).agg(*aggs).drop(*extra)


def running_sum(df: DataFrame, keys: list[str], seq: str, value: str, name: str, before: str | None = None,
                block: int | str = BLOCK, total: str | None = None, last: str | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in the order of the whole number ``seq`` (P-4, A-30, A-31).

    ``before`` names a column for the sum up to the row before, equal to what that row got.  ``block`` is how many
    numbers of ``seq`` make a block, or "_block" if the rows have that column already.  ``total`` and ``last``
    name columns for the key's greatest running sum and ``seq``, which come with the few block results.
    """
    keys, extra = _keyed(keys, seq)
    row = W.partitionBy(*keys, "_block").orderBy(seq)
    blocked = df.withColumns(extra)
    inside = ((blocked if block == "_block" else blocked.withColumn("_block", F.floor(F.col(seq) / block)))
              .withColumn("_in", F.sum(value).over(row.rowsBetween(W.unboundedPreceding, W.currentRow))))
    # A block's total is its last running sum, so the next block starts from the very number at which this one ends.
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (inside.groupBy(*keys, "_block").agg(F.max_by("_in", seq).alias("_bw"), *([F.max(seq).alias("_seq")] if last else []))
              .withColumn("_start", F.coalesce(F.sum("_bw").over(earlier), F.lit(0.0))))
    whole = W.partitionBy(*keys)
    starts = starts.withColumn(total, F.max(F.col("_start") + F.col("_bw")).over(whole)) if total else starts
    starts = starts.withColumn(last, F.max("_seq").over(whole)) if last else starts
    starts = starts.drop("_bw", "_seq")
    summed = inside.join(starts, [*keys, "_block"]).withColumn(name, F.col("_in") + F.col("_start"))
    if before:
        summed = summed.withColumn(before, F.coalesce(F.lag(name).over(row), F.col("_start")))
    return summed.drop("_in", "_start", "_block", *extra)


def carry(df: DataFrame, keys: list[str], seq: str, value: str, name: str, forward: bool = True,
          block: int | str = BLOCK) -> DataFrame:
    """Last stated ``value`` at or before each row (or the next one at or after it) (W-5, P-39).

    The result is struct(seq, value) of the row it came from, null where there is none.  With "_block" for ``block``
    the rows have that column and keep it, so that one carry after another needs no shuffle of its own.
    """
    blocked = (df if block == "_block" else df.withColumn("_block", F.floor(F.col(seq) / block))).withColumn(
        "_own", F.when(F.col(value).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(value).alias("value"))))
    edge, pick = (W.unboundedPreceding, F.last) if forward else (0, F.first)
    frame = (edge, 0) if forward else (0, W.unboundedFollowing)
    outside = (W.unboundedPreceding, -1) if forward else (1, W.unboundedFollowing)
    block_value = F.max("_own") if forward else F.min("_own")
    starts = (blocked.groupBy(*keys, "_block").agg(block_value.alias("_b"))
              .withColumn("_carried", pick("_b", ignorenulls=True).over(
                  W.partitionBy(*keys).orderBy("_block").rowsBetween(*outside))).drop("_b"))
    inside = W.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(*frame)
    return (blocked.withColumn("_in", pick("_own", ignorenulls=True).over(inside))
            .join(starts, [*keys, "_block"])
            .withColumn(name, F.coalesce("_in", "_carried")).drop("_in", "_carried", "_own", *([] if block == "_block" else ["_block"])))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  The rank limit is applied before the shuffle, so a hot key sends k rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_by(df: DataFrame, keys: list[str], order: list[str | Column], keep: list[str], largest: bool = False) -> DataFrame:
    """One row per key: the least (or greatest) in ``order`` (W-4, W-7, S-18).  Combines before the shuffle."""
    rank = F.struct(*order)
    row = F.struct(*keep)
    pick = F.max_by(row, rank) if largest else F.min_by(row, rank)
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float, close: bool = True) -> DataFrame:
    """G-24: intervals of one line merged over gaps shorter than ``gap``.

    A scan in segments: intervals are merged inside fixed stretches of the line, and how far the stretches before
    reach, one row each, is carried to each stretch.  There an interval opens a new one, or belongs
    to the last that was opened, also in an earlier stretch.  No window sees the rows of a whole line.
    """
    part = [*keys, "_stretch"]
    w = W.partitionBy(*part).orderBy(start, end)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    opens = lambda reach: F.when(reach.isNull() | (F.col(start) - reach >= gap), 1).otherwise(0)
    rows = df.select(*keys, start, end).withColumn("_stretch", F.floor(F.col(start) / (gap * 64)))
    inside = (rows.withColumn("_new", opens(F.max(end).over(before))).withColumn("_island", F.sum("_new").over(w))
              .groupBy(*part, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island"))
    if not close:
        return inside.drop("_stretch")
    inside = cut(inside)
    earlier = W.partitionBy(*keys).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    reaches = inside.groupBy(*part).agg(F.max(end).alias("_end")).select(*part, F.max("_end").over(earlier).alias("_reach"))
    # Inside a stretch what is left lies a gap apart already, so only the stretches before can reach it.
    opened = cut(inside.join(reaches, part).withColumn("_new", opens(F.col("_reach"))).drop("_reach"))
    counts = opened.groupBy(*part).agg(F.sum("_new").alias("_n")).select(*part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from"))
    numbered = opened.join(counts, part).withColumn("_island", F.sum("_new").over(w) + F.col("_from"))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
