"""Ranks and running sums over one order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut


def running(df: DataFrame, order: list[Column], sums: dict[str, str], position: str | None = None) -> DataFrame:
    """Add inclusive running sums (new column -> summed whole-number column) in ``order``.

    The rows are dealt into ranges of the order and written out, so that the ranges are the
    same for every reader; the totals of the ranges (one row each) give every range its start.
    Rows that are equal in ``order`` may change places, so the order should be a total one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    starts = totals.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
                           *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in sums])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row a range: as many as there are shuffle partitions, so this broadcast is bounded.
    out = ranged.join(F.broadcast(starts), "_range").withColumns(
        {k: F.col(f"_s_{k}") + F.sum(c).over(inside) for k, c in sums.items()}
        | ({position: F.col("_n0") + F.row_number().over(W.partitionBy("_range").orderBy(*order))} if position else {}))
    return out.drop("_range", "_n0", *[f"_s_{k}" for k in sums])
