"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .order import running
from .registry import query, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2
BLANK = " \t\n\x0b\f\r"


def word_count(text):
    """Runs without ASCII white space; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES) -> tuple[DataFrame, float]:
    """Each source's target and the budget, from (source, source_size).

    Weights repeat over the sources by code point, null last.  A target stops at ``copies``
    times the source; what is over is shared again by weight.  Filling up in order of
    capacity per weight finds the level at which that ends.
    """
    by_name = running(sizes, [F.col("source").asc_nulls_last()], {"_through": "source_size"}, position="_rank")
    ranked = cut(by_name.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
                 .withColumn("_cap", F.col("source_size") * copies))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("_weight"), F.lit(0)).alias("weight")).first()
    budget = min(share, copies) * total["size"]
    ratio = F.col("_cap") / F.col("_weight")
    filled = running(ranked, [ratio, F.col("_rank")], {"_caps": "_cap", "_weights": "_weight"})
    level = (F.lit(budget) - (F.col("_caps") - F.col("_cap"))) / (F.lit(total["weight"]) - (F.col("_weights") - F.col("_weight")))
    at = filled.withColumn("_level", level).filter(ratio >= level).agg(F.min_by("_level", F.struct(ratio, "_rank")).alias("level")).first()["level"]
    target = F.col("_cap").cast("double") if at is None else F.least(F.col("_cap").cast("double"), F.lit(at) * F.col("_weight"))
    return ranked.select("source", "source_size", target.alias("target"), (F.col("_through") - F.col("source_size")).alias("_before")), budget


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, copies: int = COPIES, seed: int = 1) -> DataFrame:
    """(doc_id, source, size) rows with their source's size and target and the words taken.

    Every row gets a place in its source by a hash of its id; there its virtual finish time is
    the source's words up to and with it over the target, once for each copy.  All copies are
    sorted by that time, and those within the budget are taken.  The order of the names puts
    each source's rows side by side, so one running sum serves all sources and a source of any
    size is spread over tasks.

    Repeated rows count as rows of their own.  Null ids and sources are values like others.
    Empty texts take nothing.  An empty table gives none.
    """
    place = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(str(seed))))
    rows = cut(rows.select("doc_id", "source", "size").withColumn("_place", place))
    wanted, budget = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, copies)
    placed = running(rows, [F.col("source").asc_nulls_last(), F.col("_place"), F.col("doc_id"), F.col("size")], {"_through": "size"}, position="_row")
    aimed = (placed.join(wanted.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
             .withColumn("_copy", F.explode(F.array(*[F.lit(k) for k in range(copies)]))))
    finish = (F.col("_copy") * F.col("source_size") + F.col("_through") - F.col("_before")) / F.col("target")
    queued = running(aimed.select("doc_id", "source", "size", "source_size", "target", "_row", "_copy", F.when(F.col("target") > 0, finish).otherwise(F.lit(0.0)).alias("_finish")),
                     [F.col("_finish"), F.col("_copy"), F.col("_row")], {"_queue": "size"})
    return (queued.groupBy("_row", "doc_id", "source", "size", "source_size", "target")
            .agg(F.sum(F.when(F.col("_queue") <= F.lit(budget), F.col("size")).otherwise(F.lit(0))).alias("taken")).drop("_row"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '-') || ':1') AS place
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rnk,
         ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
             - coalesce((sum(2 * source_size) OVER o)::BIGINT - 2 * source_size, 0)) / ((sum(weight) OVER ())::BIGINT - ((sum(weight) OVER o)::BIGINT - weight))::DOUBLE AS level,
         (2 * source_size)::DOUBLE / weight AS ratio
  FROM sources
  WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, rnk ROWS UNBOUNDED PRECEDING)),
aims AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, ratio * 1e6 + rnk) FROM levels WHERE ratio >= level), 1e300::DOUBLE) * weight) AS target
  FROM levels),
placed AS (
  SELECT doc_id, sized.source, size, source_size, target,
         (sum(size) OVER (PARTITION BY sized.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS through,
         row_number() OVER (ORDER BY sized.source NULLS LAST, place, doc_id) AS rw
  FROM sized JOIN aims ON sized.source IS NOT DISTINCT FROM aims.source),
queued AS (
  SELECT doc_id, size, source_size, target, rw,
         (sum(size) OVER (ORDER BY CASE WHEN target > 0 THEN (copy * source_size + through) / target ELSE 0 END, copy, rw ROWS UNBOUNDED PRECEDING))::BIGINT AS queue
  FROM placed, (VALUES (0), (1)) AS c(copy))
SELECT doc_id, size, source_size, target,
       (sum(CASE WHEN queue <= 1.5 * (SELECT sum(size) FROM sized) THEN size ELSE 0 END))::BIGINT AS taken
FROM queued GROUP BY rw, doc_id, size, source_size, target
"""


@query("op6_fair_queue_mix", SQL)
def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).drop("source")
