"""Quality rules: every rule is a DataFrame of violations (Q-1..Q-13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from .identity import concat_tables


def violation(rows: DataFrame, rule: str, key: str | Column, detail: Column | None = None, severity: str = "error") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return rows.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
                       F.lit(severity).alias("severity"))


def all_violations(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), found)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Q-1: keys that occur more than once."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return violation(n, "duplicate id", key, F.col("_n"))


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str, rule: str = "dangling id") -> DataFrame:
    """Q-1, J-18: references that lead nowhere."""
    return violation(rows.select(key).distinct().join(target.select(F.col(target_key).alias(key)), key, "left_anti"), rule, key)


def index_against_geometry(index: DataFrame, geometry: DataFrame, key: str) -> DataFrame:
    """Q-1: routes with one of index and geometry only."""
    return all_violations(dangling(index, key, geometry, key, "no geometry"), dangling(geometry, key, index, key, "not in the index"))


def remnants(routes: DataFrame, group: str, miles: str, key: str) -> DataFrame:
    """Q-1: zero-mile pieces beside a longer one."""
    longer = routes.filter(F.col(miles) > 0).select(group).distinct()
    return violation(routes.filter(F.col(miles) == 0).join(longer, group, "left_semi"), "remnant", key)


def figures(rows: DataFrame, key: str, value: str, source: str, reason: str, texts: list[str], section: str, sections: list[str]) -> DataFrame:
    """Q-2: a value needs a source, no value a reason; localised texts come together; sections are known."""
    stated = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    some = reduce(lambda a, b: a | b, [stated(c) for c in texts])
    every = reduce(lambda a, b: a & b, [stated(c) for c in texts])
    return all_violations(
        violation(rows.filter(F.col(value).isNotNull() & ~stated(source)), "value without source", key),
        violation(rows.filter(F.col(value).isNull() & ~stated(reason)), "no value and no reason", key),
        violation(rows.filter(some & ~every), "text missing in one language", key),
        violation(rows.filter(~F.coalesce(F.col(section), F.lit("")).isin(*sections)), "unknown section", key, F.col(section)))


def repeated_sections(rows: DataFrame, key: str, section: str) -> DataFrame:
    """Q-2: a section that occurs twice under one key."""
    n = rows.groupBy(key, section).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return violation(n, "duplicate section", key, F.col(section))


def paragraph_parity(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Q-2: the two languages of a section differ in paragraphs (a warning)."""
    return violation(rows.filter(F.size(F.split(a, "\n")) != F.size(F.split(b, "\n"))), "paragraphs differ", key, severity="warning")


def length_tolerance(rows: DataFrame, key: str, official: str, logged: str, measured: str) -> DataFrame:
    """Q-3: official length against the log (2% or 1 mi) and against what was measured (20%)."""
    off = F.col(official)
    log_gap = F.abs(off - F.col(logged)) > F.greatest(F.lit(1.0), off * 0.02)
    far = F.abs(F.try_divide(F.col(measured), off) - 1) > 0.2
    return all_violations(violation(rows.filter(log_gap), "official differs from log", key, F.round(off - F.col(logged), 3)),
                          violation(rows.filter(far), "measured differs from official", key, F.round(F.try_divide(F.col(measured), off), 3)))


def supersede(claims: DataFrame, register: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Q-4: claims without a value are dropped where the register has one; returns (kept, report)."""
    empty = claims.filter(F.col(value).isNull())
    replaced = empty.join(register.select(key).distinct(), key, "left_semi")
    kept = claims.filter(F.col(value).isNotNull()).unionByName(empty.join(register.select(key).distinct(), key, "left_anti"))
    return kept, violation(replaced, "the register has it", key, severity="note")


def timeline(*tables: DataFrame) -> DataFrame:
    """Q-5: dated routes, openings and events in one table (key, year, kind, title)."""
    return concat_tables(*tables).filter(F.col("year").isNotNull())


def orient_termini(rows: DataFrame, key: str, warn_km: float = 60) -> DataFrame:
    """Q-6: declared ends matched to the line's ends (ax, ay, bx, by); swapped if the first lies nearer the other end.

    ``rows`` has key, dlon, dlat (declared first end) and the ends of the line.
    """
    a = haversine(F.col("dlon"), F.col("dlat"), F.col("ax"), F.col("ay"))
    b = haversine(F.col("dlon"), F.col("dlat"), F.col("bx"), F.col("by"))
    return rows.select(key, (b < a).alias("swapped"), F.round(F.least(a, b), 6).alias("km"), (F.least(a, b) > warn_km).alias("warn"))


def toll_agreement(rows: DataFrame, keys: list[str], suffix: Column, flag: Column) -> DataFrame:
    """Q-7: where the number's suffix or the flag says tolled, how often both do."""
    flag = F.coalesce(flag, F.lit(False))
    return rows.groupBy(*keys).agg(F.count(F.when(suffix & flag, 1)).alias("both"), F.count(F.when(suffix & ~flag, 1)).alias("suffix_only"),
                                   F.count(F.when(~suffix & flag, 1)).alias("flag_only"))


def branch_only(rows: DataFrame, group: str, name: str, pattern: str, listed: DataFrame) -> DataFrame:
    """Q-8: groups all of whose names read as a branch, unless another register lists them."""
    every = rows.groupBy(group).agg(F.min(F.coalesce(F.col(name).rlike(pattern), F.lit(False))).alias("_all")).filter("_all").select(group)
    return every.join(listed.select(group).distinct(), group, "left_anti")


def stale_figures(published: DataFrame, built: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Q-9: published figures that the build does not give (any more), and built ones not published."""
    both = (published.select(*keys, F.col(value).alias("published")).join(built.select(*keys, F.col(value).alias("built")), keys, "full_outer"))
    return both.filter(~F.col("published").eqNullSafe(F.col("built")))


def match_alarm(rows: DataFrame, key: str, matched: Column, least: float = 0.8) -> DataFrame:
    """Q-10: share of joined rows per key, with an alarm below ``least``."""
    return rows.groupBy(key).agg(F.round(F.avg(matched.cast("double")), 6).alias("share")).withColumn("alarm", F.col("share") < least)


def far_apart(pairs: DataFrame, key: str, km: float = 25) -> DataFrame:
    """Q-11: placed points too far from their counterpart (lon, lat, olon, olat)."""
    d = haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat"))
    return violation(pairs.withColumn("_km", F.round(d, 3)).filter(F.col("_km") > km), "far from its counterpart", key, F.col("_km"), "warning")


def total_notes(register: DataFrame, totals: DataFrame, key: str, value: str, total: str, tolerance: float = 0.5) -> DataFrame:
    """Q-12: a published total that its own rows do not add up to; both are kept."""
    sums = register.groupBy(key).agg(F.sum(value).alias("rows_total"))
    return totals.join(sums, key).withColumn("note", F.abs(F.col(total) - F.col("rows_total")) > tolerance)


def missing_values(offered: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Q-13: values a publisher's own filter offers that were not found."""
    return violation(offered.select(key).distinct().join(found.select(key).distinct(), key, "left_anti"), "offered but not found", key)


def require_none(found: DataFrame) -> None:
    """Fail the job when a violations table holds an error; the first few are named."""
    worst = found.filter(F.col("severity") == "error").limit(5).collect()
    if worst:
        raise ValueError("quality rules failed: " + "; ".join(f"{r.rule} {r.key} {r.detail}" for r in worst))
