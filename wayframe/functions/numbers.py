"""Number columns: rounding rules, bands, shares, parsing (P-13, P-15, P-16, P-27, P-32..P-36)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_MI = 1.609344


def js_round(x: Column) -> Column:
    """Round half up, also for negatives (-2.5 gives -2)."""
    return F.floor(x + F.lit(0.5))


def decimals_of(step: float) -> int:
    return max(0, -math.floor(math.log10(step)))


def step_round(x: Column, step: float) -> Column:
    """P-33: round to a multiple of ``step`` and cut float noise."""
    return F.round(js_round(x / F.lit(float(step))) * F.lit(float(step)), decimals_of(step))


def percent(part: Column, whole: Column, decimals: int = 0) -> Column:
    """Half-up percentage; null when the whole is not positive."""
    scale = 10.0 ** decimals
    return F.when(whole > 0, js_round(part / whole * F.lit(100.0 * scale)) / F.lit(scale))


def cover(part: Column, whole: Column) -> Column:
    """Share of ``whole`` that ``part`` covers, in whole percent, at most 100."""
    return F.least(F.lit(100.0), js_round(part / F.greatest(whole, F.lit(1e-9)) * 100.0).cast("double"))


def null_if_zero(x: Column) -> Column:
    return F.when(x != 0, x)


def null_if_redundant(value: Column, other: Column, ratio: float | None = None) -> Column:
    """P-42: keep ``value`` only if it differs from ``other``, or exceeds ``ratio`` times it."""
    if ratio is None:
        return F.when(~value.eqNullSafe(other), value)
    return F.when(value > other * ratio, value)


def band(kph: Column) -> Column:
    """P-32: speed band: 40 and under, tens, 120 and over."""
    return (F.when(kph >= 120, F.lit(120)).when(kph <= 40, F.lit(40))
            .otherwise((js_round(kph / 10) * 10).cast("int")))


def roughness_grade(iri: Column) -> Column:
    """P-32: pavement grade from roughness in inches per mile."""
    return F.when(iri < 95, "good").when(iri <= 170, "fair").when(iri.isNotNull(), "poor")


def iri_metric(iri: Column) -> Column:
    """P-32: inches per mile to metres per kilometre."""
    return F.round(iri / 63.36, 2)


def parse_number(text: Column) -> Column:
    """P-15: number text with thousands separators and spaces; null when it is not a number."""
    return F.regexp_replace(text, r"[\s,]", "").try_cast("double")


def year_in(text: Column, first: int, last: Column | int) -> Column:
    """P-13: a whole year inside the plausible window, else null."""
    year = F.regexp_extract(text.cast("string"), r"^\s*(\d{4})(?:\.0+)?\s*$", 1).try_cast("int")
    return F.when(year.between(first, last), year)


def roc_year(text: Column) -> Column:
    """Calendar year of a Republic-of-China year."""
    return text.try_cast("int") + 1911


def year_cell(text: Column) -> Column:
    """P-36: struct(year, note): a lone year is dated, a span or text stays a note."""
    trimmed = F.trim(text)
    lone = F.regexp_extract(trimmed, r"^(\d{4})$", 1).try_cast("int")
    return F.struct(lone.alias("year"), F.when(lone.isNull() & (trimmed != ""), trimmed).alias("note"))


def chainage_km(text: Column) -> Column:
    """P-16: chainage such as ``12K+345`` as kilometres."""
    pattern = r"(?i)^\s*(\d+)\s*k\s*\+\s*(\d{1,3})\s*$"
    return (F.regexp_extract(text, pattern, 1).try_cast("double")
            + F.regexp_extract(text, pattern, 2).try_cast("double") / 1000)


def posts_km(whole: Column, metres: Column) -> Column:
    """P-16: kilometre post and metres beyond it."""
    return whole.cast("double") + F.coalesce(metres.cast("double"), F.lit(0.0)) / 1000


def kph_of(text: Column) -> Column:
    """P-27: speed text in km/h; mph is converted, values outside 5..140 are null."""
    first = F.lower(F.trim(F.split(text, ";")[0]))
    pattern = r"^(\d{1,3})(?:\s*(mph|km/h|kmh|kph))?$"
    number = F.regexp_extract(first, pattern, 1).try_cast("double")
    kph = number * F.when(F.regexp_extract(first, pattern, 2) == "mph", KM_PER_MI).otherwise(1.0)
    return F.when(kph.between(5, 140), js_round(kph).cast("int"))


def speed_of(both: Column, forward: Column, backward: Column) -> Column:
    """P-27: posted speed, or the mean of the two directions, or the one that is stated."""
    f, b = kph_of(forward), kph_of(backward)
    return F.coalesce(kph_of(both), js_round((f + b) / 2).cast("int"), f, b)


def lanes_of(text: Column) -> Column:
    """P-28: a plain lane count from 1 to 12."""
    n = F.regexp_extract(text, r"^\s*(\d+)\s*$", 1).try_cast("int")
    return F.when(n.between(1, 12), n)


def toll_flag(tag: Column) -> Column:
    """P-28: yes/no tag as 1/0; anything else is not stated."""
    return F.when(tag == "yes", 1).when(tag == "no", 0)


def structure_of(tunnel: Column, bridge: Column) -> Column:
    """P-28: ``t`` for a tunnel, ``b`` for a bridge."""
    return (F.when(~tunnel.isin("no", "culvert", ""), "t")
            .when(~bridge.isin("no", ""), "b"))


def oneway_flag(tag: Column, road_class: Column) -> Column:
    """P-28: tagged one-way, or a motorway not tagged otherwise."""
    tag = F.coalesce(tag, F.lit(""))
    return F.when(tag.isin("yes", "1") | ((road_class == "motorway") & (tag != "no")), 1).otherwise(0)


def sum_check(parts: list[Column], total: float, tolerance: float) -> Column:
    """P-34: 1 when the parts miss ``total`` by more than ``tolerance``, else 0."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    return F.when(F.abs(whole - total) > tolerance, 1).otherwise(0)
