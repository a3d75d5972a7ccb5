"""Statistics over finished tables: accuracy, histograms, profiles, registers (A-14, A-15, A-21..A-29, A-32..A-47)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import js_round, percent
from .ordered import positions, quantiles, top_k


def accuracy(routes: DataFrame, key: str, measured: str, official: str, least: float = 5) -> DataFrame:
    """A-14: signed error in percent against the register: quantiles by index and shares within 5, 10 and 25."""
    checked = routes.filter(F.col(official) > least).withColumn("_err", (F.col(measured) - F.col(official)) / F.col(official) * 100)
    ranks = quantiles(checked, [key], "_err", {"median": ("index", 0.5), "p10": ("index", 0.1), "p90": ("index", 0.9)})
    within = checked.groupBy(key).agg(F.count(F.lit(1)).alias("routes"), *[
        js_round(F.avg(F.when(F.abs("_err") <= n, 100.0).otherwise(0.0))).cast("double").alias(f"within{n}") for n in (5, 10, 25)])
    return within.join(ranks, key).select(key, "routes", *[F.round(c, 1).alias(c) for c in ("median", "p10", "p90")], "within5", "within10", "within25")


def histogram(rows: DataFrame, keys: list[str], value: Column, edges: list[float], name: str) -> DataFrame:
    """A-15: counts in bins that start at the given edges; the first bin has no lower bound."""
    start = F.lit(edges[0])
    for e in edges[1:]:
        start = F.when(value >= e, F.lit(e)).otherwise(start)
    # Later edges must win, so they are nested outermost above.
    return rows.filter(value.isNotNull()).withColumn(name, start).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))


def inventory_summary(structures: DataFrame, keys: list[str], built: str, lon: str) -> tuple[DataFrame, DataFrame]:
    """A-21: dated and placed structures with the oldest and newest, and counts by decade."""
    summary = structures.groupBy(*keys).agg(F.count(F.lit(1)).alias("structures"), F.count(built).alias("dated"), F.count(lon).alias("placed"),
                                            F.min(built).alias("oldest"), F.max(built).alias("newest"))
    decades = (structures.filter(F.col(built).isNotNull()).withColumn("decade", (F.floor(F.col(built) / 10) * 10).cast("int"))
               .groupBy(*keys, "decade").agg(F.count(F.lit(1)).alias("n")))
    return summary, decades


def top_names(rows: DataFrame, keys: list[str], name: str, k: int = 4) -> DataFrame:
    """A-22: the most frequent names of a key, at most ``k`` (ties by name)."""
    counted = rows.filter(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counted, keys, [F.col("n").desc(), F.col(name)], k)


def toll_points(gantries: DataFrame, number: str, line: str, direction: str, km: str) -> DataFrame:
    """A-23: gantries and charged km per line of a road: the larger of its directions, which are not paired."""
    per_dir = gantries.groupBy(number, line, direction).agg(F.count(F.lit(1)).alias("_n"), F.sum(km).alias("_km"))
    return per_dir.groupBy(number, line).agg(F.max("_n").alias("gantries"), (js_round(F.max("_km") * 10) / 10.0).alias("km"))


def fare_bands(fares: DataFrame, facility: str, vehicle: str, fare: str, updated: str, wanted: str) -> DataFrame:
    """A-24: least and greatest fare of one vehicle class, and the latest update of any."""
    mine = F.when(F.col(vehicle) == wanted, F.col(fare))
    return fares.groupBy(facility).agg(F.min(mine).alias("fare_from"), F.max(mine).alias("fare_to"), F.max(updated).alias("updated"))


def section_lengths(sections: DataFrame, numbers: list[str], length: str, wanted: Column) -> DataFrame:
    """A-25: section lengths per highway; a shared section counts under each of its numbers once."""
    listed = F.array_distinct(F.array_compact(F.array(*[F.col(n) for n in numbers])))
    return (sections.filter(wanted).withColumn("number", F.explode(listed)).groupBy("number")
            .agg(F.round(F.sum(length), 3).alias("km"), F.count(F.lit(1)).alias("sections")))


def crosstab(rows: DataFrame, keys: list[str], verdict: str, verdicts: list[str]) -> DataFrame:
    """A-26, A-47: rows per verdict, one column each, with the share of each in percent to 0.1."""
    n = F.count(F.lit(1))
    out = rows.groupBy(*keys).agg(n.alias("rows"), *[F.count(F.when(F.col(verdict) == v, 1)).alias(v) for v in verdicts])
    return out.withColumns({f"{v}_share": percent(F.col(v), F.col("rows"), 1) for v in verdicts})


def best_tier(register: DataFrame, number: str, tier: str, precedence: list[str]) -> DataFrame:
    """A-27: the strongest tier a number is listed under, by a fixed precedence."""
    rank = F.array_position(F.lit(precedence), F.col(tier))
    return (register.groupBy(number).agg(F.min(F.when(rank > 0, rank)).alias("_r"))
            .select(number, F.try_element_at(F.lit(precedence), F.col("_r").cast("int")).alias("tier")))


def best_description(rows: DataFrame, key: str, score: Column, fields: list[str], tie: str) -> DataFrame:
    """A-28: each field from the best-scored row that states it."""
    rank = F.struct(-score, F.col(tie))
    return rows.groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), rank)).alias(f) for f in fields])


def busiest_and_quietest(stations: DataFrame, key: str, count: str, place: str, core: Column) -> DataFrame:
    """A-29: median count with the busiest and quietest place, and how many stations are core ones."""
    counted = stations.filter(F.col(count).isNotNull())
    ends = counted.groupBy(key).agg(F.count(F.lit(1)).alias("stations"), F.count(F.when(core, 1)).alias("core"),
                                    F.max_by(place, F.struct(count, place)).alias("busiest"), F.min_by(place, F.struct(count, place)).alias("quietest"))
    return ends.join(quantiles(counted, [key], count, {"median": ("middle", 0.5)}), key)


def system_profile(routes: DataFrame, system: str, miles: str, freeway: str, toll: str, route: str) -> DataFrame:
    """A-32: routes, miles, upper-median length, freeway and toll share, and the longest route of a system."""
    basics = routes.groupBy(system).agg(
        F.count(F.lit(1)).alias("routes"), F.round(F.sum(miles), 1).alias("mi"), F.sum(F.col(miles) * F.col(freeway)).alias("_f"),
        F.sum(F.col(miles) * F.col(toll)).alias("_t"), F.sum(miles).alias("_mi"), F.max_by(route, F.struct(F.col(miles), -F.col(route))).alias("longest"))
    return basics.join(quantiles(routes, [system], miles, {"median": ("upper", 0.5)}), system).select(
        system, "routes", "mi", "median", percent(F.coalesce(F.col("_f"), F.lit(0.0)), F.col("_mi"), 1).alias("freeway"),
        percent(F.coalesce(F.col("_t"), F.lit(0.0)), F.col("_mi"), 1).alias("toll"), "longest")


def country_totals(routes: DataFrame, country: str, miles: str) -> DataFrame:
    """A-33: totals per country with their share of everything.  The window sees one row per country."""
    by = routes.groupBy(country).agg(F.count(F.lit(1)).alias("routes"), F.sum(miles).alias("_mi"))
    everything = W.partitionBy(F.lit(0))
    return by.select(country, "routes", F.round("_mi", 1).alias("mi"), percent(F.col("_mi"), F.sum("_mi").over(everything), 1).alias("share"))


def drawn_jurisdictions(pieces: DataFrame, keys: list[str], state: str) -> DataFrame:
    """A-34: distinct (designation, jurisdiction) pairs that are drawn."""
    return pieces.select(*keys, state).distinct()


def rank_correlation(rows: DataFrame, key: str, x: str, y: str, tie: str) -> DataFrame:
    """A-35: Spearman correlation per key; ties are ranked in the order of ``tie``."""
    ranked = positions(rows, [key], [F.col(x), F.col(tie)], x, name="_rx")
    ranked = positions(ranked, [key], [F.col(y), F.col(tie)], y, name="_ry")
    a, b = F.col("_rx").cast("double"), F.col("_ry").cast("double")
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.corr(a, b), F.lit(0.0)), 6).alias("rho"))


def orientation_fit(routes: DataFrame, cls: str, width: Column, height: Column, wanted: Column) -> DataFrame:
    """A-35: how many routes of a class run the way their number says."""
    runs = F.when(height > width, "ns").otherwise("ew")
    return routes.filter(wanted.isNotNull()).groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(runs == wanted, 1)).alias("ok"))


def panel_by_year(panel: DataFrame, year: str, station: str, value: str) -> DataFrame:
    """A-37: rows, distinct stations and median of a station panel by year."""
    by = panel.groupBy(year).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(station).alias("stations"))
    return by.join(quantiles(panel, [year], value, {"median": ("middle", 0.5)}), year)


def directory(rows: DataFrame, route: list[str], section: str, length: str) -> DataFrame:
    """A-38: a flattened directory: segments per section, its length, and whether the rows disagree on it."""
    return rows.groupBy(*route, section).agg(F.count(F.lit(1)).alias("segments"), F.max(length).alias("length"),
                                             (F.min(length) != F.max(length)).alias("inconsistent"))


def class_mix(rows: DataFrame, reason: Column) -> DataFrame:
    """A-39: rows per class or reason for rejection."""
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def inventory_touched(pieces: DataFrame, inventory: DataFrame, route: str, state: str, km: str) -> DataFrame:
    """A-40: published inventory of each jurisdiction a route touches, beside the national total."""
    total = inventory.withColumn("national", F.round(F.sum(km).over(W.partitionBy(F.lit(0))), 3))
    return pieces.select(route, state).distinct().join(total, state).select(route, state, F.round(km, 3).alias("km"), "national")


def register_against_drawn(register: DataFrame, drawn: DataFrame, number: str, state: str, km: str, branch: str) -> DataFrame:
    """A-41: register length and drawn length per number, branches apart, with the states of each."""
    listed = register.groupBy(number).agg(F.round(F.sum(F.when(~F.col(branch), F.col(km)).otherwise(0.0)), 3).alias("register_km"),
                                          F.round(F.sum(F.when(F.col(branch), F.col(km)).otherwise(0.0)), 3).alias("branch_km"),
                                          F.count_distinct(state).alias("states"))
    ours = drawn.groupBy(number).agg(F.round(F.sum(km), 3).alias("drawn_km"))
    return listed.join(ours, number, "left")


def lineage_flows(routes: DataFrame, system: str, miles: str, flows: DataFrame, matrix: DataFrame) -> DataFrame:
    """A-42: miles each source feeds into a system; an attribute source counts by its coverage.

    ``flows`` is (source, system, field); a null field is the geometry itself.
    """
    mi = routes.groupBy(system).agg(F.sum(miles).alias("_mi"))
    return (flows.join(mi, system).join(matrix, [system, "field"], "left")
            .withColumn("mi", F.round(F.when(F.col("field").isNull(), F.col("_mi")).otherwise(F.col("_mi") * F.col("cell") / 100), 3))
            .filter(F.col("mi") > 0).groupBy("source", system).agg(F.round(F.sum("mi"), 3).alias("mi")))


def gantry_points(gantries: DataFrame, gantry: str, lon: str, lat: str) -> DataFrame:
    """A-43: the two directions of a gantry as one point with its directions named."""
    return (gantries.withColumn("point", F.regexp_replace(gantry, "[NSEW]$", "")).groupBy("point")
            .agg(F.round(F.avg(lon), 6).alias("lon"), F.round(F.avg(lat), 6).alias("lat"), F.count(F.lit(1)).alias("gantries"),
                 # One of four letters each.
                 F.array_join(F.array_sort(F.collect_set(F.regexp_extract(gantry, "([NSEW])$", 1))), "").alias("directions")))


def places_served(pieces: DataFrame, cities: DataFrame, number: str, route: str, state: str, city: str) -> DataFrame:
    """A-44: "City, ST" of every jurisdiction a route touches, one row each."""
    return (pieces.select(route, number, state).distinct().join(cities, [number, state])
            .select(route, F.concat_ws(", ", F.col(city), F.col(state).cast("string")).alias("place")).distinct())


def number_reuse(routes: DataFrame, number: str, state: str, k: int) -> DataFrame:
    """A-45: numbers used in most jurisdictions."""
    return (routes.groupBy(number).agg(F.count_distinct(state).alias("states"), F.count(F.lit(1)).alias("routes"))
            .orderBy(F.col("states").desc(), F.col("routes").desc(), F.col(number)).limit(k))


def children_of(routes: DataFrame, number: str, digits: int = 2) -> DataFrame:
    """A-45: how many longer numbers end in each short parent number."""
    return (routes.select(number).distinct().filter(F.length(number) > digits)
            .withColumn("parent", F.regexp_replace(F.substring(F.col(number), -digits, digits), "^0", ""))
            .groupBy("parent").agg(F.count(F.lit(1)).alias("children")))


def source_age(rows: DataFrame, source: str, year: str) -> DataFrame:
    """A-47: latest year of each source."""
    return rows.groupBy(source).agg(F.max(year).alias("latest"), F.count(F.lit(1)).alias("rows"))

