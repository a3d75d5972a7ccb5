"""Tables laid over the routes: bridges, crossings, speeds, tolls, heights, names, reports (D-2..D-11, D-15..D-17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import designation as D
from ..functions.geo import dms, packed_metres, plausible, tile_address
from ..functions.numbers import js_round, null_if_redundant, year_in
from ..functions.text import other_names
from ..operators import attach, grid, identity, measures, statistics
from ..operators.lines import sample_evenly
from ..operators.ordered import BLOCK, carry
from ..runtime import cut
from ..sources.readers import edition_fallback, require_columns

FEET = 3.280839895


def bridges_on_routes(records: DataFrame, legs: DataFrame, first_year: int, last_year: int, match_km: float = 1) -> DataFrame:
    """D-2: inventory records placed on the nearest route of their designation.

    ``records`` has the record id, kind, key, st, packed lat and lon, built, rebuilt,
    length and structure type as text; ``legs`` has key, route and the leg.  Only records
    carried on a route count (kind ``1``).
    """
    require_columns(records, ["id", "kind", "key", "st", "lat", "lon", "built", "rebuilt", "length", "type"], "bridge inventory")
    placed = records.filter(F.col("kind") == "1").select(
        "id", "key", "st", (-dms(F.col("lon"), 3)).alias("lon"), dms(F.col("lat"), 2).alias("lat"), year_in(F.col("built"), first_year, last_year).alias("built"),
        year_in(F.col("rebuilt"), first_year, last_year).alias("_rebuilt"), F.col("length").try_cast("double").alias("_len"), "type")
    inside = placed.filter(F.col("lat").between(17, 72) & F.col("lon").between(-180, -64))
    hosts = grid.nearest_leg(inside.select("id", "key", "lon", "lat"), legs, match_km, "id", "route", ["key"])
    return inside.join(hosts, "id").select(
        "id", "st", "route", plausible(F.col("lon"), 180).alias("lon"), plausible(F.col("lat"), 90).alias("lat"), "built",
        null_if_redundant(F.col("_rebuilt"), F.col("built")).alias("rebuilt"), F.when(F.col("_len") > 0, js_round(F.col("_len") * 10) / 10.0).alias("length_m"),
        F.when(F.col("type") == "19", "culvert").alias("kind"))


def inventory_union(**sets: DataFrame) -> DataFrame:
    """D-3: the inventories of several authorities in one table; unplaceable rows are dropped."""
    tagged = [df.withColumn("set", F.lit(name)).withColumn("lon", plausible(F.col("lon"), 180)).withColumn("lat", plausible(F.col("lat"), 90)) for name, df in sets.items()]
    return identity.concat_tables(*tagged).filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def crossings(points: DataFrame, by_highway: DataFrame, vertices: DataFrame, border_legs: DataFrame, legs: DataFrame, meet_km: float = 2, near_km: float = 2, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """D-4: border crossings placed, and the routes near each.

    ``points`` (crossing, lon, lat) are placed already.  ``by_highway`` (crossing, key) name a
    road: they go where its vertices (key, lon, lat) come nearest the border.
    Returns (placed, near) with near = crossing, route, dist, rank.
    """
    spots = grid.nearest_vertex_to_boundary(vertices, border_legs, ["key"], meet_km)
    found = by_highway.join(spots, "key", "left")
    placed = (points.select("crossing", "lon", "lat", F.lit("source").alias("how"))
              .unionByName(found.select("crossing", "lon", "lat", F.when(F.col("lon").isNotNull(), "highway").otherwise("none").alias("how"))))
    near = grid.nearest_lines(placed.filter(F.col("lon").isNotNull()).select("crossing", "lon", "lat"), legs, near_km, "crossing", "route", most)
    return placed, near


def speed_tiers(routes: DataFrame, observed: DataFrame, laws: dict[str, int], least_cover: float = 25) -> DataFrame:
    """D-5: the limit of each route from the best tier: posted, observed, or the law's default.

    ``routes`` has route, system, km, posted, posted_cover; ``observed`` has route, kph, km.
    Observation of under ``least_cover`` percent gives way to the law where there is one.
    """
    law = D.mapped(F.col("system"), {k: str(v) for k, v in laws.items()}).cast("int")
    limits = measures.dominant_limit(observed.join(routes.select("route", F.col("km").alias("route_km")), "route"), "route", "kph", "km", "route_km")
    seen = routes.join(limits, "route", "left").withColumn("_law", law)
    thin = F.col("kph").isNotNull() & (F.col("cover") < least_cover) & F.col("_law").isNotNull()
    source = (F.when(F.col("posted").isNotNull(), "p").when(thin, "l").when(F.col("kph").isNotNull(), "o").when(F.col("_law").isNotNull(), "l").otherwise("u"))
    limit = F.when(source == "p", F.col("posted")).when(source == "o", F.col("kph")).when(source == "l", F.col("_law"))
    return seen.select("route", "system", source.alias("source"), limit.cast("int").alias("limit"), F.when(source == "p", F.col("posted_cover")).otherwise(F.col("cover")).alias("cover"))


def tariff_links(titles: DataFrame, matches: DataFrame, routes: DataFrame) -> DataFrame:
    """D-6: toll titles linked to routes: by number and state where the title gives one, else by approved match.

    ``titles`` has title, number, st; ``matches`` has title, route, name, approved; ``routes`` has route, number, st.
    """
    listed = titles.filter(F.col("number").isNotNull())
    numbered = attach.numbers_in_states(listed, routes, "title", "route", "number", "st").withColumn("by", F.lit("number"))
    named = attach.approved_matches(matches, "title", "route", "name", "approved").select("title", "route", F.lit("name").alias("by"))
    # The links by number are as many as titles times routes of a number, so only the named pairs are looked up.
    rest = named.join(attach.linked_by_number(named, listed, routes, "title", "route", "number", "st"), ["title", "route"], "left_anti")
    return numbered.unionByName(rest)


def elevation_profiles(vertices: DataFrame, pixels: DataFrame, key: str, samples: int = 220, zoom: int = 9, tile_pixels: int = 256, dry: Column | None = None) -> DataFrame:
    """D-7: heights along each route, in feet, from a pixel table (tx, ty, px, py, metres).

    A sample without a pixel keeps the height before it, and 0 before the first.  Below sea
    level is water, bridged from bank to bank, except where ``dry`` holds.
    """
    points = sample_evenly(vertices, [key], samples)
    addressed = points.withColumn("_t", tile_address(F.col("lon"), F.col("lat"), zoom, tile_pixels)).select(key, "n", "lon", "lat", "_t.*")
    found = addressed.join(pixels, ["tx", "ty", "px", "py"], "left")
    water = (F.col("metres") < 0) & ~(F.lit(False) if dry is None else dry)
    # What a sample reads: a height, water, or nothing.
    read = F.when(F.col("metres").isNotNull(), F.struct(water.alias("water"), js_round(F.col("metres") * FEET).cast("double").alias("ft")))
    # What was read is written once, and the three passes along the routes share its blocks.
    rows = cut(found.select(key, "n", F.floor(F.col("n") / BLOCK).alias("_block"), read.alias("_r")))
    kept = carry(rows, [key], "n", "_r", "_c", block="_block").select(key, "n", "_block", F.coalesce("_r", F.col("_c.value")).alias("_r"))
    ft = F.when(F.col("_r").isNull(), 0.0).when(~F.col("_r.water"), F.col("_r.ft"))
    filled = measures.fill_gaps(kept.select(key, "n", "_block", ft.alias("h")), key, "n", "h", block="_block")
    return filled.select(key, "n", F.col("filled").alias("ft"))


def pixel_heights(tiles: DataFrame) -> DataFrame:
    """D-7, P-40: packed colour bytes (tx, ty, px, py, r, g, b) as metres."""
    return tiles.select("tx", "ty", "px", "py", packed_metres(F.col("r"), F.col("g"), F.col("b")).alias("metres"))


def towns(samples: DataFrame, cities: DataFrame, districts: DataFrame, route: str, order: list[str], km: float = 10, parent_km: float = 60) -> DataFrame:
    """D-8: cities along each route in travel order; a district counts as the large city it belongs to.

    ``cities`` has city, olon, olat, large; ``districts`` has district, lon, lat.
    """
    big = cities.filter("large").select("city", "olon", "olat")
    filed = grid.parent_cities(districts, big, "district", "city", parent_km).join(districts, "district").select("city", F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    return grid.towns_along(samples, cities.select("city", "olon", "olat").unionByName(filed), route, order, "city", km)


def route_names(names: DataFrame, key: str, priority: list[str], numeric: str) -> DataFrame:
    """D-9: the name of a route from its best source, and its other names; names that are numbers do not count.

    ``names`` has the key and one column per source.
    """
    usable = [F.when(~F.col(c).rlike(numeric), F.col(c)) for c in priority]
    named = names.select(key, F.coalesce(*usable).alias("name"), other_names(*usable).alias("_all"))
    others = F.trim(F.expr("substring(_all, length(name) + 1)"))
    return named.filter(F.col("name").isNotNull()).select(key, "name", F.when(others != "", others).alias("also"))


def insights(routes: DataFrame, system: str, miles: str, official: str, gap: str, breaks: str, key: str, fields: dict[str, Column]) -> dict[str, DataFrame]:
    """D-10: the report tables: coverage, broken routes, largest gaps, length errors and the farthest off."""
    error = (F.col(miles) / F.col(official) - 1) * 100
    checked = routes.filter(F.col(official) > 0)
    return {
        "coverage": measures.coverage_matrix(routes, system, miles, fields),
        "broken": measures.broken_share(routes, system, breaks, gap),
        "gaps": identity.top(routes.filter(F.col(gap) > 0).select(key, system, miles, gap), [F.col(gap).desc(), F.col(key)], 20),
        "errors": statistics.histogram(checked, [system], error, [-100, -25, -10, -5, -2, 2, 5, 10, 25], "lo"),
        "outliers": identity.top(checked.select(key, system, F.round(error, 1).alias("error")), [F.abs("error").desc(), F.col(key)], 12),
    }


def register_coverage(listed: DataFrame, drawn: DataFrame, reasons: DataFrame, system: str, keys: list[str]) -> DataFrame:
    """D-11: per system, designations listed, drawn, absent with a reason and absent without."""
    seen = attach.membership(listed.select(system, *keys), drawn, [system, *keys])
    why = seen.join(reasons.select(system, *keys).distinct().withColumn("_why", F.lit(True)), [system, *keys], "left")
    n = lambda c: F.count(F.when(c, 1))
    return why.groupBy(system).agg(F.count(F.lit(1)).alias("listed"), n(F.col("drawn")).alias("drawn"), n(~F.col("drawn") & F.col("_why").isNotNull()).alias("explained"),
                                   n(~F.col("drawn") & F.col("_why").isNull()).alias("unexplained"))


def coverage_verdicts(reported: DataFrame, drawn: DataFrame, source: DataFrame, short_km: float, least_mi: float = 1) -> DataFrame:
    """D-15, A-26: each reported (st, system, number, mi): covered, otherSystem, notIn, short or in.

    ``drawn`` has st, system, number; ``source`` the longest stretch of each (st, system, number, km).
    """
    keys = ["st", "system", "number"]
    wanted = reported.filter(F.col("mi") >= least_mi).select(*keys, "mi")
    here = drawn.select(*keys).distinct().withColumn("_here", F.lit(True))
    # One row per number and state, so another system is found without pairing systems.
    other = drawn.groupBy("st", "number").agg(F.min("system").alias("_s0"), F.max("system").alias("_s1"))
    stretch = source.groupBy(*keys).agg(F.max("km").alias("_km"))
    j = wanted.join(here, keys, "left").join(other, ["st", "number"], "left").join(stretch, keys, "left")
    elsewhere = (F.col("_s0") != F.col("system")) | (F.col("_s1") != F.col("system"))
    verdict = (F.when(F.col("_here"), "covered").when(elsewhere, "otherSystem").when(F.coalesce("_km", F.lit(0.0)) == 0, "notIn")
               .when(F.col("_km") < short_km, "short").otherwise("in"))
    return j.select(*keys, "mi", verdict.alias("verdict"))


def directional_traffic(counts: DataFrame) -> DataFrame:
    """D-16: counts per place and direction (route, section, place, direction, date, row_id, value, km, year) as route figures.

    Two-way volumes first, then the mean of a section's places, then sections weighted by length.
    """
    places = measures.two_way(counts, ["route", "section", "place"], "direction", "date", "value", "row_id")
    volumes = places.groupBy("route", "section").agg(F.avg("volume").alias("aadt"))
    facts = counts.groupBy("route", "section").agg(F.max("km").alias("km"), F.min("year").alias("year"))
    rows = volumes.join(facts, ["route", "section"]).filter(F.col("km") > 0)
    return measures.accumulate(rows, ["route"], "km", ["aadt"], "year", peak="aadt")


def normalise_counts(rows: DataFrame, shape: dict[str, Column], method: str) -> DataFrame:
    """D-16: one publisher's table in the common shape (route, km, aadt, truck, speed, year, method)."""
    common = ["route", "km", "aadt", "truck", "speed", "year"]
    return rows.select(*[shape.get(c, F.lit(None)).cast("string" if c == "route" else "int" if c == "year" else "double").alias(c) for c in common], F.lit(method).alias("method"))


def station_panel(current: DataFrame, previous: DataFrame, year: int, key: str, shares: list[str], truck: str) -> tuple[DataFrame, DataFrame]:
    """D-17: the latest station panel with the fallback edition, and its class-sum checks per jurisdiction."""
    panel = edition_fallback(current, previous, key, year, year - 1)
    total = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in shares), F.lit(0.0))
    heavy = sum((F.coalesce(F.col(s), F.lit(0.0)) for s in shares[2:]), F.lit(0.0))
    checks = panel.groupBy(key).agg(F.count(F.lit(1)).alias("stations"), F.count(F.when(F.abs(total - 100) > 1, 1)).alias("sums_off"),
                                    F.count(F.when(F.abs(heavy - F.col(truck)) > 0.5, 1)).alias("trucks_off"), F.min("edition").alias("edition"))
    return panel, checks
