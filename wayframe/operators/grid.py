"""Distance joins over a cell grid (J-1..J-8, J-13, J-15, J-25..J-27, J-29, J-34, J-35, G-14).

Spark has no spatial index, but a grid cell makes a distance join an equi-join.  Lines are
spread over the cells they may be met from; a point stays in its one cell, so every pair
is looked at once and the point side is never multiplied.  Crowded cells are split by
:func:`skew_join`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, distance, haversine, offset_deg, project
from ..runtime import cut, skew_join
from .ordered import first_by, top_k


def in_cell(df: DataFrame, size: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Add the cell of a point."""
    return df.withColumn("_cx", F.floor(F.col(lon) / size)).withColumn("_cy", F.floor(F.col(lat) / size))


def pad(lat: Column, km: float) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that surely hold ``km`` around ``lat``."""
    return F.lit(km / 110.5) / F.greatest(F.cos(F.radians(F.abs(lat) + km / 110.5)), F.lit(0.01)), F.lit(km / 110.5)


def around(df: DataFrame, size: float, km: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Repeat a point over all cells from which it may lie within ``km``."""
    dx, dy = pad(F.col(lat), km)
    span = lambda c, d: F.sequence(F.floor((c - d) / size), F.floor((c + d) / size))
    return df.withColumn("_cx", F.explode(span(F.col(lon), dx))).withColumn("_cy", F.explode(span(F.col(lat), dy)))


def leg_cells(df: DataFrame, size: float, dx: Column, dy: Column) -> DataFrame:
    """Repeat a leg over the cells its padded course crosses: column by column, not its whole box."""
    x0, x1 = F.least("ax", "bx"), F.greatest("ax", "bx")
    df = df.withColumn("_px", dx).withColumn("_py", dy).withColumn(
        "_cx", F.explode(F.sequence(F.floor((x0 - F.col("_px")) / size), F.floor((x1 + F.col("_px")) / size))))
    # The part of the leg that a point of this column may be near.
    left = F.greatest(x0, F.col("_cx") * size - F.col("_px"))
    right = F.least(x1, (F.col("_cx") + 1) * size + F.col("_px"))
    slope = F.when(F.col("bx") != F.col("ax"), (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax")))
    at = lambda x: F.col("ay") + slope * (x - F.col("ax"))
    low = F.when(slope.isNull(), F.least("ay", "by")).otherwise(F.least(at(left), at(right)))
    high = F.when(slope.isNull(), F.greatest("ay", "by")).otherwise(F.greatest(at(left), at(right)))
    return df.withColumn("_cy", F.explode(F.sequence(F.floor((low - F.col("_py") - 1e-9) / size), F.floor((high + F.col("_py") + 1e-9) / size)))).drop("_px", "_py")


def leg_distance(metric: str, px: Column, py: Column) -> Column:
    """Distance from a point to leg ax,ay-bx,by in one of the distance models."""
    spot = project(px, py, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return spot["km"] if metric == "haversine" else distance(metric, px, py, spot["lon"], spot["lat"])


def near_legs(points: DataFrame, line_legs: DataFrame, km: float, on: list[str] = (), size: float | None = None,
              metric: str = "haversine") -> DataFrame:
    """J-2: points and the legs within ``km`` of them that share the ``on`` columns; adds ``dist``."""
    size = size or max(km / 40, 0.0005)
    dx, dy = pad(F.greatest(F.abs("ay"), F.abs("by")), km)
    cells = leg_cells(line_legs, size, dx, dy)
    joined = skew_join(in_cell(points, size), cells, [*on, "_cx", "_cy"])
    return joined.withColumn("dist", leg_distance(metric, F.col("lon"), F.col("lat"))).filter(F.col("dist") <= km).drop("_cx", "_cy")


def nearest_leg(points: DataFrame, line_legs: DataFrame, km: float, point: str, line: str, on: list[str] = (),
                keep: list[str] = (), size: float | None = None, metric: str = "haversine") -> DataFrame:
    """J-1: the nearest line of each point within ``km`` among those of its designation (ties to the least id)."""
    hits = near_legs(points, line_legs, km, on, size, metric)
    return first_by(hits, [point], ["dist", line], [line, "dist", *keep])


def at_spots(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct places of points, numbered (_spot, lon, lat), and the points with the number of theirs.

    What is asked of a place is then asked once, however many points stand there.
    """
    spots = cut(points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select("lon", "lat").distinct().withColumn("_spot", F.monotonically_increasing_id()))
    return spots, points.join(spots, ["lon", "lat"])


def nearest_lines(points: DataFrame, line_legs: DataFrame, km: float, point: str, line: str, k: int) -> DataFrame:
    """J-5: up to ``k`` lines nearest to each point within ``km``, nearest first.

    Legs are the larger table, so each goes to the cells it crosses only and places to those around them.
    A pair that meets in two cells counts once, as the least distance is taken.
    """
    spots, at = at_spots(points.select(point, "lon", "lat"))
    size = max(km / 40, 0.0005)
    eps = F.lit(1e-9)
    hits = (skew_join(leg_cells(line_legs.select(line, "ax", "ay", "bx", "by"), size, eps, eps), around(spots, size, km), ["_cx", "_cy"])
            .withColumn("dist", leg_distance("haversine", F.col("lon"), F.col("lat"))).filter(F.col("dist") <= km))
    order = [F.col("dist"), F.col(line)]
    few = cut(top_k(hits.groupBy("_spot", line).agg(F.min("dist").alias("dist")), ["_spot"], order, k).drop("rank"))
    return top_k(at.select(point, "_spot").join(few, "_spot").groupBy(point, line).agg(F.min("dist").alias("dist")), [point], order, k)


def near_points(points: DataFrame, others: DataFrame, km: float, on: list[str] = (), size: float | None = None,
                metric: str = "haversine") -> DataFrame:
    """J-2: points and the other points (olon, olat) within ``km`` of them; adds ``dist``."""
    size = size or max(km / 40, 0.0005)
    spread = around(others, size, km, "olon", "olat")
    joined = skew_join(in_cell(points, size), spread, [*on, "_cx", "_cy"])
    return (joined.withColumn("dist", distance(metric, F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat")))
            .filter(F.col("dist") <= km).drop("_cx", "_cy"))


def within(samples: DataFrame, others: DataFrame, km: float, on: list[str] = (),
           also: Column | None = None, spread_samples: bool = False) -> DataFrame:
    """J-2, G-14: the samples that lie within ``km`` of any of the other points (columns olon, olat).

    The others are first thinned to one row per exact place (unless ``also`` tells those of a place
    apart), and only whether there is a neighbour is asked.  Crowded cells are answered by a semi-join,
    which stops at the first hit and emits no pairs.  The others are spread over the cells around
    them, or, where they are far more than the samples (which must then be distinct), the samples.
    Cells are twice as wide as the reach, so that each is spread over about 4 of them.
    """
    size = max(2 * km / KM_PER_DEG, 1e-5)
    extra = [] if also is None else [c for c in others.columns if c not in (*on, "olon", "olat")]
    spots = others.select(*on, "olon", "olat", *extra)
    spots = spots.distinct() if also is None else spots
    if spread_samples:
        a, b = around(samples, size, km).alias("a"), in_cell(spots, size, "olon", "olat").alias("b")
    else:
        a, b = in_cell(samples, size).alias("a"), around(spots, size, km, "olon", "olat").alias("b")
    cond = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*on, "_cx", "_cy")]
    cond.append(haversine(F.col("a.lon"), F.col("a.lat"), F.col("b.olon"), F.col("b.olat")) <= km)
    if also is not None:
        cond.append(also)
    test = cond[0]
    for c in cond[1:]:
        test = test & c
    hit = a.join(b, test, "left_semi").drop("_cx", "_cy")
    return hit.distinct() if spread_samples else hit


def within_deg(points: DataFrame, line_legs: DataFrame, on: list[str], degrees: float, size: float = 0.02) -> DataFrame:
    """Points within ``degrees`` of latitude of any leg that shares ``on`` (semi-join)."""
    widest = F.lit(degrees) / F.greatest(F.cos(F.radians(F.greatest(F.abs("ay"), F.abs("by")) + degrees)), F.lit(0.01))
    cells = leg_cells(line_legs, size, widest, F.lit(degrees)).alias("b")
    a = in_cell(points, size).alias("a")
    test = (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy"))
    for c in on:
        test = test & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    d = offset_deg(F.col("a.lon"), F.col("a.lat"), F.col("b.ax"), F.col("b.ay"), F.col("b.bx"), F.col("b.by"), F.cos(F.radians(F.col("a.lat"))))
    return a.join(cells, test & (d < degrees), "left_semi").drop("_cx", "_cy")


def coincident_share(samples: DataFrame, others: DataFrame, keys: list[str], km: float, on: list[str] = (), spread_samples: bool = False) -> DataFrame:
    """G-14: share of a line's samples within ``km`` of the other points."""
    hit = within(samples, others, km, on, spread_samples=spread_samples).groupBy(*keys).agg(F.count(F.lit(1)).alias("_hit"))
    return (samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).join(hit, keys, "left")
            .select(*keys, "samples", (F.coalesce("_hit", F.lit(0)) / F.col("samples")).alias("share")))


# No two places are farther apart.
EARTH_KM = 20_100
# Rings widen by this factor; the first is so small that an average cell holds few rows.
WIDER = 4
FEW = 4


def first_ring(others: DataFrame, most_km: float, on: list[str] = ()) -> float:
    """A radius at which a cell holds about :data:`FEW` of the others, from their number and extent (one bounded row)."""
    each = others.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), (F.max("olon") - F.min("olon")).alias("w"), (F.max("olat") - F.min("olat")).alias("h"))
    seen = each.agg(F.sum("n").alias("n"), F.sum(F.greatest(F.col("w"), F.lit(1e-4)) * F.greatest(F.col("h"), F.lit(1e-4))).alias("area")).first()
    if not seen["n"]:
        return most_km
    return max(min(most_km, KM_PER_DEG * (FEW * seen["area"] / seen["n"]) ** 0.5), most_km / WIDER ** 8)


def in_rings(points: DataFrame, keys: list[str], look: Callable[[DataFrame, float], DataFrame], first_km: float, most_km: float) -> DataFrame:
    """What ``look(points, km)``, the nearest of each point within ``km``, finds for each point in the smallest ring that holds any.

    Looks around all points at once, in rings that widen by a factor.  A point whose nearest lies within the
    ring is settled, as all that it has not met is farther; it leaves before the next ring.  A point
    so meets only what is up to a few times as far as its nearest, however much lies within ``most_km``.
    """
    left, m = cut(points, rows=F.count(F.lit(1)))
    km, settled = first_km, []
    while True:
        km = min(km, most_km)
        found = cut(look(left, km))
        settled.append(found)
        if km >= most_km or not m["rows"]:
            return reduce(lambda a, b: a.unionByName(b), settled)
        left, m = cut(left.join(found.select(*keys), keys, "left_anti"), rows=F.count(F.lit(1)))
        if not m["rows"]:
            return reduce(lambda a, b: a.unionByName(b), settled)
        km *= WIDER


def sharing(points: DataFrame, others: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points and others that share a value of ``on`` with the other side."""
    if not on:
        return points, others
    both = cut(points.select(*on).distinct().join(others.select(*on).distinct(), on))
    return points.join(both, on, "left_semi"), others.join(both, on, "left_semi")


def nearest_in_rings(points: DataFrame, others: DataFrame, point: str, other: str, most_km: float, on: list[str] = (), keep: list[str] = (),
                     radius: float | None = None, first_km: float | None = None) -> DataFrame:
    """The nearest other (olon, olat) of each point that shares ``on`` and lies within ``most_km``: (point, other, keep, dist).

    Equally near ones go to the least id.  Points with nothing within reach give no row.  Points of one place
    look once, and of others at one place only the one of least id is met.
    """
    points, others = sharing(points.select(*dict.fromkeys([point, *on]), "lon", "lat"), others.select(*on, other, "olon", "olat", *keep), on)
    spot = [*on, "lon", "lat"]
    others = cut(first_by(others, [*on, "olon", "olat"], [other], [other, *keep]))
    measure = haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat"), *([radius] if radius else []))

    def look(left: DataFrame, km: float) -> DataFrame:
        near = skew_join(in_cell(left, km / KM_PER_DEG), around(others, km / KM_PER_DEG, km, "olon", "olat"), [*on, "_cx", "_cy"]).withColumn("dist", measure)
        return first_by(near.filter(F.col("dist") <= km), spot, ["dist", other], [other, *keep, "dist"])
    found = in_rings(points.select(*spot).distinct(), spot, look, first_km or first_ring(others, most_km, on), most_km)
    return first_by(points.join(found, spot), [point], ["dist", other], [other, *keep, "dist"])


def nearest_leg_in_rings(points: DataFrame, line_legs: DataFrame, keys: list[str], order: list[str], keep: list[str], on: list[str] = (), first_km: float = 1, most_km: float = EARTH_KM) -> DataFrame:
    """The nearest leg of each point that shares ``on``: (keys, keep); equally near ones by ``order``.  ``keep`` may name ``dist``."""
    points, line_legs = sharing(points, line_legs, on)
    return in_rings(points, keys, lambda left, km: first_by(near_legs(left, line_legs, km, on), keys, ["dist", *order], keep), first_km, most_km)


# Fixed value: km that prominence may count at most.
PROMINENCE = 6.0


def nearest_place(points: DataFrame, places: DataFrame, point: str, place: str) -> DataFrame:
    """J-3: the place of least distance less a prominence bonus (half the root of its area, at most 6 km).

    Places of the point's own one-degree cell and the eight around it are considered.  At one spot only the
    most prominent place counts.  A spot is settled once nothing outside the ring can score less.
    """
    bonus = F.least(F.lit(PROMINENCE), F.sqrt("area") * 0.5)
    best_at = cut(first_by(places.withColumn("_bonus", bonus), ["olon", "olat"], [-F.col("_bonus"), place], [place, "_bonus"]))
    spots, at = at_spots(points.select(point, "lon", "lat"))
    beside = lambda a, b: F.abs(F.floor(a) - F.floor(b)) <= 1
    most_km = 3 * KM_PER_DEG  # farther than any place of the nine cells

    def look(left: DataFrame, km: float) -> DataFrame:
        near = (skew_join(in_cell(left, km / KM_PER_DEG), around(best_at, km / KM_PER_DEG, km, "olon", "olat"), ["_cx", "_cy"])
                .withColumn("km", haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat")))
                .filter((F.col("km") <= km) & beside("lon", "olon") & beside("lat", "olat")).withColumn("_score", F.col("km") - F.col("_bonus")))
        best = first_by(near, ["_spot"], ["_score", place], [place, "km", "_score"])
        return best if km >= most_km else best.filter(F.col("_score") <= km - PROMINENCE)

    found = in_rings(spots, ["_spot"], look, max(first_ring(best_at, most_km), 2 * PROMINENCE), most_km)
    return first_by(at.select(point, "_spot").join(found, "_spot"), [point], ["_score", place], [place, F.round("km", 1).alias("km")])


def tiered_place(points: DataFrame, places: DataFrame, point: str, place: str, near_km: float = 30, far_km: float = 120,
                 city_bonus: float = 8, radius: float = 6371.0) -> DataFrame:
    """J-4: best place within the near radius; only where there is none, within the far one.  A city counts nearer.

    Among cities, and among the rest, the nearest is the best, so each kind is searched in rings and
    the two are compared, once for each place at which points stand.
    """
    kinds = [(cut(places.filter(F.col("kind").eqNullSafe("city"))), city_bonus), (cut(places.filter(~F.col("kind").eqNullSafe("city"))), 0.0)]

    spots, at = at_spots(points.select(point, "lon", "lat"))

    def best(pts: DataFrame, km: float) -> DataFrame:
        hits = [nearest_in_rings(pts, of, "_spot", place, km, radius=radius).withColumn("_score", F.col("dist") - bonus) for of, bonus in kinds]
        return first_by(hits[0].unionByName(hits[1]), ["_spot"], ["_score", place], [place, "dist", "_score"])

    close = cut(best(spots, near_km))
    far = best(spots.join(close.select("_spot"), "_spot", "left_anti"), far_km)
    found = close.withColumn("_far", F.lit(False)).unionByName(far.withColumn("_far", F.lit(True)))
    return first_by(at.select(point, "_spot").join(found, "_spot"), [point], ["_far", "_score", place], [place, F.round("dist", 1).alias("km")])


def polygons_at(points: DataFrame, rings: DataFrame, point: str, code: str, band: float = 0.25) -> DataFrame:
    """J-6: the polygon each point lies in, holes cut out (least code where several).

    A ray east of the point crosses the edges of one latitude band only, so points and
    edges meet on the band; the parity of crossings is an aggregate.
    """
    nxt = rings.select(code, "ring", (F.col("seq") - 1).alias("seq"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    first = rings.filter(F.col("seq") == 0).select(code, "ring", F.col("lon").alias("_fx"), F.col("lat").alias("_fy"))
    edges = (rings.select(code, "ring", "seq", F.col("lon").alias("ax"), F.col("lat").alias("ay"))
             .join(nxt, [code, "ring", "seq"], "left").join(first, [code, "ring"])
             .withColumn("bx", F.coalesce("bx", "_fx")).withColumn("by", F.coalesce("by", "_fy")))
    edges = edges.filter(F.col("ay") != F.col("by")).select(code, "ax", "ay", "bx", "by").withColumn(
        "_band", F.explode(F.sequence(F.floor(F.least("ay", "by") / band), F.floor(F.greatest("ay", "by") / band))))
    boxes = rings.groupBy(code).agg(F.min("lon").alias("_x0"), F.max("lon").alias("_x1"), F.min("lat").alias("_y0"), F.max("lat").alias("_y1"))
    wide = boxes.withColumn("_cx", F.explode(F.sequence(F.floor("_x0"), F.floor("_x1")))).withColumn("_cy", F.explode(F.sequence(F.floor("_y0"), F.floor("_y1"))))
    candidates = (skew_join(in_cell(points.select(point, "lon", "lat"), 1.0), wide, ["_cx", "_cy"])
                  .filter(F.col("lon").between(F.col("_x0"), F.col("_x1")) & F.col("lat").between(F.col("_y0"), F.col("_y1")))
                  .select(point, "lon", "lat", code, F.floor(F.col("lat") / band).alias("_band")))
    straddles = (F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat"))
    crossing = F.col("lon") < (F.col("bx") - F.col("ax")) * (F.col("lat") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    crossed = (skew_join(candidates, edges, [code, "_band"]).filter(straddles & crossing)
               .groupBy(point, code).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") % 2 == 1))
    return crossed.groupBy(point).agg(F.min(code).alias(code))


def nearest_boundary(points: DataFrame, rings: DataFrame, point: str, code: str, max_deg: float) -> DataFrame:
    """J-7: the polygon with the nearest boundary vertex within ``max_deg`` degrees."""
    spots = rings.select(code, F.col("lon").alias("olon"), F.col("lat").alias("olat")).distinct()
    span = lambda c: F.sequence(F.floor((F.col(c) - max_deg) / max_deg), F.floor((F.col(c) + max_deg) / max_deg))
    spread = spots.withColumn("_cx", F.explode(span("olon"))).withColumn("_cy", F.explode(span("olat")))
    d = F.sqrt(F.pow(F.col("lon") - F.col("olon"), 2) + F.pow(F.col("lat") - F.col("olat"), 2))
    hits = skew_join(in_cell(points, max_deg), spread, ["_cx", "_cy"]).withColumn("deg", d).filter(F.col("deg") <= max_deg)
    return first_by(hits, [point], ["deg", code], [code, "deg"])


def assign_jurisdiction(points: DataFrame, rings: DataFrame, point: str, code: str, max_deg: float = 0.2) -> DataFrame:
    """J-8: the polygon a point lies in, else the one it is nearly in; adds ``how``."""
    inside = polygons_at(points, rings, point, code).withColumn("how", F.lit("inside"))
    rest = points.join(inside.select(point), point, "left_anti")
    beside = nearest_boundary(rest, rings, point, code, max_deg).select(point, code).withColumn("how", F.lit("near"))
    return inside.unionByName(beside)


def place_stations(stations: DataFrame, line_legs: DataFrame, designation: str, station: str, route: str, km: float = 5) -> DataFrame:
    """J-13: each station on the nearest route of its designation; placed, far or unmatched."""
    hosts = nearest_leg(stations, line_legs, km, station, route, [designation])
    known = line_legs.select(designation).distinct().withColumn("_known", F.lit(True))
    status = F.when(F.col("_known").isNull(), "unmatched").when(F.col(route).isNull(), "far").otherwise("placed")
    return (stations.select(station, designation).join(known, designation, "left").join(hosts, station, "left")
            .withColumn("status", status).drop("_known"))


def credit_ways(ways: DataFrame, line_legs: DataFrame, keys: list[str], way: str, route: str, km: float = 0.35) -> DataFrame:
    """J-15: each observed leg credited to the nearest route of each of its keys within ``km`` of its middle."""
    hits = near_legs(ways, line_legs, km, keys, metric="flat_square", size=0.05)
    return first_by(hits, [way, *keys], ["dist", route], [route, "dist", "len"])


def boundary_distance(points: DataFrame, border_legs: DataFrame, km: float, point: str) -> DataFrame:
    """J-27: distance of each point to a boundary, for points within ``km`` of it."""
    return near_legs(points, border_legs, km, metric="flat").groupBy(point).agg(F.min("dist").alias("dist"))


def nearest_vertex_to_boundary(vertices: DataFrame, border_legs: DataFrame, keys: list[str], km: float = 2) -> DataFrame:
    """J-26: where the vertices of each named road come nearest the boundary, within ``km``."""
    return first_by(near_legs(vertices, border_legs, km, metric="flat"), keys, ["dist", "lon", "lat"], ["lon", "lat", "dist"])


def route_end(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """J-25: the end of a route that lies farther north."""
    ends = vertices.groupBy(*keys).agg(F.min_by(F.struct("lon", "lat"), "seq").alias("_a"), F.max_by(F.struct("lon", "lat"), "seq").alias("_b"))
    north = F.when(F.col("_a.lat") >= F.col("_b.lat"), F.col("_a")).otherwise(F.col("_b"))
    return ends.select(*keys, north["lon"].alias("lon"), north["lat"].alias("lat"))


def not_covered(samples: DataFrame, network_legs: DataFrame, keys: list[str], km: float = 0.4, share: float = 0.5) -> DataFrame:
    """J-29: named lines of which at most ``share`` of the samples lies within ``km`` of the numbered network."""
    hit = within_deg(samples, network_legs, [], km / KM_PER_DEG).groupBy(*keys).agg(F.count(F.lit(1)).alias("_hit"))
    return (samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples")).join(hit, keys, "left")
            .withColumn("covered", F.coalesce("_hit", F.lit(0)) / F.col("samples")).filter(F.col("covered") <= share).drop("_hit"))


def towns_along(samples: DataFrame, cities: DataFrame, route: str, order: list[str], city: str, km: float = 10) -> DataFrame:
    """J-34: cities within ``km`` of a route with where along it each is first met.

    Routes meet the spots at which cities stand; only what they first meet is then told by city.
    """
    at = cut(cities.select(city, "olon", "olat").distinct())
    spots = cut(at.select("olon", "olat").distinct().withColumn("_spot", F.monotonically_increasing_id()))
    first = F.min(order[0] if len(order) == 1 else F.struct(*order)).alias("_at")
    met = cut(near_points(samples.select(route, *order, "lon", "lat"), spots, km).groupBy(route, "_spot").agg(first))
    names = at.join(spots, ["olon", "olat"]).select(city, "_spot")
    several = names.groupBy(city).agg((F.count(F.lit(1)) > 1).alias("_several"))
    names = cut(names.join(several, city, "left").withColumn("_several", F.coalesce("_several", F.lit(True))))
    # A city of one spot meets a route there only; those of several, the districts' cities, are put together.
    once = met.join(names.filter(~F.col("_several")), "_spot").select(route, city, "_at")
    every = once.unionByName(met.join(names.filter("_several"), "_spot").groupBy(route, city).agg(F.min("_at").alias("_at")))
    return every.select(route, city, *([F.col("_at").alias(order[0])] if len(order) == 1 else ["_at.*"]))


def parent_cities(districts: DataFrame, cities: DataFrame, district: str, city: str, km: float = 60) -> DataFrame:
    """J-34: the large city a district is filed under: the nearest within ``km``."""
    return nearest_in_rings(districts, cities, district, city, km)


def facility_points(listed: DataFrame, named: DataFrame, facility: str) -> DataFrame:
    """J-35: mean of a facility's listed points, else of the vertices that bear its name."""
    mean = lambda d, p: d.groupBy(facility).agg(F.avg("lon").alias(f"_{p}x"), F.avg("lat").alias(f"_{p}y"))
    both = mean(listed, "p").join(mean(named, "n"), facility, "full_outer")
    return both.select(facility, F.round(F.coalesce("_px", "_nx"), 7).alias("lon"), F.round(F.coalesce("_py", "_ny"), 7).alias("lat"),
                       F.when(F.col("_px").isNotNull(), "listed").otherwise("named").alias("by"))
