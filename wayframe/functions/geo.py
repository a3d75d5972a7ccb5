"""Geometry columns on lon/lat pairs (P-1..P-12, P-40, G-22, G-26).

A line is ``ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>`` of one source fragment.  Whole
routes are never one array; they stay rows of fragments or vertices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import js_round

EARTH_KM = 6371.0088
KM_PER_DEG = 111.32


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """P-1: great-circle distance in km."""
    h = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def flat(lon1: Column, lat1: Column, lon2: Column, lat2: Column,
         lat_km: float = 110.57, lon_km: float = KM_PER_DEG) -> Column:
    """P-2: distance on a local plane, scaled at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * lon_km
    return F.sqrt(F.pow(dx, 2) + F.pow((lat2 - lat1) * lat_km, 2))


def distance(metric: str, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """One of the three distance models: ``haversine``, ``flat`` or ``flat_square``."""
    if metric == "haversine":
        return haversine(lon1, lat1, lon2, lat2)
    return flat(lon1, lat1, lon2, lat2, lat_km=110.57 if metric == "flat" else KM_PER_DEG)


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """P-5: nearest place on segment a-b: struct(t, lon, lat, km); a point segment has t = 0.

    The numbers are taken in the order in which the SQL beside the queries takes them: between two lines that lie
    on each other, one turned, the last bit of the distance decides which is the nearest.
    """
    k = F.cos(F.radians(py))
    dx, dy = bx - ax, by - ay
    length2 = F.pow(dx * k, 2) + F.pow(dy, 2)
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (px - ax) * dx * F.pow(k, 2) + (py - ay) * dy) / length2))).otherwise(F.lit(0.0))
    lon, lat = ax + (bx - ax) * t, ay + (by - ay) * t
    return F.struct(t.alias("t"), lon.alias("lon"), lat.alias("lat"),
                    haversine(px, py, lon, lat).alias("km"))


def offset_deg(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column, k: Column) -> Column:
    """P-5: distance from a point to segment a-b in latitude degrees, longitudes scaled by ``k``."""
    dx, dy = (bx - ax) * k, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (px - ax) * k * dx + (py - ay) * dy) / length2))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow((px - ax) * k - dx * t, 2) + F.pow(py - ay - dy * t, 2))


def leg_kms(coords: Column) -> Column:
    """Length of each leg of one fragment."""
    return F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))),
                      F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))),
                      lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))


def line_km(coords: Column) -> Column:
    """P-3: length of one fragment in km."""
    return F.aggregate(leg_kms(coords), F.lit(0.0), lambda acc, x: acc + x)


def bbox(coords: Column) -> Column:
    """P-7: bounding box of one fragment."""
    lons, lats = F.transform(coords, lambda c: c["lon"]), F.transform(coords, lambda c: c["lat"])
    return F.struct(F.array_min(lons).alias("x0"), F.array_min(lats).alias("y0"),
                    F.array_max(lons).alias("x1"), F.array_max(lats).alias("y1"))


def bbox_gap_km(a: Column, b: Column) -> Column:
    """P-7: gap between two boxes, zero where they overlap."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, a["x0"] - b["x1"], b["x0"] - a["x1"])
    dy = F.greatest(zero, a["y0"] - b["y1"], b["y0"] - a["y1"])
    mid = (a["y0"] + a["y1"] + b["y0"] + b["y1"]) / 4
    return F.sqrt(F.pow(dx * F.cos(F.radians(mid)), 2) + F.pow(dy, 2)) * KM_PER_DEG


def round_coords(coords: Column, decimals: int = 4) -> Column:
    """P-8: round every vertex and drop repeats of the one before; two points at least stay."""
    m = float(10 ** decimals)
    rounded = F.transform(coords, lambda c: F.struct((js_round(c["lon"] * m) / m).alias("lon"),
                                                     (js_round(c["lat"] * m) / m).alias("lat")))
    kept = F.filter(rounded, lambda c, i: (i == 0) | (c != F.get(rounded, i - 1)))
    return F.when(F.size(kept) >= 2, kept).otherwise(F.slice(rounded, 1, 2))


def middle(coords: Column) -> Column:
    """P-9: middle vertex of a fragment."""
    return F.get(coords, F.floor(F.size(coords) / 2).cast("int"))


def reverse_line(coords: Column) -> Column:
    return F.reverse(coords)


# GRS80 ellipsoid and the third-order series of the transverse Mercator projection.
_A, _FLAT = 6378137.0, 1 / 298.257222101
_N = _FLAT / (2 - _FLAT)


def tm2_to_lonlat(x: Column, y: Column, lon0: float = 121.0, k0: float = 0.9999, false_east: float = 250000.0) -> Column:
    """P-10: projected metres to struct(lon, lat), third-order series."""
    n, n2, n3 = _N, _N ** 2, _N ** 3
    rectifying = _A / (1 + n) * (1 + n2 / 4 + n2 * n2 / 64)
    inverse = [n / 2 - 2 * n2 / 3 + 37 * n3 / 96, n2 / 48 + n3 / 15, 17 * n3 / 480]
    latitude = [2 * n - 2 * n2 / 3 - 2 * n3, 7 * n2 / 3 - 8 * n3 / 5, 56 * n3 / 15]
    north, east = y / (k0 * rectifying), (x - false_east) / (k0 * rectifying)
    u = north - sum(c * F.sin(north * (2 * (j + 1))) * F.cosh(east * (2 * (j + 1))) for j, c in enumerate(inverse))
    v = east - sum(c * F.cos(north * (2 * (j + 1))) * F.sinh(east * (2 * (j + 1))) for j, c in enumerate(inverse))
    conformal = F.asin(F.sin(u) / F.cosh(v))
    lat = conformal + sum(c * F.sin(conformal * (2 * (j + 1))) for j, c in enumerate(latitude))
    return F.struct((F.degrees(F.atan2(F.sinh(v), F.cos(u))) + lon0).alias("lon"), F.degrees(lat).alias("lat"))


def dms(text: Column, degree_digits: int) -> Column:
    """P-11: packed degrees, minutes and hundredths of seconds to degrees."""
    padded = F.lpad(F.trim(text), degree_digits + 6, "0")
    digits = F.when(padded.rlike(r"^\d+$"), padded)
    degrees = F.substring(digits, 1, degree_digits).cast("double")
    minutes = F.substring(digits, degree_digits + 1, 2).cast("double")
    seconds = F.substring(digits, degree_digits + 3, 32).cast("double") / 100
    return F.when((digits.cast("double") != 0) & (minutes < 60) & (seconds < 60),
                  degrees + minutes / 60 + seconds / 3600)


def plausible(value: Column, limit: float, decimals: int = 5) -> Column:
    """P-12: a coordinate within the limit and not zero, rounded; else null."""
    m = float(10 ** decimals)
    return F.when((F.abs(value) <= limit) & (value != 0), js_round(value * m) / m)


def in_box(lon: Column, lat: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """P-12: bounding-box predicate."""
    return lon.between(x0, x1) & lat.between(y0, y1)


def tile_address(lon: Column, lat: Column, zoom: int, pixels: int = 256) -> Column:
    """P-40: Web-Mercator tile and pixel holding a point."""
    x = (lon + 180) / 360 * (2 ** zoom)
    rad = F.radians(lat)
    y = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2 * (2 ** zoom)
    inside = lambda v: F.least(F.lit(pixels - 1), F.floor((v - F.floor(v)) * pixels)).cast("int")
    return F.struct(F.floor(x).cast("int").alias("tx"), F.floor(y).cast("int").alias("ty"),
                    inside(x).alias("px"), inside(y).alias("py"))


def packed_metres(r: Column, g: Column, b: Column) -> Column:
    """P-40: height in metres packed in three colour bytes."""
    return r * 256 + g + b / 256 - 32768


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """G-26: initial bearing in degrees, 0..360."""
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    deg = F.degrees(F.atan2(y, x)) + 360.0
    return deg - F.floor(deg / 360.0) * 360.0


def runs_forward(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """G-22: true when a line already runs south to north, or west to east if it is wider than tall."""
    tall = F.abs(lat2 - lat1) >= F.abs(lon2 - lon1)
    return F.when(tall, lat2 > lat1).otherwise(lon2 > lon1)
