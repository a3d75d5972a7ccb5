"""The measures as SQL functions, for queries written as text; the optimizer inlines them (P-1, P-5, P-10)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .geo import EARTH_KM, _A, _N

_POINT_LEG = "px DOUBLE, py DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE"


def _series(coefficients: list[float], first: str, second: str | None = None) -> str:
    """A sum of sines (or cosines) of even multiples."""
    return " + ".join(f"{c!r}D * " + " * ".join(f.format(2 * (j + 1)) for f in (first, second) if f) for j, c in enumerate(coefficients))


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name, parameters, type and body of each function, in the order in which they build on each other."""
    n = _N
    scale = 0.9999 * _A / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    inverse = [n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96, n ** 2 / 48 + n ** 3 / 15, 17 * n ** 3 / 480]
    latitude = [2 * n - 2 * n ** 2 / 3 - 2 * n ** 3, 7 * n ** 2 / 3 - 8 * n ** 3 / 5, 56 * n ** 3 / 15]
    return {
        "way_km": ("lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE",
                   f"{2 * EARTH_KM!r}D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
        "way_along": (_POINT_LEG, "DOUBLE", "CASE WHEN pow((bx - ax) * cos(radians(py)), 2) + pow(by - ay, 2) > 0 THEN greatest(0D, least(1D, "
                      "((px - ax) * (bx - ax) * pow(cos(radians(py)), 2) + (py - ay) * (by - ay)) / (pow((bx - ax) * cos(radians(py)), 2) + pow(by - ay, 2)))) ELSE 0D END"),
        "way_to_leg": (_POINT_LEG, "DOUBLE", "way_km(px, py, ax + (bx - ax) * way_along(px, py, ax, ay, bx, by), ay + (by - ay) * way_along(px, py, ax, ay, bx, by))"),
        "way_tm2_u": ("n DOUBLE, e DOUBLE", "DOUBLE", f"n - ({_series(inverse, 'sin({} * n)', 'cosh({} * e)')})"),
        "way_tm2_v": ("n DOUBLE, e DOUBLE", "DOUBLE", f"e - ({_series(inverse, 'cos({} * n)', 'sinh({} * e)')})"),
        "way_tm2_lat": ("chi DOUBLE", "DOUBLE", f"degrees(chi + {_series(latitude, 'sin({} * chi)')})"),
        "way_tm2": ("x DOUBLE, y DOUBLE", "STRUCT<lon: DOUBLE, lat: DOUBLE>",
                    f"named_struct('lon', 121D + degrees(atan2(sinh(way_tm2_v(y / {scale!r}D, (x - 250000) / {scale!r}D)), cos(way_tm2_u(y / {scale!r}D, (x - 250000) / {scale!r}D)))), "
                    f"'lat', way_tm2_lat(asin(sin(way_tm2_u(y / {scale!r}D, (x - 250000) / {scale!r}D)) / cosh(way_tm2_v(y / {scale!r}D, (x - 250000) / {scale!r}D)))))"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session: way_km, way_along, way_to_leg, way_tm2 and what they build on."""
    made = definitions()
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(made)
