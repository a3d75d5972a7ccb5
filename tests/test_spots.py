"""Distance joins ask once for each place, however many points or others stand there."""

import pytest
from pyspark.sql import functions as F

from wayframe.operators import grid

SPOTS = "array(struct(-100D AS lon, 30D AS lat), struct(-100D AS lon, 30.02D AS lat), struct(-99D AS lon, 31D AS lat))"


@pytest.fixture
def sides(monkeypatch):
    seen, join = [], grid.skew_join

    def counted(left, right, on, how="inner"):
        seen.extend([left.count(), right.count()])
        return join(left, right, on, how)
    monkeypatch.setattr(grid, "skew_join", counted)
    return seen


def placed(spark, n, name, lon="lon", lat="lat"):
    at = F.element_at(F.expr(SPOTS), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias(name), at["lon"].alias(lon), at["lat"].alias(lat))


def answers(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select(*cols).collect()}


def test_nearest(spark, sides):
    points, others = placed(spark, 300, "pt"), placed(spark, 210, "place", "olon", "olat")
    assert answers(grid.nearest_in_rings(points, others, "pt", "place", 10), "pt", "place", "dist") == {k: (k % 3, 0.0) for k in range(300)}
    kinds = others.withColumn("kind", F.when(F.col("place") < 100, "town").otherwise("city"))
    assert answers(grid.tiered_place(points, kinds, "pt", "place"), "pt", "place") == {k: (102 if k % 3 == 0 else 100 + (k % 3 - 1),) for k in range(300)}
    assert max(sides) < 100


def test_prominent_place(spark, sides):
    points = placed(spark, 300, "pt")
    places = placed(spark, 210, "place", "olon", "olat").withColumn("area", F.when(F.col("place").isin(7, 10), 100.0).otherwise(1.0))
    # Place 7, at the second spot, is prominent by 5 km; the first spot lies 2.2 km off.
    assert answers(grid.nearest_place(points, places, "pt", "place"), "pt", "place", "km") == {k: ((7, 2.2), (7, 0.0), (2, 0.0))[k % 3] for k in range(300)}
    assert max(sides) < 100


def test_nearest_lines(spark, sides):
    points = placed(spark, 300, "pt").unionByName(placed(spark, 4, "pt").filter("pt = 3").withColumn("pt", F.lit(1).cast("bigint")))
    legs = spark.createDataFrame([(k, -100.01, 30.0 + k / 100, -99.99, 30.0 + k / 100) for k in range(5)], "line int, ax double, ay double, bx double, by double")
    got = {}
    for r in grid.nearest_lines(points, legs, 4, "pt", "line", 2).collect():
        got.setdefault(r["pt"], []).append((r["rank"], r["line"]))
    want = {k: ([(1, 0), (2, 1)], [(1, 2), (2, 1)])[k % 3] for k in range(300) if k % 3 < 2}
    assert {k: sorted(v) for k, v in got.items()} == want | {1: [(1, 0), (2, 2)]}
    assert max(sides) < 100


def test_towns(spark, sides):
    samples = placed(spark, 6, "road").withColumn("seq", F.col("road") * 2)
    cities = placed(spark, 300, "city", "olon", "olat").unionByName(placed(spark, 2, "city", "olon", "olat").withColumn("city", F.lit(2).cast("bigint")))
    got = sorted(map(tuple, grid.towns_along(samples, cities, "road", ["seq"], "city", 1).collect()))
    at = {c: {c % 3} for c in range(300)} | {2: {0, 1, 2}}
    assert got == sorted((r, c, 2 * r) for r in range(6) for c in range(300) if r % 3 in at[c])
    assert max(sides) < 100
