"""Queries over lines, distances and the cell grid (P-1..P-12, P-40, G-*, J-1..J-8 ...)."""

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.sql import register
from ..operators import grid as N
from ..operators import lines as L
from ..operators import ordered as O
from .registry import query


def hav(a, b, c, d, r=6371.0088):
    return (f"({2 * r} * asin(least(1.0, sqrt(pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) "
            f"* pow(sin(radians(({c}) - ({a})) / 2), 2)))))")


def flat(a, b, c, d, lat_km=110.57):
    return f"sqrt(pow((({c}) - ({a})) * cos(radians((({b}) + ({d})) / 2)) * 111.32, 2) + pow((({d}) - ({b})) * {lat_km}, 2))"


_T = ("CASE WHEN pow((bx - ax) * cos(radians({y})), 2) + pow(by - ay, 2) > 0 THEN greatest(0.0, least(1.0, (({x} - ax) * (bx - ax) * pow(cos(radians({y})), 2) "
      "+ ({y} - ay) * (by - ay)) / (pow((bx - ax) * cos(radians({y})), 2) + pow(by - ay, 2)))) ELSE 0.0 END")


def to_leg(x, y):
    t = _T.format(x=x, y=y)
    return hav(x, y, f"ax + (bx - ax) * ({t})", f"ay + (by - ay) * ({t})")


LEGS = """legs AS (SELECT a.seg_id, a.group_key, b.i AS seq, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by FROM vertices a JOIN vertices b ON a.seg_id = b.seg_id AND b.i = a.i + 1)"""


def vertices(t):
    return t.vertices.withColumnRenamed("i", "seq")


def road_legs(t):
    return L.legs(vertices(t), ["seg_id", "group_key"])


def fragments(t):
    return L.to_fragments(vertices(t), ["seg_id", "group_key"]).drop("block")


@query("P1_P2_distances", f"""SELECT o_orderkey, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS haversine, round({hav('a.lon', 'a.lat', 'b.lon', 'b.lat', 6371.0)}, 6) AS sphere,
  round({flat('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 6) AS flat, round({flat('a.lon', 'a.lat', 'b.lon', 'b.lat', 111.32)}, 6) AS square
FROM (SELECT seg_id AS o_orderkey, lon, lat FROM vertices WHERE i = 0) a JOIN (SELECT seg_id, lon, lat FROM vertices WHERE i = 4) b ON o_orderkey = seg_id""")
def distances(t):
    a = t.vertices.filter("i = 0").select("seg_id", F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    b = t.vertices.filter("i = 4").select("seg_id", F.col("lon").alias("bx"), F.col("lat").alias("by"))
    p = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    return a.join(b, "seg_id").select(F.col("seg_id").alias("o_orderkey"), F.round(G.haversine(*p), 6).alias("haversine"), F.round(G.haversine(*p, 6371.0), 6).alias("sphere"),
                                      F.round(G.distance("flat", *p), 6).alias("flat"), F.round(G.distance("flat_square", *p), 6).alias("square"))


@query("P3_line_lengths", f"WITH {LEGS} SELECT seg_id, round(sum({hav('ax', 'ay', 'bx', 'by')}), 6) AS km FROM legs GROUP BY seg_id")
def line_lengths(t):
    return fragments(t).select("seg_id", F.round(G.line_km(F.col("coords")), 6).alias("km"))


@query("P4_chainage", f"""WITH {LEGS} SELECT seg_id, CAST(seq AS INT) AS seq, round(sum({hav('ax', 'ay', 'bx', 'by')}) OVER (PARTITION BY seg_id ORDER BY seq), 6) AS to_km FROM legs""")
def chainage(t):
    return L.chainage(vertices(t), ["seg_id"]).select("seg_id", F.col("seq").cast("int").alias("seq"), F.round("to_km", 6).alias("to_km"))


@query("P5_projection", f"""WITH {LEGS}, p AS (SELECT *, (ax + bx) / 2 + 0.003 AS px, (ay + by) / 2 - 0.002 AS py FROM legs)
SELECT seg_id, CAST(seq AS INT) AS seq, round({_T.format(x='px', y='py')}, 5) AS t, round({to_leg('px', 'py')}, 6) AS km FROM p""")
def projection(t):
    px, py = (F.col("ax") + F.col("bx")) / 2 + 0.003, (F.col("ay") + F.col("by")) / 2 - 0.002
    spot = G.project(px, py, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return road_legs(t).select("seg_id", F.col("seq").cast("int").alias("seq"), F.round(spot["t"], 5).alias("t"), F.round(spot["km"], 6).alias("km"))


@query("P6_distance_to_own_lines", f"""WITH {LEGS}, s AS (SELECT o_orderkey, o_custkey, -120 + (o_custkey * 37 % 5000) / 100.0 + 0.3 AS lon, 26 + (o_custkey * 53 % 2200) / 100.0 + (o_orderkey % 50) / 1000.0 AS lat FROM orders)
SELECT o_orderkey, round(min({to_leg('lon', 'lat')}), 6) AS km FROM s JOIN legs ON o_custkey = group_key GROUP BY o_orderkey""")
def distance_to_own_lines(t):
    s = t.sql("SELECT o_orderkey, o_custkey AS group_key, CAST(-120 + (o_custkey * 37 % 5000) / 100.0 + 0.3 AS DOUBLE) AS lon, CAST(26 + (o_custkey * 53 % 2200) / 100.0 + (o_orderkey % 50) / 1000.0 AS DOUBLE) AS lat FROM orders")
    return L.distance_to_lines(s, road_legs(t), ["group_key"], ["o_orderkey"]).select("o_orderkey", F.round("km", 6).alias("km"))


@query("P7_boxes", f"""WITH b AS (SELECT group_key, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM vertices GROUP BY 1)
SELECT a.group_key, round(a.x0, 6) AS x0, round(a.y1, 6) AS y1, round(sqrt(pow(greatest(0, a.x0 - c.x1, c.x0 - a.x1) * cos(radians((a.y0 + a.y1 + c.y0 + c.y1) / 4)), 2) + pow(greatest(0, a.y0 - c.y1, c.y0 - a.y1), 2)) * 111.32, 5) AS gap
FROM b a JOIN b c ON c.group_key = a.group_key + 1""")
def boxes(t):
    b = L.extents(vertices(t), ["group_key"])
    box = F.struct("x0", "y0", "x1", "y1")
    a = b.select("group_key", box.alias("a"))
    c = b.select((F.col("group_key") - 1).alias("group_key"), box.alias("c"))
    return a.join(c, "group_key").select("group_key", F.round("a.x0", 6).alias("x0"), F.round("a.y1", 6).alias("y1"), F.round(G.bbox_gap_km(F.col("a"), F.col("c")), 5).alias("gap"))


@query("P8_rounded_coords", """WITH r AS (SELECT seg_id, i, floor((lon + 0.0031) * 10 + 0.5) / 10 AS x, floor((lat + 0.0017) * 10 + 0.5) / 10 AS y FROM vertices),
d AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM r WINDOW w AS (PARTITION BY seg_id ORDER BY i)), k AS (SELECT seg_id, count(*) AS n, sum(x) AS sx FROM d WHERE px IS NULL OR px <> x OR py <> y GROUP BY 1),
f AS (SELECT seg_id, sum(x) AS sx FROM r WHERE i <= 1 GROUP BY 1)
SELECT k.seg_id, CAST(greatest(n, 2) AS INT) AS n, round(CASE WHEN n >= 2 THEN k.sx ELSE f.sx END, 6) AS sum_lon FROM k JOIN f ON k.seg_id = f.seg_id""")
def rounded_coords(t):
    moved = F.transform("coords", lambda c: F.struct((c["lon"] + 0.0031).alias("lon"), (c["lat"] + 0.0017).alias("lat")))
    r = fragments(t).select("seg_id", G.round_coords(moved, 1).alias("r"))
    return r.select("seg_id", F.size("r").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda a, c: a + c["lon"]), 6).alias("sum_lon"))


@query("P9_middle_vertices", "SELECT seg_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM vertices WHERE i = 2")
def middle_vertices(t):
    m = G.middle(F.col("coords"))
    return fragments(t).select("seg_id", F.round(m["lon"], 6).alias("lon"), F.round(m["lat"], 6).alias("lat"))


_TM2_N = 1 / 298.257222101 / (2 - 1 / 298.257222101)


def _tm2_sql() -> str:
    n = _TM2_N
    a = 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)
    b = [n / 2 - 2 / 3 * n ** 2 + 37 / 96 * n ** 3, n ** 2 / 48 + n ** 3 / 15, 17 / 480 * n ** 3]
    d = [2 * n - 2 / 3 * n ** 2 - 2 * n ** 3, 7 / 3 * n ** 2 - 8 / 5 * n ** 3, 56 / 15 * n ** 3]
    u = " ".join(f"- {c!r}::DOUBLE * sin({2 * j + 2} * xi) * cosh({2 * j + 2} * eta)" for j, c in enumerate(b))
    v = " ".join(f"- {c!r}::DOUBLE * cos({2 * j + 2} * xi) * sinh({2 * j + 2} * eta)" for j, c in enumerate(b))
    p = " ".join(f"+ {c!r}::DOUBLE * sin({2 * j + 2} * chi)" for j, c in enumerate(d))
    return f"""WITH s AS (SELECT o_orderkey, (2450000 + o_orderkey * 29 % 350000) / {0.9999 * a!r}::DOUBLE AS xi, (150000 + o_orderkey * 13 % 200000 - 250000) / {0.9999 * a!r}::DOUBLE AS eta FROM orders),
w AS (SELECT o_orderkey, xi {u} AS u, eta {v} AS v FROM s), x AS (SELECT *, asin(sin(u) / cosh(v)) AS chi FROM w)
SELECT o_orderkey, round(121 + degrees(atan2(sinh(v), cos(u))), 7) AS lon, round(degrees(chi {p}), 7) AS lat FROM x"""


@query("P10_projected_coordinates", _tm2_sql())
def projected(t):
    spot = G.tm2_to_lonlat((150000 + F.col("o_orderkey") * 13 % 200000).cast("double"), (2450000 + F.col("o_orderkey") * 29 % 350000).cast("double"))
    return t.orders.select("o_orderkey", F.round(spot["lon"], 7).alias("lon"), F.round(spot["lat"], 7).alias("lat"))


_SPOTS = """SELECT o_orderkey, -120 + CAST(o_orderkey % 97 AS DOUBLE) / 10 AS ax, 30 + CAST(o_orderkey % 31 AS DOUBLE) / 10 AS ay, -120 + CAST(o_orderkey % 97 AS DOUBLE) / 10 + CAST(o_orderkey % 7 AS DOUBLE) / 20 AS bx, 30 + CAST(o_orderkey % 31 AS DOUBLE) / 10 + CAST(o_orderkey % 5 AS DOUBLE) / 25 AS by,
  -120 + CAST(o_orderkey % 97 AS DOUBLE) / 10 + CAST(o_orderkey % 11 AS DOUBLE) / 30 AS px, 30 + CAST(o_orderkey % 31 AS DOUBLE) / 10 + CAST(o_orderkey % 13 AS DOUBLE) / 60 AS py FROM orders"""


@query("P1_P5_P10_sql_functions", f"""WITH p AS ({_SPOTS}), tm AS ({_tm2_sql()})
SELECT p.o_orderkey, round({hav('ax', 'ay', 'px', 'py')}, 6) AS km, round({to_leg('px', 'py')}, 6) AS to_leg, lon, lat FROM p JOIN tm ON p.o_orderkey = tm.o_orderkey""")
def sql_functions(t):
    """The same measures in a query that is text."""
    register(t.spark)
    spots = t.sql(_SPOTS).select("o_orderkey", *[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by", "px", "py")])
    return t.spark.sql("""SELECT o_orderkey, round(way_km(ax, ay, px, py), 6) AS km, round(way_to_leg(px, py, ax, ay, bx, by), 6) AS to_leg, round(spot.lon, 7) AS lon, round(spot.lat, 7) AS lat
FROM (SELECT *, way_tm2(150000D + o_orderkey * 13 % 200000, 2450000D + o_orderkey * 29 % 350000) AS spot FROM {spots})""", spots=spots)


_DMS = "CAST(o_orderkey * 7919 % 100000000 AS STRING)"


@query("P11_degrees_minutes_seconds", f"""WITH p AS (SELECT o_orderkey, lpad({_DMS}, 8, '0') AS v FROM orders), q AS (SELECT o_orderkey, v, CAST(substr(v, 1, 2) AS DOUBLE) AS d, CAST(substr(v, 3, 2) AS DOUBLE) AS m, CAST(substr(v, 5) AS DOUBLE) / 100 AS s FROM p)
SELECT o_orderkey, CASE WHEN CAST(v AS DOUBLE) <> 0 AND m < 60 AND s < 60 THEN round(d + m / 60 + s / 3600, 8) END AS deg FROM q""")
def degrees_minutes_seconds(t):
    return t.orders.select("o_orderkey", F.round(G.dms((F.col("o_orderkey") * 7919 % 100000000).cast("string"), 2), 8).alias("deg"))


@query("P12_plausible_coordinates", """SELECT c_custkey, CASE WHEN abs(c_acctbal / 50) <= 90 AND c_acctbal <> 0 THEN floor(c_acctbal / 50 * 100000.0 + 0.5) / 100000.0 END AS lat,
  c_acctbal / 50 BETWEEN 20 AND 60 AND c_nationkey BETWEEN 5 AND 15 AS inside FROM customer""")
def plausible_coordinates(t):
    lat = F.col("c_acctbal") / 50
    return t.customer.select("c_custkey", G.plausible(lat, 90).alias("lat"), G.in_box(F.col("c_nationkey"), lat, 5, 20, 15, 60).alias("inside"))


@query("P40_tile_addresses", """WITH p AS (SELECT pt, (lon + 180) / 360 * 512 AS x, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512 AS y FROM points)
SELECT pt, CAST(floor(x) AS INT) AS tx, CAST(floor(y) AS INT) AS ty, CAST(least(255, floor((x - floor(x)) * 256)) AS INT) AS px, CAST(least(255, floor((y - floor(y)) * 256)) AS INT) AS py FROM p""")
def tile_addresses(t):
    return t.points.select("pt", G.tile_address(F.col("lon"), F.col("lat"), 9).alias("a")).select("pt", "a.*")


# ---------------------------------------------------------------- line rewriting
_SIMPLIFIED = f"""WITH RECURSIVE v AS (SELECT seg_id, i, lon, lat FROM vertices),
e AS (SELECT a.seg_id, cos(radians((a.lat + b.lat) / 2)) AS k FROM v a JOIN v b ON a.seg_id = b.seg_id AND a.i = 0 AND b.i = 4),
w(seg_id, lo, hi, level) AS (SELECT seg_id, 0, 4, 0 FROM e
 UNION ALL SELECT seg_id, CASE WHEN side = 0 THEN lo ELSE far END, CASE WHEN side = 0 THEN far ELSE hi END, level + 1 FROM
  (SELECT w.seg_id, w.lo, w.hi, w.level, arg_min(v.i, (-d.d, v.i)) AS far FROM w JOIN e ON w.seg_id = e.seg_id JOIN v ON v.seg_id = w.seg_id AND v.i > w.lo AND v.i < w.hi
   JOIN v a ON a.seg_id = w.seg_id AND a.i = w.lo JOIN v b ON b.seg_id = w.seg_id AND b.i = w.hi,
   LATERAL (SELECT (b.lon - a.lon) * k AS dx, b.lat - a.lat AS dy, (v.lon - a.lon) * k AS qx, v.lat - a.lat AS qy) g,
   LATERAL (SELECT sqrt(pow(qx - dx * greatest(0, least(1, (qx * dx + qy * dy) / (dx * dx + dy * dy))), 2) + pow(qy - dy * greatest(0, least(1, (qx * dx + qy * dy) / (dx * dx + dy * dy))), 2)) AS d) d
   WHERE d.d > 0.0007 GROUP BY 1, 2, 3, 4) s, (VALUES (0), (1)) sides(side)),
kept AS (SELECT DISTINCT seg_id, CAST(i AS INT) AS seq FROM (SELECT seg_id, lo AS i FROM w UNION ALL SELECT seg_id, hi FROM w))"""


@query("G1_simplified", f"{_SIMPLIFIED} SELECT seg_id, seq FROM kept")
def simplified(t):
    return L.simplify(vertices(t), ["seg_id"], 0.0007).select("seg_id", F.col("seq").cast("int").alias("seq"))


_CHAIN = f"""c AS (SELECT seg_id, seq, ax, ay, bx, by, sum(k) OVER (PARTITION BY seg_id ORDER BY seq) AS t1, k FROM (SELECT *, {hav('ax', 'ay', 'bx', 'by')} AS k FROM legs)),
d AS (SELECT *, t1 - k AS t0 FROM c)"""


@query("G2_resampled", f"""WITH {LEGS}, {_CHAIN}, s AS (SELECT seg_id, unnest(generate_series(0, CAST(floor(max(t1) / 0.4) AS BIGINT))) AS n FROM d GROUP BY seg_id),
h AS (SELECT s.seg_id, n, ax, ay, bx, by, (n * 0.4 - t0) / k AS f FROM s JOIN d ON s.seg_id = d.seg_id AND ((n = 0 AND seq = 1) OR (n * 0.4 > t0 AND n * 0.4 <= t1)))
SELECT seg_id, CAST(n AS BIGINT) AS n, round(ax + (bx - ax) * f, 6) AS lon, round(ay + (by - ay) * f, 6) AS lat FROM h""")
def resampled(t):
    return L.resample(vertices(t), ["seg_id"], 0.4).select("seg_id", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("G2_sampled_evenly", f"""WITH {LEGS}, {_CHAIN}, x AS (SELECT seg_id, max(t1) AS total FROM d GROUP BY 1), s AS (SELECT seg_id, total, unnest(generate_series(0, 9)) AS n FROM x),
h AS (SELECT s.seg_id, n, arg_min(d, seq) AS r, max(total) AS total FROM s JOIN d ON s.seg_id = d.seg_id AND (t1 >= n / 9.0 * total - 1e-9) GROUP BY 1, 2)
SELECT seg_id, CAST(n AS BIGINT) AS n, round(r.ax + (r.bx - r.ax) * least(1, (n / 9.0 * total - r.t0) / r.k), 5) AS lon, round(r.ay + (r.by - r.ay) * least(1, (n / 9.0 * total - r.t0) / r.k), 5) AS lat FROM h""")
def sampled_evenly(t):
    return L.sample_evenly(vertices(t), ["seg_id"], 10).select("seg_id", "n", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"))


@query("G3_walked", f"""WITH {LEGS}, {_CHAIN}, s AS (SELECT d.*, unnest(generate_series(CAST(floor(t0 / 0.2) + 1 AS BIGINT), CAST(ceil(t1 / 0.2) - 1 AS BIGINT))) AS n FROM d WHERE k > 0)
SELECT seg_id, round(n * 0.2, 6) AS along, round(ax + (bx - ax) * (n * 0.2 - t0) / k, 6) AS lon FROM s
UNION ALL SELECT seg_id, round(max(t1), 6), round(arg_max(bx, seq), 6) FROM d GROUP BY seg_id""")
def walked(t):
    return L.sample_fragments(fragments(t), ["seg_id"], "coords", 0.2).select("seg_id", F.round("along", 6).alias("along"), F.round("lon", 6).alias("lon"))


@query("G3_subdivided", f"""WITH {LEGS}, p AS (SELECT *, greatest(1, ceil({hav('ax', 'ay', 'bx', 'by')} / 0.5)) AS n FROM legs)
SELECT seg_id, CAST(seq AS INT) AS seq, CAST(s AS INT) AS part, round(ax + (bx - ax) * s / n, 6) AS lon FROM (SELECT *, unnest(generate_series(CASE WHEN seq = 1 THEN 0 ELSE 1 END, CAST(n AS BIGINT))) AS s FROM p)""")
def subdivided(t):
    return L.subdivide(vertices(t), ["seg_id"], 0.5).select("seg_id", F.col("seq").cast("int").alias("seq"), "part", F.round("lon", 6).alias("lon"))


@query("G5_unfolded", f"""WITH r AS (SELECT seg_id, lon, lat FROM vertices WHERE i = 0), d AS (SELECT v.seg_id, i, sqrt(pow((v.lon - r.lon) * cos(radians(r.lat)), 2) + pow(v.lat - r.lat, 2)) AS d,
  sqrt(pow((v.lon - r.lon) * cos(radians(r.lat)), 2) + pow(v.lat + 0.0002 - r.lat, 2)) AS d2 FROM vertices v JOIN r ON v.seg_id = r.seg_id),
f AS (SELECT seg_id, greatest(max(d), max(d2) FILTER (i < 4)) AS far, arg_max(i, (d, -i)) AS tip, max(d2) FILTER (i < 4) AS back_far, max(d) AS out_far, max(d2) FILTER (i = 0) AS ends FROM d GROUP BY 1)
SELECT f.seg_id, far >= 0.027 AND ends <= far / 2 AND back_far <= out_far AS folded FROM f""")
def unfolded(t):
    # Each fragment is drawn out and back again: seq 0..4 and the same places home.
    v = vertices(t)
    back = v.filter("seq < 4").withColumn("seq", 8 - F.col("seq")).withColumn("lat", F.col("lat") + 0.0002)
    parts = L.unfold(v.unionByName(back).select("seg_id", "seq", "lon", "lat"), ["seg_id"], out_deg=0.027)
    return parts.groupBy("seg_id").agg((F.max("part") == 1).alias("folded"))


@query("G22_oriented", """WITH e AS (SELECT a.seg_id, CASE WHEN abs(b.lat - a.lat) >= abs(b.lon - a.lon) THEN b.lat > a.lat ELSE b.lon > a.lon END AS f FROM vertices a JOIN vertices b ON a.seg_id = b.seg_id AND a.i = 0 AND b.i = 4)
SELECT v.seg_id, CAST(CASE WHEN f THEN i ELSE 4 - i END AS INT) AS seq, round(lon, 6) AS lon, NOT f AS flipped FROM vertices v JOIN e ON v.seg_id = e.seg_id""")
def oriented(t):
    return L.orient(vertices(t), ["seg_id"]).select("seg_id", F.col("seq").cast("int").alias("seq"), F.round("lon", 6).alias("lon"), "flipped")


_BEAR = "(degrees(atan2(sin(radians(bx - ax)) * cos(radians(by)), cos(radians(ay)) * sin(radians(by)) - sin(radians(ay)) * cos(radians(by)) * cos(radians(bx - ax)))) + 360)"


@query("G26_track", f"""WITH {LEGS}, {_CHAIN} SELECT seg_id, CAST(seq AS INT) AS seq, round(t1, 6) AS along, round({_BEAR} - floor({_BEAR} / 360) * 360, 5) AS bearing, k > 1.3 AS gap FROM d""")
def track(t):
    return L.track(vertices(t), ["seg_id"], 1.3).select("seg_id", F.col("seq").cast("int").alias("seq"), F.round("along", 6).alias("along"), F.round("bearing", 5).alias("bearing"), "gap")


@query("G26_points_at", f"""WITH {LEGS}, {_CHAIN}, w AS (SELECT o_orderkey AS seg_id, (o_orderkey % 40) / 10.0 + 0.05 AS at_km FROM orders)
SELECT w.seg_id, round(at_km, 6) AS at_km, round(ax + (bx - ax) * (at_km - t0) / k, 6) AS lon FROM w JOIN d ON w.seg_id = d.seg_id AND at_km >= t0 AND at_km < t1""")
def points_at(t):
    wanted = t.sql("SELECT o_orderkey AS seg_id, CAST((o_orderkey % 40) / 10.0 + 0.05 AS DOUBLE) AS at_km FROM orders")
    return L.point_at(vertices(t), ["seg_id"], wanted, "at_km").select("seg_id", F.round("at_km", 6).alias("at_km"), F.round("lon", 6).alias("lon"))


@query("D13_background_lines", f"WITH {LEGS} SELECT seg_id, round(sum({hav('ax', 'ay', 'bx', 'by')}), 6) AS km FROM legs GROUP BY seg_id HAVING sum({hav('ax', 'ay', 'bx', 'by')}) >= 5")
def background_lines(t):
    return L.background(fragments(t), "coords", 5).select("seg_id", F.round("km", 6).alias("km"))


# ---------------------------------------------------------------- distance joins
_NEAR_OWN = f"""{LEGS}, n AS (SELECT station, seg_id, group_key, min({to_leg('lon', 'lat')}) AS dist FROM stations JOIN legs ON route = group_key GROUP BY 1, 2, 3)"""


@query("J1_nearest_line", f"""WITH {_NEAR_OWN} SELECT station, arg_min(seg_id, (dist, seg_id)) AS seg_id, round(min(dist), 6) AS dist FROM n WHERE dist <= 1 GROUP BY station""")
def nearest_line(t):
    stations = t.stations.withColumnRenamed("route", "group_key").select("station", "group_key", "lon", "lat")
    return N.nearest_leg(stations, road_legs(t), 1, "station", "seg_id", ["group_key"]).withColumn("dist", F.round("dist", 6))


@query("J2_points_near_points", f"""SELECT pt, place_id, round({hav('p.lon', 'p.lat', 'q.lon', 'q.lat')}, 6) AS dist FROM points p JOIN places q ON q.lat BETWEEN p.lat - 0.1 AND p.lat + 0.1 AND q.lon BETWEEN p.lon - 0.15 AND p.lon + 0.15
WHERE {hav('p.lon', 'p.lat', 'q.lon', 'q.lat')} <= 8""")
def points_near_points(t):
    places = t.places.select("place_id", F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    return N.near_points(t.points, places, 8).select("pt", "place_id", F.round("dist", 6).alias("dist"))


@query("J3_nearest_place", f"""WITH j AS (SELECT pt, place_id, {hav('p.lon', 'p.lat', 'q.lon', 'q.lat')} AS km, area FROM points p JOIN places q ON floor(q.lat) BETWEEN floor(p.lat) - 1 AND floor(p.lat) + 1 AND floor(q.lon) BETWEEN floor(p.lon) - 1 AND floor(p.lon) + 1)
SELECT pt, arg_min(place_id, (km - least(6, sqrt(area) * 0.5), place_id)) AS place_id, round(arg_min(km, (km - least(6, sqrt(area) * 0.5), place_id)), 1) AS km FROM j GROUP BY pt""")
def nearest_place(t):
    places = t.places.select("place_id", "area", F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    return N.nearest_place(t.points, places, "pt", "place_id")


@query("J4_tiered_place", f"""WITH j AS (SELECT pt, place_id, {hav('p.lon', 'p.lat', 'q.lon', 'q.lat', 6371.0)} AS km, CASE WHEN kind = 'city' THEN 8.0 ELSE 0.0 END AS bonus FROM points p JOIN places q ON q.lat BETWEEN p.lat - 1.2 AND p.lat + 1.2 AND q.lon BETWEEN p.lon - 1.8 AND p.lon + 1.8),
k AS (SELECT *, km > 30 AS far FROM j WHERE km <= 120)
SELECT pt, arg_min(place_id, (far, km - bonus, place_id)) AS place_id, round(arg_min(km, (far, km - bonus, place_id)), 1) AS km FROM k GROUP BY pt""")
def tiered_place(t):
    places = t.places.select("place_id", "kind", F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    return N.tiered_place(t.points, places, "pt", "place_id")


@query("J5_nearest_routes", f"""WITH {LEGS}, j AS (SELECT place_id, group_key, min({to_leg('lon', 'lat')}) AS dist FROM places JOIN legs ON lat BETWEEN least(ay, by) - 0.05 AND greatest(ay, by) + 0.05 AND lon BETWEEN least(ax, bx) - 0.07 AND greatest(ax, bx) + 0.07 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY dist, group_key) AS rank FROM j WHERE dist <= 4)
SELECT place_id, group_key, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4""")
def nearest_routes(t):
    return N.nearest_lines(t.places, road_legs(t), 4, "place_id", "group_key", 4).withColumn("dist", F.round("dist", 6)).select("place_id", "group_key", "dist", "rank")


_RING = """e AS (SELECT r.code, r.lon AS ax, r.lat AS ay, coalesce(n.lon, f.lon) AS bx, coalesce(n.lat, f.lat) AS by FROM rings r LEFT JOIN rings n ON n.code = r.code AND n.ring = r.ring AND n.seq = r.seq + 1 JOIN rings f ON f.code = r.code AND f.ring = r.ring AND f.seq = 0),
ins AS (SELECT pt, min(code) AS code FROM (SELECT pt, code FROM points JOIN e ON (ay > lat) <> (by > lat) AND lon < (bx - ax) * (lat - ay) / (by - ay) + ax GROUP BY 1, 2 HAVING count(*) % 2 = 1) GROUP BY pt)"""


@query("J6_polygon_of_point", f"WITH {_RING} SELECT pt, code FROM ins")
def polygon_of_point(t):
    return N.polygons_at(t.points, t.rings, "pt", "code")


@query("J7_J8_jurisdictions", f"""WITH {_RING}, o AS (SELECT pt, arg_min(code, (d, code)) AS code FROM (SELECT pt, code, sqrt(pow(p.lon - r.lon, 2) + pow(p.lat - r.lat, 2)) AS d FROM points p JOIN rings r ON r.lat BETWEEN p.lat - 0.6 AND p.lat + 0.6 AND r.lon BETWEEN p.lon - 0.6 AND p.lon + 0.6)
 WHERE d <= 0.5 AND pt NOT IN (SELECT pt FROM ins) GROUP BY pt)
SELECT pt, code, 'inside' AS how FROM ins UNION ALL SELECT pt, code, 'near' FROM o""")
def jurisdictions(t):
    return N.assign_jurisdiction(t.points, t.rings, "pt", "code", 0.5)


@query("J13_placed_stations", f"""WITH {LEGS}, s AS (SELECT station, CASE WHEN station % 10 = 0 THEN -route ELSE route END AS route, lon, lat FROM stations),
n AS (SELECT station, seg_id, min({to_leg('lon', 'lat')}) AS dist FROM s JOIN legs ON route = group_key GROUP BY 1, 2),
b AS (SELECT station, arg_min(seg_id, (dist, seg_id)) AS seg_id FROM n WHERE dist <= 5 GROUP BY 1), k AS (SELECT DISTINCT group_key FROM legs)
SELECT s.station, b.seg_id, CASE WHEN k.group_key IS NULL THEN 'unmatched' WHEN b.seg_id IS NULL THEN 'far' ELSE 'placed' END AS status FROM s LEFT JOIN k ON s.route = k.group_key LEFT JOIN b ON s.station = b.station""")
def placed_stations(t):
    s = t.stations.select("station", F.when(F.col("station") % 10 == 0, -F.col("route")).otherwise(F.col("route")).alias("group_key"), "lon", "lat")
    return N.place_stations(s, road_legs(t), "group_key", "station", "seg_id").select("station", "seg_id", "status")


@query("J15_credited_ways", f"""WITH {LEGS}, w AS (SELECT seg_id * 10 + seq AS way, group_key, (ax + bx) / 2 + ((seg_id * 3) % 7) * 0.001 AS lon, (ay + by) / 2 + 0.001 AS lat, {hav('ax', 'ay', 'bx', 'by')} AS len FROM legs),
n AS (SELECT way, w.group_key, l.seg_id, {flat('lon', 'lat', f"ax + (bx - ax) * ({_T.format(x='lon', y='lat')})", f"ay + (by - ay) * ({_T.format(x='lon', y='lat')})", 111.32)} AS d, len FROM w JOIN legs l ON w.group_key = l.group_key)
SELECT seg_id, round(sum(len), 5) AS km FROM (SELECT way, arg_min(seg_id, (d, seg_id)) AS seg_id, any_value(len) AS len FROM n WHERE d <= 0.35 GROUP BY way) GROUP BY seg_id""")
def credited_ways(t):
    legs = road_legs(t)
    ways = legs.select((F.col("seg_id") * 10 + F.col("seq")).alias("way"), "group_key", ((F.col("ax") + F.col("bx")) / 2 + ((F.col("seg_id") * 3) % 7) * 0.001).alias("lon"),
                       ((F.col("ay") + F.col("by")) / 2 + 0.001).alias("lat"), F.col("km").alias("len"))
    hits = N.credit_ways(ways, legs.drop("km"), ["group_key"], "way", "seg_id")
    return hits.groupBy("seg_id").agg(F.round(F.sum("len"), 5).alias("km"))


_BORDER = "SELECT n_nationkey, CAST(-120 + n_nationkey * 2 AS DOUBLE) AS ax, CAST(30 + (n_nationkey % 3) AS DOUBLE) AS ay, CAST(-120 + (n_nationkey + 1) * 2 AS DOUBLE) AS bx, CAST(30 + ((n_nationkey + 1) % 3) AS DOUBLE) AS by FROM nation"


def _flat_leg(x, y):
    t = _T.format(x=x, y=y)
    return flat(x, y, f"ax + (bx - ax) * ({t})", f"ay + (by - ay) * ({t})")


@query("J27_boundary_distance", f"""WITH b AS ({_BORDER}) SELECT pt, round(min({_flat_leg('lon', 'lat')}), 5) AS dist FROM points JOIN b ON lon BETWEEN ax - 0.5 AND bx + 0.5 AND {_flat_leg('lon', 'lat')} <= 25 GROUP BY pt""")
def boundary_distance(t):
    return N.boundary_distance(t.points, t.sql(_BORDER), 25, "pt").withColumn("dist", F.round("dist", 5))


@query("J26_placed_on_boundary", f"""WITH b AS ({_BORDER}) SELECT group_key, round(arg_min(lon, (d, lon, lat)), 6) AS lon, round(min(d), 5) AS dist FROM (SELECT group_key, lon, lat, {_flat_leg('lon', 'lat')} AS d FROM vertices JOIN b ON lon BETWEEN ax - 0.5 AND bx + 0.5) WHERE d <= 20 GROUP BY group_key""")
def placed_on_boundary(t):
    return N.nearest_vertex_to_boundary(t.vertices, t.sql(_BORDER), ["group_key"], 20).select("group_key", F.round("lon", 6).alias("lon"), F.round("dist", 5).alias("dist"))


@query("J25_route_ends", "WITH e AS (SELECT a.seg_id, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by FROM vertices a JOIN vertices b ON a.seg_id = b.seg_id AND a.i = 0 AND b.i = 4) SELECT seg_id, round(CASE WHEN ay >= by THEN ax ELSE bx END, 6) AS lon, round(greatest(ay, by), 6) AS lat FROM e")
def route_ends(t):
    return N.route_end(vertices(t), ["seg_id"]).select("seg_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


_OFF = "sqrt(pow((x - ax) * k - (bx - ax) * k * tt, 2) + pow(y - ay - (by - ay) * tt, 2))"


@query("J29_not_covered", f"""WITH {LEGS}, s AS (SELECT seg_id, i, lon + (seg_id % 5) * 0.01 AS x, lat AS y, cos(radians(lat)) AS k FROM vertices),
j AS (SELECT s.seg_id, s.i, x, y, k, ax, ay, bx, by, CASE WHEN pow((bx - ax) * k, 2) + pow(by - ay, 2) > 0 THEN greatest(0.0, least(1.0, ((x - ax) * k * (bx - ax) * k + (y - ay) * (by - ay)) / (pow((bx - ax) * k, 2) + pow(by - ay, 2)))) ELSE 0 END AS tt
  FROM s JOIN legs ON x BETWEEN least(ax, bx) - 0.01 AND greatest(ax, bx) + 0.01 AND y BETWEEN least(ay, by) - 0.01 AND greatest(ay, by) + 0.01),
h AS (SELECT seg_id, count(DISTINCT i) AS n FROM j WHERE {_OFF} < 0.4 / 111.32 GROUP BY 1)
SELECT v.seg_id, CAST(5 AS BIGINT) AS samples, coalesce(n, 0) / 5.0 AS covered FROM (SELECT DISTINCT seg_id FROM vertices) v LEFT JOIN h ON v.seg_id = h.seg_id WHERE coalesce(n, 0) / 5.0 <= 0.5""")
def not_covered(t):
    samples = t.vertices.select(F.col("seg_id"), (F.col("lon") + (F.col("seg_id") % 5) * 0.01).alias("lon"), "lat")
    return N.not_covered(samples, road_legs(t), ["seg_id"])


@query("J34_towns_along", f"""SELECT seg_id, place_id, CAST(min(i) AS INT) AS seq FROM vertices v JOIN places p ON p.lat BETWEEN v.lat - 0.1 AND v.lat + 0.1 AND p.lon BETWEEN v.lon - 0.15 AND v.lon + 0.15 WHERE {hav('v.lon', 'v.lat', 'p.lon', 'p.lat')} <= 10 GROUP BY 1, 2""")
def towns_along(t):
    places = t.places.select("place_id", F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    return N.towns_along(vertices(t), places, "seg_id", ["seq"], "place_id").withColumn("seq", F.col("seq").cast("int"))


@query("J34_parent_cities", f"""SELECT d.place_id AS district, arg_min(c.place_id, ({hav('d.lon', 'd.lat', 'c.lon', 'c.lat')}, c.place_id)) AS city FROM places d JOIN places c ON c.kind = 'city' AND d.kind = 'town' AND c.lat BETWEEN d.lat - 0.6 AND d.lat + 0.6 AND {hav('d.lon', 'd.lat', 'c.lon', 'c.lat')} <= 60 GROUP BY 1""")
def parent_cities(t):
    cities = t.places.filter("kind = 'city'").select(F.col("place_id").alias("city"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    return N.parent_cities(t.places.filter("kind = 'town'").withColumnRenamed("place_id", "district"), cities, "district", "city").select("district", "city")


@query("J35_facility_points", """WITH l AS (SELECT route AS f, avg(lon) AS x, avg(lat) AS y FROM stations GROUP BY 1), n AS (SELECT group_key AS f, avg(lon) AS x, avg(lat) AS y FROM vertices GROUP BY 1)
SELECT coalesce(l.f, n.f) AS facility, round(coalesce(l.x, n.x), 7) AS lon, round(coalesce(l.y, n.y), 7) AS lat, CASE WHEN l.x IS NOT NULL THEN 'listed' ELSE 'named' END AS by FROM l FULL JOIN n ON l.f = n.f""")
def facility_points(t):
    listed = t.stations.select(F.col("route").alias("facility"), "lon", "lat")
    return N.facility_points(listed, t.vertices.select(F.col("group_key").alias("facility"), "lon", "lat"), "facility")


@query("G14_coincident_share", f"""WITH a AS (SELECT seg_id, group_key, lon, lat FROM vertices), h AS (SELECT DISTINCT a.seg_id, a.lon, a.lat FROM a JOIN a b ON a.group_key = b.group_key AND a.seg_id <> b.seg_id AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 0.08),
c AS (SELECT seg_id, count(*) AS n FROM h GROUP BY 1)
SELECT v.seg_id, CAST(5 AS BIGINT) AS samples, round(coalesce(n, 0) / 5.0, 6) AS share FROM (SELECT DISTINCT seg_id FROM a) v LEFT JOIN c ON v.seg_id = c.seg_id""")
def coincident_share(t):
    samples = t.vertices.select("seg_id", "group_key", "lon", "lat")
    others = t.vertices.select("group_key", F.col("seg_id").alias("other"), F.col("lon").alias("olon"), F.col("lat").alias("olat"))
    hit = N.within(samples, others, 0.08, ["group_key"], also=F.col("a.seg_id") != F.col("b.other"))
    share = samples.groupBy("seg_id").agg(F.count(F.lit(1)).alias("samples")).join(hit.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n")), "seg_id", "left")
    return share.select("seg_id", "samples", F.round(F.coalesce("n", F.lit(0)) / F.col("samples"), 6).alias("share"))


@query("G24_merged_intervals", """WITH i AS (SELECT l_partkey AS route, l_orderkey / 10.0 AS a, l_orderkey / 10.0 + l_quantity AS b FROM lineitem),
o AS (SELECT *, max(b) OVER (PARTITION BY route ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a - reach >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT route, round(min(a), 4) AS a, round(max(b), 4) AS b FROM g GROUP BY route, n""")
def merged_intervals(t):
    i = t.lineitem.select(F.col("l_partkey").alias("route"), (F.col("l_orderkey") / 10.0).alias("a"), (F.col("l_orderkey") / 10.0 + F.col("l_quantity")).alias("b"))
    return O.merge_intervals(i, ["route"], "a", "b", 25).select("route", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))
