"""Queries over the end-to-end tables (D-*)."""

from pyspark.sql import functions as F

from ..plans import overlays as P
from ..plans import routes as B
from ..runtime import cut
from .aggregates import cov, pct
from .geometry import LEGS, _BORDER, _flat_leg, fragments, hav, road_legs, to_leg, vertices
from .registry import query


def named_segments(t):
    """Road fragments with a name, a jurisdiction and attributes: one numbered road per customer."""
    attributes = t.orders.select(F.col("o_orderkey").alias("seg_id"), F.concat(F.lit("State Rte "), (F.col("o_custkey") % 9000 + 1).cast("string")).alias("name"), F.lit("S").alias("road_type"),
                                 F.concat(F.lit("S"), F.floor(F.col("o_custkey") / 9000).cast("string")).alias("st"),
                                 F.when(F.col("o_orderpriority") == "1-URGENT", "Freeway").otherwise("Primary").alias("type"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "O").alias("divided"))
    return fragments(t).drop("group_key").join(attributes, "seg_id")


@query("D1_route_build")
def route_build(t):
    how = B.Stitching(bridge_km=15, dedupe_km=0.08, wide_km=None)
    routes, _ = B.build_routes(B.group_segments(named_segments(t)), how)
    return routes.drop("comp")



_BESIDE = "SELECT 'J' || CAST(n_nationkey AS STRING) AS st, 'J' || CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 1 ELSE n_nationkey - 1 END AS STRING) AS beside FROM nation"
# Fixed values of the systems in ``highways``: gaps that are bridged, and those that are within a corridor.
_SYSTEM = ", ".join(f"('{s}', {B.SYSTEMS[s].bridge_km}, {B.SYSTEMS[s].wide_km or 0})" for s in ("us-numbered", "us-state", "ca-other", "cn-national", "hk-route"))
_MI = "floor(({}) / 1.609344 + 0.5)"


@query("D1_systems_with_corridors", f"""WITH RECURSIVE how(system, bridge, wide) AS (VALUES {_SYSTEM}), beside AS ({_BESIDE}),
h AS (SELECT highways.*, bridge, wide, {hav('ax', 'ay', 'bx', 'by')} AS km, {hav('lag(bx) OVER w', 'lag(by) OVER w', 'ax', 'ay')} AS gap FROM highways JOIN how ON highways.system = how.system WINDOW w AS (PARTITION BY group_key ORDER BY slot)),
one AS (SELECT *, sum(CASE WHEN gap > bridge THEN 1 ELSE 0 END) OVER (PARTITION BY group_key ORDER BY slot) AS c FROM h),
holds AS (SELECT DISTINCT group_key, c, st FROM one WHERE wide > 0),
link AS (SELECT DISTINCT x.group_key AS g, x.c AS a, y.c AS b FROM holds x JOIN holds y ON x.group_key = y.group_key WHERE x.st = y.st OR EXISTS (SELECT 1 FROM beside WHERE beside.st = x.st AND beside.beside = y.st)),
reach(g, a, b) AS (SELECT g, a, b FROM link UNION SELECT reach.g, reach.a, link.b FROM reach JOIN link ON reach.g = link.g AND reach.b = link.a),
corridor AS (SELECT g, a, min(b) AS k FROM reach GROUP BY 1, 2),
two AS (SELECT one.*, CASE WHEN wide > 0 THEN k ELSE c END AS k, CASE WHEN wide > 0 THEN wide ELSE bridge END AS most FROM one LEFT JOIN corridor ON g = group_key AND a = c),
gaps AS (SELECT *, {hav('lag(bx) OVER w', 'lag(by) OVER w', 'ax', 'ay')} AS g2 FROM two WINDOW w AS (PARTITION BY group_key, k ORDER BY slot)),
runs AS (SELECT *, sum(CASE WHEN g2 > most THEN 1 ELSE 0 END) OVER (PARTITION BY group_key, k ORDER BY slot) AS r FROM gaps),
main AS (SELECT group_key, k, r, arg_max(st, kms) AS st FROM (SELECT group_key, k, r, st, sum(km) AS kms FROM runs GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
built AS (SELECT group_key, k, r, 2 * min(seg_id) AS comp, any_value(system) AS system, count(*) AS edges, {_MI.format('sum(km)')} AS mi, {_MI.format(hav('arg_min(ax, slot)', 'arg_min(ay, slot)', 'arg_max(bx, slot)', 'arg_max(by, slot)'))} AS span_mi,
  count(CASE WHEN g2 > 0 AND g2 <= most THEN 1 END) AS breaks, {_MI.format('coalesce(sum(CASE WHEN g2 <= most THEN g2 END), 0)')} AS gap_mi FROM runs GROUP BY 1, 2, 3),
n AS (SELECT b.*, st, count(*) OVER (PARTITION BY b.group_key) AS n_all, count(*) OVER (PARTITION BY b.group_key, st) AS n_same, row_number() OVER (PARTITION BY b.group_key ORDER BY mi DESC, comp) AS n, row_number() OVER (PARTITION BY b.group_key, st ORDER BY mi DESC, comp) AS s
  FROM built b JOIN main ON b.group_key = main.group_key AND b.k = main.k AND b.r = main.r)
SELECT regexp_replace(lower(replace(group_key, '|', '-') || CASE WHEN n_all = 1 THEN '' WHEN system = 'us-state' THEN '-' || n ELSE '-' || st || CASE WHEN n_same > 1 THEN '-' || s ELSE '' END END), '[^a-z0-9-]', '', 'g') AS route_id,
  system, st, CAST(edges AS BIGINT) AS edges, mi, mi AS paved_mi, span_mi, CAST(breaks AS BIGINT) AS breaks, gap_mi FROM n""")
def systems_with_corridors(t):
    coords = F.array(F.struct(F.col("ax").alias("lon"), F.col("ay").alias("lat")), F.struct(F.col("bx").alias("lon"), F.col("by").alias("lat")))
    grouped = t.highways.select("seg_id", "group_key", "system", F.lit("primary").alias("tier"), F.col("key").cast("string").alias("number"), F.lit(None).cast("string").alias("qualifier"), "st",
                                F.when(F.col("slot") % 3 == 0, "Freeway").otherwise("Primary").alias("type"), (F.col("slot") % 2 == 0).alias("divided"), coords.alias("coords"))
    routes, lines = B.build_routes(cut(grouped), B.SYSTEMS, t.sql(_BESIDE))
    edges = lines.edges.groupBy("comp").agg(F.count(F.lit(1)).alias("edges"))
    return routes.join(edges, "comp").select("route_id", "system", "st", "edges", "mi", "paved_mi", "span_mi", F.col("breaks").cast("bigint").alias("breaks"), "gap_mi")


@query("D2_bridges_on_routes", f"""WITH {LEGS}, r AS (SELECT o_orderkey AS id, o_custkey AS key, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 1 END AS INT) AS kind, 'S' || (o_custkey % 25) AS st,
  120 - floor(o_custkey * 37 % 5000 / 100) AS dlon, 60 - 1 - (o_custkey * 37 % 5000) % 100 * 0.6 AS mlon, 26 + floor(o_custkey * 53 % 2200 / 100) AS dlat, (o_custkey * 53 % 2200) % 100 * 0.6 AS mlat, o_orderkey % 17 AS k FROM orders),
p AS (SELECT id, key, st, -((dlon - 1) + floor(mlon) / 60.0 + (k * 3) / 3600.0) AS lon, dlat + floor(mlat) / 60.0 + (k * 2) / 3600.0 AS lat FROM r WHERE kind = 1 AND mlon >= 0),
n AS (SELECT id, st, p.lon, p.lat, seg_id, min({to_leg('lon', 'lat')}) AS dist FROM p JOIN legs ON key = group_key GROUP BY 1, 2, 3, 4, 5)
SELECT id, st, arg_min(seg_id, (dist, seg_id)) AS route, floor(any_value(lon) * 100000 + 0.5) / 100000 AS lon, floor(any_value(lat) * 100000 + 0.5) / 100000 AS lat FROM n WHERE dist <= 1 GROUP BY 1, 2""")
def bridges_on_routes(t):
    o = t.orders
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.when(F.col("o_orderkey") % 13 == 0, "2").otherwise("1").alias("kind"),
                    F.concat(F.lit("S"), (F.col("o_custkey") % 25).cast("string")).alias("st"),
                    (119 - F.floor(F.col("o_custkey") * 37 % 5000 / 100)).alias("dlon"), F.floor(59 - (F.col("o_custkey") * 37 % 5000) % 100 * 0.6).alias("mlon"),
                    (26 + F.floor(F.col("o_custkey") * 53 % 2200 / 100)).alias("dlat"), F.floor((F.col("o_custkey") * 53 % 2200) % 100 * 0.6).alias("mlat"), (F.col("o_orderkey") % 17).alias("k"))
    two = lambda c, n=2: F.lpad(F.col(c).cast("string"), n, "0") if isinstance(c, str) else F.lpad(c.cast("string"), n, "0")
    records = base.select("id", "key", "kind", "st", F.concat(two("dlat"), two("mlat"), two(F.col("k") * 200, 4)).alias("lat"), F.concat(two("dlon", 3), two("mlon"), two(F.col("k") * 300, 4)).alias("lon"),
                          F.lit("1980").alias("built"), F.lit("0").alias("rebuilt"), F.lit("12.5").alias("length"), F.lit("19").alias("type"))
    legs = road_legs(t).withColumnRenamed("group_key", "key").withColumnRenamed("seg_id", "route")
    return P.bridges_on_routes(records, legs, 1850, 2027).select("id", "st", "route", "lon", "lat")


@query("D3_inventory_union", """SELECT 'a' AS "set", place_id AS id, floor(lon * 100000 + 0.5) / 100000 AS lon, floor(lat * 100000 + 0.5) / 100000 AS lat, name, CAST(NULL AS BIGINT) AS route FROM places
UNION ALL SELECT 'b', station, floor(lon * 100000 + 0.5) / 100000, floor(lat * 100000 + 0.5) / 100000, NULL, route FROM stations WHERE station % 4 <> 0""")
def inventory_union(t):
    b = t.stations.select(F.col("station").alias("id"), F.when(F.col("station") % 4 != 0, F.col("lon")).alias("lon"), "lat", "route")
    return P.inventory_union(a=t.places.select(F.col("place_id").alias("id"), "lon", "lat", "name"), b=b).select("set", "id", "lon", "lat", "name", "route")


@query("D4_crossings_placed", f"""WITH b AS ({_BORDER}), v AS (SELECT group_key, arg_min(lon, (d, lon, lat)) AS lon FROM (SELECT group_key, lon, lat, {_flat_leg('lon', 'lat')} AS d FROM vertices JOIN b ON lon BETWEEN ax - 0.5 AND bx + 0.5) WHERE d <= 20 GROUP BY 1)
SELECT 'p' || place_id AS crossing, round(lon, 6) AS lon, 'source' AS how FROM places UNION ALL SELECT 'h' || c_custkey, round(lon, 6), CASE WHEN lon IS NULL THEN 'none' ELSE 'highway' END FROM customer LEFT JOIN v ON c_custkey = group_key""")
def crossings_placed(t):
    points = t.places.select(F.concat(F.lit("p"), F.col("place_id").cast("string")).alias("crossing"), "lon", "lat")
    named = t.customer.select(F.concat(F.lit("h"), F.col("c_custkey").cast("string")).alias("crossing"), F.col("c_custkey").alias("key"))
    legs = road_legs(t).withColumnRenamed("group_key", "route")
    placed, _ = P.crossings(points, named, t.vertices.withColumnRenamed("group_key", "key"), t.sql(_BORDER), legs, 20)
    return placed.select("crossing", F.round("lon", 6).alias("lon"), "how")


@query("D4_J5_routes_near_crossings", f"""WITH {LEGS}, j AS (SELECT place_id, group_key, min({to_leg('lon', 'lat')}) AS dist FROM places JOIN legs ON lat BETWEEN least(ay, by) - 0.05 AND greatest(ay, by) + 0.05 AND lon BETWEEN least(ax, bx) - 0.07 AND greatest(ax, bx) + 0.07 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY dist, group_key) AS rank FROM j WHERE dist <= 2)
SELECT place_id AS crossing, group_key AS route, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM r WHERE rank <= 4""")
def routes_near_crossings(t):
    points = t.places.select(F.col("place_id").alias("crossing"), "lon", "lat")
    none = t.customer.select(F.col("c_custkey").alias("crossing"), F.col("c_custkey").alias("key")).filter("key < 0")
    legs = road_legs(t).withColumnRenamed("group_key", "route")
    _, near = P.crossings(points, none, t.vertices.withColumnRenamed("group_key", "key"), t.sql(_BORDER), legs, 20)
    return near.select("crossing", "route", F.round("dist", 6).alias("dist"), "rank")


@query("D5_speed_tiers", f"""WITH r AS (SELECT id AS route, sys AS system, mi * 1.609344 AS km, CASE WHEN id % 4 = 0 THEN CAST(80 + id % 3 * 10 AS INT) END AS posted, CAST(id % 100 AS DOUBLE) AS pc FROM routes),
o AS (SELECT r.route, kph, sum(observed.km) AS w, max(r.km) AS rk FROM observed JOIN r ON observed.route = r.route GROUP BY 1, 2),
c AS (SELECT route, kph, rk, sum(w) OVER (PARTITION BY route ORDER BY kph) AS upto, sum(w) OVER (PARTITION BY route) AS total FROM o),
m AS (SELECT route, min(kph) FILTER (upto >= total / 2) AS kph, {cov('max(total)', 'greatest(max(rk), 0.1)')} AS cover FROM c GROUP BY route),
j AS (SELECT r.*, m.kph, m.cover, CASE system WHEN 'ECONOMY' THEN 120 WHEN 'SMALL' THEN 70 END AS law FROM r LEFT JOIN m ON r.route = m.route),
s AS (SELECT *, CASE WHEN posted IS NOT NULL THEN 'p' WHEN kph IS NOT NULL AND cover < 25 AND law IS NOT NULL THEN 'l' WHEN kph IS NOT NULL THEN 'o' WHEN law IS NOT NULL THEN 'l' ELSE 'u' END AS source FROM j)
SELECT route, system, source, CAST(CASE source WHEN 'p' THEN posted WHEN 'o' THEN kph WHEN 'l' THEN law END AS INT) AS "limit", CASE WHEN source = 'p' THEN pc ELSE cover END AS cover FROM s""")
def speed_tiers(t):
    r = t.routes.select(F.col("id").alias("route"), F.col("sys").alias("system"), (F.col("mi") * 1.609344).alias("km"), F.when(F.col("id") % 4 == 0, 80 + F.col("id") % 3 * 10).alias("posted"), (F.col("id") % 100).cast("double").alias("posted_cover"))
    return P.speed_tiers(r, t.observed.select("route", "kph", "km"), {"ECONOMY": 120, "SMALL": 70})


@query("D6_tariff_links", """WITH t AS (SELECT o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 211 AS VARCHAR) END AS n, 'Brand#' || (1 + o_custkey % 25) AS st FROM orders),
a AS (SELECT DISTINCT title, id AS route FROM t JOIN routes ON n = CAST(number AS VARCHAR) AND t.st = routes.st), m AS (SELECT DISTINCT l_orderkey AS title, l_partkey AS route FROM lineitem WHERE l_returnflag = 'R')
SELECT title, route, 'number' AS "by" FROM a UNION ALL SELECT title, route, 'name' FROM m WHERE (title, route) NOT IN (SELECT title, route FROM a)""")
def tariff_links(t):
    titles = t.orders.select(F.col("o_orderkey").alias("title"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 211).cast("string")).alias("number"), F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("st"))
    matches = t.lineitem.select(F.col("l_orderkey").alias("title"), F.col("l_partkey").alias("route"), F.col("l_suppkey").alias("name"), (F.col("l_returnflag") == "R").alias("approved"))
    return P.tariff_links(titles, matches, t.routes.select(F.col("id").alias("route"), F.col("number").cast("string").alias("number"), "st"))


@query("D7_elevation_profiles")
def elevation_profiles(t):
    pixels = (t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "v"))
              .select((F.col("vec_id") % 40 + 85).cast("int").alias("tx"), (F.floor(F.col("vec_id") / 40) + 180).cast("int").alias("ty"),
                      (F.col("i") % 8).cast("int").alias("px"), F.floor(F.col("i") / 8).cast("int").alias("py"), (F.col("v") * 1000).cast("double").alias("metres"))
              .groupBy("tx", "ty", "px", "py").agg(F.min("metres").alias("metres")))
    return P.elevation_profiles(vertices(t).select("seg_id", "seq", "lon", "lat"), pixels, "seg_id", samples=20, tile_pixels=8)


@query("D8_towns_along_routes", f"""WITH big AS (SELECT place_id AS city, lon AS olon, lat AS olat FROM places WHERE kind = 'city'),
d AS (SELECT p.place_id, p.lon, p.lat, arg_min(city, ({hav('p.lon', 'p.lat', 'olon', 'olat')}, city)) AS city FROM places p JOIN big ON p.kind = 'town' AND olat BETWEEN p.lat - 0.3 AND p.lat + 0.3 AND {hav('p.lon', 'p.lat', 'olon', 'olat')} <= 20 GROUP BY 1, 2, 3),
c AS (SELECT * FROM big UNION ALL SELECT city, lon, lat FROM d)
SELECT seg_id, city, CAST(min(i) AS INT) AS seq FROM vertices v JOIN c ON olat BETWEEN v.lat - 0.1 AND v.lat + 0.1 AND olon BETWEEN v.lon - 0.15 AND v.lon + 0.15 WHERE {hav('v.lon', 'v.lat', 'olon', 'olat')} <= 10 GROUP BY 1, 2""")
def towns_along_routes(t):
    cities = t.places.filter("kind = 'city'").select(F.col("place_id").alias("city"), F.col("lon").alias("olon"), F.col("lat").alias("olat"), F.lit(True).alias("large"))
    districts = t.places.filter("kind = 'town'").select(F.col("place_id").alias("district"), "lon", "lat")
    return P.towns(vertices(t), cities, districts, "seg_id", ["seq"], 10, 20).select("seg_id", "city", F.col("seq").cast("int").alias("seq"))


@query("D9_route_names", """WITH n AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS own, CASE WHEN p_size % 4 = 0 THEN 'G' || p_size ELSE p_type END AS tag FROM part), u AS (SELECT id, own, CASE WHEN NOT regexp_matches(tag, '^G\\d+') THEN tag END AS tag FROM n)
SELECT id, coalesce(own, tag) AS name, CASE WHEN own IS NOT NULL AND tag IS NOT NULL AND own <> tag THEN tag END AS also FROM u WHERE coalesce(own, tag) IS NOT NULL""")
def route_names(t):
    n = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("own"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("G"), F.col("p_size").cast("string"))).otherwise(F.col("p_type")).alias("tag"))
    return P.route_names(n, "id", ["own", "tag"], r"^G\d+")


def _insights(t):
    return P.insights(t.routes, "sys", "mi", "off_mi", "gap_mi", "breaks", "id", {"lanes": F.col("lanes_share"), "toll": F.col("toll_share")})


@query("D10_insight_coverage", f"""SELECT sys, 'lanes' AS field, {pct('sum(mi * lanes_share)', 'sum(mi)', 1)} AS cell FROM routes GROUP BY sys UNION ALL SELECT sys, 'toll', {pct('sum(mi * toll_share)', 'sum(mi)', 1)} FROM routes GROUP BY sys""")
def insight_coverage(t):
    return _insights(t)["coverage"]


@query("D10_insight_outliers", """SELECT id, sys, round((mi / off_mi - 1) * 100, 1) AS error FROM routes WHERE off_mi > 0 ORDER BY abs(round((mi / off_mi - 1) * 100, 1)) DESC, id LIMIT 12""")
def insight_outliers(t):
    return _insights(t)["outliers"]


@query("D11_register_coverage", """WITH l AS (SELECT DISTINCT l_returnflag AS sys, l_partkey AS num FROM lineitem), d AS (SELECT DISTINCT l_returnflag AS sys, l_partkey AS num FROM lineitem WHERE l_tax > 0.07), r AS (SELECT 'R' AS sys, p_partkey AS num FROM part WHERE p_size < 20)
SELECT l.sys, CAST(count(*) AS BIGINT) AS listed, CAST(count(d.num) AS BIGINT) AS drawn, CAST(count(CASE WHEN d.num IS NULL AND r.num IS NOT NULL THEN 1 END) AS BIGINT) AS explained, CAST(count(CASE WHEN d.num IS NULL AND r.num IS NULL THEN 1 END) AS BIGINT) AS unexplained
FROM l LEFT JOIN d ON l.sys = d.sys AND l.num = d.num LEFT JOIN r ON l.sys = r.sys AND l.num = r.num GROUP BY 1""")
def register_coverage(t):
    rows = t.lineitem.select(F.col("l_returnflag").alias("sys"), F.col("l_partkey").alias("num"), "l_tax")
    reasons = t.part.filter("p_size < 20").select(F.lit("R").alias("sys"), F.col("p_partkey").alias("num"))
    return P.register_coverage(rows, rows.filter("l_tax > 0.07"), reasons, "sys", ["num"])


@query("D12_overlay_routes")
def overlay_routes(t):
    f = cut(fragments(t))
    ends = f.groupBy("group_key").agg(F.min_by(F.element_at("coords", 1), "seg_id").alias("f"), F.max_by(F.element_at("coords", -1), "seg_id").alias("t"))
    definitions = ends.select(F.col("group_key").alias("route"), F.col("f.lon").alias("flon"), F.col("f.lat").alias("flat"), F.col("t.lon").alias("tlon"), F.col("t.lat").alias("tlat"))
    return B.overlay_routes(f.withColumnRenamed("group_key", "route"), definitions, bridge_km=15)


@query("D13_chained_background")
def chained_background(t):
    return B.background_lines(cut(fragments(t).select("seg_id", "coords")), 2, 0.0007)


@query("D15_coverage_verdicts", """WITH r AS (SELECT st, l_system AS system, number, sum(len) / 20 AS mi FROM (SELECT number, st, len, CASE WHEN f_class < 4 THEN 'a' ELSE 'b' END AS l_system FROM sections) GROUP BY 1, 2, 3),
d AS (SELECT DISTINCT st, CASE WHEN f_class < 4 THEN 'a' ELSE 'b' END AS system, number FROM sections WHERE iri > 150), s AS (SELECT st, CASE WHEN f_class < 4 THEN 'a' ELSE 'b' END AS system, number, max(len) AS km FROM sections WHERE toll = 'R' GROUP BY 1, 2, 3)
SELECT r.st, r.system, r.number, r.mi, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.st = r.st AND d.system = r.system AND d.number = r.number) THEN 'covered' WHEN EXISTS (SELECT 1 FROM d WHERE d.st = r.st AND d.system <> r.system AND d.number = r.number) THEN 'otherSystem'
  WHEN coalesce(s.km, 0) = 0 THEN 'notIn' WHEN s.km < 25 THEN 'short' ELSE 'in' END AS verdict FROM r LEFT JOIN s ON s.st = r.st AND s.system = r.system AND s.number = r.number WHERE r.mi >= 1""")
def coverage_verdicts(t):
    s = t.sections.withColumn("system", F.when(F.col("f_class") < 4, "a").otherwise("b"))
    reported = s.groupBy("st", "system", "number").agg((F.sum("len") / 20).alias("mi"))
    source = s.filter("toll = 'R'").groupBy("st", "system", "number").agg(F.max("len").alias("km"))
    return P.coverage_verdicts(reported, s.filter("iri > 150"), source, 25)


@query("D16_directional_traffic", """WITH c AS (SELECT l_partkey AS route, l_suppkey % 5 AS section, l_orderkey % 7 AS place, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'S' END AS d, l_shipdate, l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS v, CAST(1 + l_suppkey % 5 AS DOUBLE) AS km, year(l_shipdate) AS y FROM lineitem),
l AS (SELECT route, section, place, d, arg_max(v, (l_shipdate, row_id)) AS v FROM c GROUP BY 1, 2, 3, 4), w AS (SELECT route, section, place, sum(v) AS v FROM l GROUP BY 1, 2, 3 HAVING count(*) = 2 AND sum(v) > 0),
s AS (SELECT route, section, avg(v) AS aadt FROM w GROUP BY 1, 2), f AS (SELECT route, section, max(km) AS km, CAST(min(y) AS INT) AS year FROM c GROUP BY 1, 2), j AS (SELECT s.route, aadt, km, year FROM s JOIN f ON s.route = f.route AND s.section = f.section)
SELECT route, CAST(count(*) AS BIGINT) AS n, floor(sum(km) * 10 + 0.5) / 10.0 AS km, CASE WHEN max(aadt) > 0 THEN round(floor(max(aadt) / 100 + 0.5) * 100, 0) END AS peak, max(year) AS year, CASE WHEN min(year) < max(year) THEN min(year) END AS year_from,
  round(floor(sum(aadt * km) / sum(km) / 100 + 0.5) * 100, 0) AS aadt_v, 100.0::DOUBLE AS aadt_cover FROM j GROUP BY route""")
def directional_traffic(t):
    c = t.lineitem.select(F.col("l_partkey").alias("route"), (F.col("l_suppkey") % 5).alias("section"), (F.col("l_orderkey") % 7).alias("place"), F.when(F.col("l_linestatus") == "O", "N").otherwise("S").alias("direction"),
                          F.col("l_shipdate").alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("value"), (1 + F.col("l_suppkey") % 5).cast("double").alias("km"), F.year("l_shipdate").alias("year"))
    return P.directional_traffic(c)


@query("D16_normalised_counts", """SELECT CAST(o_custkey AS VARCHAR) AS route, NULL::DOUBLE AS km, o_totalprice AS aadt, NULL::DOUBLE AS truck, NULL::DOUBLE AS speed, CAST(year(o_orderdate) AS INT) AS year, 'stations' AS method FROM orders
UNION ALL SELECT CAST(l_partkey AS VARCHAR), l_quantity, l_extendedprice, l_tax, NULL, CAST(year(l_shipdate) AS INT), 'sections' FROM lineitem""")
def normalised_counts(t):
    a = P.normalise_counts(t.orders, {"route": F.col("o_custkey"), "aadt": F.col("o_totalprice"), "year": F.year("o_orderdate")}, "stations")
    b = P.normalise_counts(t.lineitem, {"route": F.col("l_partkey"), "km": F.col("l_quantity"), "aadt": F.col("l_extendedprice"), "truck": F.col("l_tax"), "year": F.year("l_shipdate")}, "sections")
    return a.unionByName(b)


@query("D17_station_panel", """WITH r AS (SELECT o_custkey AS st, o_orderkey, year(o_orderdate) AS y, CAST(50 + o_orderkey % 3 AS DOUBLE) AS a, CAST(40 - o_orderkey % 5 AS DOUBLE) AS b, 10.0::DOUBLE AS c, CAST(10 + o_orderkey % 2 AS DOUBLE) AS k FROM orders),
n AS (SELECT * FROM r WHERE y = 1999), p AS (SELECT * FROM r WHERE y = 1998), s AS (SELECT p.st FROM (SELECT st, count(*) AS c FROM p GROUP BY 1) p LEFT JOIN (SELECT st, count(*) AS c FROM n GROUP BY 1) n ON p.st = n.st WHERE coalesce(n.c, 0) < p.c * 0.5),
e AS (SELECT *, 1999 AS edition FROM n WHERE st NOT IN (SELECT st FROM s) UNION ALL SELECT *, 1998 FROM p WHERE st IN (SELECT st FROM s))
SELECT st, CAST(count(*) AS BIGINT) AS stations, CAST(count(CASE WHEN abs(a + b + c - 100) > 1 THEN 1 END) AS BIGINT) AS sums_off, CAST(count(CASE WHEN abs(c - k) > 0.5 THEN 1 END) AS BIGINT) AS trucks_off, CAST(min(edition) AS INT) AS edition FROM e GROUP BY st""")
def station_panel(t):
    r = t.orders.select(F.col("o_custkey").alias("st"), "o_orderkey", F.year("o_orderdate").alias("y"), (50 + F.col("o_orderkey") % 3).cast("double").alias("a"), (40 - F.col("o_orderkey") % 5).cast("double").alias("b"), F.lit(10.0).alias("c"), (10 + F.col("o_orderkey") % 2).cast("double").alias("k"))
    return P.station_panel(r.filter("y = 1999").drop("y"), r.filter("y = 1998").drop("y"), 1999, "st", ["a", "b", "c"], "k")[1]
