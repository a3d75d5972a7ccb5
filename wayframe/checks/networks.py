"""Queries over graphs and stitching (G-4, G-6..G-25)."""

from pyspark.sql import functions as F

from ..functions.geo import haversine, line_km
from ..operators import graph as R
from ..operators import lines as L
from ..operators import stitch as S
from ..operators.ordered import first_by, running_sum
from ..runtime import cut
from .geometry import LEGS, fragments, hav, vertices
from .registry import query

SNAP = 0.0002

# Ends, pairs of ends within tolerance, and the least end each is linked to, by brute force per group.
_NODES = f"""ends AS (SELECT group_key, seg_id * 2 + CASE WHEN i = 4 THEN 1 ELSE 0 END AS e, lon, lat FROM vertices WHERE i IN (0, 4)),
pairs AS (SELECT a.e AS a, b.e AS b FROM ends a JOIN ends b ON a.group_key = b.group_key WHERE {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= {SNAP * 111.32}),
reach(e, r) AS (SELECT e, e FROM ends UNION SELECT reach.e, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a),
noded AS (SELECT e, min(r) AS node FROM reach GROUP BY e),
nodes AS (SELECT DISTINCT n.node, x.group_key, x.lon, x.lat FROM noded n JOIN ends x ON x.e = n.node),
net AS (SELECT s.seg_id, s.group_key, a.node AS a, b.node AS b, s.km FROM (SELECT seg_id, group_key, sum({hav('ax', 'ay', 'bx', 'by')}) AS km FROM legs GROUP BY 1, 2) s JOIN noded a ON a.e = s.seg_id * 2 JOIN noded b ON b.e = s.seg_id * 2 + 1)"""
_COMPS = """around(n, r) AS (SELECT node, node FROM nodes UNION SELECT around.n, l.b FROM around JOIN (SELECT a, b FROM net UNION SELECT b, a FROM net) l ON around.r = l.a),
comps AS (SELECT n AS node, min(r) AS comp FROM around GROUP BY n)"""


def network(t):
    """Edges, without their coordinates, and nodes, each derived once for all their readers."""
    edges, nodes = S.build_edges(cut(fragments(t)), "group_key", SNAP)
    return cut(edges.drop("coords")), cut(nodes)


@query("G6_snapped_edges", f"WITH RECURSIVE {LEGS}, {_NODES} SELECT seg_id, a, b, round(km, 6) AS km FROM net")
def snapped_edges(t):
    edges, _ = network(t)
    return edges.select(F.col("edge_id").alias("seg_id"), "a", "b", F.round("km", 6).alias("km"))


@query("G7_components", f"WITH RECURSIVE {LEGS}, {_NODES}, {_COMPS} SELECT node, comp FROM comps")
def components(t):
    edges, nodes = network(t)
    return R.label_nodes(nodes.select("node"), edges.select("a", "b")).select("node", "comp")


@query("G7_hub_components", """SELECT o_custkey * 10 + 1 AS node, min(least(o_custkey * 10 + 1, o_orderkey * 10 + 2)) AS comp FROM orders GROUP BY 1
UNION ALL SELECT o_orderkey * 10 + 2, least(min(o_orderkey * 10 + 2) OVER (PARTITION BY o_custkey), o_custkey * 10 + 1) FROM orders""")
def hub_components(t):
    links = t.orders.select((F.col("o_custkey") * 10 + 1).alias("a"), (F.col("o_orderkey") * 10 + 2).alias("b"))
    return R.connected(links)


@query("G9_extremities", f"""WITH RECURSIVE {LEGS}, {_NODES}, c AS (SELECT group_key, avg(lon) AS x, avg(lat) AS y FROM nodes GROUP BY 1),
s AS (SELECT n.group_key, arg_max(struct_pack(x := n.lon, y := n.lat), (round({hav('c.x', 'c.y', 'n.lon', 'n.lat')}, 8), -node)) AS p FROM nodes n JOIN c ON n.group_key = c.group_key GROUP BY 1),
a AS (SELECT n.group_key, arg_max(struct_pack(x := n.lon, y := n.lat, n := node), (round({hav('s.p.x', 's.p.y', 'n.lon', 'n.lat')}, 8), -node)) AS p FROM nodes n JOIN s ON n.group_key = s.group_key GROUP BY 1)
SELECT n.group_key AS comp, a.p.n AS a, arg_max(node, (round({hav('a.p.x', 'a.p.y', 'n.lon', 'n.lat')}, 8), -node)) AS b FROM nodes n JOIN a ON n.group_key = a.group_key GROUP BY 1, 2""")
def extremities(t):
    _, nodes = network(t)
    return R.extremities(nodes.select(F.col("group_key").alias("comp"), "node", "lon", "lat"))


@query("G10_shortest_paths", f"""WITH RECURSIVE {LEGS}, {_NODES}, {_COMPS},
w AS (SELECT a, b, min(km) AS km FROM (SELECT a, b, km FROM net UNION ALL SELECT b, a, km FROM net) WHERE a <> b GROUP BY 1, 2),
walk(start, node, km, seen) AS (SELECT comp, comp, 0.0::DOUBLE, [comp] FROM (SELECT DISTINCT comp FROM comps)
 UNION ALL SELECT walk.start, w.b, walk.km + w.km, list_append(seen, w.b) FROM walk JOIN w ON walk.node = w.a WHERE NOT list_contains(seen, w.b))
SELECT start AS comp, node, round(min(km), 5) AS dist FROM walk GROUP BY 1, 2""")
def shortest_paths(t):
    edges, nodes = network(t)
    cost = edges.select("edge_id", "a", "b", F.col("km").alias("cost"), F.lit(False).alias("bridge"))
    starts = R.label_nodes(nodes.select("node"), edges.select("a", "b")).select("comp", F.col("comp").alias("node")).distinct()
    return R.shortest_paths(cost, starts, "comp").select("comp", "node", F.round("dist", 5).alias("dist"))


@query("G4_chained_lines", f"""WITH RECURSIVE {LEGS}, {_NODES}, {_COMPS}, d AS (SELECT node, count(*) AS n, count(DISTINCT seg_id) AS m FROM (SELECT a AS node, seg_id FROM net UNION ALL SELECT b, seg_id FROM net) GROUP BY 1),
per AS (SELECT comp, count(CASE WHEN n = 2 AND m = 2 THEN 1 END) AS through, bool_and(n = 2 AND m = 2) AS ring FROM d JOIN comps ON d.node = comps.node GROUP BY 1),
e AS (SELECT comp, count(*) AS edges FROM net JOIN comps ON a = node GROUP BY 1)
SELECT e.comp, CAST(edges - through + CASE WHEN ring THEN 1 ELSE 0 END AS BIGINT) AS chains, CAST(edges AS BIGINT) AS edges FROM e JOIN per ON e.comp = per.comp""")
def chained_lines(t):
    edges, nodes = network(t)
    placed = R.chains(edges.select("edge_id", "a", "b"))
    comps = R.label_nodes(nodes.select("node"), edges.select("a", "b"))
    return placed.join(edges.select("edge_id", F.col("a").alias("node")), "edge_id").join(comps, "node").groupBy("comp").agg(
        F.count_distinct("chain").alias("chains"), F.count(F.lit(1)).alias("edges"))


@query("G8_bridged_gaps", f"""WITH RECURSIVE {LEGS}, {_NODES}, {_COMPS}, dead AS (SELECT node FROM (SELECT a AS node FROM net UNION ALL SELECT b FROM net) GROUP BY node HAVING count(*) = 1),
d AS (SELECT n.group_key, n.node, n.lon, n.lat, c.comp FROM nodes n JOIN dead ON n.node = dead.node JOIN comps c ON c.node = n.node),
cand AS (SELECT x.group_key AS g, x.comp AS ca, y.comp AS cb, min(row({hav('x.lon', 'x.lat', 'y.lon', 'y.lat')}, least(x.node, y.node), greatest(x.node, y.node))) AS w FROM d x JOIN d y ON x.group_key = y.group_key AND x.comp < y.comp WHERE {hav('x.lon', 'x.lat', 'y.lon', 'y.lat')} <= 15 GROUP BY 1, 2, 3),
lighter(g, ca, cb, w, at_comp) AS (SELECT g, ca, cb, w, ca FROM cand UNION SELECT l.g, l.ca, l.cb, l.w, CASE WHEN c.ca = l.at_comp THEN c.cb ELSE c.ca END FROM lighter l JOIN cand c ON c.g = l.g AND c.w < l.w AND (c.ca = l.at_comp OR c.cb = l.at_comp))
SELECT g AS group_key, w[2] AS a, w[3] AS b, round(w[1], 6) AS km FROM cand WHERE NOT EXISTS (SELECT 1 FROM lighter l WHERE l.g = cand.g AND l.ca = cand.ca AND l.cb = cand.cb AND l.at_comp = cand.cb)""")
def bridged_gaps(t):
    edges, nodes = network(t)
    labelled = R.label_nodes(nodes, edges.select("a", "b"))
    return R.bridges(labelled, edges, "group_key", 15)[0].withColumn("km", F.round("km", 6))


@query("G11_G12_G15_G19_G20_stitched_components")
def stitched(t):
    return S.stitch(cut(fragments(t)), "group_key", SNAP, bridge_km=15, min_km=1.2, dedupe_km=0.08).components


@query("G13_path_pieces")
def path_pieces(t):
    out = S.stitch(cut(fragments(t)), "group_key", SNAP, bridge_km=15, min_km=1.2, rings=False)
    return out.pieces().groupBy("comp", "piece").agg(F.count(F.lit(1)).alias("vertices"))


_DRIVEN = f"""WITH {LEGS}, l AS (SELECT *, {hav('ax', 'ay', 'bx', 'by')} AS k FROM legs), s AS (SELECT seg_id, group_key, sum(k) AS km FROM l GROUP BY 1, 2),
o AS (SELECT *, sum(km) OVER (PARTITION BY group_key ORDER BY seg_id) - km AS off FROM s),
c AS (SELECT seg_id, group_key, ax, ay, bx, by, k, sum(k) OVER (PARTITION BY seg_id ORDER BY seq) AS t1 FROM l),
p AS (SELECT c.group_key, c.seg_id, off + n * 0.2 AS along, ax + (bx - ax) * (n * 0.2 - (t1 - k)) / k AS lon, ay + (by - ay) * (n * 0.2 - (t1 - k)) / k AS lat
  FROM (SELECT *, unnest(generate_series(CAST(floor((t1 - k) / 0.2) + 1 AS BIGINT), CAST(ceil(t1 / 0.2) - 1 AS BIGINT))) AS n FROM c) c JOIN o ON o.seg_id = c.seg_id),
d AS (SELECT seg_id, count(*) * 0.2 AS d FROM (SELECT DISTINCT a.seg_id, a.along FROM p a JOIN p b ON a.group_key = b.group_key AND abs(a.along - b.along) >= 1.6 AND b.lat BETWEEN a.lat - 0.004 AND a.lat + 0.004 AND {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} <= 0.4) GROUP BY 1)
SELECT o.group_key, o.seg_id, round(greatest(0, km - coalesce(d, 0) / 2), 5) AS driven FROM o LEFT JOIN d ON o.seg_id = d.seg_id"""


@query("G16_driven_km", _DRIVEN)
def driven_km(t):
    f = cut(fragments(t))
    path = f.select("group_key", F.col("seg_id").alias("seq"), F.col("seg_id").alias("edge_id"), F.lit(True).alias("forward"), F.lit(False).alias("bridge"), line_km(F.col("coords")).alias("km"))
    out = S.driven_km(path, f.select(F.col("seg_id").alias("edge_id"), "coords"), "group_key", tol_km=0.4)
    return out.select("group_key", F.col("edge_id").alias("seg_id"), F.round("driven", 5).alias("driven"))


@query("G17_noded_parts")
def noded_parts(t):
    return S.node_parts(cut(fragments(t)), "group_key", join_km=0.4).select("group_key", "seg_id", "sub", F.size("coords").alias("vertices"))


@query("G18_paths_between")
def paths_between(t):
    parts = cut(fragments(t))
    ends = parts.groupBy("group_key").agg(
        F.min_by(F.element_at("coords", 1), "seg_id").alias("f"), F.max_by(F.element_at("coords", 1), "seg_id").alias("t"))
    termini = ends.select("group_key", F.col("f.lon").alias("flon"), F.col("f.lat").alias("flat"), F.col("t.lon").alias("tlon"), F.col("t.lat").alias("tlat"))
    return S.stitch_between(parts, termini, "group_key", SNAP, bridge_km=15)[0]


_ADJ = "SELECT 'Brand#' || CAST(n_nationkey AS STRING) AS st, 'Brand#' || CAST(n_nationkey + 1 AS STRING) AS beside FROM nation UNION ALL SELECT 'Brand#' || CAST(n_nationkey + 1 AS STRING), 'Brand#' || CAST(n_nationkey AS STRING) FROM nation"


@query("G21_corridors", f"""WITH RECURSIVE adj AS ({_ADJ}), l AS (SELECT a.id AS a, b.id AS b FROM routes a JOIN routes b ON a.number = b.number WHERE a.st = b.st OR EXISTS (SELECT 1 FROM adj WHERE adj.st = a.st AND adj.beside = b.st)),
r(a, b) AS (SELECT id, id FROM routes UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT number, id, min(b) AS corridor FROM r JOIN routes ON r.a = id GROUP BY 1, 2""")
def corridors(t):
    return R.corridors(t.routes, t.routes.select("number", "id", "st"), t.sql(_ADJ), "number", "id", "st")


@query("G23_cut_between_points", f"""WITH {LEGS}, l AS (SELECT *, {hav('ax', 'ay', 'bx', 'by')} AS k FROM legs) SELECT seg_id AS facility, round(sum(k) FILTER (seq < 4), 5) AS published, true AS drawn FROM l GROUP BY seg_id""")
def cut_between_points(t):
    along = cut(L.chainage(vertices(t), ["seg_id", "group_key"]).drop("km"))
    ends = along.groupBy("group_key", "seg_id").agg(F.min_by("ax", "seq").alias("flon"), F.min_by("ay", "seq").alias("flat"), F.max_by("ax", "seq").alias("tlon"),
                                                    F.max_by("ay", "seq").alias("tlat"), F.max("from_km").alias("km")).withColumnRenamed("seg_id", "facility")
    cuts = S.between_points(along, cut(ends), "facility", "seg_id", ["group_key"], 0.5, 0.1)
    return cuts.select("facility", F.round("published", 5).alias("published"), "drawn")


@query("G23_cut_over_two_lines", f"""WITH h AS (SELECT *, {hav('ax', 'ay', 'bx', 'by')} AS k, lead(slot) OVER w AS nslot, lead(seg_id) OVER w AS nseg, {hav('lead(ax) OVER w', 'lead(ay) OVER w', 'lead(bx) OVER w', 'lead(by) OVER w')} AS nk FROM highways WINDOW w AS (PARTITION BY group_key ORDER BY slot)),
f AS (SELECT seg_id, CASE WHEN nslot = slot + 1 THEN nseg END AS line2, k + CASE WHEN nslot = slot + 1 THEN nk ELSE 0 END AS km FROM h)
SELECT seg_id AS facility, seg_id AS line, line2, round(km, 5) AS km, seg_id % 3 <> 0 AS drawn FROM f""")
def cut_over_two_lines(t):
    """From where each road fragment starts to where it, or the next one that it runs into, ends."""
    h = t.highways
    along = h.select("group_key", F.col("seg_id").alias("line"), F.lit(0).alias("seq"), "ax", "ay", "bx", "by", F.lit(0.0).alias("from_km"), haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("to_km"))
    after = h.select("group_key", (F.col("slot") - 1).alias("slot"), F.col("bx").alias("nx"), F.col("by").alias("ny"), haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("nk"))
    own = haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    ends = h.join(after, ["group_key", "slot"], "left").select(
        F.col("seg_id").alias("facility"), "group_key", F.col("ax").alias("flon"), F.col("ay").alias("flat"), F.coalesce("nx", "bx").alias("tlon"), F.coalesce("ny", "by").alias("tlat"),
        ((own + F.coalesce("nk", F.lit(0.0))) * F.when(F.col("seg_id") % 3 == 0, 2.0).otherwise(1.05)).alias("km"))
    return S.between_points(cut(along), cut(ends), "facility", "line", ["group_key"], 0.5, 0.1).select("facility", "line", "line2", F.round("km", 5).alias("km"), "drawn")


@query("G24_flagged_stretches")
def flagged_stretches(t):
    """A customer's road is named where an order is urgent: the stretches between and around such fragments."""
    v = vertices(t)
    slot, branch = F.col("seg_id") % 13, F.floor(F.col("seg_id") / 13) % 6 == 0
    # The mainline runs east, with the least fragment of each slot that is no branch; a missing slot has no length.
    east = F.when(F.col("seg_id") % 2 == 1, 4 - F.col("seq")).otherwise(F.col("seq"))
    placed = v.filter(~branch).select(F.col("group_key").alias("road"), "seg_id", (slot * 5 + east).alias("seq"), "lon", "lat")
    main = cut(L.chainage(first_by(placed, ["road", "seq"], ["seg_id"], ["lon", "lat"]), ["road"]).drop("km"))
    named = t.orders.select(F.col("o_orderkey").alias("seg_id"), (F.col("o_orderpriority") == "1-URGENT").alias("named"))
    parts = cut(fragments(t).withColumnRenamed("group_key", "road").join(named, "seg_id"))
    return S.flag_stretches(parts, main, F.col("named"), "road")


@query("G24_named_stretches", f"""WITH k AS (SELECT group_key, seg_id, slot, {hav('ax', 'ay', 'bx', 'by')} AS k FROM highways),
h AS (SELECT *, sum(k) OVER w - k AS f, sum(k) OVER w AS t, sum(k) OVER (PARTITION BY group_key) AS total FROM k WINDOW w AS (PARTITION BY group_key ORDER BY slot)),
i AS (SELECT *, max(t) OVER (PARTITION BY group_key ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h WHERE seg_id % 4 = 0),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR f - reach >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY group_key ORDER BY slot) AS n FROM i),
m AS (SELECT group_key, CASE WHEN min(f) < 25 THEN 0 ELSE min(f) END AS lo, CASE WHEN any_value(total) - max(t) < 25 THEN any_value(total) ELSE max(t) END AS hi FROM g GROUP BY group_key, n)
SELECT seg_id, EXISTS (SELECT 1 FROM m WHERE m.group_key = h.group_key AND h.t BETWEEN lo - 0.05 AND hi + 0.05) AS flagged FROM h""")
def named_stretches(t):
    h = t.highways.withColumn("km", haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    main = cut(running_sum(h, ["group_key"], "slot", "km", "to_km", before="from_km"))
    coords = F.array(F.struct(F.col("ax").alias("lon"), F.col("ay").alias("lat")), F.struct(F.col("bx").alias("lon"), F.col("by").alias("lat")))
    parts = main.select("group_key", "seg_id", coords.alias("coords"))
    legs = main.select("group_key", F.col("slot").alias("seq"), "ax", "ay", "bx", "by", "from_km", "to_km")
    return S.flag_stretches(parts, legs, F.col("seg_id") % 4 == 0, "group_key").select("seg_id", "flagged")


@query("G25_split_groups", """SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey || '|named' ELSE CAST(o_custkey AS VARCHAR) END AS part_key, CAST(count(*) AS BIGINT) AS parts FROM orders GROUP BY 1""")
def split_groups(t):
    flags = t.orders.select(F.col("o_custkey").alias("group_key"), F.col("o_orderkey").alias("seg_id"), (F.col("o_orderpriority") == "1-URGENT").alias("flagged"))
    segments = t.orders.select(F.col("o_custkey").alias("group_key"), F.col("o_orderkey").alias("seg_id"))
    return S.split_groups(segments, flags, "group_key", "named").groupBy("part_key").agg(F.count(F.lit(1)).alias("parts"))


def path_length(t):
    """Straight-line length of every fragment, for the tests."""
    v = vertices(t)
    return v.groupBy("seg_id").agg(haversine(F.min_by("lon", "seq"), F.min_by("lat", "seq"), F.max_by("lon", "seq"), F.max_by("lat", "seq")).alias("km"))
