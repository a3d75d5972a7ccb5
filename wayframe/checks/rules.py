"""Queries over sources, sinks and quality rules (S-*, Q-*)."""

import uuid

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..runtime import table_dir
from ..sources import readers as R
from ..sources import writers as Z
from .geometry import _SIMPLIFIED, hav, vertices
from .registry import query


def _scratch(t) -> str:
    return f"{table_dir(t.spark)}/wayframe-io-{uuid.uuid4().hex}"


@query("S1_S13_delimited_source", """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || '"x", ' || chr(10) || 'y' AS name FROM part""")
def delimited_source(t):
    path = _scratch(t)
    (t.part.select(F.col("p_partkey").alias("P_Partkey"), F.concat(F.col("p_name"), F.lit('"x", \ny')).alias("Name"))
     .write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).csv(path))
    return R.read_delimited(t.spark, path, ["p_partkey", "name"], line_breaks=True)


@query("S2_single_quoted_source", """SELECT CAST(c_custkey AS VARCHAR) AS key, 'a,' || c_name AS name FROM customer""")
def single_quoted(t):
    path = _scratch(t)
    (t.customer.select(F.col("c_custkey").alias("key"), F.concat(F.lit("a,"), F.col("c_name")).alias("name"))
     .write.option("header", True).option("quote", "'").option("quoteAll", True).csv(path))
    return R.read_delimited(t.spark, path, ["key", "name"], quote="'")


@query("S3_positional_source", """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_suppkey % 4 <> 0""")
def positional_source(t):
    path = _scratch(t)
    row = F.when(F.col("s_suppkey") % 4 == 0, F.concat_ws("\t", F.lit("short"), F.col("s_name"))).otherwise(
        F.concat_ws("\t", F.col("s_suppkey").cast("string"), F.lit("x"), F.col("s_name"), F.lit("end ")))
    # One column under one long name: the name is each file's header line.
    t.supplier.select(row.alias("a\tb\tc\td")).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path)
    return R.read_positional(t.spark, path, {0: "id", 2: "name"}, 4)


@query("S4_decoded_files", """SELECT CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'utf-8' ELSE 'windows-1252' END AS encoding, p_name || ' é' AS text FROM part""")
def decoded_files(t):
    # The Latin letter as one byte, which is no valid UTF-8.
    utf8, latin = F.encode(F.concat(F.col("p_name"), F.lit(" é")), "UTF-8"), F.concat(F.encode(F.concat(F.col("p_name"), F.lit(" ")), "UTF-8"), F.unhex(F.lit("E9")))
    files = t.part.select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 2 == 0, utf8).otherwise(latin).alias("content"))
    return R.decode_files(files)


@query("S5_array_lines", """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'G' || o_custkey AS refs, CAST(2 AS INT) AS points, round(o_custkey / 10.0 + o_orderkey / 7.0, 6) AS total FROM orders""")
def array_lines(t):
    path = _scratch(t)
    cells = F.array(F.col("o_orderkey").cast("string"), F.concat(F.lit("G"), F.col("o_custkey").cast("string")), (F.col("o_custkey") / 10.0).cast("string"), F.lit("1.5"), F.lit("0.5"), (F.col("o_orderkey") / 7.0).cast("string"))
    t.orders.select(F.to_json(cells).alias("value")).write.text(path)
    rows = R.read_array_lines(t.spark, path, ["id", "refs"], ["id", "refs", "kph", "lanes"], wide=False)
    return rows.select("id", "refs", F.size("coords").alias("points"), F.round(F.get("coords", 0)["lon"] + F.get("coords", 1)["lat"], 6).alias("total"))


@query("S6_geojson_lines", """SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INT) AS lines, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS lon FROM orders""")
def geojson_lines(t):
    c = F.col("o_custkey").cast("string")
    g = (F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"type":"LineString","coordinates":[['), c, F.lit(",1],[2,3]]}")))
         .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"type":"MultiLineString","coordinates":[[['), c, F.lit(",1],[2,3]],[[4,5],[6,7]]]}"))).otherwise(F.lit('{"type":"Point","coordinates":[1,2]}')))
    lines = R.lines_of(g)
    return t.orders.select("o_orderkey", F.size(lines).alias("lines"), F.get(F.get(lines, 0), 0)["lon"].alias("lon"))


@query("S7_S10_partitioned_dataset", "SELECT id, st FROM routes WHERE sys = 'LARGE' AND st IN ('Brand#3', 'Brand#4')")
def partitioned_dataset(t):
    path = _scratch(t)
    rows = t.routes.select("id", F.col("sys").alias("system"), "st")
    Z.write_partitions(rows, path, ["system", "st"])
    return R.read_partitions(t.spark, path, "LARGE", ["Brand#3", "Brand#4"]).select("id", "st")


@query("S8_geometry_sink", f"""{_SIMPLIFIED} SELECT c_mktsegment AS system, c_nationkey AS st, CAST(count(DISTINCT seg_id) AS BIGINT) AS blocks, CAST(count(*) AS BIGINT) AS vertices
FROM kept JOIN orders ON seg_id = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def geometry_sink(t):
    path = _scratch(t)
    v = vertices(t).select(F.col("group_key").alias("route"), F.col("seg_id").alias("line"), F.lit(True).alias("main"), "seq", "lon", "lat")
    routes = t.customer.select(F.col("c_custkey").alias("route"), F.col("c_mktsegment").alias("system"), F.col("c_nationkey").alias("st"))
    Z.write_geometry(v, routes, path, "route", 0.0007)
    back = t.spark.read.parquet(path)
    return back.groupBy("system", "st").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.size("coords")).alias("vertices"))


@query("S9_route_index", "SELECT id, label, mi FROM routes")
def route_index(t):
    path = _scratch(t)
    Z.write_index(t.routes, path, ["id", "label", "mi"], "mi", "id")
    return t.spark.read.parquet(path)


@query("S11_point_index", """SELECT st, CAST(count(*) AS BIGINT) AS points, round(min(lon), 6) AS x0, round(min(lat), 6) AS y0, round(max(lon), 6) AS x1, round(max(lat), 6) AS y1 FROM places GROUP BY st""")
def point_index(t):
    return Z.point_index(t.places, "st")


@query("S14_way_numbers", """SELECT DISTINCT way, ref FROM (SELECT o_orderkey AS way, 'own' || CAST(o_custkey % 40 AS VARCHAR) AS ref FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT l_orderkey, 'rel' || l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""")
def way_numbers(t):
    ways = t.orders.select(F.col("o_orderkey").alias("way"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("own"), (F.col("o_custkey") % 40).cast("string"))).alias("ref"))
    relations = t.lineitem.select(F.concat(F.lit("rel"), F.col("l_partkey").cast("string")).alias("ref"), F.array("l_orderkey").alias("members"))
    return R.way_numbers(ways, relations, "way", "ref", "members")


@query("S15_way_vertices", """WITH r AS (SELECT o_orderkey AS way, p, CASE p WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey % 3000 ELSE o_custkey % 700 END AS node FROM orders, (VALUES (0), (1), (2)) v(p)),
j AS (SELECT way, p, lon, lat FROM r JOIN places ON node = place_id), n AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY p) - 1 AS seq, count(*) OVER (PARTITION BY way) AS n FROM j)
SELECT way, CAST(seq AS INT) AS seq, round(lon, 6) AS lon, round(lat, 6) AS lat FROM n WHERE n >= 2""")
def way_vertices(t):
    ways = t.orders.select(F.col("o_orderkey").alias("way"), F.array(F.col("o_custkey"), F.col("o_orderkey") % 3000, F.col("o_custkey") % 700).alias("refs"))
    v = R.way_vertices(ways, t.places.withColumnRenamed("place_id", "node"), "way", "refs", "node")
    return v.select("way", "seq", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("S17_edition_fallback", """WITH n AS (SELECT o_custkey, o_orderkey FROM orders WHERE year(o_orderdate) = 1998), p AS (SELECT o_custkey, o_orderkey FROM orders WHERE year(o_orderdate) = 1997),
s AS (SELECT p.o_custkey FROM (SELECT o_custkey, count(*) AS c FROM p GROUP BY 1) p LEFT JOIN (SELECT o_custkey, count(*) AS c FROM n GROUP BY 1) n ON p.o_custkey = n.o_custkey WHERE coalesce(n.c, 0) < p.c * 0.5)
SELECT *, 1998 AS edition FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM s) UNION ALL SELECT *, 1997 FROM p WHERE o_custkey IN (SELECT o_custkey FROM s)""")
def edition_fallback(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    return R.edition_fallback(rows.filter("y = 1998").drop("y"), rows.filter("y = 1997").drop("y"), "o_custkey", 1998, 1997)


@query("S18_newest_resource", """SELECT o_custkey, max(CAST(year(o_orderdate) AS INT)) AS edition_year FROM orders GROUP BY 1""")
def newest_resource(t):
    r = t.orders.select("o_custkey", F.concat(F.lit("Traffic "), F.year("o_orderdate").cast("string"), F.lit(" edition "), F.col("o_orderkey").cast("string")).alias("title"))
    return R.newest_edition(r, "o_custkey", "title", ["title"]).select("o_custkey", "edition_year")


@query("S19_yearly_columns", """SELECT c_custkey, 2019 AS year, CAST(c_custkey AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 2020, c_acctbal FROM customer WHERE c_nationkey > 5""")
def yearly_columns(t):
    wide = t.customer.select("c_custkey", F.col("c_custkey").alias("aadt_2019"), F.when(F.col("c_nationkey") > 5, F.col("c_acctbal")).alias("aadt_2020"))
    return R.yearly_columns(wide, ["c_custkey"], r"aadt_(\d{4})")


@query("S19_numbered_pairs", """SELECT c_custkey, 2010 AS year, CAST(c_custkey AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, CAST(2011 + c_nationkey AS INT), c_acctbal FROM customer""")
def numbered_pairs(t):
    wide = t.customer.select("c_custkey", F.lit(2010).alias("year1"), F.col("c_custkey").alias("value1"), (F.col("c_nationkey") + 2011).alias("year2"), F.col("c_acctbal").alias("value2"))
    return R.numbered_pairs(wide, ["c_custkey"], "year", "value", 2)


@query("S19_headed_columns", """SELECT c_custkey, 'TCH' AS highway, CAST(c_custkey AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 'R-2', c_acctbal FROM customer UNION ALL SELECT c_custkey, 'R-3', CAST(c_nationkey AS DOUBLE) FROM customer""")
def headed_columns(t):
    wide = t.customer.select("c_custkey", F.col("c_custkey").alias("Trans Canada Hi"), F.col("c_acctbal").alias("Route Tw"), F.col("c_nationkey").alias("unlabelled"))
    return R.headed_columns(wide, ["c_custkey"], {"Trans Canada Highway": "TCH", "Route Two": "R-2", "Route Three": "R-3"})


@query("S20_drifting_documents", """SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) END AS box_size,
  CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS VARCHAR) || ' cm' ELSE CAST(p_size AS VARCHAR) END AS width, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand FROM part""")
def drifting_documents(t):
    """Fields that come and go, one that changes its type, one that changes its name, and one inside an object."""
    k = F.col("p_partkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    doc = F.concat(F.lit('{"'), F.when(k % 2 == 0, "title").otherwise("name"), F.lit('": '), q(F.col("p_name")),
                   F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(', "box": {"size": '), F.col("p_size").cast("string"), F.lit("}"))),
                   F.lit(', "width": '), F.when(k % 7 == 0, q(F.concat(F.col("p_size").cast("string"), F.lit(" cm")))).otherwise(F.col("p_size").cast("string")),
                   F.when(k % 3 == 0, F.concat(F.lit(', "brand": '), q(F.col("p_brand")))).otherwise(""), F.lit("}"))
    return R.drifting_documents(t.part.select("p_partkey", doc.alias("doc")), "doc", ["p_partkey"], {"title": "name"})


@query("S5_drifting_arrays", """SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS BIGINT) END AS lanes_forward, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END AS points FROM orders""")
def drifting_arrays(t):
    """Ways as documents: their coordinates are a list, and lanes are told in some editions only."""
    k = F.col("o_orderkey")
    doc = F.concat(F.lit('{"id": '), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, F.concat(F.lit(', "lanes": {"forward": '), (k % 9).cast("string"), F.lit("}"))).otherwise(""),
                   F.lit(', "at": [[1.5, 2], [3, 4.25]'), F.when(k % 5 == 0, "").otherwise(", [5, 6]"), F.lit("]}"))
    read = R.drifting_documents(t.orders.select("o_orderkey", doc.alias("doc")), "doc", ["o_orderkey"])
    return read.select("o_orderkey", "id", "lanes_forward", F.size("at").cast("bigint").alias("points"))


@query("S20_drifting_union", """SELECT 2019 AS year, CAST(c_custkey AS BIGINT) AS key, c_acctbal AS length FROM customer UNION ALL SELECT 2020, CAST(s_suppkey AS BIGINT), s_acctbal FROM supplier""")
def drifting_union(t):
    return R.drifting_union({2019: t.customer, 2020: t.supplier}, {"key": ["s_suppkey", "c_custkey"], "length": ["c_acctbal", "s_acctbal"]})


# ---------------------------------------------------------------- quality
@query("Q1_table_contracts", """SELECT 'duplicate id' AS rule, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail, 'error' AS severity FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'no geometry', CAST(o_orderkey AS VARCHAR), '', 'error' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'remnant', CAST(id AS VARCHAR), '', 'error' FROM routes r WHERE mi = 0 AND EXISTS (SELECT 1 FROM routes o WHERE o.number = r.number AND o.mi > 0)""")
def table_contracts(t):
    keys = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return Q.all_violations(Q.duplicates(keys, "k"), Q.index_against_geometry(t.orders.select(F.col("o_orderkey").alias("k")), t.lineitem.select(F.col("l_orderkey").alias("k")), "k"),
                            Q.remnants(t.routes, "number", "mi", "id"))


_FIGURES = """SELECT doc_id, CASE WHEN quality = 1 THEN toxic END AS value, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'src' END AS source, CASE WHEN doc_id % 4 = 0 THEN 'none kept' END AS reason,
  CASE WHEN doc_id % 5 <> 0 THEN 'a' END AS en, CASE WHEN doc_id % 6 <> 0 THEN 'b' END AS zh, CASE WHEN doc_id % 7 = 0 THEN 'odd' ELSE 'history' END AS section FROM labels"""


@query("Q2_figure_rules", f"""WITH f AS ({_FIGURES}) SELECT 'value without source' AS rule, CAST(doc_id AS VARCHAR) AS key, '' AS detail, 'error' AS severity FROM f WHERE value IS NOT NULL AND source IS NULL
UNION ALL SELECT 'no value and no reason', CAST(doc_id AS VARCHAR), '', 'error' FROM f WHERE value IS NULL AND reason IS NULL
UNION ALL SELECT 'text missing in one language', CAST(doc_id AS VARCHAR), '', 'error' FROM f WHERE (en IS NULL) <> (zh IS NULL) UNION ALL SELECT 'unknown section', CAST(doc_id AS VARCHAR), 'odd', 'error' FROM f WHERE section = 'odd'
UNION ALL SELECT 'paragraphs differ', CAST(conv_id * 100 + turn AS VARCHAR), '', 'warning' FROM conversations WHERE contains(text, chr(10))""")
def figure_rules(t):
    parity = Q.paragraph_parity(t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text", F.lit("x").alias("one")), "k", "text", "one")
    return Q.figures(t.sql(_FIGURES), "doc_id", "value", "source", "reason", ["en", "zh"], "section", ["history"]).unionByName(parity)


@query("Q2_repeated_sections", """SELECT 'duplicate section' AS rule, CAST(conv_id AS VARCHAR) AS key, role AS detail, 'error' AS severity FROM conversations GROUP BY conv_id, role HAVING count(*) > 1""")
def repeated_sections(t):
    return Q.repeated_sections(t.conversations, "conv_id", "role")


@query("Q3_length_tolerances", """SELECT 'measured differs from official' AS rule, CAST(id AS VARCHAR) AS key, CAST(CAST(round(mi / off_mi, 3) AS DOUBLE) AS VARCHAR) AS detail, 'error' AS severity FROM routes WHERE abs(mi / off_mi - 1) > 0.2
UNION ALL SELECT 'official differs from log', CAST(id AS VARCHAR), CAST(CAST(round(off_mi - floor(mi), 3) AS DOUBLE) AS VARCHAR), 'error' FROM routes WHERE abs(off_mi - floor(mi)) > greatest(1, off_mi * 0.02)""")
def length_tolerances(t):
    return Q.length_tolerance(t.routes.withColumn("logged", F.floor("mi").cast("double")), "id", "off_mi", "logged", "mi")


@query("Q4_superseded_claims", """SELECT 'the register has it' AS rule, CAST(id AS VARCHAR) AS key, '' AS detail, 'note' AS severity FROM routes WHERE off_mi IS NULL AND id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def superseded_claims(t):
    return Q.supersede(t.routes, t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), "id", "off_mi")[1]


@query("Q5_timeline", """SELECT 'route' AS kind, id AS key, opened AS year, CAST(NULL AS VARCHAR) AS title FROM routes WHERE opened IS NOT NULL UNION ALL SELECT 'event', o_orderkey, CAST(year(o_orderdate) AS INT), o_orderpriority FROM orders""")
def timeline(t):
    return Q.timeline(t.routes.select(F.lit("route").alias("kind"), F.col("id").alias("key"), F.col("opened").alias("year")),
                      t.orders.select(F.lit("event").alias("kind"), F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("title"))).select("kind", "key", "year", "title")


@query("Q6_oriented_termini", f"""WITH r AS (SELECT s.seg_id, b.lon + (s.seg_id % 3 - 1) * 0.03 AS dx, b.lat AS dy, s.lon AS ax, s.lat AS ay, b.lon AS bx, b.lat AS by FROM vertices s JOIN vertices b ON s.seg_id = b.seg_id AND s.i = 0 AND b.i = 4)
SELECT seg_id, {hav('dx', 'dy', 'bx', 'by')} < {hav('dx', 'dy', 'ax', 'ay')} AS swapped, round(least({hav('dx', 'dy', 'bx', 'by')}, {hav('dx', 'dy', 'ax', 'ay')}), 6) AS km, least({hav('dx', 'dy', 'bx', 'by')}, {hav('dx', 'dy', 'ax', 'ay')}) > 2 AS warn FROM r""")
def oriented_termini(t):
    a = t.vertices.filter("i = 0").select("seg_id", F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    b = t.vertices.filter("i = 4").select("seg_id", F.col("lon").alias("bx"), F.col("lat").alias("by"))
    rows = a.join(b, "seg_id").withColumn("dlon", F.col("bx") + (F.col("seg_id") % 3 - 1) * 0.03).withColumn("dlat", F.col("by"))
    return Q.orient_termini(rows, "seg_id", 2)


@query("Q7_toll_agreement", """SELECT l_suppkey, CAST(count(CASE WHEN s AND f THEN 1 END) AS BIGINT) AS both, CAST(count(CASE WHEN s AND NOT f THEN 1 END) AS BIGINT) AS suffix_only, CAST(count(CASE WHEN NOT s AND f THEN 1 END) AS BIGINT) AS flag_only
FROM (SELECT l_suppkey, l_linenumber < 4 AS s, coalesce(CASE WHEN l_tax > 0.02 THEN l_returnflag = 'R' END, false) AS f FROM lineitem) GROUP BY 1""")
def toll_agreement(t):
    return Q.toll_agreement(t.lineitem, ["l_suppkey"], F.col("l_linenumber") < 4, F.when(F.col("l_tax") > 0.02, F.col("l_returnflag") == "R"))


@query("Q8_branch_only_groups", """SELECT number FROM routes GROUP BY number HAVING bool_and(regexp_matches(name, '^(red|blue|small|old|hot|large)')) AND number NOT IN (SELECT DISTINCT c_custkey % 211 FROM customer WHERE c_nationkey = 3)""")
def branch_only_groups(t):
    listed = t.customer.filter("c_nationkey = 3").select((F.col("c_custkey") % 211).alias("number"))
    return Q.branch_only(t.routes, "number", "name", "^(red|blue|small|old|hot|large)", listed)


@query("Q9_stale_figures", """WITH b AS (SELECT sys, CAST(floor(sum(mi)) AS BIGINT) AS v FROM routes GROUP BY sys), p AS (SELECT sys, CAST(floor(sum(mi)) AS BIGINT) AS v FROM routes WHERE sys < 'M' GROUP BY sys UNION ALL SELECT 'GONE', 1)
SELECT coalesce(p.sys, b.sys) AS sys, p.v AS published, b.v AS built FROM p FULL JOIN b ON p.sys = b.sys WHERE p.v IS DISTINCT FROM b.v""")
def stale_figures(t):
    built = t.routes.groupBy("sys").agg(F.floor(F.sum("mi")).alias("v"))
    published = built.filter("sys < 'M'").unionByName(t.region.filter("r_regionkey = 0").select(F.lit("GONE").alias("sys"), F.lit(1).cast("bigint").alias("v")))
    return Q.stale_figures(published, built, ["sys"], "v")


@query("Q10_match_alarm", """SELECT o_orderpriority, round(avg(CASE WHEN o_custkey % 5 < 4 THEN 1.0 ELSE 0 END), 6) AS share, round(avg(CASE WHEN o_custkey % 5 < 4 THEN 1.0 ELSE 0 END), 6) < 0.8 AS alarm FROM orders GROUP BY 1""")
def match_alarm(t):
    return Q.match_alarm(t.orders, "o_orderpriority", F.col("o_custkey") % 5 < 4)


@query("Q11_far_counterparts", f"""SELECT 'far from its counterpart' AS rule, CAST(seg_id AS VARCHAR) AS key, CAST(CAST(round({hav('lon', 'lat', 'olon', 'lat')}, 3) AS DOUBLE) AS VARCHAR) AS detail, 'warning' AS severity FROM (SELECT seg_id, lon, lat, lon + (seg_id % 10) * 0.05 AS olon FROM vertices WHERE i = 0) WHERE round({hav('lon', 'lat', 'olon', 'lat')}, 3) > 25""")
def far_counterparts(t):
    pairs = t.vertices.filter("i = 0").select("seg_id", "lon", "lat", (F.col("lon") + (F.col("seg_id") % 10) * 0.05).alias("olon"), F.col("lat").alias("olat"))
    return Q.far_apart(pairs, "seg_id")


@query("Q12_total_notes", """WITH r AS (SELECT number, sum(mi) AS s FROM route_pieces GROUP BY 1), p AS (SELECT p_partkey AS number, CAST(p_size AS DOUBLE) * 20 AS total FROM part) SELECT p.number, total, s AS rows_total, abs(total - s) > 100 AS note FROM p JOIN r ON p.number = r.number""")
def total_notes(t):
    return Q.total_notes(t.route_pieces, t.part.select(F.col("p_partkey").alias("number"), (F.col("p_size").cast("double") * 20).alias("total")), "number", "mi", "total", 100)


@query("Q13_missing_values", """SELECT 'offered but not found' AS rule, CAST(c_custkey AS VARCHAR) AS key, '' AS detail, 'error' AS severity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def missing_values(t):
    return Q.missing_values(t.customer.select(F.col("c_custkey").alias("k")), t.orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")), "k")
