"""Queries over statistics, ids, sorting, sets and designation joins (A-21.., W-*, O-*, U-*, J-9..J-33)."""

from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import attach as J
from ..operators import identity as I
from ..operators import ordered as O
from ..operators import statistics as S
from .aggregates import pct
from .registry import query


@query("A21_inventory_summary", """SELECT st, CAST(count(*) AS BIGINT) AS structures, CAST(count(opened) AS BIGINT) AS dated, CAST(count(off_mi) AS BIGINT) AS placed,
  min(opened) AS oldest, max(opened) AS newest FROM routes GROUP BY st""")
def inventory_summary(t):
    return S.inventory_summary(t.routes, ["st"], "opened", "off_mi")[0]


@query("A21_by_decade", """SELECT st, CAST(floor(opened / 10) * 10 AS INT) AS decade, CAST(count(*) AS BIGINT) AS n FROM routes WHERE opened IS NOT NULL GROUP BY 1, 2""")
def by_decade(t):
    return S.inventory_summary(t.routes, ["st"], "opened", "off_mi")[1]


@query("A22_top_names", """WITH c AS (SELECT sys, name, CAST(count(*) AS BIGINT) AS n FROM routes GROUP BY 1, 2)
SELECT sys, name, n, CAST(row_number() OVER (PARTITION BY sys ORDER BY n DESC, name) AS INT) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY sys ORDER BY n DESC, name) <= 4""")
def top_names(t):
    return S.top_names(t.routes, ["sys"], "name")


@query("A23_toll_gantries", """WITH d AS (SELECT l_partkey AS number, l_returnflag AS line, l_linestatus AS dir, count(*) AS n, sum(l_quantity) AS km FROM lineitem GROUP BY 1, 2, 3)
SELECT number, line, CAST(max(n) AS BIGINT) AS gantries, floor(max(km) * 10 + 0.5) / 10.0 AS km FROM d GROUP BY 1, 2""")
def toll_gantries(t):
    g = t.lineitem.select(F.col("l_partkey").alias("number"), F.col("l_returnflag").alias("line"), F.col("l_linestatus").alias("dir"), F.col("l_quantity").alias("km"))
    return S.toll_points(g, "number", "line", "dir", "km")


@query("A24_fare_bands", """SELECT o_custkey AS facility, min(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS fare_from, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS fare_to,
  CAST(max(year(o_orderdate)) AS INT) AS updated FROM orders GROUP BY 1""")
def fare_bands(t):
    fares = t.orders.select(F.col("o_custkey").alias("facility"), "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("y"))
    return S.fare_bands(fares, "facility", "o_orderstatus", "o_totalprice", "y", "P")


@query("A25_section_lengths", """WITH n AS (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_tax > 0.05 THEN NULL ELSE l_linenumber END AS c, l_quantity AS len, l_linestatus FROM lineitem),
u AS (SELECT a AS number, len FROM n WHERE l_linestatus = 'O' UNION ALL SELECT b, len FROM n WHERE l_linestatus = 'O' AND b <> a
 UNION ALL SELECT c, len FROM n WHERE l_linestatus = 'O' AND c IS NOT NULL AND c <> a AND c <> b)
SELECT CAST(number AS BIGINT) AS number, round(sum(len), 3) AS km, CAST(count(*) AS BIGINT) AS sections FROM u GROUP BY 1""")
def section_lengths(t):
    rows = t.lineitem.withColumn("third", F.when(F.col("l_tax") <= 0.05, F.col("l_linenumber").cast("bigint")))
    return S.section_lengths(rows, ["l_partkey", "l_suppkey", "third"], "l_quantity", F.col("l_linestatus") == "O")


_VERDICTS = ["covered", "other", "short", "absent"]
_VERDICT_SQL = "CASE WHEN l_returnflag = 'A' THEN 'covered' WHEN l_quantity < 5 THEN 'short' WHEN l_returnflag = 'R' THEN 'other' ELSE 'absent' END"


@query("A26_A47_verdict_shares", f"""WITH v AS (SELECT l_suppkey AS st, {_VERDICT_SQL} AS verdict FROM lineitem),
c AS (SELECT st, CAST(count(*) AS BIGINT) AS rows, {', '.join(f"CAST(count(CASE WHEN verdict = '{v}' THEN 1 END) AS BIGINT) AS {v}" for v in _VERDICTS)} FROM v GROUP BY st)
SELECT *, {', '.join(f"{pct(v, 'rows', 1)} AS {v}_share" for v in _VERDICTS)} FROM c""")
def verdict_shares(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("st"), F.expr(_VERDICT_SQL).alias("verdict"))
    return S.crosstab(rows, ["st"], "verdict", _VERDICTS)


@query("A27_best_tier", """SELECT o_custkey AS number, CASE min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '5-LOW' THEN 3 END)
  WHEN 1 THEN '1-URGENT' WHEN 2 THEN '2-HIGH' WHEN 3 THEN '5-LOW' END AS tier FROM orders GROUP BY 1""")
def best_tier(t):
    return S.best_tier(t.orders.withColumnRenamed("o_custkey", "number"), "number", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).select(
        "number", F.col("tier").alias("tier"))


@query("A28_best_description", """WITH r AS (SELECT l_orderkey AS k, l_partkey, l_quantity AS score, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS tie,
  CASE WHEN l_discount > 0.05 THEN NULL ELSE l_returnflag END AS a, CASE WHEN l_tax > 0.03 THEN NULL ELSE l_partkey END AS b FROM lineitem)
SELECT k, arg_min(a, (-score, tie)) FILTER (a IS NOT NULL) AS a, arg_min(b, (-score, tie)) FILTER (b IS NOT NULL) AS b FROM r GROUP BY k""")
def best_description(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("score"),
                             (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("tie"),
                             F.when(F.col("l_discount") <= 0.05, F.col("l_returnflag")).alias("a"), F.when(F.col("l_tax") <= 0.03, F.col("l_partkey")).alias("b"))
    return S.best_description(rows, "k", F.col("score"), ["a", "b"], "tie")


@query("A29_busiest_and_quietest", """SELECT route, CAST(count(*) AS BIGINT) AS stations, CAST(count(CASE WHEN moto > 20 THEN 1 END) AS BIGINT) AS core,
  arg_max(place, (tdpa, place)) AS busiest, arg_min(place, (tdpa, place)) AS quietest, median(tdpa) AS median FROM stations GROUP BY route""")
def busiest_and_quietest(t):
    return S.busiest_and_quietest(t.stations, "route", "tdpa", "place", F.col("moto") > 20)


@query("A32_system_profile", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY sys ORDER BY mi, id) AS p, count(*) OVER (PARTITION BY sys) AS n FROM routes)
SELECT sys, CAST(count(*) AS BIGINT) AS routes, round(sum(mi), 1) AS mi, max(CASE WHEN p = floor(n / 2) + 1 THEN mi END) AS median,
  {pct('coalesce(sum(mi * lanes_share), 0)', 'sum(mi)', 1)} AS freeway, {pct('coalesce(sum(mi * toll_share), 0)', 'sum(mi)', 1)} AS toll, arg_max(id, (mi, -id)) AS longest FROM r GROUP BY sys""")
def system_profile(t):
    return S.system_profile(t.routes, "sys", "mi", "lanes_share", "toll_share", "id")


@query("A33_country_totals", f"""WITH c AS (SELECT cc, CAST(count(*) AS BIGINT) AS routes, sum(mi) AS m FROM routes GROUP BY cc)
SELECT cc, routes, round(m, 1) AS mi, {pct('m', 'sum(m) OVER ()', 1)} AS share FROM c""")
def country_totals(t):
    return S.country_totals(t.routes, "cc", "mi")


@query("A34_drawn_jurisdictions", "SELECT DISTINCT route, st FROM edges")
def drawn_jurisdictions(t):
    return S.drawn_jurisdictions(t.edges, ["route"], "st")


@query("A35_rank_correlation", """WITH r AS (SELECT sys, CAST(row_number() OVER (PARTITION BY sys ORDER BY number, id) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY sys ORDER BY cx, id) AS DOUBLE) AS b FROM routes)
SELECT sys, CAST(count(*) AS BIGINT) AS n, round(coalesce(corr(a, b), 0), 6) AS rho FROM r GROUP BY sys""")
def rank_correlation(t):
    return S.rank_correlation(t.routes, "sys", "number", "cx", "id")


@query("A35_orientation_fit", """SELECT cc, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN (CASE WHEN mi > number THEN 'ns' ELSE 'ew' END) = (CASE WHEN number % 2 = 1 THEN 'ns' ELSE 'ew' END) THEN 1 END) AS BIGINT) AS ok
FROM routes GROUP BY cc""")
def orientation_fit(t):
    return S.orientation_fit(t.routes, "cc", F.col("number"), F.col("mi"), F.when(F.col("number") % 2 == 1, "ns").otherwise("ew"))


@query("A37_panel_by_year", """SELECT year, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT route) AS BIGINT) AS stations, median(tdpa) AS median FROM stations GROUP BY year""")
def panel_by_year(t):
    return S.panel_by_year(t.stations, "year", "route", "tdpa")


@query("A38_directory", """SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS segments, max(l_quantity) AS length, min(l_quantity) <> max(l_quantity) AS inconsistent FROM lineitem GROUP BY 1, 2""")
def directory(t):
    return S.directory(t.lineitem, ["l_orderkey"], "l_linenumber", "l_quantity")


@query("A39_class_mix", """SELECT CASE WHEN l_tax > 0.06 THEN 'rejected' ELSE l_returnflag END AS reason, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def class_mix(t):
    return S.class_mix(t.lineitem, F.when(F.col("l_tax") > 0.06, "rejected").otherwise(F.col("l_returnflag")))


@query("A40_inventory_touched", """WITH i AS (SELECT st, sum(km) AS km FROM edges GROUP BY st), n AS (SELECT st, km, sum(km) OVER () AS total FROM i)
SELECT DISTINCT e.route, e.st, round(n.km, 3) AS km, round(total, 3) AS national FROM edges e JOIN n ON e.st = n.st""")
def inventory_touched(t):
    inventory = t.edges.groupBy("st").agg(F.sum("km").alias("km"))
    return S.inventory_touched(t.edges, inventory, "route", "st", "km")


@query("A41_register_against_drawn", """WITH r AS (SELECT number, round(sum(CASE WHEN nhs = 0 THEN len ELSE 0 END), 3) AS register_km, round(sum(CASE WHEN nhs = 1 THEN len ELSE 0 END), 3) AS branch_km,
  CAST(count(DISTINCT st) AS BIGINT) AS states FROM sections GROUP BY number), d AS (SELECT route, round(sum(km), 3) AS drawn_km FROM edges GROUP BY route)
SELECT number, register_km, branch_km, states, drawn_km FROM r LEFT JOIN d ON number = route""")
def register_against_drawn(t):
    register = t.sections.select("number", "st", F.col("len").alias("km"), (F.col("nhs") == 1).alias("branch"))
    return S.register_against_drawn(register, t.edges.withColumnRenamed("route", "number"), "number", "st", "km", "branch")


@query("A42_lineage_flows", f"""WITH m AS (SELECT sys, sum(mi) AS mi, {pct('sum(mi * lanes_share)', 'sum(mi)', 1)} AS lanes, {pct('sum(mi * toll_share)', 'sum(mi)', 1)} AS toll FROM routes GROUP BY sys),
f AS (SELECT 'geometry' AS source, sys, mi FROM m UNION ALL SELECT 'survey', sys, round(mi * lanes / 100, 3) FROM m UNION ALL SELECT 'survey', sys, round(mi * toll / 100, 3) FROM m)
SELECT source, sys, round(sum(mi), 3) AS mi FROM f WHERE mi > 0 GROUP BY 1, 2""")
def lineage_flows(t):
    from ..operators.measures import coverage_matrix
    matrix = coverage_matrix(t.routes, "sys", "mi", {"lanes": F.col("lanes_share"), "toll": F.col("toll_share")})
    systems = t.routes.select("sys").distinct()
    flows = systems.select("sys", F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(f).cast("string").alias("field"))
                                                     for s, f in (("geometry", None), ("survey", "lanes"), ("survey", "toll"))])))
    return S.lineage_flows(t.routes, "sys", "mi", flows, matrix)


@query("A43_gantry_points", """WITH g AS (SELECT 'G' || CAST(floor(o_orderkey / 4) AS BIGINT) || CASE o_orderkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE '' END AS gid, o_totalprice AS x, o_custkey AS y FROM orders)
SELECT regexp_replace(gid, '[NSEW]$', '') AS point, round(avg(x), 6) AS lon, round(avg(y), 6) AS lat, CAST(count(*) AS BIGINT) AS gantries,
  coalesce(string_agg(DISTINCT regexp_extract(gid, '([NSEW])$', 1), '' ORDER BY regexp_extract(gid, '([NSEW])$', 1)), '') AS directions FROM g GROUP BY 1""")
def gantry_points(t):
    g = t.orders.select(F.concat(F.lit("G"), F.floor(F.col("o_orderkey") / 4).cast("string"), F.element_at(F.array(*map(F.lit, ["N", "S", "E", ""])), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("gid"),
                        F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    return S.gantry_points(g, "gid", "x", "y")


@query("A44_places_served", """WITH c AS (SELECT l_partkey AS number, CAST(l_suppkey % 7 AS INT) AS st, 'City ' || l_linenumber AS city FROM lineitem)
SELECT DISTINCT p.number AS route, city || ', ' || p.st AS place FROM route_pieces p JOIN c ON p.number = c.number AND p.st = c.st""")
def places_served(t):
    cities = t.lineitem.select(F.col("l_partkey").alias("number"), (F.col("l_suppkey") % 7).cast("int").alias("st"),
                               F.concat(F.lit("City "), F.col("l_linenumber").cast("string")).alias("city"))
    return S.places_served(t.route_pieces.withColumn("route", F.col("number")), cities, "number", "route", "st", "city")


@query("A45_O2_number_reuse", """SELECT number, CAST(count(DISTINCT st) AS BIGINT) AS states, CAST(count(*) AS BIGINT) AS routes FROM routes GROUP BY number ORDER BY states DESC, routes DESC, number LIMIT 20""")
def number_reuse(t):
    return S.number_reuse(t.routes, "number", "st", 20)


@query("A45_children", """WITH n AS (SELECT DISTINCT CAST(id AS VARCHAR) AS num FROM routes)
SELECT regexp_replace(right(num, 2), '^0', '') AS parent, CAST(count(*) AS BIGINT) AS children FROM n WHERE length(num) > 2 GROUP BY 1""")
def children(t):
    return S.children_of(t.routes.select(F.col("id").cast("string").alias("num")), "num")


@query("A46_typical_band", """WITH b AS (SELECT src, CAST(CASE WHEN kph >= 120 THEN 120 WHEN kph <= 40 THEN 40 ELSE floor(kph / 10.0 + 0.5) * 10 END AS INT) AS band, sum(km) AS w FROM observed GROUP BY 1, 2),
c AS (SELECT src, band, sum(w) OVER (PARTITION BY src ORDER BY band) AS upto, sum(w) OVER (PARTITION BY src) AS total FROM b)
SELECT src, min(band) AS typical FROM c WHERE upto >= total / 2 GROUP BY src""")
def typical_band(t):
    from ..functions.numbers import band
    bands = t.observed.withColumn("band", band(F.col("kph"))).groupBy("src", "band").agg(F.sum("km").alias("km"))
    return O.quantiles(bands, ["src"], "band", {"typical": ("weighted", 0.5)}, weight="km")


@query("A47_source_age", "SELECT st, max(opened) AS latest, CAST(count(*) AS BIGINT) AS rows FROM routes GROUP BY st")
def source_age(t):
    return S.source_age(t.routes, "st", "opened")


# ---------------------------------------------------------------- ids, names, order
@query("W1_route_ids", """WITH r AS (SELECT id, sys, number, st, mi, sys || '|' || number AS key, lower(sys) || '-' || number AS slug, sys IN ('SMALL', 'LARGE') AS per FROM routes),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY mi DESC, id) AS n, row_number() OVER (PARTITION BY key, st ORDER BY mi DESC, id) AS s,
  count(*) OVER (PARTITION BY key) AS alls, count(*) OVER (PARTITION BY key, st) AS same FROM r),
i AS (SELECT id, mi, regexp_replace(lower(slug || CASE WHEN alls = 1 THEN '' WHEN per THEN '-' || n ELSE '-' || lower(st) || CASE WHEN same > 1 THEN '-' || s ELSE '' END END), '[^a-z0-9-]', '', 'g') AS rid FROM n),
u AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY mi DESC, id) AS u FROM i)
SELECT id, CASE WHEN u = 1 THEN rid ELSE rid || '-' || u END AS route_id FROM u""")
def route_ids(t):
    r = t.routes.withColumn("key", F.concat_ws("|", "sys", F.col("number").cast("string")))
    return I.assign_ids(r, "key", F.concat_ws("-", F.lower("sys"), F.col("number").cast("string")), "mi", "st", "id",
                        F.col("sys").isin("SMALL", "LARGE")).select("id", "route_id")


@query("W2_remnants_dropped", "SELECT id, number, mi FROM routes r WHERE NOT (mi = 0 AND EXISTS (SELECT 1 FROM routes o WHERE o.number = r.number AND o.mi > 0))")
def remnants(t):
    return I.drop_remnants(t.routes.select("id", "number", "mi"), "number", "mi")


_ENDS = "CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_brand END AS s, CASE WHEN p_size % 5 = 0 THEN NULL ELSE substr(p_name, 1, 4) END AS e"


@query("W3_disambiguators", f"""WITH r AS (SELECT p_partkey AS id, p_partkey % 211 AS key, {_ENDS} FROM part),
o AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY key) > 1 THEN CASE WHEN s IS NOT NULL AND s IS DISTINCT FROM e THEN s ELSE coalesce(e, s) END END AS one FROM r)
SELECT id, CASE WHEN one IS NOT NULL AND count(*) OVER (PARTITION BY key, one) > 1 AND s IS NOT NULL AND e IS NOT NULL THEN s || ' – ' || e ELSE one END AS "where" FROM o""")
def disambiguators(t):
    r = t.sql(f"SELECT p_partkey AS id, p_partkey % 211 AS key, {_ENDS} FROM part")
    return I.disambiguate(r, "key", "s", "e").select("id", "where")


@query("W4_longest_per_number", "SELECT number, arg_min(id, (-mi, id)) AS id, max(mi) AS mi FROM routes GROUP BY number")
def longest_per_number(t):
    return I.longest_per(t.routes, ["number"], "mi", "id", ["id", "mi"])


@query("W7_S18_latest_edition", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY 1")
def latest_edition(t):
    return I.latest_per(t.orders, ["o_custkey"], "o_orderdate", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("W8_chainage_length", """SELECT l_partkey AS number, min(l_orderkey / 8.0) AS from_km, max(l_orderkey / 8.0) AS to_km, round(max(l_orderkey / 8.0) - min(l_orderkey / 8.0), 3) AS km FROM lineitem GROUP BY 1""")
def chainage_length(t):
    return I.chainage_length(t.lineitem.select(F.col("l_partkey").alias("number"), (F.col("l_orderkey") / 8.0).alias("km")), "number", "km")


@query("W9_termini", """WITH e AS (SELECT l_orderkey AS route, l_partkey * 1000 + l_linenumber AS seq, CASE WHEN l_tax < 0.04 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS name, l_orderkey % 3 = 0 AS f FROM lineitem),
g AS (SELECT route, arg_min(name, (seq, name)) FILTER (name IS NOT NULL) AS a, arg_max(name, (seq, name)) FILTER (name IS NOT NULL) AS b, bool_or(f) AS f FROM e GROUP BY route)
SELECT route, CASE WHEN f THEN b ELSE a END AS start_name, CASE WHEN f THEN a ELSE b END AS end_name FROM g""")
def termini(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("route"), F.struct(F.col("l_partkey") * 1000 + F.col("l_linenumber"), F.col("l_suppkey").cast("string")).alias("seq"),
                          F.when(F.col("l_tax") >= 0.04, F.col("l_suppkey").cast("string")).alias("name"), (F.col("l_orderkey") % 3 == 0).alias("f"))
    return I.termini(e, "route", "seq", "name", "f")


@query("O1_numeric_order", """SELECT label, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(label, '^\\D*(\\d+)', 1) AS INT), label) AS BIGINT) AS place FROM routes""")
def numeric_order(t):
    n = t.routes.withColumn("n", F.regexp_extract("label", r"^\D*(\d+)", 1).try_cast("int"))
    return O.positions(n, [], [F.col("n"), F.col("label")], "n", name="place").select("label", "place")


@query("O2_widest_gaps", "SELECT id, sys, gap_mi FROM routes WHERE gap_mi > 0 ORDER BY gap_mi DESC, id LIMIT 20")
def widest_gaps(t):
    return I.top(t.routes.filter("gap_mi > 0").select("id", "sys", "gap_mi"), [F.col("gap_mi").desc(), F.col("id")], 20)


@query("O3_search", """WITH h AS (SELECT *, upper(label || ' ' || name || ' ' || st) AS hay FROM routes),
r AS (SELECT id, CASE WHEN upper(label) = 'RED BRAND#1' THEN -400 ELSE 0 END + CASE WHEN CAST(number AS VARCHAR) = 'RED BRAND#1' THEN -300 ELSE 0 END + CASE WHEN upper(name) LIKE 'RED BRAND#1%' OR upper(st) LIKE 'RED BRAND#1%' THEN -250 ELSE 0 END
  + CASE sys WHEN 'ECONOMY' THEN -60 WHEN 'SMALL' THEN -20 ELSE 0 END + CASE WHEN cc = 'EC' THEN -15 ELSE 0 END - least(mi, 3000) / 100 AS score FROM h WHERE contains(hay, 'RED') AND contains(hay, 'BRAND#1'))
SELECT id, round(score, 6) AS score, count(*) OVER () AS total FROM r ORDER BY r.score, id LIMIT 300""")
def search(t):
    tier = F.when(F.col("sys") == "ECONOMY", "primary").when(F.col("sys") == "SMALL", "auxiliary")
    rows = I.haystack(t.routes.withColumn("tier", tier), "label", "name", "st")
    return I.search(rows, "red brand#1", "label", "number", ["name", "st"], "mi", "id", "tier", F.col("cc") == "EC").select("id", F.round("score", 6).alias("score"), "total")


@query("O3_search_many", """WITH w AS (SELECT DISTINCT id, unnest(string_split(upper(name || ' ' || st), ' ')) AS w FROM routes),
p AS (SELECT DISTINCT n_nationkey AS pid, t FROM nation, (VALUES (1), (2)) v(i), LATERAL (SELECT CASE WHEN i = 1 THEN 'BRAND#' || (n_nationkey + 1) ELSE (CASE n_nationkey % 3 WHEN 0 THEN 'RED' WHEN 1 THEN 'BOLT' ELSE 'GEAR' END) END AS t))
SELECT pid, id FROM w JOIN p ON w = t GROUP BY pid, id HAVING count(*) = 2""")
def search_many(t):
    phrases = t.nation.select(F.col("n_nationkey").alias("pid"), F.explode(F.array(
        F.concat(F.lit("brand#"), (F.col("n_nationkey") + 1).cast("string")),
        F.element_at(F.array(*map(F.lit, ["red", "bolt", "gear"])), F.col("n_nationkey") % 3 + 1))).alias("term"))
    return I.search_many(I.haystack(t.routes, "name", "st"), phrases, "pid", "term", "id")


@query("U1_S12_concatenated", """SELECT CAST(c_custkey AS BIGINT) AS key, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT CAST(s_suppkey AS BIGINT), NULL, s_acctbal FROM supplier""")
def concatenated(t):
    return I.concat_tables(t.customer.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")),
                           t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


@query("U2_distinct_numbers", "SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n FROM orders GROUP BY 1")
def distinct_numbers(t):
    return t.orders.select("o_custkey", "o_orderpriority").dropDuplicates().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("U3_J18_difference", """SELECT l_orderkey AS k, 'sections' AS side FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)
UNION ALL SELECT o_orderkey, 'orders' FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def key_difference(t):
    return I.difference(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")), ["k"], "sections", "orders")


@query("U4_merged_keys", """SELECT CASE WHEN n_regionkey IS NOT NULL AND c_nationkey >= 20 THEN n_regionkey ELSE c_nationkey END AS key, CAST(count(*) AS BIGINT) AS n
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def merged_keys(t):
    merges = t.nation.filter("n_nationkey >= 20").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("into"))
    return I.merge_keys(t.customer.select(F.col("c_nationkey").alias("key")), "key", merges).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- designation joins
_REGISTER = """SELECT CASE p_partkey % 4 WHEN 0 THEN 'I-' || CAST(p_partkey % 97 AS STRING) WHEN 1 THEN CAST(p_partkey % 97 AS STRING) WHEN 2 THEN 'H-' || CAST(p_partkey % 97 AS STRING)
  ELSE 'I-' || CAST(p_partkey % 97 AS STRING) || ' East' END AS entry, p_partkey FROM part"""
_NUMBERS = "SELECT c_custkey AS route, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 120 AS STRING) WHEN 1 THEN 'H' || CAST(c_custkey % 120 AS STRING) ELSE CAST(c_custkey % 120 AS STRING) || 'E' END AS number FROM customer"


@query("J10_register_lookup", f"""WITH reg AS (SELECT DISTINCT entry FROM ({_REGISTER})), n AS ({_NUMBERS}),
s AS (SELECT route, 0 AS p, 'I-' || number AS entry FROM n UNION ALL SELECT route, 1, number FROM n UNION ALL SELECT route, 2, regexp_replace(number, '^([A-Z]+)(\\d)', '\\1-\\2') FROM n
  UNION ALL SELECT route, 3, 'I-' || regexp_extract(number, '^(\\d+)', 1) || ' East' FROM n WHERE regexp_matches(number, '^\\d+E$'))
SELECT route, arg_min(s.entry, p) AS entry FROM s JOIN reg ON s.entry = reg.entry GROUP BY route""")
def register_lookup(t):
    return J.register_lookup(t.sql(_NUMBERS), "route", "number", t.sql(_REGISTER), "entry")


@query("J11_all_or_nothing", """WITH reg AS (SELECT number AS entry, st, sum(len) AS v FROM sections WHERE f_class <= 5 GROUP BY 1, 2),
j AS (SELECT p.number AS route, p.number AS entry, p.mi, reg.v FROM route_pieces p LEFT JOIN reg ON p.number = reg.entry AND p.st = reg.st)
SELECT route, entry, sum(v) AS total, CAST(count(v) AS BIGINT) AS known FROM j GROUP BY 1, 2 HAVING count(v) > 0 AND count(v) = count(CASE WHEN v IS NOT NULL OR mi > 40 THEN 1 END)""")
def all_or_nothing(t):
    register = t.sections.filter("f_class <= 5").groupBy(F.col("number").alias("entry"), "st").agg(F.sum("len").alias("v"))
    pieces = t.route_pieces.select(F.col("number").alias("route"), F.col("number").alias("entry"), "st", "mi")
    return J.all_or_nothing(pieces, register, "route", "entry", "st", "mi", "v", graze=40)


@query("J11_whole_total", """WITH reg AS (SELECT DISTINCT number AS entry, st FROM sections WHERE f_class <= 2), tot AS (SELECT number AS entry, sum(len) AS total FROM sections GROUP BY 1),
l AS (SELECT entry, count(*) AS listed FROM reg GROUP BY 1),
s AS (SELECT p.number AS route, count(reg.st) AS shared, count(*) AS mine FROM route_pieces p LEFT JOIN reg ON p.number = reg.entry AND p.st = reg.st GROUP BY 1)
SELECT route, route AS entry, total FROM s JOIN l ON route = l.entry JOIN tot ON route = tot.entry WHERE shared >= listed - 1 AND shared >= mine - 2 AND shared / listed >= 0.8""")
def whole_total(t):
    register = t.sections.filter("f_class <= 2").select(F.col("number").alias("entry"), "st")
    totals = t.sections.groupBy(F.col("number").alias("entry")).agg(F.sum("len").alias("total"))
    pieces = t.route_pieces.select(F.col("number").alias("route"), F.col("number").alias("entry"), "st")
    return J.whole_total(pieces, register, totals, "route", "entry", "st", "total")


@query("J12_attached_to_longest", """WITH l AS (SELECT number, arg_min(id, (-mi, id)) AS id, max(mi) AS mi FROM routes GROUP BY number),
f AS (SELECT CAST(c_custkey % 230 AS BIGINT) AS number, c_custkey, CAST(600 + (c_custkey * 17) % 900 AS DOUBLE) AS km FROM customer)
SELECT f.number, c_custkey, km, id, CASE WHEN id IS NULL THEN 'unmatched' WHEN mi = 0 OR abs(km / 1.609344 - mi) > 0.2 * mi THEN 'apart' ELSE 'shown' END AS verdict,
  CASE WHEN id IS NOT NULL AND mi > 0 AND abs(km / 1.609344 - mi) <= 0.2 * mi THEN round(km / 1.609344, 6) END AS official_mi FROM f LEFT JOIN l ON f.number = l.number""")
def attached_to_longest(t):
    figures = t.customer.select((F.col("c_custkey") % 230).alias("number"), "c_custkey", (600 + (F.col("c_custkey") * 17) % 900).cast("double").alias("km"))
    return J.attach_to_longest(t.routes, figures, ["number"], "id", "mi", "km")


@query("J14_majority_prefix", """WITH v AS (SELECT p_name AS prefix, p_brand AS st, CAST(count(*) AS BIGINT) AS votes FROM part GROUP BY 1, 2)
SELECT prefix, arg_min(st, (-votes, st)) AS st, max(votes) AS votes FROM v GROUP BY prefix""")
def majority_prefix(t):
    return J.majority_prefix(t.part.select(F.col("p_name").alias("prefix"), F.col("p_brand").alias("st")), "prefix", "st")


@query("J16_absences", """WITH l AS (SELECT DISTINCT l_partkey AS number, l_suppkey % 7 AS st FROM lineitem WHERE l_linenumber <= 4), d AS (SELECT DISTINCT l_partkey AS number, l_suppkey % 7 AS st FROM lineitem WHERE l_linenumber > 4),
r AS (SELECT p_partkey AS number, CAST(p_size % 7 AS BIGINT) AS st, p_name AS reason FROM part), m AS (SELECT * FROM l EXCEPT SELECT * FROM d)
SELECT m.number, m.st, reason, CASE WHEN reason IS NULL THEN 'unexplained' END AS problem FROM m LEFT JOIN r ON m.number = r.number AND m.st = r.st
UNION ALL SELECT number, st, reason, 'stale' FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.number = r.number AND m.st = r.st)""")
def absences(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("number"), (F.col("l_suppkey") % 7).alias("st"), "l_linenumber")
    reasons = t.part.select(F.col("p_partkey").alias("number"), (F.col("p_size") % 7).cast("bigint").alias("st"), F.col("p_name").alias("reason"))
    return J.absences(rows.filter("l_linenumber <= 4"), rows.filter("l_linenumber > 4"), ["number", "st"], reasons)


@query("J17_membership", """WITH d AS (SELECT DISTINCT route, st FROM edges WHERE divided), l AS (SELECT DISTINCT route, st FROM edges)
SELECT l.route, l.st, d.st IS NOT NULL AS drawn FROM l LEFT JOIN d ON l.route = d.route AND l.st = d.st""")
def membership(t):
    return J.membership(t.edges, t.edges.filter("divided"), ["route", "st"])


@query("J23_approved_matches", """SELECT l_partkey AS title, l_suppkey AS route, CAST(count(DISTINCT l_shipdate) AS BIGINT) AS names, CAST(min(l_shipdate) AS DATE) AS first_name FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def approved_matches(t):
    m = t.lineitem.select(F.col("l_partkey").alias("title"), F.col("l_suppkey").alias("route"), F.col("l_shipdate").cast("date").alias("name"), (F.col("l_returnflag") == "R").alias("ok"))
    return J.approved_matches(m, "title", "route", "name", "ok")


@query("J24_numbers_in_states", """WITH a AS (SELECT DISTINCT o_orderkey AS title, o_orderkey % 211 AS n, 'Brand#' || (1 + o_custkey % 25) AS st FROM orders)
SELECT DISTINCT title, id AS route FROM a JOIN routes ON n = number AND a.st = routes.st""")
def numbers_in_states(t):
    titles = t.orders.select(F.col("o_orderkey").alias("title"), F.concat((F.col("o_orderkey") % 211).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "D").otherwise("")).alias("number"),
                             F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("st"))
    return J.numbers_in_states(titles, t.routes.select(F.col("id").alias("route"), F.col("number").cast("string").alias("number"), "st"), "title", "route", "number", "st")


@query("J30_relabelled", """WITH a AS (SELECT DISTINCT p_name AS name, upper(p_name) AS alias FROM part WHERE p_name LIKE 'r%')
SELECT p_partkey, coalesce(alias, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')) AS key FROM part LEFT JOIN a ON p_name = name""")
def relabelled(t):
    aliases = t.part.filter(F.col("p_name").startswith("r")).select(F.col("p_name").alias("name"), F.upper("p_name").alias("alias")).distinct()
    return J.relabel(t.part, "p_name", aliases).select("p_partkey", "key")


_RULES = """SELECT p_brand AS st, p_name AS name, p_partkey AS line, 'one ' || CAST(p_size AS STRING) AS as_name FROM part WHERE p_size < 6
UNION ALL SELECT 'Brand#' || CAST(n_nationkey AS STRING), 'red bolt', CAST(NULL AS BIGINT), 'all ' || CAST(n_nationkey AS STRING) FROM nation
UNION ALL SELECT 'Brand#99', n_name, CAST(n_nationkey AS BIGINT), 'none' FROM nation"""


@query("J31_renamed", f"""WITH r AS ({_RULES}) SELECT p_partkey, coalesce(e.as_name, g.as_name, p_name) AS read_as FROM part
LEFT JOIN r e ON e.st = p_brand AND e.name = p_name AND e.line = p_partkey LEFT JOIN r g ON g.st = p_brand AND g.name = p_name AND g.line IS NULL""")
def renamed(t):
    s = t.part.select("p_partkey", F.col("p_brand").alias("st"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    return J.rename(s, t.sql(_RULES), "st", "name", "line").select("p_partkey", "read_as")


@query("J31_unmatched_rules", f"""WITH r AS ({_RULES}) SELECT st, name, line, as_name FROM r WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = st AND p_name = name AND (line IS NULL OR p_partkey = line))""")
def unmatched_rules(t):
    s = t.part.select(F.col("p_brand").alias("st"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    return J.unmatched_rules(s, t.sql(_RULES), "st", "name", "line")


@query("J32_corrected", """SELECT l.number, l.st, CASE WHEN p_size IS NOT NULL THEN mi + p_size ELSE mi END AS mi FROM route_pieces l LEFT JOIN part ON number = p_partkey AND st = p_size % 7""")
def corrected(t):
    listed = t.route_pieces.select("number", "st", "mi")
    fixes = (t.part.select(F.col("p_partkey").alias("number"), (F.col("p_size") % 7).alias("st"), "p_size").join(listed, ["number", "st"])
             .select("number", "st", F.col("mi").alias("published"), (F.col("mi") + F.col("p_size")).alias("corrected")))
    return J.correct(listed, fixes, ["number", "st"], "mi")


@query("J33_translated_names", """WITH d AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word, '#' || split_part(p_name, ' ', 1) AS tr FROM part WHERE p_name < 'o'),
n AS (SELECT DISTINCT replace(p_name, ' ', ' & ') AS name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT name, CASE WHEN x.tr IS NOT NULL AND y.tr IS NOT NULL THEN x.tr || ' & ' || y.tr END AS translated FROM n LEFT JOIN d x ON a = x.word LEFT JOIN d y ON b = y.word""")
def translated_names(t):
    word = F.split("p_name", " ")[0]
    dictionary = t.part.filter(F.col("p_name") < "o").select(word.alias("word"), F.concat(F.lit("#"), word).alias("translation")).distinct()
    return J.translate_names(t.part.select(F.regexp_replace("p_name", " ", " & ").alias("name")), "name", dictionary)


@query("P17_folded_names", "SELECT p_partkey, upper(p_name) AS folded FROM part")
def folded_names(t):
    return t.part.select("p_partkey", fold(F.col("p_name")).alias("folded"))
