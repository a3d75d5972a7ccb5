"""Queries over names, codes and free text (P-13..P-43, J-19..J-22, J-28, J-33)."""

from pyspark.sql import functions as F

from ..functions import designation as D
from ..functions import numbers as N
from ..functions import text as X
from ..operators import matching as M
from .geometry import hav
from .registry import query

# ---------------------------------------------------------------- numbers and dates
_YEAR = "CASE o_orderkey % 5 WHEN 0 THEN CAST(1700 + o_orderkey % 400 AS STRING) WHEN 1 THEN 'n/a' WHEN 2 THEN ' ' || CAST(1900 + o_orderkey % 130 AS STRING) || '.0 ' WHEN 3 THEN '19a0' ELSE NULL END"


@query("P13_plausible_years", f"""WITH y AS (SELECT o_orderkey, trim({_YEAR}) AS v FROM orders), z AS (SELECT o_orderkey, CASE WHEN regexp_full_match(v, '\\d{{4}}(\\.0+)?') THEN CAST(substr(v, 1, 4) AS INT) END AS y FROM y)
SELECT o_orderkey, CASE WHEN y BETWEEN 1850 AND 2027 THEN y END AS built FROM z""")
def plausible_years(t):
    return t.orders.select("o_orderkey", N.year_in(F.expr(_YEAR), 1850, 2027).alias("built"))


@query("P14_sentinels", """SELECT p_partkey, CASE WHEN upper(trim(v)) NOT IN ('', 'N/A', 'N/D', 'NA', 'ND', 'NONE', 'UNKNOWN', 'NULL', '-1', 'SIN DATO', 'SIN DATOS') THEN trim(v) END AS v
FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN ' N/A' WHEN 1 THEN 'unknown' WHEN 2 THEN '-1' WHEN 3 THEN 'Sin dato ' ELSE ' ' || p_name END AS v FROM part)""")
def sentinels(t):
    v = F.expr("CASE p_partkey % 7 WHEN 0 THEN ' N/A' WHEN 1 THEN 'unknown' WHEN 2 THEN '-1' WHEN 3 THEN 'Sin dato ' ELSE ' ' || p_name END")
    return t.part.select("p_partkey", X.null_if_sentinel(v).alias("v"))


@query("P15_parsed_numbers", """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey * 1000 + 7.5 END AS DOUBLE) AS v FROM orders""")
def parsed_numbers(t):
    text = F.when(F.col("o_orderkey") % 6 == 0, "12 mil").otherwise(F.concat(F.lit(" "), F.format_number((F.col("o_orderkey") * 1000 + 7.5), 1), F.lit(" ")))
    return t.orders.select("o_orderkey", N.parse_number(text).alias("v"))


@query("P16_chainages", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderkey % 400 + (o_orderkey % 1000) / 1000.0 END AS km, round(o_orderkey % 90 + (o_orderkey % 7) / 1000.0, 6) AS post FROM orders""")
def chainages(t):
    text = F.when(F.col("o_orderkey") % 4 == 3, "km 5").otherwise(F.concat((F.col("o_orderkey") % 400).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "K+").otherwise("k+"), (F.col("o_orderkey") % 1000).cast("string")))
    return t.orders.select("o_orderkey", N.chainage_km(text).alias("km"), F.round(N.posts_km(F.col("o_orderkey") % 90, F.col("o_orderkey") % 7), 6).alias("post"))


_SPEED = "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 160 AS STRING) WHEN 1 THEN CAST(o_orderkey % 90 AS STRING) || ' mph' WHEN 2 THEN CAST(o_orderkey % 150 AS STRING) || ';30' WHEN 3 THEN 'signals' WHEN 4 THEN CAST(o_orderkey % 130 AS STRING) || 'km/h' ELSE NULL END"


@query("P27_P28_tagged_ways", f"""WITH s AS (SELECT o_orderkey, o_orderstatus, CAST(regexp_extract(split_part(v, ';', 1), '^(\\d{{1,3}})( mph|km/h)?$', 1) AS VARCHAR) AS n, contains(v, 'mph') AS mph, o_custkey FROM (SELECT *, {_SPEED} AS v FROM orders)),
k AS (SELECT *, TRY_CAST(n AS DOUBLE) * CASE WHEN mph THEN 1.609344 ELSE 1 END AS kph FROM s)
SELECT o_orderkey, CASE WHEN kph BETWEEN 5 AND 140 THEN CAST(floor(kph + 0.5) AS INT) ELSE CASE WHEN o_custkey % 2 = 0 THEN 65 ELSE 80 END END AS kph,
  CASE WHEN o_custkey % 15 BETWEEN 1 AND 12 THEN CAST(o_custkey % 15 AS INT) END AS lanes,
  CASE o_orderstatus WHEN 'P' THEN 't' WHEN 'O' THEN 'b' END AS structure FROM k""")
def tagged_ways(t):
    o = t.orders
    back = F.when(F.col("o_custkey") % 2 == 0, "50").otherwise("x")
    speed = N.speed_of(F.expr(_SPEED), F.lit("80"), back)
    structure = N.structure_of(F.when(F.col("o_orderstatus") == "P", "yes").otherwise("no"), F.when(F.col("o_orderstatus") == "O", "viaduct"))
    return o.select("o_orderkey", speed.alias("kph"), N.lanes_of((F.col("o_custkey") % 15).cast("string")).alias("lanes"), structure.alias("structure"))


@query("P28_flags", """SELECT l_orderkey, l_linenumber, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS INT) AS toll, CAST(CASE WHEN l_linestatus = 'O' OR (l_suppkey % 2 = 0 AND l_returnflag <> 'N') THEN 1 ELSE 0 END AS INT) AS oneway, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
def flags(t):
    toll = N.toll_flag(F.when(F.col("l_returnflag") == "A", "yes").when(F.col("l_returnflag") == "R", "no"))
    one = N.oneway_flag(F.when(F.col("l_linestatus") == "O", "yes").when(F.col("l_returnflag") == "N", "no"), F.when(F.col("l_suppkey") % 2 == 0, "motorway"))
    return t.lineitem.groupBy("l_orderkey", "l_linenumber", toll.alias("toll"), one.alias("oneway")).agg(F.count(F.lit(1)).alias("n"))


@query("P32_grades", """SELECT l_suppkey, CASE WHEN l_suppkey < 95 THEN 'good' WHEN l_suppkey <= 170 THEN 'fair' ELSE 'poor' END AS grade, round(l_suppkey / 63.36, 2) AS metric, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def grades(t):
    s = F.col("l_suppkey").cast("double")
    return t.lineitem.groupBy("l_suppkey", N.roughness_grade(s).alias("grade"), N.iri_metric(s).alias("metric")).agg(F.count(F.lit(1)).alias("n"))


@query("P33_step_rounded", """SELECT o_orderkey, round(floor(o_totalprice / 100 + 0.5) * 100, 0) AS hundreds, round(floor((o_totalprice / 7) / 0.1 + 0.5) * 0.1, 1) AS tenths, floor(-o_orderkey / 2.0 + 0.5) AS halves FROM orders""")
def step_rounded(t):
    return t.orders.select("o_orderkey", N.step_round(F.col("o_totalprice"), 100).alias("hundreds"), N.step_round(F.col("o_totalprice") / 7, 0.1).alias("tenths"),
                           N.js_round(-F.col("o_orderkey") / 2).cast("double").alias("halves"))


@query("P34_class_sums", """SELECT l_partkey, CAST(sum(CASE WHEN abs(l_quantity + l_discount * 100 + 50 - 80) > 20 THEN 1 ELSE 0 END) AS BIGINT) AS off, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def class_sums(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum(N.sum_check([F.col("l_quantity"), F.col("l_discount") * 100, F.lit(50.0)], 80, 20)).alias("off"), F.count(F.lit(1)).alias("n"))


_CELL = "CASE p_partkey % 4 WHEN 0 THEN CAST(1950 + p_size AS STRING) WHEN 1 THEN CAST(1950 + p_size AS STRING) || '-1999' WHEN 2 THEN ' ' || p_name ELSE '' END"


@query("P36_year_cells", f"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(1950 + p_size AS INT) END AS year, CASE WHEN p_partkey % 4 IN (1, 2) THEN trim({_CELL}) END AS note FROM part""")
def year_cells(t):
    return t.part.select("p_partkey", N.year_cell(F.expr(_CELL)).alias("c")).select("p_partkey", "c.*")


@query("P42_null_if_redundant", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey <> l_suppkey THEN l_partkey END AS rebuilt, CASE WHEN l_quantity > l_linenumber * 1.2 * 5 THEN l_quantity END AS peak FROM lineitem""")
def redundant(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.null_if_redundant(F.col("l_partkey"), F.col("l_suppkey")).alias("rebuilt"),
                             N.null_if_redundant(F.col("l_quantity"), F.col("l_linenumber") * 5, 1.2).alias("peak"))


# ---------------------------------------------------------------- names
@query("P17_P19_keys", """SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) || 'CANON' AS squashed, p_name || ' canon' AS words, 'MEXICO ' || upper(p_name) AS folded, p_name || ' end' AS bare FROM part""")
def name_keys(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", X.squash(F.concat(n, F.lit(" - Cañón!"))).alias("squashed"), X.words_key(F.concat(n, F.lit(" (Cañon)"))).alias("words"),
                         X.fold(F.concat(F.lit("  México   "), n)).alias("folded"), X.unbracket(F.concat(n, F.lit(" (cuota) end (x)"))).alias("bare"))


@query("P18_expanded", """SELECT p_partkey, 'ciudad ' || p_name || ' road' AS plain FROM part""")
def expanded(t):
    rules = X.expand(F.concat(F.lit("cd. "), F.col("p_name"), F.lit(" rd")), M.ABBREVIATIONS)
    return t.part.select("p_partkey", X.expand_words(rules, {"rd": "road", "hwy": "highway"}).alias("plain"))


@query("P35_double_encoded", """SELECT doc_id, CAST(length(text) - length(replace(text, 'â€', 'â')) AS INT) + CAST(len(regexp_extract_all(text, 'Ã[\\x{80}-\\x{BF}]|Â[\\x{80}-\\x{BF}]')) AS INT) AS marks FROM documents""")
def double_encoded(t):
    return t.documents.select("doc_id", X.double_encoded(F.col("text")).alias("marks"))


@query("P37_mentioned_numbers", """SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '(\\d{2,4})', 1))) AS INT) AS numbers, coalesce(regexp_matches(text, '(?i)constru|build'), false) AS builds, CAST(len(list_filter(list_transform(string_split_regex(source || ', ' || lang || '/', '[,;/]'), lambda x: trim(x)), lambda x: x <> '')) AS INT) AS cells FROM documents""")
def mentioned_numbers(t):
    return t.documents.select("doc_id", F.size(X.mentioned_numbers(F.col("text"), r"(\d{2,4})")).alias("numbers"), F.col("text").rlike("(?i)constru|build").alias("builds"),
                              F.size(X.cell_list(F.concat(F.col("source"), F.lit(", "), F.col("lang"), F.lit("/")))).alias("cells"))


@query("P43_other_names", """SELECT p_partkey, CASE WHEN p_brand = 'Brand#5' THEN 'Brand#5 ' || p_type ELSE p_brand || ' Brand#5 ' || p_type END AS aka FROM part""")
def other_names(t):
    return t.part.select("p_partkey", X.other_names(F.col("p_brand"), F.lit(None).cast("string"), F.lit("Brand#5"), F.col("p_type"), F.col("p_brand")).alias("aka"))


# ---------------------------------------------------------------- designations
_ROAD = """CASE o_orderkey % 12 WHEN 0 THEN 'I- ' || CAST(o_orderkey % 99 + 1 AS STRING) WHEN 1 THEN 'US Hwy ' || CAST(o_orderkey % 400 + 1 AS STRING) || ' Byp' WHEN 2 THEN 'State Rte ' || CAST(o_orderkey % 90 + 1 AS STRING) || '/' || CAST(o_custkey % 80 + 1 AS STRING)
 WHEN 3 THEN 'Old State Rte 5' WHEN 4 THEN 'N US Hwy ' || CAST(o_custkey % 90 + 1 AS STRING) || ' S' WHEN 5 THEN 'FM ' || CAST(o_orderkey % 3000 + 1 AS STRING) WHEN 6 THEN 'Main St' WHEN 7 THEN 'State Loop ' || CAST(o_custkey % 300 + 1 AS STRING)
 WHEN 8 THEN 'I-H1' WHEN 9 THEN 'US Hwy 6 Frontage' WHEN 10 THEN 'Rte ' || CAST(o_custkey % 200 + 1 AS STRING) ELSE 'State Hwy ' || CAST(o_custkey % 200 + 1 AS STRING) || ' Bus' END"""


@query("P20_designations", """WITH r AS (SELECT o_orderkey, o_orderkey % 12 AS k, CASE WHEN o_custkey % 3 = 0 THEN 'TX' ELSE 'OH' END AS st, o_custkey AS c FROM orders),
d AS (SELECT o_orderkey, 'us-interstate' AS system, CAST(o_orderkey % 99 + 1 AS VARCHAR) AS number, NULL AS qualifier FROM r WHERE k = 0
UNION ALL SELECT o_orderkey, 'us-numbered', CAST(o_orderkey % 400 + 1 AS VARCHAR), 'bypass' FROM r WHERE k = 1
UNION ALL SELECT o_orderkey, 'us-state', CAST(o_orderkey % 90 + 1 AS VARCHAR), NULL FROM r WHERE k = 2 UNION ALL SELECT o_orderkey, 'us-state', CAST(c % 80 + 1 AS VARCHAR), NULL FROM r WHERE k = 2
UNION ALL SELECT o_orderkey, 'us-numbered', CAST(c % 90 + 1 AS VARCHAR), NULL FROM r WHERE k = 4
UNION ALL SELECT o_orderkey, 'us-state', 'FM' || (o_orderkey % 3000 + 1), NULL FROM r WHERE k = 5 AND st = 'TX'
UNION ALL SELECT o_orderkey, 'us-state', CAST(c % 300 + 1 AS VARCHAR), 'loop' FROM r WHERE k = 7 UNION ALL SELECT o_orderkey, 'us-interstate', 'H1', NULL FROM r WHERE k = 8
UNION ALL SELECT o_orderkey, 'us-state', CAST(c % 200 + 1 AS VARCHAR), NULL FROM r WHERE k = 10 UNION ALL SELECT o_orderkey, 'us-state', CAST(c % 200 + 1 AS VARCHAR), 'business' FROM r WHERE k = 11)
SELECT o_orderkey, system, number, qualifier FROM d""")
def designations(t):
    st = F.when(F.col("o_custkey") % 3 == 0, "TX").otherwise("OH")
    rows = t.orders.select("o_orderkey", F.inline(D.designations(F.expr(_ROAD), F.lit("U"), st)))
    return rows


@query("P21_coded_routes", """WITH s AS (SELECT p_partkey, p_partkey % 90 AS a, p_size AS b FROM part)
SELECT p_partkey, 'MEX' AS prefix, lpad(CAST(a AS VARCHAR), 3, '0') || 'D' AS number, true AS toll FROM s UNION ALL SELECT p_partkey, NULL, lpad(CAST(b AS VARCHAR), 3, '0'), false FROM s UNION ALL SELECT p_partkey, 'EM', 'AB', false FROM s""")
def coded_routes(t):
    code = F.concat(F.lit("mex-"), (F.col("p_partkey") % 90).cast("string"), F.lit("D / "), F.col("p_size").cast("string"), F.lit(";EM AB, sin número x")).alias("c")
    return t.part.select("p_partkey", code).select("p_partkey", F.inline(D.coded_routes(F.col("c"))))


@query("P22_field_numbers", """WITH f AS (SELECT p_partkey, CASE WHEN p_size > 0 THEN CAST(p_size AS VARCHAR) END AS n FROM part UNION SELECT p_partkey, CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey BETWEEN 1 AND 9999 UNION SELECT p_partkey, upper(substr(p_name, 1, 3)) FROM part)
SELECT p_partkey, CAST(count(DISTINCT n) AS INT) AS numbers FROM f WHERE regexp_full_match(n, '[1-9]\\d{0,3}[A-Z]{0,2}|[A-Z]{2,4}') GROUP BY 1""")
def field_numbers(t):
    n = D.field_numbers(F.concat(F.col("p_size").cast("string"), F.lit(".0")), F.col("p_partkey").cast("string"), F.lit("None"), F.substring("p_name", 1, 3), F.concat(F.lit("0"), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", F.size(n).alias("numbers"))


_REF = "CASE p_partkey % 6 WHEN 0 THEN 'G' || CAST(p_size AS STRING) WHEN 1 THEN 'Ｇ' || CAST(p_partkey % 9000 + 1000 AS STRING) WHEN 2 THEN 's' || CAST(p_partkey % 900 + 100 AS STRING) || '(x)' WHEN 3 THEN 'G0' || CAST(p_size % 10 AS STRING) WHEN 4 THEN '旧G15' ELSE 'G' || CAST(p_size % 90 + 10 AS STRING) || 'A' END"


@query("P23_references", """WITH r AS (SELECT p_partkey, p_partkey % 6 AS k, CASE p_partkey % 6 WHEN 0 THEN 'G' || p_size WHEN 1 THEN 'G' || (p_partkey % 9000 + 1000) WHEN 2 THEN 'S' || (p_partkey % 900 + 100) WHEN 5 THEN 'G' || (p_size % 90 + 10) || 'A' END AS ref FROM part)
SELECT p_partkey, ref, CASE k WHEN 2 THEN 'cn-provincial' WHEN 0 THEN 'cn-expressway' WHEN 1 THEN 'cn-expressway' WHEN 5 THEN 'cn-expressway' END AS system,
  CASE k WHEN 2 THEN 'state' WHEN 0 THEN 'primary' WHEN 1 THEN 'auxiliary' WHEN 5 THEN 'auxiliary' END AS tier FROM r""")
def references(t):
    r = t.part.select("p_partkey", D.parse_ref(F.expr(_REF)).alias("ref"))
    return r.select("p_partkey", "ref", D.classify_ref(F.col("ref")).alias("c")).select("p_partkey", "ref", "c.system", "c.tier")


@query("P24_stem_numbers", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tw-freeway' WHEN 3 THEN NULL ELSE 'tw-provincial' END AS system, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN p_size || 'A' WHEN 2 THEN p_size || 'C' END AS number FROM part""")
def stem_numbers(t):
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN '國' || CAST(p_size AS STRING) WHEN 1 THEN ' 台' || CAST(p_size AS STRING) || '甲' WHEN 2 THEN '臺' || CAST(p_size AS STRING) || '丙' ELSE '台' || CAST(p_size AS STRING) || '臨2' END")
    return t.part.select("p_partkey", D.stem_number(raw).alias("s")).select("p_partkey", "s.system", "s.number")


@query("P25_dialect_keys", """SELECT p_partkey, 'MEX-' || lpad(CAST(p_size AS VARCHAR), 3, '0') || 'D' AS key FROM part UNION ALL SELECT p_partkey, 'JAL-' || lpad(CAST(p_partkey % 700 AS VARCHAR), 3, '0') FROM part
UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'P' END || p_size FROM part UNION ALL SELECT p_partkey, 'P' || p_size || 'A' FROM part UNION ALL SELECT p_partkey, 'G' || p_size FROM part""")
def dialect_keys(t):
    n = F.col("p_size").cast("string")
    mx = D.dialect_keys("mx", F.concat(F.lit("Fed. "), n, F.lit("D; jal "), (F.col("p_partkey") % 700).cast("string"), F.lit(";x")), F.lit(None).cast("string"))
    tw = D.dialect_keys("tw", F.concat(n, F.lit("號;台"), n, F.lit(" 甲 線")), F.when(F.col("p_size") % 2 == 0, "motorway"))
    cn = D.dialect_keys("cn", F.concat(F.lit("G"), n, F.lit("；旧G"), n), F.lit(None).cast("string"))
    return t.part.select("p_partkey", F.explode(F.concat(mx, tw, cn)).alias("key"))


@query("P26_route_ids", """SELECT l_partkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'us-state' WHEN 1 THEN 'us-interstate' ELSE 'us-numbered' END AS system, CASE l_linenumber % 3 WHEN 0 THEN 'FM' ELSE '' END || (l_partkey % 900 + 1) AS number, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def route_ids(t):
    num = F.col("l_partkey") % 900 + 1
    rid = (F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("FM"), F.lpad(num.cast("string"), 4, "0"), F.lit("-KG")))
           .when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("i"), num.cast("string"), F.lit(" NB"))).otherwise(F.concat(F.lit("00017US"), F.lpad(num.cast("string"), 5, "0"))))
    st = F.element_at(F.array(*map(F.lit, ["TX", "MA", "MD"])), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return t.lineitem.select("l_partkey", "l_linenumber", D.from_route_id(st, rid).alias("r")).groupBy("l_partkey", "l_linenumber", F.col("r.system").alias("system"), F.col("r.number").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("P26_section_routes", """SELECT p_partkey, CASE WHEN p_partkey % 2000 BETWEEN 1 AND 999 THEN CAST(p_partkey % 2000 AS VARCHAR) END AS qc, CAST(p_size AS VARCHAR) AS nb, CASE WHEN p_size > 0 THEN CAST(p_size AS VARCHAR) END AS pe FROM part""")
def section_routes(t):
    n = F.col("p_size").cast("string")
    return t.part.select("p_partkey", D.section_route("QC", F.concat(F.lpad((F.col("p_partkey") % 2000).cast("string"), 5, "0"), F.lit("01234"))).alias("qc"),
                         D.section_route("NB", F.concat(F.lit("R"), F.lpad(n, 4, "0"), F.lit("007"))).alias("nb"), D.section_route("PE", F.concat(F.lpad(n, 3, "0"), F.lit("12"))).alias("pe"))


@query("P29_P31_classes", """SELECT p_type, p_brand, CASE p_type WHEN 'ECONOMY' THEN 'Freeway' WHEN 'SMALL' THEN 'Local' WHEN 'LARGE' THEN 'Primary' ELSE 'Other Paved' END AS type, CASE WHEN p_brand = 'Brand#3' THEN 'Unpaved' WHEN p_type = 'ECONOMY' THEN 'Freeway' ELSE 'Other Paved' END AS tagged,
  p_type <> 'PROMO' AS open, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2""")
def classes(t):
    v = D.mapped(F.col("p_type"), {"ECONOMY": "Freeway", "SMALL": "Local", "LARGE": "Primary"}, "Other Paved")
    tagged = D.tag_type(F.when(F.col("p_type") == "ECONOMY", "motorway").otherwise("x"), F.when(F.col("p_brand") == "Brand#3", "gravel"))
    is_open = D.is_open(F.when(F.col("p_type") == "PROMO", "Fuera de servicio"), F.lit(None).cast("string"))
    return t.part.groupBy("p_type", "p_brand", v.alias("type"), tagged.alias("tagged"), is_open.alias("open")).agg(F.count(F.lit(1)).alias("n"))


@query("P30_tiers_and_labels", """WITH r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'us-interstate' WHEN 1 THEN 'us-numbered' ELSE 'us-state' END AS s, p_partkey % 3 AS k, CAST(p_partkey % 500 + 1 AS VARCHAR) AS n, p_size % 4 = 0 AS biz FROM part)
SELECT p_partkey, CASE WHEN k = 2 THEN 'state' WHEN biz THEN 'special' WHEN length(n) <= 2 THEN 'primary' ELSE 'auxiliary' END AS tier,
  CASE k WHEN 0 THEN CASE WHEN biz THEN 'Business I-' ELSE 'I-' END || n WHEN 1 THEN 'US ' || n || CASE WHEN biz THEN ' Bus' ELSE '' END ELSE 'OH ' || CASE WHEN biz THEN 'BUS' ELSE '' END || n END AS label,
  s || '|' || CASE WHEN biz THEN 'BUS' ELSE '' END || n || CASE WHEN k = 2 OR biz THEN '|OH' ELSE '' END AS grp, CASE WHEN CAST(n AS INT) <= 99 OR CAST(n AS INT) >= 400 THEN 'A-' || n ELSE 'QC ' || n END AS qc FROM r""")
def tiers_and_labels(t):
    r = t.part.select("p_partkey", F.element_at(F.array(*map(F.lit, ["us-interstate", "us-numbered", "us-state"])), (F.col("p_partkey") % 3 + 1).cast("int")).alias("s"),
                      (F.col("p_partkey") % 500 + 1).cast("string").alias("n"), F.when(F.col("p_size") % 4 == 0, "business").alias("q"))
    s, n, q = F.col("s"), F.col("n"), F.col("q")
    tier = D.tier(s, n, q)
    return r.select("p_partkey", tier.alias("tier"), D.label(s, n, q, F.lit("OH")).alias("label"), D.route_group(s, tier, D.raw_number(n, q), F.lit("OH")).alias("grp"),
                    D.provincial_label(F.lit("ca-other"), F.lit("QC"), n).alias("qc"))


@query("P38_composite_keys", """SELECT p_partkey, 'MEX-' || lpad(CAST(p_size AS VARCHAR), 3, '0') || 'D,MEX-' || lpad(CAST(p_partkey % 90 AS VARCHAR), 3, '0') || ',JAL-007' AS routes, true AS toll, false AS shared FROM part""")
def composite_keys(t):
    key = F.concat(F.lit("Mex-"), F.col("p_size").cast("string"), F.lit("D-"), (F.col("p_partkey") % 90).cast("string"), F.lit("-JAL-7"))
    return t.part.select("p_partkey", D.composite_key(key).alias("k")).select("p_partkey", F.array_join("k.routes", ",").alias("routes"), "k.toll", "k.shared")


@query("P39_inherited_headings", """WITH r AS (SELECT l_orderkey, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS line, CASE WHEN l_tax = 0.0 THEN 'mixed' WHEN l_tax = 0.01 THEN 'state' END AS juris, l_tax <= 0.01 AS head FROM lineitem)
SELECT l_orderkey, line, last_value(juris IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY line ROWS UNBOUNDED PRECEDING) AS juris FROM (SELECT DISTINCT * FROM r)""")
def inherited_headings(t):
    from ..operators.ordered import carry
    title = F.when(F.col("l_tax") == 0.0, "Carreteras federales y estatales libres").when(F.col("l_tax") == 0.01, "Red Estatal de Cuota").otherwise("GTO-12")
    rows = t.lineitem.select("l_orderkey", (F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("line"), D.heading(title)["juris"].alias("h")).distinct()
    return carry(rows, ["l_orderkey"], "line", "h", "c", block=100000).select("l_orderkey", "line", F.col("c.value").alias("juris"))


@query("P41_number_classes", """WITH r AS (SELECT p_partkey % 299 + 1 AS n FROM part)
SELECT CASE WHEN n < 100 AND n % 2 = 1 THEN 'ns' WHEN n < 100 THEN 'ew' WHEN floor(n / 100) % 2 = 1 THEN 'spur' ELSE 'loop' END AS cls, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def number_classes(t):
    n = (F.col("p_partkey") % 299 + 1).cast("string")
    return t.part.groupBy(D.number_class(F.lit("us-interstate"), n).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


@query("P41_number_plans", """WITH r AS (SELECT p_partkey, p_partkey % 6 AS s, p_partkey % 211 + 1 AS n, p_partkey % 5 = 0 AS suffixed, floor(p_partkey % 900 / 100) + 1 AS d FROM part)
SELECT p_partkey, CASE s WHEN 0 THEN CASE d WHEN 1 THEN 'radial' WHEN 2 THEN 'ns' WHEN 3 THEN 'ew' WHEN 4 THEN 'other' ELSE 'link' END
  WHEN 1 THEN CASE WHEN suffixed THEN 'branch' WHEN n % 2 = 1 THEN 'ns' ELSE 'ew' END
  WHEN 2 THEN CASE WHEN suffixed THEN 'branch' WHEN n >= 62 AND n % 2 = 0 THEN 'ew' WHEN n >= 61 AND n % 2 = 1 THEN 'coast' ELSE 'trunk' END
  WHEN 3 THEN CASE WHEN suffixed THEN 'toll' WHEN n % 2 = 1 THEN 'ns' ELSE 'ew' END WHEN 4 THEN 'route' END AS cls FROM r""")
def number_plans(t):
    """Plans of five systems, and null for one that has none."""
    key = F.col("p_partkey")
    system = F.element_at(F.array(*map(F.lit, ["cn-national", "tw-freeway", "tw-provincial", "mx-federal", "hk-route", "mx-state"])), (key % 6 + 1).cast("int"))
    plain = F.concat((key % 211 + 1).cast("string"), F.when(key % 5 == 0, "D").otherwise(""))
    number = F.when(key % 6 == 0, F.concat(F.lit("G"), (100 + key % 900).cast("string"))).otherwise(plain)
    return t.part.select("p_partkey", D.number_class(system, number).alias("cls"))


# ---------------------------------------------------------------- names matched with names
@query("J19_fuzzy_places", """WITH w AS (SELECT o_orderkey AS crossing, CASE o_orderkey % 6 WHEN 0 THEN 'BOLT' WHEN 1 THEN 'GEAR' WHEN 2 THEN 'SMALL' WHEN 3 THEN 'RED' WHEN 4 THEN 'AR' ELSE 'PLATE' END AS town, 'Brand#' || (1 + o_custkey % 25) AS st FROM orders),
c AS (SELECT p_partkey AS place, p_brand AS st, upper(p_name) AS name, p_size % 5 AS rank, p_retailprice / 300 AS km FROM part)
SELECT crossing, arg_min(place, (rank, km, place)) AS place, arg_min(rank, (rank, km, place)) AS rank FROM w JOIN c ON w.st = c.st AND contains(name, town) WHERE km <= 5 GROUP BY 1""")
def fuzzy_places(t):
    w = t.orders.select(F.col("o_orderkey").alias("crossing"), F.element_at(F.array(*map(F.lit, ["BOLT", "GEAR", "SMALL", "RED", "AR", "PLATE"])), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("town"),
                        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("st"))
    c = t.part.select(F.col("p_partkey").alias("place"), F.col("p_brand").alias("st"), X.fold(F.col("p_name")).alias("name"), (F.col("p_size") % 5).alias("rank"), (F.col("p_retailprice") / 300).alias("km"))
    return M.fuzzy_places(w, c, "crossing", "st", "town", "name", "place", "rank", "km").select("crossing", "place", "rank")


@query("J20_ranked_facilities", """WITH w AS (SELECT n_nationkey AS want, CASE n_nationkey % 5 WHEN 0 THEN 'red bolt' WHEN 1 THEN 'blue' WHEN 2 THEN 'red' WHEN 3 THEN 'ea' ELSE 'gear' END AS name FROM nation), f AS (SELECT p_partkey AS facility, p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' port' END AS title, p_retailprice AS km FROM part),
h AS (SELECT want, facility, CASE WHEN title = name THEN 0 WHEN starts_with(title, name) THEN 1 ELSE 2 END AS rank, km FROM w JOIN f ON contains(title, name) WHERE km <= 1500)
SELECT want, arg_min(facility, (rank, km, facility)) AS facility, CAST(min(rank) AS INT) AS rank FROM h GROUP BY 1""")
def ranked_facilities(t):
    w = t.nation.select(F.col("n_nationkey").alias("want"), F.element_at(F.array(*map(F.lit, ["red bolt", "blue", "red", "ea", "gear"])), F.col("n_nationkey") % 5 + 1).alias("name"))
    f = t.part.select(F.col("p_partkey").alias("facility"), F.concat("p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(" port")).alias("title"), F.col("p_retailprice").alias("km"))
    return M.ranked_facility(w, f, "want", "name", "title", "facility", "km", 1500).select("want", "facility", "rank")


@query("J21_D14_proposals", """WITH w AS (SELECT p_partkey AS id, p_brand AS st, p_size AS sz, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
t AS (SELECT id AS title, st, a, b FROM w), e AS (SELECT title, r.id AS road FROM t JOIN w r ON t.st = r.st AND least(t.a, t.b) = least(r.a, r.b) AND greatest(t.a, t.b) = greatest(r.a, r.b)),
x AS (SELECT DISTINCT st, CAST(sz AS BIGINT) AS road, a AS p FROM w UNION SELECT DISTINCT st, CAST(sz AS BIGINT), b FROM w), p AS (SELECT DISTINCT title, x.road FROM t JOIN x ON t.st = x.st AND t.a = x.p JOIN x y ON y.st = t.st AND y.road = x.road AND y.p = t.b WHERE t.a <> t.b)
SELECT title, road, CASE WHEN bool_or(r) THEN 'road' ELSE 'points' END AS via FROM (SELECT title, road, true AS r FROM e UNION ALL SELECT title, road, false FROM p) GROUP BY 1, 2""")
def proposals(t):
    titles = t.part.select(F.col("p_partkey").alias("title"), F.concat(F.lit("Autopista "), F.regexp_replace("p_name", " ", "-"), F.lit(" y Lib. Norte")).alias("object"))
    states = t.part.select(F.col("p_partkey").alias("title"), F.col("p_brand").alias("st"))
    roads = t.part.select(F.col("p_brand").alias("st"), F.col("p_partkey").alias("road"), F.concat(F.split("p_name", " ")[1], F.lit(" - "), F.split("p_name", " ")[0]).alias("name"))
    points = t.part.select(F.col("p_brand").alias("st"), (F.col("p_size")).cast("bigint").alias("road"), F.split("p_name", " ")[0].alias("place")).unionByName(
        t.part.select(F.col("p_brand").alias("st"), (F.col("p_size")).cast("bigint").alias("road"), F.split("p_name", " ")[1].alias("place")))
    return M.propose(titles, states, roads, points, "title", "object", "st", "road", "name", "place")


@query("J21_place_pairs", """WITH w AS (SELECT o_orderkey AS title, 'alpha k' || (o_orderkey % 9) AS l, 'beta z' || (o_custkey % 7) || ' end' AS r, 'omega' AS q FROM orders)
SELECT title, CAST(2 * 3 + 3 * 1 + 2 * 1 AS BIGINT) AS pairs FROM w""")
def place_pairs(t):
    titles = t.orders.select(F.col("o_orderkey").alias("title"), F.concat(F.lit("Alpha K"), (F.col("o_orderkey") % 9).cast("string"), F.lit("-Beta z"), (F.col("o_custkey") % 7).cast("string"), F.lit(" end - (cuota) Omega")).alias("text"))
    return M.place_pairs(titles, "title", "text").groupBy("title").agg(F.count(F.lit(1)).alias("pairs"))


@query("J22_number_verdicts", """WITH l AS (SELECT p_brand AS st, p_size % 12 AS num, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
l2 AS (SELECT st, num, upper(CASE WHEN length(a) >= 4 THEN a END) AS a, upper(CASE WHEN length(b) >= 4 THEN b END) AS b FROM l),
o AS (SELECT DISTINCT p_brand AS st, p_size % 15 AS num, upper(replace(p_name, ' ', '')) AS seg FROM part),
h AS (SELECT l2.st, l2.num, bool_or(o.num = l2.num) AS same, bool_or(o.num <> l2.num) AS other FROM l2 JOIN o ON l2.st = o.st AND (a IS NULL OR contains(seg, a)) AND (b IS NULL OR contains(seg, b)) AND (a IS NOT NULL OR b IS NOT NULL) GROUP BY 1, 2),
k AS (SELECT DISTINCT st, num FROM l2), m AS (SELECT DISTINCT st, num FROM o)
SELECT k.st, k.num, CASE WHEN same AND m.num IS NOT NULL THEN 'agree' WHEN other THEN 'otherNumber' WHEN m.num IS NOT NULL THEN 'numberOnly' ELSE 'notFound' END AS verdict FROM k LEFT JOIN h ON k.st = h.st AND k.num = h.num LEFT JOIN m ON k.st = m.st AND k.num = m.num""")
def number_verdicts(t):
    register = t.part.select(F.col("p_brand").alias("st"), (F.col("p_size") % 12).alias("num"), F.regexp_replace("p_name", " ", " - ").alias("name"), F.col("p_partkey").alias("road"))
    ours = t.part.select(F.col("p_brand").alias("st"), (F.col("p_size") % 15).alias("num"), F.col("p_name").alias("name"))
    return M.number_verdicts(register, ours, "st", "num", "name", "road")


@query("J28_resolved_anchors", f"""WITH e AS (SELECT station AS entry, station % 211 AS number, 'Brand#' || (station % 25) AS hint, lon, lat FROM stations),
j AS (SELECT entry, id, CASE WHEN hint = st THEN 0 ELSE 1 END AS miss, round({hav('lon', 'lat', 'cx', 'cy')}, 6) AS km FROM e JOIN routes r ON e.number = r.number),
b AS (SELECT entry, min(row(miss, km, id)) AS b FROM j GROUP BY entry), q AS (SELECT entry, arg_min(id, (miss, km, id)) AS id, arg_min(miss, (miss, km, id)) AS miss, arg_min(km, (miss, km, id)) AS km FROM j GROUP BY entry),
n AS (SELECT q.entry, count(*) AS n FROM q JOIN j ON q.entry = j.entry AND q.miss = j.miss AND q.km = j.km GROUP BY 1)
SELECT e.entry, CASE WHEN n = 1 AND km <= 500 THEN id END AS route, km, CASE WHEN id IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN km > 500 THEN 'far' ELSE 'found' END AS status FROM e LEFT JOIN q ON e.entry = q.entry LEFT JOIN n ON e.entry = n.entry""")
def resolved_anchors(t):
    entries = t.stations.select(F.col("station").alias("entry"), (F.col("station") % 211).alias("number"), F.concat(F.lit("Brand#"), (F.col("station") % 25).cast("string")).alias("hint"), "lon", "lat")
    routes = t.routes.select(F.col("id").alias("route"), "number", "st", F.col("cx").alias("olon"), F.col("cy").alias("olat"))
    return M.resolve_anchors(entries, routes, "entry", ["number"], "hint", "st", "route", 500)
