"""Network-shaped inputs derived from the given tables.

Each is one SELECT in SQL that Spark and the comparison database both read, with integer
arithmetic only, so that both sides start from identical rows.  Sizes follow the given
tables.
"""

_BASE_LON = "-120 + (o_custkey * 37 % 5000) / 100.0"
_BASE_LAT = "26 + (o_custkey * 53 % 2200) / 100.0"
_SLOT = "(o_orderkey % 13)"
_BRANCH = "(CAST(floor(o_orderkey / 13) AS BIGINT) % 6 = 0)"


def _spot(i: int) -> tuple[str, str, str]:
    """Place in its fragment, longitude and latitude of vertex ``i`` of 5 of the road fragment an order stands for.

    The fragments of one customer form a road of 13 slots running east, some fragments leave
    it northwards.  Ends are displaced by a few metres, so they have to be snapped.
    """
    bend = f"((o_orderkey * 7 + {i} * 3) % 5) * 0.0003" if 0 < i < 4 else f"((o_orderkey * 31 + {i}) % 5) * 0.00003"
    here = f"({_SLOT} * {_SLOT} + o_custkey) % 4 * 0.01"
    after = f"(({_SLOT} + 1) * ({_SLOT} + 1) + o_custkey) % 4 * 0.01"
    lon = f"CASE WHEN {_BRANCH} THEN {_SLOT} * 0.05 ELSE ({_SLOT} + {i} / 4.0) * 0.05 END"
    lat = (f"CASE WHEN {_BRANCH} THEN {here} + {i} * 0.012 "
           f"ELSE {here} * {(4 - i) / 4} + {after} * {i / 4} END")
    return (f"CAST(CASE WHEN o_orderkey % 2 = 1 THEN {4 - i} ELSE {i} END AS INT)",
            f"CAST({_BASE_LON} + {lon} AS DOUBLE)", f"CAST({_BASE_LAT} + {lat} + {bend} AS DOUBLE)")


def _vertex(i: int) -> str:
    at, lon, lat = _spot(i)
    return f"SELECT o_orderkey AS seg_id, o_custkey AS group_key, {at} AS i, {lon} AS lon, {lat} AS lat FROM orders"


INPUTS = {
    # Road sections with reported measures; nulls where nothing was reported.
    "sections": """
SELECT l_partkey AS number, CAST(l_suppkey % 7 AS INT) AS st, CAST(l_quantity AS DOUBLE) AS len,
  CASE WHEN l_discount = 0.05 THEN NULL ELSE CAST(floor(l_extendedprice) AS DOUBLE) END AS aadt,
  CASE WHEN l_tax < 0.03 THEN NULL ELSE CAST(floor(l_extendedprice / 10) AS DOUBLE) END AS truck,
  CASE WHEN l_linenumber > 3 THEN NULL ELSE CAST(l_suppkey % 200 AS DOUBLE) END AS iri,
  CAST(l_linenumber AS INT) AS f_class, l_returnflag AS toll, CAST(l_linestatus = 'O' AS INT) AS nhs,
  CAST(l_partkey % 3 AS BIGINT) AS signals, CAST(year(l_shipdate) AS INT) AS improved
FROM lineitem""",
    # Miles of each route in each jurisdiction, and of the whole route.
    "route_pieces": """
SELECT p.number, p.st, p.mi, r.route_mi FROM
 (SELECT l_partkey AS number, CAST(l_suppkey % 7 AS INT) AS st, CAST(sum(l_quantity) AS DOUBLE) AS mi FROM lineitem GROUP BY l_partkey, CAST(l_suppkey % 7 AS INT)) p
 JOIN (SELECT l_partkey AS number, CAST(sum(l_quantity) * 1.25 AS DOUBLE) AS route_mi FROM lineitem GROUP BY l_partkey) r ON p.number = r.number
""",
    # What each province counted on a route.
    "province_figures": """
SELECT l_partkey AS number, CAST(l_suppkey % 7 AS INT) AS st,
  CASE WHEN min(l_tax) > 0.01 THEN NULL ELSE CAST(sum(l_quantity) * 1.2 AS DOUBLE) END AS km,
  CASE WHEN l_partkey % 2 = 0 THEN 'stations' ELSE 'sections' END AS method,
  CAST(count(*) AS BIGINT) AS n, CAST(max(floor(l_extendedprice)) AS DOUBLE) AS peak,
  CAST(min(year(l_shipdate)) AS INT) AS year_from, CAST(max(year(l_shipdate)) AS INT) AS year_to,
  CAST(floor(avg(l_quantity)) * 100 AS DOUBLE) AS aadt_v, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 100 AS DOUBLE) END AS aadt_cover
FROM lineitem GROUP BY l_partkey, CAST(l_suppkey % 7 AS INT)""",
    # Counts in one direction at a place.
    "direction_counts": """
SELECT l_orderkey AS place, CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'N' WHEN l_returnflag = 'A' THEN 's'
   WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'E ' WHEN l_returnflag = 'N' THEN 'W' WHEN l_linestatus = 'O' THEN '' ELSE NULL END AS direction,
  l_shipdate AS counted, CAST(l_quantity AS DOUBLE) AS volume, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS row_id
FROM lineitem""",
    # Freeway sections published once per direction.
    "freeway_sections": """
SELECT l_suppkey AS number, l_returnflag = 'R' AS elevated, l_linestatus AS dir,
  CASE WHEN l_linenumber % 2 = 0 THEN 'A' || CAST(l_partkey % 400 AS STRING) ELSE 'B' || CAST(l_partkey % 37 AS STRING) END AS a,
  CASE WHEN l_linenumber % 2 = 0 THEN 'B' || CAST(l_partkey % 37 AS STRING) ELSE 'A' || CAST(l_partkey % 400 AS STRING) END AS b,
  CAST(l_quantity AS DOUBLE) AS weekday, CAST(floor(l_extendedprice) AS DOUBLE) AS sat
FROM lineitem""",
    # Count stations with coordinates.
    "stations": """
SELECT o_orderkey AS station, o_custkey AS route, CAST(floor(o_totalprice / 100) AS DOUBLE) AS tdpa,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) + 0.5 END AS trucks,
  CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 12 AS DOUBLE) END AS km,
  CAST(o_orderkey % 40 AS DOUBLE) AS moto, CAST(year(o_orderdate) AS INT) AS year,
  'place ' || CAST(o_orderkey AS STRING) AS place, CAST(80 + o_custkey % 50 AS DOUBLE) AS route_km,
  CAST(-120 + (o_custkey * 37 % 5000) / 100.0 + (o_orderkey % 17) * 0.041 AS DOUBLE) AS lon,
  CAST(26 + (o_custkey * 53 % 2200) / 100.0 + (o_orderkey % 11) * 0.007 AS DOUBLE) AS lat
FROM orders""",
    # Pavement pieces with attributes.
    "edges": """
SELECT l_partkey AS route, CAST(l_quantity AS DOUBLE) / 8 AS km, l_returnflag || l_linestatus AS type,
  CASE WHEN l_tax < 0.02 THEN NULL ELSE l_tax > 0.05 END AS divided, CAST(l_suppkey % 9 AS INT) AS st
FROM lineitem""",
    # The route index.
    "routes": """
SELECT p_partkey AS id, 'R-' || CAST(p_partkey AS STRING) AS label, p_type AS sys, substr(p_type, 1, 2) AS cc,
  CAST(p_partkey % 211 AS BIGINT) AS number, p_brand AS st, CAST(floor((p_partkey * 7919) % 1500) / 2.0 AS DOUBLE) AS mi,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(((p_partkey * 7919) % 1500) / 2.0 * (80 + (p_partkey * 7) % 41) / 100.0 + 1 AS DOUBLE) END AS off_mi,
  CAST(CASE WHEN p_size % 4 = 0 THEN p_size / 4 ELSE 0 END AS INT) AS breaks,
  CASE WHEN p_size % 4 = 0 THEN CAST((p_partkey * 31) % 700 / 10.0 AS DOUBLE) ELSE NULL END AS gap_mi,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_size % 101 AS DOUBLE) / 100 END AS lanes_share,
  CASE WHEN p_type = 'SMALL' THEN NULL ELSE CAST(p_partkey % 11 AS DOUBLE) / 10 END AS toll_share,
  p_name AS name, CAST(-120 + (p_partkey * 37 % 5000) / 100.0 AS DOUBLE) AS cx, CAST(26 + (p_partkey * 53 % 2200) / 100.0 AS DOUBLE) AS cy,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(1950 + p_size + p_partkey % 20 AS INT) END AS opened
FROM part""",
    # Observed ways credited to a route.
    "observed": """
SELECT l_partkey AS route, CAST(30 + l_linenumber * 15 + l_suppkey % 3 AS INT) AS kph, CAST(l_quantity AS DOUBLE) / 16 AS km,
  CAST(l_partkey % 90 + 5 AS DOUBLE) AS route_km, CASE WHEN l_returnflag = 'R' THEN 'b' WHEN l_tax = 0.0 THEN 't' ELSE NULL END AS structure,
  CASE WHEN l_discount > 0.07 THEN NULL ELSE CAST(1 + l_suppkey % 4 AS INT) END AS lanes, CAST(l_linestatus = 'O' AS INT) AS oneway,
  CASE WHEN l_returnflag = 'A' THEN 'p' WHEN l_returnflag = 'R' THEN 'o' ELSE 'l' END AS src
FROM lineitem""",
    # A value per key and year.
    "yearly": """
SELECT o_custkey AS key, CAST(year(o_orderdate) AS INT) AS year, CAST(floor(o_totalprice) AS DOUBLE) AS value,
  CAST(1 + o_orderkey % 5 AS DOUBLE) AS weight FROM orders""",
    # Height samples: one per array position of a vector, missing where low.
    "heights": """
SELECT l_partkey AS route, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS pos, CAST(max(floor(l_extendedprice / 10)) AS DOUBLE) AS h,
  max(l_tax) AS tax FROM lineitem GROUP BY l_partkey, CAST(l_orderkey * 8 + l_linenumber AS BIGINT)""",
    # Road fragments as vertices.
    "vertices": "\nUNION ALL\n".join(_vertex(i) for i in range(5)),
    # Straight roads of several systems, one for each customer: 40 slots running east through jurisdictions, most of them empty.
    "highways": """
SELECT seg_id, key, slot, system, st, CASE WHEN system = 'us-state' THEN 'us-state|' || CAST(key AS STRING) || '|' || st ELSE system || '|' || CAST(key AS STRING) END AS group_key,
  CAST(-120 + (key * 37 % 5000) / 100.0 + slot * 0.1 + (slot * slot * 37 % 101) * 0.0005 AS DOUBLE) AS ax, CAST(26 + (key * 53 % 2200) / 100.0 + (slot * slot * slot % 11) * 0.001 AS DOUBLE) AS ay,
  CAST(-120 + (key * 37 % 5000) / 100.0 + (slot + 1) * 0.1 + ((slot + 1) * (slot + 1) * 37 % 101) * 0.0005 AS DOUBLE) AS bx,
  CAST(26 + (key * 53 % 2200) / 100.0 + ((slot + 1) * (slot + 1) * (slot + 1) % 11) * 0.001 AS DOUBLE) AS by
FROM (SELECT min(o_orderkey) AS seg_id, o_custkey AS key, o_orderkey % 40 AS slot, 'J' || CAST((o_custkey * 3 + CAST(floor((o_orderkey % 40) / 5) AS BIGINT)) % 25 AS STRING) AS st,
  CASE o_custkey % 5 WHEN 0 THEN 'us-numbered' WHEN 1 THEN 'us-state' WHEN 2 THEN 'ca-other' WHEN 3 THEN 'cn-national' ELSE 'hk-route' END AS system
  FROM orders GROUP BY o_custkey, o_orderkey % 40) q""",
    # Places with a prominence.
    "places": """
SELECT c_custkey AS place_id, 'Town ' || CAST(c_custkey AS STRING) AS name, c_nationkey AS st, CAST(c_custkey % 97 AS DOUBLE) AS area,
  CASE WHEN c_custkey % 6 = 0 THEN 'city' ELSE 'town' END AS kind,
  CAST(-120 + (c_custkey * 41 % 5000) / 100.0 AS DOUBLE) AS lon, CAST(26 + (c_custkey * 59 % 2200) / 100.0 AS DOUBLE) AS lat
FROM customer""",
    # Points to be located.
    "points": """
SELECT o_orderkey AS pt, o_custkey AS route, CAST(-120 + (o_orderkey * 43 % 50000) / 1000.0 AS DOUBLE) AS lon,
  CAST(26 + (o_orderkey * 61 % 22000) / 1000.0 AS DOUBLE) AS lat FROM orders""",
    # Boxes with a square hole, one per nation, as ring edges.
    "rings": """
SELECT n_nationkey AS code, CAST(0 AS INT) AS ring, CAST(0 AS INT) AS seq, CAST(-120 + (n_nationkey % 5) * 10 AS DOUBLE) AS lon, CAST(26 + floor(n_nationkey / 5) * 4 AS DOUBLE) AS lat FROM nation
UNION ALL SELECT n_nationkey, 0, 1, CAST(-120 + (n_nationkey % 5) * 10 + 9 AS DOUBLE), CAST(26 + floor(n_nationkey / 5) * 4 + 0.5 AS DOUBLE) FROM nation
UNION ALL SELECT n_nationkey, 0, 2, CAST(-120 + (n_nationkey % 5) * 10 + 8.5 AS DOUBLE), CAST(26 + floor(n_nationkey / 5) * 4 + 3.7 AS DOUBLE) FROM nation
UNION ALL SELECT n_nationkey, 0, 3, CAST(-120 + (n_nationkey % 5) * 10 + 0.5 AS DOUBLE), CAST(26 + floor(n_nationkey / 5) * 4 + 3.4 AS DOUBLE) FROM nation
UNION ALL SELECT n_nationkey, 1, 0, CAST(-120 + (n_nationkey % 5) * 10 + 3 AS DOUBLE), CAST(26 + floor(n_nationkey / 5) * 4 + 1.1 AS DOUBLE) FROM nation
UNION ALL SELECT n_nationkey, 1, 1, CAST(-120 + (n_nationkey % 5) * 10 + 5 AS DOUBLE), CAST(26 + floor(n_nationkey / 5) * 4 + 1.2 AS DOUBLE) FROM nation
UNION ALL SELECT n_nationkey, 1, 2, CAST(-120 + (n_nationkey % 5) * 10 + 4.5 AS DOUBLE), CAST(26 + floor(n_nationkey / 5) * 4 + 2.3 AS DOUBLE) FROM nation""",
}

# The same rows from one reading of the table, where the form of the text is Spark's own.  A small table
# of one file is dealt over TASKS, as many as the session runs at a time.  The comparison database divides in doubles and
# keeps products with decimals exact; Spark's decimals would differ from it in the last bit, so the same is said in doubles here.
_BASES = "-120D + CAST({c} * 37 % 5000 AS DOUBLE) / 100D", "26D + CAST({c} * 53 % 2200 AS DOUBLE) / 100D"
SPARK_INPUTS = {
    "vertices": f"""SELECT seg_id, group_key, CAST(CASE WHEN seg_id % 2 = 1 THEN 4 - k ELSE k END AS INT) AS i,
  {_BASES[0].format(c='group_key')} + CASE WHEN branch THEN CAST(slot * 5 AS DOUBLE) / 100D ELSE (CAST(slot AS DOUBLE) + CAST(k AS DOUBLE) / 4D) * 0.05D END AS lon,
  {_BASES[1].format(c='group_key')} + CAST(CASE WHEN branch THEN here * 40 + k * 48 ELSE here * 10 * (4 - k) + after * 10 * k END AS DOUBLE) / 4000D
    + CASE WHEN k BETWEEN 1 AND 3 THEN CAST((seg_id * 7 + k * 3) % 5 * 3 AS DOUBLE) / 10000D ELSE CAST((seg_id * 31 + k) % 5 * 3 AS DOUBLE) / 100000D END AS lat
FROM (SELECT o_orderkey AS seg_id, o_custkey AS group_key, o_orderkey % 13 AS slot, CAST(floor(o_orderkey / 13) AS BIGINT) % 6 = 0 AS branch,
  ((o_orderkey % 13) * (o_orderkey % 13) + o_custkey) % 4 AS here, ((o_orderkey % 13 + 1) * (o_orderkey % 13 + 1) + o_custkey) % 4 AS after, explode(sequence(0, 4)) AS k
  FROM (SELECT /*+ REPARTITION(TASKS) */ o_orderkey, o_custkey FROM orders))""",
}
SPARK_INPUTS["stations"] = (INPUTS["stations"]
    .replace("CAST(-120 + (o_custkey * 37 % 5000) / 100.0 + (o_orderkey % 17) * 0.041 AS DOUBLE)", f"{_BASES[0].format(c='o_custkey')} + CAST((o_orderkey % 17) * 41 AS DOUBLE) / 1000D")
    .replace("CAST(26 + (o_custkey * 53 % 2200) / 100.0 + (o_orderkey % 11) * 0.007 AS DOUBLE)", f"{_BASES[1].format(c='o_custkey')} + CAST((o_orderkey % 11) * 7 AS DOUBLE) / 1000D"))
