"""Queries over the aggregation operators (A-*)."""

from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..operators import measures as M
from ..operators import ordered as O
from ..operators import statistics as S
from .registry import query

R = "floor({} + 0.5)"


def step(x: str, s: str) -> str:
    return f"round(floor(({x}) / {s} + 0.5) * {s}, 6)"


def pct(a: str, b: str, dp: int = 0) -> str:
    k = 100.0 * 10 ** dp
    return f"CASE WHEN {b} > 0 THEN floor(CAST({a} AS DOUBLE) / {b} * {k} + 0.5) / {10.0 ** dp} END"


def cov(a: str, b: str) -> str:
    return f"least(100.0::DOUBLE, floor({a} / greatest({b}, 1e-9) * 100 + 0.5))"


MEASURES = ["aadt", "truck", "iri"]
STEP = {"aadt": "100.0", "truck": "10.0", "iri": "1.0"}


def _weighted_sql(keys: str) -> str:
    parts = []
    for m in MEASURES:
        w, l = f"sum({m} * len)", f"sum(CASE WHEN {m} IS NOT NULL THEN len END)"
        parts.append(f"CASE WHEN {w} <> 0 AND {l} > 0 THEN {step(f'{w} / {l}', STEP[m])} END AS {m}_v")
        parts.append(f"CASE WHEN {w} <> 0 AND {l} > 0 THEN {cov(l, 'sum(len)')} END AS {m}_cover")
    return f"""SELECT {keys}, floor(sum(len) * 10 + 0.5) / 10.0 AS mi, CAST(count(*) AS BIGINT) AS sections, {', '.join(parts)},
  {pct("sum(CASE WHEN f_class <= 2 THEN len ELSE 0 END)", "sum(len)", 1)} AS freeway,
  {pct("sum(CASE WHEN toll = 'R' THEN len ELSE 0 END)", "sum(len)", 1)} AS tolled,
  {pct("sum(CASE WHEN nhs > 0 THEN len ELSE 0 END)", "sum(len)", 1)} AS nhs,
  max(aadt) AS aadt_max, max(improved) AS improved_max, CAST(nullif(sum(signals), 0) AS BIGINT) AS signals_sum
FROM sections GROUP BY {keys}"""


def _section_figures(t, keys):
    return M.weighted_measures(t.sections, keys, "len", MEASURES, shares={
        "freeway": F.col("f_class") <= 2, "tolled": F.col("toll") == "R", "nhs": F.col("nhs") > 0},
        maxima=["aadt", "improved"], sums=["signals"])


@query("A1_A2_section_measures", _weighted_sql("number, st"))
def section_measures(t):
    return _section_figures(t, ["number", "st"])


_combined = []
for _m in MEASURES:
    _n, _d = f"sum({_m}_v * mi_p * {_m}_cover / 100)", f"sum(CASE WHEN {_m}_v IS NOT NULL THEN mi_p * {_m}_cover / 100 END)"
    _combined.append(f"CASE WHEN {_d} > 0 THEN {step(f'{_n} / {_d}', STEP[_m])} END AS {_m}_v, CASE WHEN {_d} > 0 THEN {cov(_d, 'max(route_mi)')} END AS {_m}_cover")


@query("A3_J9_route_figures", f"""WITH figures AS ({_weighted_sql('number, st')}),
joined AS (SELECT p.number, p.mi AS mi_p, p.route_mi, f.* EXCLUDE (number, st, mi) FROM route_pieces p JOIN figures f ON p.number = f.number AND p.st = f.st)
SELECT number, floor(sum(mi_p) / greatest(max(route_mi), 1e-9) * 100 + 0.5) AS cover, {', '.join(_combined)},
  floor(sum(freeway * mi_p) / sum(CASE WHEN freeway IS NOT NULL THEN mi_p END) * 10 + 0.5) / 10.0 AS freeway,
  floor(sum(tolled * mi_p) / sum(CASE WHEN tolled IS NOT NULL THEN mi_p END) * 10 + 0.5) / 10.0 AS tolled
FROM joined GROUP BY number""")
def route_figures(t):
    figures = _section_figures(t, ["number", "st"]).drop("mi")
    return M.combine_measures(t.route_pieces, figures, ["number", "st"], "number", "mi", "route_mi", MEASURES, ["freeway", "tolled"])


@query("A4_counted_figures", f"""WITH j AS (SELECT p.number, p.mi, p.route_mi, f.* EXCLUDE (number, st),
   CASE WHEN f.km IS NULL THEN p.mi ELSE least(p.mi, f.km / 1.609344) END AS c
   FROM route_pieces p JOIN province_figures f ON p.number = f.number AND p.st = f.st),
 k AS (SELECT *, c * coalesce(aadt_cover, 100.0) / 100 AS w FROM j)
SELECT number, {cov('sum(c)', 'max(route_mi)')} AS cover, string_agg(DISTINCT method, '+' ORDER BY method) AS method,
  CAST(sum(CASE WHEN method = 'stations' THEN n END) AS BIGINT) AS stations, min(year_from) AS year, max(year_to) AS year_to,
  nullif(max(peak), 0) AS peak,
  CASE WHEN sum(CASE WHEN w > 0 THEN w END) > 0 THEN {step('sum(CASE WHEN w > 0 THEN aadt_v * w END) / sum(CASE WHEN w > 0 THEN w END)', '100.0')} END AS aadt_v,
  CASE WHEN sum(CASE WHEN w > 0 THEN w END) > 0 THEN {cov('sum(CASE WHEN w > 0 THEN w END)', 'max(route_mi)')} END AS aadt_cover
FROM k GROUP BY number""")
def counted_figures(t):
    return M.combine_counted(t.route_pieces, t.province_figures, ["number", "st"], "number", "mi", "route_mi", ["aadt"], {"aadt": 100})


@query("A5_accumulated_counts", f"""SELECT route, CAST(count(*) AS BIGINT) AS n,
  CASE WHEN sum(coalesce(km, 0)) > 0 THEN floor(sum(coalesce(km, 0)) * 10 + 0.5) / 10.0 END AS km,
  CASE WHEN max(tdpa) > 0 THEN {step('max(tdpa)', '100.0')} END AS peak, max(year) AS year,
  CASE WHEN min(year) < max(year) THEN min(year) END AS year_from,
  {step('sum(tdpa * coalesce(km, 1)) / nullif(sum(coalesce(km, 1)), 0)', '100.0')} AS tdpa_v,
  CASE WHEN sum(coalesce(km, 0)) > 0 THEN {cov('sum(coalesce(km, 1))', 'sum(coalesce(km, 0))')} END AS tdpa_cover,
  {step('sum(trucks * coalesce(km, 1)) / nullif(sum(CASE WHEN trucks IS NOT NULL THEN coalesce(km, 1) END), 0)', '0.1')} AS trucks_v,
  CASE WHEN sum(coalesce(km, 0)) > 0 AND sum(CASE WHEN trucks IS NOT NULL THEN coalesce(km, 1) END) > 0
    THEN {cov('sum(CASE WHEN trucks IS NOT NULL THEN coalesce(km, 1) END)', 'sum(coalesce(km, 0))')} END AS trucks_cover
FROM stations GROUP BY route""")
def accumulated_counts(t):
    return M.accumulate(t.stations, ["route"], "km", ["tdpa", "trucks"], "year", steps={"tdpa": 100, "trucks": 0.1}, peak="tdpa")


@query("A6_series_median", f"""WITH y AS (SELECT key, year, CAST(count(*) AS BIGINT) AS n, median(value) AS v FROM yearly GROUP BY key, year),
k AS (SELECT key FROM y GROUP BY key HAVING count(*) > 1)
SELECT key, year, n, {step('v', '100.0')} AS value FROM y WHERE key IN (SELECT key FROM k)""")
def series_median(t):
    return M.yearly_series(t.yearly, ["key"], "year", "value")


@query("A6_series_weighted", f"""WITH y AS (SELECT key, year, CAST(count(*) AS BIGINT) AS n, sum(value * weight) / sum(weight) AS v FROM yearly GROUP BY key, year),
k AS (SELECT key FROM y GROUP BY key HAVING count(*) > 1)
SELECT key, year, n, {step('v', '100.0')} AS value FROM y WHERE key IN (SELECT key FROM k)""")
def series_weighted(t):
    return M.yearly_series(t.yearly, ["key"], "year", "value", weight="weight")


@query("A7_station_summary", f"""SELECT route, CAST(count(CASE WHEN tdpa > 0 THEN 1 END) AS BIGINT) AS stations,
  {step('floor(median(tdpa) FILTER (tdpa > 0) + 0.5)', '10.0')} AS median, {step('min(tdpa) FILTER (tdpa > 0)', '10.0')} AS lowest,
  {step('max(tdpa)', '10.0')} AS highest, floor(median(trucks) FILTER (trucks >= 0) * 10 + 0.5) / 10.0 AS truck_share,
  CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR) ELSE CAST(min(year) AS VARCHAR) || '–' || CAST(max(year) AS VARCHAR) END AS years
FROM stations GROUP BY route HAVING count(CASE WHEN tdpa > 0 THEN 1 END) > 0""")
def station_summary(t):
    return M.station_summary(t.stations, "route", "tdpa", "trucks", "year")


_k = "sum(coalesce(km, 0))"


def _avg(c: str) -> str:
    return f"CASE WHEN {_k} > 0 THEN sum({c} * coalesce(km, 0)) / {_k} ELSE floor(median({c}) + 0.5) END"


@query("A8_station_average", f"""WITH s AS (SELECT * FROM stations WHERE tdpa > 0),
a AS (SELECT route, CAST(count(*) AS BIGINT) AS stations, {_avg('tdpa')} AS av, {_avg('moto')} AS mo, {_avg('trucks')} AS tr, max(tdpa) AS hi,
  {_k} AS k, max(route_km) AS rk, arg_max(place, (tdpa, place)) AS busiest FROM s GROUP BY route)
SELECT route, stations, {step('av', '100.0')} AS average, {step('hi', '100.0')} AS highest, busiest,
  {cov('k', 'rk')} AS cover, {pct('mo', 'av', 1)} AS moto_share, {pct('tr', 'av', 1)} AS heavy_share FROM a""")
def station_average(t):
    return M.station_average(t.stations, "route", "tdpa", "km", {"moto": "moto", "heavy": "trucks"}, "place", "route_km")


@query("A9_paired_directions", """WITH g AS (SELECT number, elevated, least(a, b) || '|' || greatest(a, b) AS section, CAST(count(*) AS BIGINT) AS rows,
  count(DISTINCT dir) AS dirs, sum(weekday) AS w, sum(sat) AS s FROM freeway_sections GROUP BY 1, 2, 3)
SELECT number, elevated, section, rows, rows = 2 AND dirs = 2 AS paired, CASE WHEN rows = 2 AND dirs = 2 THEN w END AS weekday,
  CASE WHEN rows = 2 AND dirs = 2 THEN s END AS sat FROM g""")
def paired_directions(t):
    return M.pair_directions(t.freeway_sections, ["number", "elevated"], M.unordered(F.col("a"), F.col("b")), "dir", ["weekday", "sat"])


@query("A10_W7_two_way_volume", """WITH l AS (SELECT place, upper(trim(coalesce(direction, ''))) AS d, arg_max(volume, (counted, row_id)) AS v FROM direction_counts GROUP BY 1, 2),
w AS (SELECT place, max(CASE WHEN d = '' THEN 1 END) AS b, max(CASE WHEN d = '' THEN v END) AS z, max(CASE WHEN d = 'N' THEN v END) AS n,
  max(CASE WHEN d = 'S' THEN v END) AS s, max(CASE WHEN d = 'E' THEN v END) AS e, max(CASE WHEN d = 'W' THEN v END) AS w FROM l GROUP BY place)
SELECT place, CASE WHEN b IS NOT NULL THEN z ELSE coalesce(n + s, e + w) END AS volume FROM w
WHERE CASE WHEN b IS NOT NULL THEN z ELSE coalesce(n + s, e + w) END > 0""")
def two_way_volume(t):
    return M.two_way(t.direction_counts, ["place"], "direction", "counted", "volume", "row_id")


@query("A11_composition", f"""WITH b AS (SELECT route, type, sum(km) AS k FROM edges GROUP BY route, type)
SELECT route, type, round(k, 3) AS km, {pct('k', 'sum(k) OVER (PARTITION BY route)', 1)} AS share FROM b""")
def composition(t):
    return M.composition(t.edges, "route", "km", "type")


@query("A11_divided_share", f"""WITH s AS (SELECT route, sum(km) AS a, sum(CASE WHEN divided IS NOT NULL THEN km END) AS k, sum(CASE WHEN divided THEN km END) AS d FROM edges GROUP BY route)
SELECT route, {pct('coalesce(d, 0)', 'k', 1)} AS divided_share, {pct('coalesce(k, 0)', 'a')} AS divided_cover FROM s""")
def divided_share(t):
    return M.divided_share(t.edges, "route", "km", "divided")


@query("A12_attribute_means", f"""SELECT route, floor(sum(km) * 10 + 0.5) / 10.0 AS km, CAST(count(*) AS BIGINT) AS sections,
  {step('sum(lanes * km) / sum(CASE WHEN lanes IS NOT NULL THEN km END)', '0.1')} AS lanes_v,
  CASE WHEN count(lanes) > 0 THEN {cov('sum(CASE WHEN lanes IS NOT NULL THEN km END)', 'sum(km)')} END AS lanes_cover,
  {step('sum(kph * km) / sum(km)', '1.0')} AS kph_v, {cov('sum(km)', 'sum(km)')} AS kph_cover FROM observed GROUP BY route""")
def attribute_means(t):
    return M.weighted_measures(t.observed, ["route"], "km", ["lanes", "kph"], length_name="km")


_TYPES = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "LARGE", "STANDARD"]


@query("A13_totals_by_system", f"""SELECT st, CAST(count(*) AS BIGINT) AS routes, CAST(sum(floor(mi + 0.5)) AS BIGINT) AS mi,
{', '.join(f"CAST(sum(CASE WHEN sys = '{s}' THEN floor(mi + 0.5) ELSE 0 END) AS BIGINT) AS mi_{i}" for i, s in enumerate(_TYPES))} FROM routes GROUP BY st""")
def totals_by_system(t):
    return M.totals_by_system(t.routes, "st", "sys", _TYPES, "mi")


_ERR = "(mi - off_mi) / off_mi * 100"


@query("A14_accuracy", f"""WITH e AS (SELECT sys, {_ERR} AS err FROM routes WHERE off_mi > 5),
r AS (SELECT sys, err, row_number() OVER (PARTITION BY sys ORDER BY err) AS p, count(*) OVER (PARTITION BY sys) AS n FROM e)
SELECT sys, CAST(max(n) AS BIGINT) AS routes, round(max(CASE WHEN p = floor((n - 1) * 0.5) + 1 THEN err END), 1) AS median,
  round(max(CASE WHEN p = floor((n - 1) * 0.1) + 1 THEN err END), 1) AS p10, round(max(CASE WHEN p = floor((n - 1) * 0.9) + 1 THEN err END), 1) AS p90,
  floor(avg(CASE WHEN abs(err) <= 5 THEN 100.0 ELSE 0 END) + 0.5) AS within5, floor(avg(CASE WHEN abs(err) <= 10 THEN 100.0 ELSE 0 END) + 0.5) AS within10,
  floor(avg(CASE WHEN abs(err) <= 25 THEN 100.0 ELSE 0 END) + 0.5) AS within25 FROM r GROUP BY sys""")
def accuracy(t):
    return S.accuracy(t.routes, "sys", "mi", "off_mi")


@query("A15_length_error_histogram", f"""SELECT sys, CASE WHEN d < -25 THEN -100 WHEN d < -10 THEN -25 WHEN d < -5 THEN -10 WHEN d < -2 THEN -5 WHEN d < 2 THEN -2
  WHEN d < 5 THEN 2 WHEN d < 10 THEN 5 WHEN d < 25 THEN 10 ELSE 25 END AS lo, CAST(count(*) AS BIGINT) AS n
FROM (SELECT sys, {_ERR} AS d FROM routes WHERE off_mi IS NOT NULL) GROUP BY 1, 2""")
def length_error_histogram(t):
    return S.histogram(t.routes.filter("off_mi IS NOT NULL"), ["sys"], (F.col("mi") - F.col("off_mi")) / F.col("off_mi") * 100,
                       [-100, -25, -10, -5, -2, 2, 5, 10, 25], "lo")


@query("A15_route_length_histogram", """SELECT cc, CASE WHEN mi < 10 THEN 0 WHEN mi < 25 THEN 10 WHEN mi < 50 THEN 25 WHEN mi < 100 THEN 50 WHEN mi < 250 THEN 100
  WHEN mi < 500 THEN 250 WHEN mi < 1000 THEN 500 ELSE 1000 END AS lo, CAST(count(*) AS BIGINT) AS n FROM routes GROUP BY 1, 2""")
def route_length_histogram(t):
    return S.histogram(t.routes, ["cc"], F.col("mi"), [0, 10, 25, 50, 100, 250, 500, 1000], "lo")


@query("A16_coverage_matrix", f"""SELECT sys, 'lanes' AS field, {pct('sum(mi * lanes_share)', 'sum(mi)', 1)} AS cell FROM routes GROUP BY sys
UNION ALL SELECT sys, 'toll', {pct('sum(mi * toll_share)', 'sum(mi)', 1)} FROM routes GROUP BY sys
UNION ALL SELECT sys, 'continuous', {pct('sum(CASE WHEN breaks > 0 THEN 0 ELSE mi END)', 'sum(mi)', 1)} FROM routes GROUP BY sys""")
def coverage_matrix(t):
    return M.coverage_matrix(t.routes, "sys", "mi", {"lanes": F.col("lanes_share"), "toll": F.col("toll_share"),
                                                    "continuous": F.when(F.col("breaks") > 0, 0.0).otherwise(1.0)})


@query("A17_broken_routes", """SELECT sys, CAST(count(*) AS BIGINT) AS routes, CAST(count(CASE WHEN breaks > 0 THEN 1 END) AS BIGINT) AS broken,
  CAST(floor(sum(coalesce(gap_mi, 0)) + 0.5) AS BIGINT) AS gap FROM routes GROUP BY sys""")
def broken_routes(t):
    return M.broken_share(t.routes, "sys", "breaks", "gap_mi")


_DOMINANT = """WITH b AS (SELECT route, kph, sum(km) AS w FROM observed GROUP BY 1, 2),
c AS (SELECT route, kph, sum(w) OVER (PARTITION BY route ORDER BY kph) AS upto, sum(w) OVER (PARTITION BY route) AS total FROM b)"""


@query("A18_dominant_limit", f"""{_DOMINANT},
m AS (SELECT route, min(kph) AS kph FROM c WHERE upto >= total / 2 GROUP BY route),
s AS (SELECT route, sum(km) AS k, max(route_km) AS rk FROM observed GROUP BY route)
SELECT s.route, m.kph, {cov('k', 'greatest(rk, 0.1)')} AS cover FROM s JOIN m ON s.route = m.route""")
def dominant_limit(t):
    return M.dominant_limit(t.observed, "route", "kph", "km", "route_km")


@query("A18_scaled_bins", """WITH b AS (SELECT route, kph, sum(km) AS w, max(route_km) AS rk FROM observed GROUP BY 1, 2),
s AS (SELECT route, kph, w, rk, sum(w) OVER (PARTITION BY route) AS total FROM b)
SELECT route, kph, floor(w * CASE WHEN total > rk THEN rk / total ELSE 1 END * 10 + 0.5) / 10.0 AS km FROM s
WHERE floor(w * CASE WHEN total > rk THEN rk / total ELSE 1 END * 10 + 0.5) / 10.0 >= 0.1""")
def scaled_bins(t):
    return M.scaled_bins(t.observed, "route", "kph", "km", "route_km")


@query("A19_P32_mileage_by_band", """SELECT route, src, CAST(CASE WHEN kph >= 120 THEN 120 WHEN kph <= 40 THEN 40 ELSE floor(kph / 10.0 + 0.5) * 10 END AS INT) AS band,
  round(sum(km / 1.609344), 3) AS mi FROM observed GROUP BY 1, 2, 3""")
def mileage_by_band(t):
    return M.mileage_by_band(t.observed, "route", "src", "kph", "km")


def _share(c: str) -> str:
    return f"least(100.0::DOUBLE, {pct(c, 'a', 1)})"


@query("A20_structure_share", f"""WITH w AS (SELECT route, route_km, structure, km * CASE WHEN oneway = 1 THEN 0.5 ELSE 1 END AS w, lanes * CASE WHEN oneway = 1 THEN 2 ELSE 1 END AS across FROM observed),
s AS (SELECT route, greatest(max(route_km), 0.1) AS a, sum(CASE WHEN structure = 'b' THEN w ELSE 0 END) AS b, sum(CASE WHEN structure = 't' THEN w ELSE 0 END) AS t, sum(across * w) AS lw,
  sum(CASE WHEN across IS NOT NULL THEN w ELSE 0 END) AS ll FROM w GROUP BY route)
SELECT route, {_share('b')} AS bridge_share, {_share('t')} AS tunnel_share, {_share('ll')} AS lanes_cover, CASE WHEN {_share('ll')} >= 20 THEN floor(lw / ll * 10 + 0.5) / 10.0 END AS lanes FROM s""")
def structure_share(t):
    return M.structure_share(t.observed, "route", "km", "structure", "lanes", "oneway", "route_km")


@query("A30_decade_increments", """WITH y AS (SELECT key, year, max(value) AS v FROM yearly GROUP BY key, year),
c AS (SELECT key, year, sum(v) OVER (PARTITION BY key ORDER BY year) AS cum FROM y),
f AS (SELECT key, min(year) AS y0, arg_min(cum, year) AS v0 FROM c GROUP BY key),
d AS (SELECT key, CAST(floor(year / 10) * 10 AS INT) AS decade, arg_max(cum, year) AS e FROM c GROUP BY 1, 2)
SELECT d.key, decade, 'decade' AS kind, e - coalesce(lag(e) OVER (PARTITION BY d.key ORDER BY decade), v0) AS added FROM d JOIN f ON d.key = f.key
UNION ALL SELECT key, CAST(y0 AS INT), 'before', v0 FROM f""")
def decade_increments(t):
    per_year = t.yearly.groupBy("key", "year").agg(F.max("value").alias("v"))
    return M.decade_increments(O.running_sum(per_year, ["key"], "year", "v", "cum"), "key", "year", "cum")


@query("A31_completion_curve", """SELECT sys, opened, CAST(sum(n) OVER (PARTITION BY sys ORDER BY opened) AS DOUBLE) AS complete FROM
 (SELECT sys, opened, count(*) AS n FROM routes WHERE opened IS NOT NULL GROUP BY 1, 2)""")
def completion_curve(t):
    return M.completion_curve(t.routes, "opened", ["sys"]).select("sys", "opened", "complete")


@query("A36_climb", """WITH n AS (SELECT route, pos, h, row_number() OVER (PARTITION BY route ORDER BY pos) AS seq FROM heights),
d AS (SELECT route, h, greatest(0, h - lag(h) OVER (PARTITION BY route ORDER BY seq)) AS up FROM n)
SELECT route, max(h) AS high, min(h) AS low, round(sum(coalesce(up, 0)), 4) AS climb FROM d GROUP BY route""")
def climb(t):
    numbered = O.positions(t.heights, ["route"], [F.col("pos")], "pos", name="seq")
    return M.climb(numbered, "route", "seq", "h")


@query("W5_gap_fill", """WITH n AS (SELECT route, pos, CASE WHEN tax < 0.04 THEN NULL ELSE h END AS h, row_number() OVER (PARTITION BY route ORDER BY pos) AS seq FROM heights),
b AS (SELECT *, last_value(h IGNORE NULLS) OVER w AS a, first_value(h IGNORE NULLS) OVER v AS z,
  last_value(CASE WHEN h IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS sa, first_value(CASE WHEN h IS NOT NULL THEN seq END IGNORE NULLS) OVER v AS sz FROM n
  WINDOW w AS (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY route ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT route, CAST(seq AS BIGINT) AS seq, CAST(coalesce(h, greatest(0, floor(coalesce(a, z, 0) + (coalesce(z, a, 0) - coalesce(a, z, 0)) * coalesce((seq - sa) / (sz - sa), 0) + 0.5))) AS DOUBLE) AS filled FROM b""")
def gap_fill(t):
    numbered = O.positions(t.heights, ["route"], [F.col("pos")], "pos", name="seq")
    gappy = numbered.withColumn("h", F.when(F.col("tax") >= 0.04, F.col("h")))
    return M.fill_gaps(gappy, "route", "seq", "h").select("route", "seq", "filled")
