"""Aggregates along the network (A-1..A-13, A-16..A-20, A-36, A-46).

Everything here is a partial/final aggregation on the given keys: no key's rows are ever
gathered, so the size of a single route does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import KM_PER_MI, band, cover, js_round, null_if_zero, percent, step_round
from .ordered import BLOCK, carry, quantiles, running_sum

# Reporting step of each measure.
STEPS = {"aadt": 100, "truck": 10, "iri": 1, "lanes": 0.1, "speed": 1, "rutting": 0.01, "cracking": 0.1}


def weighted_measures(sections: DataFrame, keys: list[str], length: str, measures: list[str],
                      shares: dict[str, Column] | None = None, maxima: list[str] | None = None,
                      sums: list[str] | None = None, steps: dict[str, float] | None = None,
                      length_name: str = "mi") -> DataFrame:
    """A-1, A-2, A-12: length-weighted means with the share of length each was measured over.

    Gives ``<m>_v`` and ``<m>_cover`` per measure, shares of length in percent to 0.1, and
    maxima and sums with 0 read as "none".
    """
    steps = {**STEPS, **(steps or {})}
    whole = F.col(length)
    aggs = [F.sum(whole).alias("_len"), F.count(F.lit(1)).alias("sections")]
    for m in measures:
        known = F.col(m).isNotNull()
        aggs += [F.sum(F.when(known, F.col(m) * whole)).alias(f"_{m}_w"), F.sum(F.when(known, whole)).alias(f"_{m}_l")]
    aggs += [F.sum(F.when(c, whole).otherwise(0.0)).alias(f"_{s}_s") for s, c in (shares or {}).items()]
    aggs += [F.max(m).alias(f"_{m}_max") for m in maxima or []]
    aggs += [F.sum(m).alias(f"_{m}_sum") for m in sums or []]
    totals = sections.filter(whole > 0).groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    out += [(js_round(F.col("_len") * 10) / 10.0).alias(length_name), "sections"]
    for m in measures:
        stated = (F.col(f"_{m}_w") != 0) & (F.col(f"_{m}_l") > 0)
        out += [F.when(stated, step_round(F.col(f"_{m}_w") / F.col(f"_{m}_l"), steps.get(m, 1))).alias(f"{m}_v"),
                F.when(stated, cover(F.col(f"_{m}_l"), F.col("_len"))).alias(f"{m}_cover")]
    out += [percent(F.col(f"_{s}_s"), F.col("_len"), 1).alias(s) for s in shares or {}]
    out += [null_if_zero(F.col(f"_{m}_max")).alias(f"{m}_max") for m in maxima or []]
    out += [null_if_zero(F.col(f"_{m}_sum")).alias(f"{m}_sum") for m in sums or []]
    return totals.select(*out)


def combine_measures(pieces: DataFrame, figures: DataFrame, on: list[str], route: str, miles: str, route_miles: str,
                     measures: list[str], shares: list[str] = (), steps: dict[str, float] | None = None) -> DataFrame:
    """A-3, J-9: per-jurisdiction figures joined by designation and combined per route.

    ``pieces`` has one row per (route, jurisdiction) with its miles; each figure weighs
    miles x its own coverage, and the result says how much of the route it covers.
    """
    steps = {**STEPS, **(steps or {})}
    joined = pieces.join(figures, on)
    mi = F.col(miles)
    aggs = [F.sum(mi).alias("_mi"), F.max(route_miles).alias("_all")]
    for m in measures:
        w = mi * F.col(f"{m}_cover") / 100
        aggs += [F.sum(F.col(f"{m}_v") * w).alias(f"_{m}_n"), F.sum(F.when(F.col(f"{m}_v").isNotNull(), w)).alias(f"_{m}_d")]
    for s in shares:
        aggs += [F.sum(F.col(s) * mi).alias(f"_{s}_n"), F.sum(F.when(F.col(s).isNotNull(), mi)).alias(f"_{s}_d")]
    out = [F.col(route), js_round(F.col("_mi") / F.greatest(F.col("_all"), F.lit(1e-9)) * 100).cast("double").alias("cover")]
    for m in measures:
        known = F.col(f"_{m}_d") > 0
        out += [F.when(known, step_round(F.col(f"_{m}_n") / F.col(f"_{m}_d"), steps.get(m, 1))).alias(f"{m}_v"),
                F.when(known, cover(F.col(f"_{m}_d"), F.col("_all"))).alias(f"{m}_cover")]
    out += [F.when(F.col(f"_{s}_d") > 0, js_round(F.col(f"_{s}_n") / F.col(f"_{s}_d") * 10) / 10.0).alias(s) for s in shares]
    return joined.groupBy(route).agg(*aggs).select(*out)


def combine_counted(pieces: DataFrame, figures: DataFrame, on: list[str], route: str, miles: str, route_miles: str,
                    measures: list[str], steps: dict[str, float]) -> DataFrame:
    """A-4: as :func:`combine_measures`, weighing at most the kilometres that were counted.

    ``figures`` also carries km, method, n, peak, year_from and year_to.
    """
    joined = pieces.join(figures, on)
    counted = F.when(F.col("km").isNull(), F.col(miles)).otherwise(F.least(F.col(miles), F.col("km") / KM_PER_MI))
    joined = joined.withColumn("_c", counted)
    aggs = [F.sum("_c").alias("_mi"), F.max(route_miles).alias("_all"), F.max("peak").alias("_peak"),
            F.sum(F.when(F.col("method") == "stations", F.col("n"))).alias("stations"),
            F.min("year_from").alias("year"), F.max("year_to").alias("year_to"),
            # A method is one of a handful of words, so the set stays small whatever the route.
            F.array_join(F.array_sort(F.collect_set("method")), "+").alias("method")]
    for m in measures:
        w = F.col("_c") * F.coalesce(F.col(f"{m}_cover"), F.lit(100.0)) / 100
        ok = F.col(f"{m}_v").isNotNull() & (w > 0)
        aggs += [F.sum(F.when(ok, F.col(f"{m}_v") * w)).alias(f"_{m}_n"), F.sum(F.when(ok, w)).alias(f"_{m}_d")]
    out = [F.col(route), cover(F.col("_mi"), F.col("_all")).alias("cover"), "method", "stations", "year", "year_to",
           null_if_zero(F.col("_peak")).alias("peak")]
    for m in measures:
        known = F.col(f"_{m}_d") > 0
        out += [F.when(known, step_round(F.col(f"_{m}_n") / F.col(f"_{m}_d"), steps[m])).alias(f"{m}_v"),
                F.when(known, cover(F.col(f"_{m}_d"), F.col("_all"))).alias(f"{m}_cover")]
    return joined.groupBy(route).agg(*aggs).select(*out)


def accumulate(rows: DataFrame, keys: list[str], km: str, values: list[str], year: str,
               weighted: bool = True, steps: dict[str, float] | None = None, peak: str = "aadt") -> DataFrame:
    """A-5: length-weighted figures of counted rows; a row without length weighs one."""
    steps = {**STEPS, **(steps or {})}
    weight = F.coalesce(F.col(km), F.lit(1.0))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(km), F.lit(0.0))).alias("_km"), F.max(peak).alias("_peak"),
            F.min(year).alias("_y0"), F.max(year).alias("year")]
    for v in values:
        known = F.col(v).isNotNull()
        aggs += [F.sum(F.when(known, F.col(v) * weight)).alias(f"_{v}_w"), F.sum(F.when(known, weight)).alias(f"_{v}_d")]
    lengths = (F.col("_km") > 0) & F.lit(weighted)
    out = [*[F.col(k) for k in keys], "n", F.when(lengths, js_round(F.col("_km") * 10) / 10.0).alias("km"),
           F.when(F.col("_peak") > 0, step_round(F.col("_peak"), steps[peak])).alias("peak"),
           "year", F.when(F.col("_y0") < F.col("year"), F.col("_y0")).alias("year_from")]
    for v in values:
        known = F.col(f"_{v}_d") > 0
        out += [F.when(known, step_round(F.col(f"_{v}_w") / F.col(f"_{v}_d"), steps.get(v, 1))).alias(f"{v}_v"),
                F.when(known & lengths, cover(F.col(f"_{v}_d"), F.col("_km"))).alias(f"{v}_cover")]
    return rows.groupBy(*keys).agg(*aggs).select(*out)


def yearly_series(rows: DataFrame, keys: list[str], year: str, value: str, weight: str | None = None,
                  step: float = 100) -> DataFrame:
    """A-6: one figure per key and year with its count; keys with a single year are left out.

    With lengths the figure is a weighted mean, without them a median.
    """
    rows = rows.filter(F.col(year).isNotNull() & F.col(value).isNotNull())
    by = [*keys, year]
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                   *([F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("_v")] if weight else []))
    if not weight:
        counts = counts.join(quantiles(rows, by, value, {"_v": ("middle", 0.5)}), by)
    counts = counts.filter(F.col("_v").isNotNull())
    several = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_years")).filter(F.col("_years") > 1).drop("_years")
    return counts.join(several, keys, "left_semi").select(*by, "n", step_round(F.col("_v"), step).alias("value"))


def station_summary(stations: DataFrame, route: str, count: str, trucks: str, year: str) -> DataFrame:
    """A-7, A-29: stations, median, least and greatest count, median truck share and year range of a route."""
    counted = stations.filter(F.col(count) > 0)
    basics = (stations.groupBy(route).agg(
        F.count(F.when(F.col(count) > 0, 1)).alias("stations"), F.min(F.when(F.col(count) > 0, F.col(count))).alias("_lo"),
        F.max(count).alias("_hi"), F.min(year).alias("_y0"), F.max(year).alias("_y1")).filter(F.col("stations") > 0))
    medians = quantiles(counted, [route], count, {"_m": ("middle", 0.5)})
    truck = quantiles(stations.filter(F.col(trucks) >= 0), [route], trucks, {"_t": ("middle", 0.5)})
    return (basics.join(medians, route).join(truck, route, "left").select(
        route, "stations", step_round(js_round(F.col("_m")), 10).alias("median"), step_round(F.col("_lo"), 10).alias("lowest"),
        step_round(F.col("_hi"), 10).alias("highest"), (js_round(F.col("_t") * 10) / 10.0).alias("truck_share"),
        F.when(F.col("_y0") == F.col("_y1"), F.col("_y0").cast("string"))
        .otherwise(F.concat_ws("–", F.col("_y0").cast("string"), F.col("_y1").cast("string"))).alias("years")))


def station_average(stations: DataFrame, route: str, total: str, km: str, parts: dict[str, str], place: str,
                    route_km: str) -> DataFrame:
    """A-8: length-weighted count, shares of its parts, coverage and the busiest place.

    A route whose stations carry no length gets medians instead.
    """
    counted = stations.filter(F.col(total) > 0).withColumn("_k", F.coalesce(F.col(km), F.lit(0.0)))
    cols = {"_all": total, **{f"_p_{n}": c for n, c in parts.items()}}
    sums = counted.groupBy(route).agg(
        F.count(F.lit(1)).alias("stations"), F.sum("_k").alias("_km"), F.max(route_km).alias("_route_km"),
        F.max_by(place, F.struct(F.col(total), F.col(place))).alias("busiest"), F.max(total).alias("_hi"),
        *[F.sum(F.col(c) * F.col("_k")).alias(f"{n}_w") for n, c in cols.items()])
    out = sums
    lengthless = counted.join(sums.filter(F.col("_km") <= 0).select(route), route, "left_semi")
    for n, c in cols.items():
        out = out.join(quantiles(lengthless, [route], c, {f"{n}_m": ("middle", 0.5)}), route, "left")
    mean = lambda n: F.when(F.col("_km") > 0, F.col(f"{n}_w") / F.col("_km")).otherwise(js_round(F.col(f"{n}_m")).cast("double"))
    return out.select(route, "stations", step_round(mean("_all"), 100).alias("average"), step_round(F.col("_hi"), 100).alias("highest"),
                      "busiest", F.when(F.col("_route_km") > 0, cover(F.col("_km"), F.col("_route_km"))).alias("cover"),
                      *[percent(mean(f"_p_{n}"), mean("_all"), 1).alias(f"{n}_share") for n in parts])


def pair_directions(sections: DataFrame, keys: list[str], ends: Column, direction: str, values: list[str]) -> DataFrame:
    """A-9: the two directions of one section summed; sections not made of exactly two are counted apart.

    Gives one row per section with ``paired``; values of unpaired sections are null.
    """
    grouped = (sections.withColumn("section", ends).groupBy(*keys, "section").agg(
        F.count(F.lit(1)).alias("rows"), F.min(direction).alias("_d0"), F.max(direction).alias("_d1"),
        *[F.sum(v).alias(v) for v in values]))
    # Two rows with two different directions: least and greatest differ.
    paired = (F.col("rows") == 2) & (F.col("_d0") != F.col("_d1"))
    return grouped.select(*keys, "section", "rows", paired.alias("paired"), *[F.when(paired, F.col(v)).alias(v) for v in values])


def unordered(a: Column, b: Column) -> Column:
    """Key of an unordered pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def two_way(counts: DataFrame, place: list[str], direction: str, date: str, value: str, tie: str) -> DataFrame:
    """A-10, W-7: two-way volume of a place from the latest count per direction.

    A row without direction wins; else N+S, else E+W; a place counted one way only is dropped.
    """
    d = F.upper(F.trim(F.coalesce(F.col(direction), F.lit(""))))
    latest = (counts.withColumn("_d", d).groupBy(*place, "_d")
              .agg(F.max_by(value, F.struct(F.col(date), F.col(tie))).alias("_v")))
    by = lambda k: F.max(F.when(F.col("_d") == k, F.col("_v")))
    wide = latest.groupBy(*place).agg(F.max(F.when(F.col("_d") == "", 1)).alias("_both"), by("").alias("_0"),
                                      *[by(k).alias(f"_{k}") for k in "NSEW"])
    volume = F.when(F.col("_both").isNotNull(), F.col("_0")).otherwise(
        F.coalesce(F.col("_N") + F.col("_S"), F.col("_E") + F.col("_W")))
    return wide.select(*place, volume.alias("volume")).filter(F.col("volume") > 0)


def composition(edges: DataFrame, route: str, km: str, attribute: str) -> DataFrame:
    """A-11: length of a route by attribute, in km and percent to 0.1 (long form)."""
    by = edges.filter(F.col(km) > 0).groupBy(route, attribute).agg(F.sum(km).alias("_km"))
    total = by.groupBy(route).agg(F.sum("_km").alias("_all"))
    return by.join(total, route).select(route, attribute, F.round("_km", 3).alias("km"),
                                        percent(F.col("_km"), F.col("_all"), 1).alias("share"))


def divided_share(edges: DataFrame, route: str, km: str, divided: str) -> DataFrame:
    """A-11: share of the known length that is divided, and how much is known."""
    length, flag = F.col(km), F.col(divided)
    sums = edges.filter(length > 0).groupBy(route).agg(
        F.sum(length).alias("_all"), F.sum(F.when(flag.isNotNull(), length)).alias("_known"), F.sum(F.when(flag, length)).alias("_div"))
    return sums.select(route, percent(F.coalesce(F.col("_div"), F.lit(0.0)), F.col("_known"), 1).alias("divided_share"),
                       percent(F.coalesce(F.col("_known"), F.lit(0.0)), F.col("_all")).alias("divided_cover"))


def totals_by_system(routes: DataFrame, key: str, system: str, systems: list[str], miles: str) -> DataFrame:
    """A-13: routes and miles per key with one column per system; miles are rounded per route first."""
    mi = js_round(F.col(miles))
    return routes.groupBy(key).agg(F.count(F.lit(1)).alias("routes"), F.sum(mi).alias("mi"),
                                   *[F.sum(F.when(F.col(system) == s, mi).otherwise(0)).alias(f"mi_{i}") for i, s in enumerate(systems)])


def coverage_matrix(routes: DataFrame, system: str, miles: str, fields: dict[str, Column]) -> DataFrame:
    """A-16: share of mileage with each field, per system (long form); null where a system never states it."""
    aggs = [F.sum(miles).alias("_mi")]
    for f, share in fields.items():
        aggs += [F.sum(F.col(miles) * share).alias(f"_{f}"), F.max(share.isNotNull()).alias(f"_{f}_stated")]
    wide = routes.groupBy(system).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f"_{f}_stated"), percent(F.col(f"_{f}"), F.col("_mi"), 1)).alias("cell"))
                      for f in fields])
    return wide.select(system, F.inline(cells))


def broken_share(routes: DataFrame, system: str, breaks: str, gap: str) -> DataFrame:
    """A-17: routes, broken ones and their total gap per system."""
    return routes.groupBy(system).agg(F.count(F.lit(1)).alias("routes"), F.count(F.when(F.col(breaks) > 0, 1)).alias("broken"),
                                      js_round(F.sum(F.coalesce(F.col(gap), F.lit(0.0)))).alias("gap"))


def dominant_limit(observed: DataFrame, route: str, kph: str, km: str, route_km: str) -> DataFrame:
    """A-18, A-46: weighted median limit of a route and how much of it was observed."""
    sums = observed.groupBy(route).agg(F.sum(km).alias("_km"), F.max(route_km).alias("_all"))
    medians = quantiles(observed, [route], kph, {"kph": ("weighted", 0.5)}, weight=km)
    return sums.join(medians, route).select(route, "kph", cover(F.col("_km"), F.greatest(F.col("_all"), F.lit(0.1))).alias("cover"))


def scaled_bins(observed: DataFrame, route: str, kph: str, km: str, route_km: str) -> DataFrame:
    """A-18: observed length per limit, scaled down where more was observed than the route has."""
    bins = observed.groupBy(route, kph).agg(F.sum(km).alias("_km"), F.max(route_km).alias("_route"))
    total = bins.groupBy(route).agg(F.sum("_km").alias("_all"))
    scaled = F.col("_km") * F.when(F.col("_all") > F.col("_route"), F.col("_route") / F.col("_all")).otherwise(1.0)
    return (bins.join(total, route).select(route, kph, (js_round(scaled * 10) / 10.0).alias("km"))
            .filter(F.col("km") >= 0.1))


def mileage_by_band(rows: DataFrame, key: str, source: str, kph: str, km: str) -> DataFrame:
    """A-19, P-32: mileage per key, source tier and speed band."""
    return (rows.withColumn("band", band(F.col(kph))).groupBy(key, source, "band")
            .agg(F.round(F.sum(F.col(km) / KM_PER_MI), 3).alias("mi")))


def structure_share(ways: DataFrame, route: str, length: str, structure: str, lanes: str, oneway: str, route_km: str,
                    min_cover: float = 20) -> DataFrame:
    """A-20: bridge and tunnel share of a route's length, and mean lanes if read over enough of it.

    One carriageway of a divided road is half its length, and has one direction's lanes.
    """
    one = F.col(oneway) == 1
    w = F.col(length) * F.when(one, 0.5).otherwise(1.0)
    across = F.col(lanes) * F.when(one, 2).otherwise(1)
    sums = ways.groupBy(route).agg(
        F.greatest(F.max(route_km), F.lit(0.1)).alias("_all"), F.sum(F.when(F.col(structure) == "b", w).otherwise(0.0)).alias("_b"),
        F.sum(F.when(F.col(structure) == "t", w).otherwise(0.0)).alias("_t"), F.sum(across * w).alias("_lw"),
        F.sum(F.when(F.col(lanes).isNotNull(), w).otherwise(0.0)).alias("_ll"))
    share = lambda c: F.least(F.lit(100.0), percent(F.col(c), F.col("_all"), 1))
    return sums.select(route, share("_b").alias("bridge_share"), share("_t").alias("tunnel_share"), share("_ll").alias("lanes_cover"),
                       F.when(share("_ll") >= min_cover, js_round(F.col("_lw") / F.col("_ll") * 10) / 10.0).alias("lanes"))


def climb(profile: DataFrame, route: str, seq: str, height: str) -> DataFrame:
    """A-36: highest, lowest and total climb of a profile given as rows.

    The height before each sample is the neighbour ``seq - 1``, found by an equi-join.
    """
    before = profile.select(F.col(route), (F.col(seq) + 1).alias(seq), F.col(height).alias("_before"))
    rise = F.greatest(F.lit(0.0), F.col(height).cast("double") - F.col("_before"))
    return (profile.join(before, [route, seq], "left").groupBy(route)
            .agg(F.max(height).alias("high"), F.min(height).alias("low"), F.round(F.sum(F.coalesce(rise, F.lit(0.0))), 4).alias("climb")))


def fill_gaps(profile: DataFrame, route: str, seq: str, height: str, block: int | str = BLOCK) -> DataFrame:
    """W-5: missing samples interpolated between their banks, never below zero.  ``block`` as for :func:`carry`."""
    blocked = profile if block == "_block" else profile.withColumn("_block", F.floor(F.col(seq) / block))
    both = carry(carry(blocked, [route], seq, height, "_a", block="_block"), [route], seq, height, "_b", forward=False, block="_block")
    both = both if block == "_block" else both.drop("_block")
    a, b = F.coalesce(F.col("_a.value"), F.col("_b.value"), F.lit(0.0)), F.coalesce(F.col("_b.value"), F.col("_a.value"), F.lit(0.0))
    # A gap at an end has one bank only and stays level with it.
    span = F.col("_b.seq") - F.col("_a.seq")
    t = F.coalesce((F.col(seq) - F.col("_a.seq")) / span, F.lit(0.0))
    filled = F.greatest(F.lit(0.0), js_round(a + (b - a) * t).cast("double"))
    return both.withColumn("filled", F.coalesce(F.col(height).cast("double"), filled)).drop("_a", "_b")


def decade_increments(table: DataFrame, key: str, year: str, cumulative: str) -> DataFrame:
    """A-30: growth per decade of a cumulative yearly table; the first year is its own entry."""
    first = table.groupBy(key).agg(F.min(year).alias("_y0"), F.min_by(cumulative, year).alias("_v0"))
    ends = (table.withColumn("decade", (F.floor(F.col(year) / 10) * 10).cast("int")).groupBy(key, "decade")
            .agg(F.max_by(cumulative, year).alias("_end")).join(first, key))
    # One row per decade is left of each key by now, so the window is short.
    w = W.partitionBy(key).orderBy("decade")
    growth = ends.withColumn("_prev", F.lag("_end").over(w)).select(
        key, F.col("decade"), F.lit("decade").alias("kind"), (F.col("_end") - F.coalesce(F.col("_prev"), F.col("_v0"))).alias("added"))
    return growth.unionByName(first.select(key, F.col("_y0").cast("int").alias("decade"), F.lit("before").alias("kind"), F.col("_v0").alias("added")))


def completion_curve(lines: DataFrame, year: str, keys: list[str] | None = None) -> DataFrame:
    """A-31: how many dated lines were complete by each year."""
    keys = keys or []
    per_year = lines.filter(F.col(year).isNotNull()).groupBy(*keys, year).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    return running_sum(per_year, keys, year, "_n", "complete")
