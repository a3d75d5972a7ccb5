"""Names matched with names (J-19..J-22, J-28).

"Contains" is turned into an equi-join: a needle can only lie where its first few letters
do, so texts and needles meet on letter groups, and no text is compared with every needle.
A needle of fewer letters than a group meets on all its letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KM_PER_DEG, haversine
from ..functions.text import expand, squash, unaccent, unbracket
from ..runtime import cut, skew_join
from .grid import EARTH_KM, around, first_ring, in_cell, in_rings, sharing
from .ordered import first_by

LETTERS = 4

# Abbreviations in titles, spelled out in this order.
ABBREVIATIONS = [
    (r"\bcd\.?(?=\s)", "ciudad"), (r"\bsta\.?(?=\s)", "santa"), (r"\bsto\.?(?=\s)", "santo"), (r"\bgral\.?(?=\s)", "general"),
    (r"\blib\.?(?=\s)", "libramiento"), (r"\bmpo\.?(?=\s)", "municipio"), (r"\b(?:entr?\.|entronque)(?=\s)", "ent"), (r"\bedo\.?(?=\s)", "estado"),
]
# Fixed value: words before a place name that do not belong to it.
FILLER = r"^(?:RAMAL A|ACCESO A|ENT\.?|EST\.?|E\.? ?C\.?|T\.? ?C\.?|LIBRAMIENTO(?: DE)?|CARRETERA)\s+"


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, on: list[str] = (), letters: int = LETTERS) -> DataFrame:
    """Pairs in which ``text`` contains ``needle``, among rows that agree on ``on``; an empty needle is in no text.

    Texts give their groups only of the lengths that needles have, up to ``letters``.
    """
    size = F.least(F.length(needle), F.lit(letters))
    sizes = sorted(r[0] for r in needles.filter(F.length(needle) > 0).select(size).distinct().collect())  # ``letters`` numbers at most

    def of_length(k: int) -> Column:
        return F.transform(F.when(F.length(text) >= k, F.sequence(F.lit(1), F.length(text) - k + 1)), lambda i: F.substring(F.col(text), i, F.lit(k)))

    groups = [of_length(k) for k in sizes]
    grams = F.array_distinct(F.flatten(F.array_compact(F.array(*groups)))) if groups else F.array().cast("array<string>")
    spread = texts.withColumn("_gram", F.explode(grams))
    anchored = needles.filter(F.length(needle) > 0).withColumn("_gram", F.substring(F.col(needle), F.lit(1), size))
    return skew_join(spread, anchored, [*on, "_gram"]).filter(F.col(text).contains(F.col(needle))).drop("_gram")


def fuzzy_places(crossings: DataFrame, candidates: DataFrame, crossing: str, province: str, town: str, name: str, place: str, rank: str,
                 boundary_km: str, km: float = 5) -> DataFrame:
    """J-19: the most precise candidate of the same province whose name contains the town, near the boundary.

    Of candidates of one name only the best is met, and a town is asked for once, however many crossings name it.
    """
    order = [rank, boundary_km, place]
    best = first_by(candidates.filter(F.col(boundary_km) <= km), [province, name], order, [place, rank, boundary_km])
    towns = crossings.select(province, town).distinct()
    found = first_by(contains_join(best, name, towns, town, [province]), [province, town], order, [place, rank, boundary_km])
    return first_by(crossings.select(crossing, province, town).join(found, [province, town]), [crossing], order, [place, rank, boundary_km])


# What may stand before a port's name, and after it without making it another.
PORT_BEFORE = "^(?:中华人民共和国|中国)"
PORT_AFTER = ["", "口岸", "公路口岸", "陆路口岸"]


def ranked_facility(wanted: DataFrame, facilities: DataFrame, want: str, name: str, title: str, facility: str, km: str, max_km: float) -> DataFrame:
    """J-20: the facility whose name is (0), begins with (1) or contains (2) a wanted one, then the nearest to the boundary.

    ``wanted`` may have several names for one place.  The country before a title and the kind of
    port after it do not count.
    """
    hits = contains_join(facilities.filter(F.col(km) <= max_km), title, wanted, name)
    bare = F.regexp_replace(title, PORT_BEFORE, "")
    same = F.array_contains(F.array(*[F.concat(F.col(name), F.lit(k)) for k in PORT_AFTER]), bare)
    rank = F.when(same, 0).when(bare.startswith(F.col(name)), 1).otherwise(2)
    return first_by(hits.withColumn("rank", rank), [want], ["rank", km, facility], [facility, "rank", km])


def plain_title(text: Column) -> Column:
    """J-21: lower case, abbreviations spelled out, hyphens set apart."""
    t = F.concat(F.lit(" "), F.lower(unaccent(text)), F.lit(" "))
    t = F.regexp_replace(t, r"\((?:cuota|libre|alta|baja|directa)\)", " ")
    t = F.regexp_replace(expand(t, ABBREVIATIONS), r"\s*-\s*", " - ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 -]", " "), r"\s+", " "))


def place_pairs(titles: DataFrame, title: str, text: str, known: DataFrame | None = None, place: str = "place") -> DataFrame:
    """J-21: pairs of places a title may write as "A - B" (title, a, b), also the two ends of "A - B - C".

    Each side is a run of words next to the hyphen.  With ``known`` places only runs that are
    one of them are paired, so that long sides stay short lists.
    """
    parts = titles.select(title, F.posexplode(F.split(plain_title(F.col(text)), " - ")).alias("p", "w")).withColumn("w", F.split("w", " "))
    runs = lambda from_end: F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.array_join(
        F.slice("w", F.size("w") - k + 1 if from_end else F.lit(1), k), " "))
    left = parts.select(title, "p", F.explode(runs(True)).alias("a"))
    right = parts.select(title, "p", F.explode(runs(False)).alias("b"))
    if known is not None:
        names = known.select(F.col(place).alias("a")).distinct()
        left, right = left.join(names, "a", "left_semi"), right.join(names.withColumnRenamed("a", "b"), "b", "left_semi")
    left = left.select(title, "a", F.explode(F.array(F.col("p") + 1, F.col("p") + 2)).alias("p"))
    return left.join(right, [title, "p"]).select(title, "a", "b").distinct()


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(" | ", F.least(a, b), F.greatest(a, b))


def propose(titles: DataFrame, title_states: DataFrame, roads: DataFrame, points: DataFrame, title: str, text: str, state: str, road: str,
            name: str, place: str) -> DataFrame:
    """J-21: roads a title may be about (title, road, via): it writes the road's name or its two ends (``road``),
    or two count points of it (``points``).  ``road`` wins.

    ``roads`` has state, road, name; ``points`` has state, road, place; ``title_states`` the states a title names.
    """
    # Titles of the same texts and states are one until the end, as are roads of one name in a state.
    told = cut(titles.join(title_states.select(title, state), title).groupBy(title).agg(
        F.sort_array(F.collect_set(text)).alias("_texts"), F.sort_array(F.collect_set(state)).alias("_states")))
    kinds = cut(told.select("_texts", "_states").distinct().withColumn("_kind", F.monotonically_increasing_id()))
    in_states, written_as = kinds.select("_kind", F.explode("_states").alias(state)), kinds.select("_kind", F.explode("_texts").alias("_text"))
    plain = roads.select(state, road, plain_title(F.col(name)).alias("_n"))
    names = cut(plain.select(state, "_n").distinct())
    ends = F.split("_n", " - ")
    stops = cut(points.select(state, road, plain_title(F.col(place)).alias("a")).distinct())
    known = stops.select("a").unionByName(names.filter(F.size(ends) == 2).select(F.explode(ends).alias("a")))
    pairs = cut(place_pairs(written_as, "_kind", "_text", known, "a").join(in_states, "_kind"))
    by_ends = (pairs.withColumn("_k", pair_key(F.col("a"), F.col("b")))
               .join(names.filter(F.size(ends) == 2).withColumn("_k", pair_key(ends[0], ends[1])), [state, "_k"]).select("_kind", state, "_n"))
    written = contains_join(written_as.select("_kind", F.concat(F.lit(" "), plain_title(F.col("_text")), F.lit(" ")).alias("_t")).join(in_states, "_kind"), "_t",
                            names.filter(F.length("_n") >= 8).withColumn("_needle", F.concat(F.lit(" "), F.col("_n"), F.lit(" "))), "_needle", [state])
    by_name = by_ends.unionByName(written.select("_kind", state, "_n")).distinct()
    at_roads = skew_join(by_name, plain, [state, "_n"]).select("_kind", road, F.lit("road").alias("via"))
    at_points = (pairs.filter(F.col("a") != F.col("b")).join(stops, [state, "a"])
                 .join(stops.withColumnRenamed("a", "b"), [state, road, "b"]).select("_kind", road, F.lit("points").alias("via")))
    every = at_roads.unionByName(at_points).groupBy("_kind", road).agg(F.max("via").alias("via"))
    found = skew_join(told.join(kinds, ["_texts", "_states"]).select(title, "_kind"), every, ["_kind"])
    return found.select(title, road, "via")


def terminus_names(name: Column) -> Column:
    """J-22: the places a road name runs between, squashed; shorter than four letters are dropped."""
    parts = F.split(F.upper(unaccent(unbracket(name))), r"\s+-\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(squash(F.regexp_replace(F.trim(p), FILLER, "")), "[^A-Z]", "")), lambda p: F.length(p) >= 4)


def number_verdicts(register: DataFrame, ours: DataFrame, state: str, number: str, name: str, road: str) -> DataFrame:
    """J-22, D-15: per listed (state, number): agree, otherNumber, numberOnly or notFound.

    A register name agrees with one of our segment names that contains all its ends.
    """
    # Names are looked for as texts: each end once in each segment name of its state, however many roads or numbers bear it.
    listed = register.select(state, number, name).distinct().select(state, number, F.array_sort(F.array_distinct(terminus_names(F.col(name)))).alias("_ends")).distinct()
    needles = listed.filter(F.size("_ends") > 0).select(state, F.col(number).alias("_num"), "_ends", F.size("_ends").alias("_need"), F.explode("_ends").alias("_end"))
    texts = cut(ours.select(state, number, name).distinct().select(state, F.col(number).alias("_ours"), F.regexp_replace(squash(unbracket(F.col(name))), "[^A-Z]", "").alias("_seg")).distinct())
    met = cut(contains_join(texts.select(state, "_seg").distinct(), "_seg", needles.select(state, "_end").distinct(), "_end", [state]))
    hits = (skew_join(needles, met, [state, "_end"]).groupBy(state, "_num", "_ends", "_seg", "_need").agg(F.count(F.lit(1)).alias("_got"))
            .filter(F.col("_got") == F.col("_need")).select(state, "_num", "_seg").distinct().join(texts, [state, "_seg"]))
    per = hits.groupBy(state, F.col("_num").alias(number)).agg(
        F.max(F.col("_ours") == F.col("_num")).alias("_same"), F.max(F.col("_ours") != F.col("_num")).alias("_other"))
    have = ours.select(state, number).distinct().withColumn("_have", F.lit(True))
    verdict = (F.when(F.col("_same") & F.col("_have"), "agree").when(F.col("_other"), "otherNumber").when(F.col("_have"), "numberOnly").otherwise("notFound"))
    return (listed.select(state, number).distinct().join(per, [state, number], "left").join(have, [state, number], "left")
            .select(state, number, verdict.alias("verdict")))


def resolve_anchors(entries: DataFrame, routes: DataFrame, entry: str, on: list[str], hint: str, state: str, route: str, max_km: float = 25) -> DataFrame:
    """J-28: the route an entry means: same designation, the hinted jurisdiction if any has it, then nearest its anchor.

    ``entries`` has entry, on, hint, lon, lat; ``routes`` has route, on, state, olon, olat.
    Status is found, far, ambiguous (equally near) or missing.  Distances count to the sixth decimal.  Routes
    of one spot and state are met as one, in widening rings: first those of the hinted state, then, where it has none, all.
    """
    spots = cut(routes.groupBy(*on, state, "olon", "olat").agg(F.min(route).alias(route), F.count(F.lit(1)).alias("_n")))
    asked = cut(entries.select(entry, *on, F.col(hint).alias("_hint"), "lon", "lat").withColumn("_row", F.monotonically_increasing_id()))
    drawn, placed = F.col("olon").isNotNull() & F.col("olat").isNotNull(), F.col("lon").isNotNull() & F.col("lat").isNotNull()
    km = F.round(haversine(F.col("lon"), F.col("lat"), F.col("olon"), F.col("olat")), 6)

    def nearest(points: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
        points, others = sharing(points.select("_row", *by, "lon", "lat"), others.select(*by, route, "_n", "olon", "olat"), by)

        def look(left: DataFrame, reach: float) -> DataFrame:
            near = skew_join(in_cell(left, reach / KM_PER_DEG), around(others, reach / KM_PER_DEG, reach, "olon", "olat"), [*by, "_cx", "_cy"]).withColumn("_km", km)
            each = near.filter(F.col("_km") <= reach).groupBy("_row", "_km").agg(F.min(route).alias(route), F.sum("_n").alias("_n"))
            best = first_by(each, ["_row"], ["_km"], ["_km", route, "_n"])
            # What rounds to the same distance must lie within the ring too.
            return best if reach >= EARTH_KM else best.filter(F.col("_km") <= reach - 1e-5)
        return in_rings(points, ["_row"], look, first_ring(others, EARTH_KM, by), EARTH_KM)

    hinted = cut(nearest(asked.filter(placed).withColumn(state, F.col("_hint")), spots.filter(drawn), [*on, state]).withColumn("_miss", F.lit(0)))
    rest = nearest(asked.filter(placed).join(hinted.select("_row"), "_row", "left_anti"), spots.filter(drawn), on).withColumn("_miss", F.lit(1))
    # Where either side has no place, the distance is half the way round.
    blank = (asked.filter(~placed).join(spots, on).unionByName(asked.filter(placed).join(spots.filter(~drawn), on))
             .withColumn("_miss", F.when(F.col("_hint") == F.col(state), 0).otherwise(1)).withColumn("_km", km)
             .groupBy("_row", "_miss", "_km").agg(F.min(route).alias(route), F.sum("_n").alias("_n")))
    found = (asked.select("_row", entry).join(hinted.unionByName(rest).unionByName(blank.select(*hinted.columns)), "_row")
             .groupBy(entry, "_miss", "_km").agg(F.min(route).alias(route), F.sum("_n").alias("_n")))
    best = found.groupBy(entry).agg(F.min(F.struct("_miss", "_km", route, "_n")).alias("_b"))
    status = (F.when(F.col("_b").isNull(), "missing").when((F.col("_b._n") > 1), "ambiguous").when(F.col("_b._km") > max_km, "far").otherwise("found"))
    return entries.select(entry).join(best, entry, "left").select(
        entry, F.when(status == "found", F.col(f"_b.{route}")).alias(route), F.col("_b._km").alias("km"), status.alias("status"))
