"""Joins by designation, never by position (J-9..J-12, J-14, J-16..J-18, J-23, J-24, J-30..J-33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import KM_PER_MI, js_round
from ..functions.text import slug
from ..runtime import skew_join
from .identity import longest_per
from .ordered import first_by


def alternate_spellings(number: Column) -> Column:
    """J-10: the ways a register may write a number, most likely first."""
    # What a directional suffix is spelled out as.
    worded = {"C": "Central", "E": "East", "W": "West"}
    suffix = F.regexp_extract(number, r"^\d{1,3}([CEW])$", 1)
    words = F.try_element_at(F.create_map(*[F.lit(x) for kv in worded.items() for x in kv]), suffix)
    return F.array(F.concat(F.lit("I-"), number), number, F.regexp_replace(number, r"^([A-Z]+)(\d)", "$1-$2"),
                   F.when(suffix != "", F.concat(F.lit("I-"), F.regexp_extract(number, r"^(\d{1,3})", 1), F.lit(" "), words)))


def register_lookup(routes: DataFrame, route: str, number: str, register: DataFrame, entry: str) -> DataFrame:
    """J-10: register entry of each route under the first spelling that is listed."""
    tried = (routes.select(route, F.posexplode(alternate_spellings(F.col(number))).alias("_p", entry))
             .filter(F.col(entry).isNotNull()))
    return first_by(tried.join(register.select(entry).distinct(), entry), [route], ["_p"], [entry])


def all_or_nothing(pieces: DataFrame, register: DataFrame, route: str, entry: str, state: str, miles: str, value: str,
                   graze: float = 2) -> DataFrame:
    """J-11: sum of the register's figures over a route's jurisdictions, only if none that matters is missing.

    A jurisdiction the route merely grazes need not be listed.
    """
    joined = pieces.join(register.select(entry, state, value), [entry, state], "left")
    listed = F.col(value).isNotNull()
    sums = joined.groupBy(route, entry).agg(F.sum(value).alias("total"), F.count(F.when(listed, 1)).alias("known"),
                                            F.count(F.when(listed | (F.col(miles) > graze), 1)).alias("_need"))
    return sums.filter((F.col("known") > 0) & (F.col("known") == F.col("_need"))).drop("_need")


def whole_total(pieces: DataFrame, register: DataFrame, totals: DataFrame, route: str, entry: str, state: str,
                total: str) -> DataFrame:
    """J-11: the whole-route figure, if nearly all listed jurisdictions are shared (80% and all but one)."""
    table = register.groupBy(entry).agg(F.count_distinct(state).alias("_listed"))
    shared = (pieces.select(route, entry, state).distinct().join(register.select(entry, state).distinct().withColumn("_in", F.lit(1)), [entry, state], "left")
              .groupBy(route, entry).agg(F.count("_in").alias("_shared"), F.count(F.lit(1)).alias("_mine")))
    ok = ((F.col("_shared") >= F.col("_listed") - 1) & (F.col("_shared") >= F.col("_mine") - 2)
          & (F.col("_shared") / F.col("_listed") >= 0.8))
    return shared.join(table, entry).filter(ok).join(totals.select(entry, total), entry).select(route, entry, total)


def attach_to_longest(routes: DataFrame, figures: DataFrame, keys: list[str], route: str, miles: str, km: str,
                      within: float = 0.2) -> DataFrame:
    """J-12: a per-number figure shown on the longest piece, if the lengths agree; with the verdict."""
    longest = longest_per(routes, keys, miles, route, [route, miles])
    official = F.col(km) / KM_PER_MI
    verdict = (F.when(F.col(route).isNull(), "unmatched").when((F.col(miles) <= 0) | (F.abs(official - F.col(miles)) > within * F.col(miles)), "apart").otherwise("shown"))
    return (figures.join(longest, keys, "left").withColumn("verdict", verdict)
            .withColumn("official_mi", F.when(F.col("verdict") == "shown", F.round(official, 6))).drop(miles))


def majority_prefix(rows: DataFrame, prefix: str, state: str) -> DataFrame:
    """J-14: the jurisdiction holding most rows of an abbreviation (ties to the least code)."""
    votes = rows.groupBy(prefix, state).agg(F.count(F.lit(1)).alias("votes"))
    return first_by(votes, [prefix], [-F.col("votes"), F.col(state)], [state, "votes"])


def absences(listed: DataFrame, drawn: DataFrame, keys: list[str], reasons: DataFrame) -> DataFrame:
    """J-16: listed designations that are not drawn, with the reason; and reasons nothing needs any more.

    ``problem`` is null for an explained absence, else ``unexplained`` or ``stale``.
    """
    missing = listed.select(*keys).distinct().join(drawn.select(*keys).distinct(), keys, "left_anti")
    explained = missing.join(reasons, keys, "left").withColumn("problem", F.when(F.col("reason").isNull(), "unexplained"))
    stale = reasons.join(missing, keys, "left_anti").withColumn("problem", F.lit("stale"))
    return explained.unionByName(stale)


def membership(listed: DataFrame, drawn: DataFrame, keys: list[str]) -> DataFrame:
    """J-17: each listed designation and whether it is drawn in that jurisdiction."""
    here = drawn.select(*keys).distinct().withColumn("_d", F.lit(True))
    return listed.select(*keys).distinct().join(here, keys, "left").withColumn("drawn", F.coalesce("_d", F.lit(False))).drop("_d")


def approved_matches(matches: DataFrame, title: str, route: str, name: str, approved: str) -> DataFrame:
    """J-23: one entry per approved (title, route), with how many names led to it and the first of them."""
    return (matches.filter(F.col(approved)).groupBy(title, route)
            .agg(F.count_distinct(name).alias("names"), F.min(name).alias("first_name")))


def _designations(rows: DataFrame, key: str, number: str, state: str) -> DataFrame:
    """Each row's number without its toll suffix, and its jurisdiction, once; ``_several`` where the key has more than one."""
    each = rows.select(key, F.regexp_replace(F.col(number), "D$", "").alias("_n"), state).distinct()
    several = each.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("_several"))
    return each.join(several, key, "left").withColumn("_several", F.coalesce("_several", F.lit(True)))


def numbers_in_states(titles: DataFrame, routes: DataFrame, title: str, route: str, number: str, state: str) -> DataFrame:
    """J-24: titles and routes that share a number (toll suffix aside) and a jurisdiction.

    Both sides come as one row per (number, jurisdiction).  Only where a title and a route both have several
    can a pair come twice, so only those pairs are made distinct; the others leave the join as they are.
    """
    a = _designations(titles, title, number, state).withColumnRenamed("_several", "_a")
    b = _designations(routes, route, number, state).withColumnRenamed("_several", "_b")
    once = skew_join(a, b, ["_n", state]).filter(~(F.col("_a") & F.col("_b"))).select(title, route)
    return once.unionByName(skew_join(a.filter("_a"), b.filter("_b"), ["_n", state]).select(title, route).distinct())


def linked_by_number(pairs: DataFrame, titles: DataFrame, routes: DataFrame, title: str, route: str, number: str, state: str) -> DataFrame:
    """J-24: those of the given pairs that :func:`numbers_in_states` links, without making all its links."""
    a, b = (_designations(df, key, number, state).drop("_several") for df, key in ((titles, title), (routes, route)))
    return pairs.select(title, route).join(a, title).join(b, [route, "_n", state], "left_semi").select(title, route).distinct()


def relabel(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """J-30: name by the alias table, else its own slug (``aliases`` has name, alias)."""
    return (names.join(aliases.select(F.col("name").alias(name), "alias"), name, "left")
            .withColumn("key", F.coalesce("alias", slug(F.col(name)))).drop("alias"))


def rename(segments: DataFrame, rules: DataFrame, state: str, name: str, line: str) -> DataFrame:
    """J-31: segments renamed by rules on (state, name) and, where listed, the line id.

    ``rules`` has state, name, line (null for any), as_name.  A rule for one line wins over one for all.
    """
    exact = rules.filter(F.col(line).isNotNull()).select(state, name, line, F.col("as_name").alias("_one"))
    general = rules.filter(F.col(line).isNull()).select(state, name, F.col("as_name").alias("_all"))
    return (segments.join(exact, [state, name, line], "left").join(general, [state, name], "left")
            .withColumn("read_as", F.coalesce("_one", "_all", name)).drop("_one", "_all"))


def unmatched_rules(segments: DataFrame, rules: DataFrame, state: str, name: str, line: str) -> DataFrame:
    """J-31: rules, and listed ids, that no segment bears out."""
    exact = rules.filter(F.col(line).isNotNull()).join(segments.select(state, name, line).distinct(), [state, name, line], "left_anti")
    general = rules.filter(F.col(line).isNull()).join(segments.select(state, name).distinct(), [state, name], "left_anti")
    return exact.select(state, name, line, "as_name").unionByName(general.select(state, name, line, "as_name"))


def correct(listed: DataFrame, corrections: DataFrame, keys: list[str], value: str) -> DataFrame:
    """J-32: replace listed figures; a correction written for another published value fails the job.

    ``corrections`` has the keys, published and corrected.
    """
    changed = F.col("published").isNotNull() & (F.col("published") != F.col(value))
    checked = F.when(changed, F.raise_error(F.concat_ws(" ", F.lit("the published value changed for"), *[F.col(k).cast("string") for k in keys])).cast("double")) \
        .otherwise(F.coalesce("corrected", value))
    return listed.join(corrections, keys, "left").withColumn(value, checked).drop("published", "corrected")


def translate_names(names: DataFrame, name: str, dictionary: DataFrame, splitter: str = " & | - ") -> DataFrame:
    """J-33: a composite name translated part by part; null unless every part is known.

    ``dictionary`` has word and translation.
    """
    parts = (names.select(name).distinct()
             .select(name, F.posexplode(F.split(name, splitter)).alias("_p", "word")).join(dictionary, "word", "left"))
    # The parts of one name are gathered again, never more than one name holds.
    return (parts.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("_p", "translation"))).alias("_t"))
            .select(name, F.when(F.forall("_t", lambda x: x["translation"].isNotNull()),
                                 F.array_join(F.transform("_t", lambda x: x["translation"]), " & ")).alias("translated")))


def rounded_official(total: Column) -> Column:
    return js_round(total * 10) / 10.0
