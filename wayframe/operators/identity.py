"""Ids, names, sorting and search over the route index (W-1..W-4, W-7..W-9, O-1..O-3, U-1..U-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .ordered import first_by, positions, top_k


def assign_ids(routes: DataFrame, key: str, slug: Column, miles: str, state: str, tie: str, per_state: Column) -> DataFrame:
    """W-1: ids within a key by length: alone the slug, else slug and position, or slug and jurisdiction.

    ``per_state`` marks systems numbered per jurisdiction, whose pieces are told apart by
    position.  The rest carry their jurisdiction, and its position if it holds several.
    """
    order = [F.col(miles).desc(), F.col(tie)]
    ranked = positions(routes, [key], order, miles, descending=True, name="_n")
    ranked = positions(ranked, [key, state], order, miles, descending=True, name="_s")
    sizes = routes.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    same = routes.groupBy(key, state).agg(F.count(F.lit(1)).alias("_same"))
    n = ranked.join(sizes, key).join(same, [key, state])
    suffix = (F.when(F.col("_all") == 1, "").when(per_state, F.concat(F.lit("-"), F.col("_n").cast("string")))
              .otherwise(F.concat(F.lit("-"), F.lower(F.col(state)),
                                  F.when(F.col("_same") > 1, F.concat(F.lit("-"), F.col("_s").cast("string"))).otherwise(""))))
    made = n.withColumn("route_id", F.regexp_replace(F.lower(F.concat(slug, suffix)), "[^a-z0-9-]", ""))
    return make_unique(made.drop("_n", "_s", "_all", "_same"), "route_id", miles, tie)


def make_unique(routes: DataFrame, name: str, miles: str, tie: str) -> DataFrame:
    """W-1: a repeated id gets its count appended from the second on."""
    numbered = positions(routes, [name], [F.col(miles).desc(), F.col(tie)], miles, descending=True, name="_u")
    return numbered.withColumn(name, F.when(F.col("_u") == 1, F.col(name)).otherwise(
        F.concat_ws("-", F.col(name), F.col("_u").cast("string")))).drop("_u")


def drop_remnants(routes: DataFrame, key: str, miles: str) -> DataFrame:
    """W-2: drop zero-mile pieces beside a longer one of the same key."""
    longer = routes.filter(F.col(miles) > 0).select(key).distinct()
    zero = routes.filter(F.col(miles) == 0).join(longer, key, "left_anti")
    return routes.filter(F.coalesce(F.col(miles), F.lit(-1.0)) != 0).unionByName(zero)


def disambiguate(routes: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """W-3: where a key has several routes, the end that tells each apart, or both ends."""
    one = F.when(F.col(start).isNotNull() & ~F.col(start).eqNullSafe(F.col(end)), F.col(start)).otherwise(F.coalesce(end, start))
    several = routes.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("_several"))
    named = routes.join(several, key).withColumn("_one", F.when(F.col("_several"), one))
    shared = named.filter(F.col("_one").isNotNull()).groupBy(key, "_one").agg(F.count(F.lit(1)).alias("_same"))
    both = F.when((F.col("_same") > 1) & F.col(start).isNotNull() & F.col(end).isNotNull(),
                  F.concat(F.col(start), F.lit(" – "), F.col(end))).otherwise(F.col("_one"))
    return named.join(shared, [key, "_one"], "left").withColumn("where", both).drop("_one", "_same", "_several")


def longest_per(routes: DataFrame, keys: list[str], miles: str, tie: str, keep: list[str]) -> DataFrame:
    """W-4, J-12: the longest route per key."""
    return first_by(routes, keys, [-F.col(miles), F.col(tie)], keep)


def latest_per(rows: DataFrame, keys: list[str], date: str, tie: str, keep: list[str]) -> DataFrame:
    """W-7, S-18: the newest row per key."""
    return first_by(rows, keys, [F.col(date), F.col(tie)], keep, largest=True)


def chainage_length(posts: DataFrame, number: str, km: str) -> DataFrame:
    """W-8: register length from the least and greatest chainage."""
    return posts.groupBy(number).agg(F.min(km).alias("from_km"), F.max(km).alias("to_km"), F.round(F.max(km) - F.min(km), 3).alias("km"))


def termini(edges: DataFrame, route: str, seq: str, name: str, flipped: str) -> DataFrame:
    """W-9: first and last stated name along the path; swapped where the line was turned round."""
    stated = F.when(F.col(name).isNotNull(), F.col(seq))
    ends = edges.groupBy(route).agg(F.min_by(name, stated).alias("_a"), F.max_by(name, stated).alias("_b"), F.max(flipped).alias("_f"))
    return ends.select(route, F.when(F.col("_f"), F.col("_b")).otherwise(F.col("_a")).alias("start_name"),
                       F.when(F.col("_f"), F.col("_a")).otherwise(F.col("_b")).alias("end_name"))


def numeric_order(number: Column) -> list[Column]:
    """O-1: numbers by value, then by what follows them."""
    return [F.regexp_extract(number, r"^\D*(\d+)", 1).try_cast("int").asc_nulls_last(), number]


def top(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """O-2: the first k rows of a report."""
    return rows.orderBy(*order).limit(k)


def haystack(routes: DataFrame, *columns: str) -> DataFrame:
    """O-3: the folded text a route is searched by."""
    return routes.withColumn("hay", fold(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])))


def search(routes: DataFrame, phrase: str, label: str, number: str, names: list[str], miles: str, tie: str, tier: str | None = None,
           here: Column | None = None, k: int = 300) -> DataFrame:
    """O-3: the ``k`` best routes whose haystack holds every term, and ``total``, the number of all.

    An exact label counts most, then an exact number, then a name that starts with the phrase;
    then the tier, being in the region on screen (``here``), and the length.
    """
    want = " ".join(phrase.upper().split()).replace("\u2013", "-").replace("\u2014", "-")
    hits = routes.filter(reduce(lambda a, b: a & b, [F.col("hay").contains(term) for term in want.split(" ")]))
    nothing = F.lit(0)
    named = reduce(lambda a, b: a | b, [F.coalesce(fold(F.col(n)).startswith(want), F.lit(False)) for n in names])
    score = (F.when(fold(F.col(label)) == want, -400).otherwise(nothing) + F.when(F.col(number).cast("string") == want, -300).otherwise(nothing)
             + F.when(named, -250).otherwise(nothing)
             + (F.when(F.col(tier) == "primary", -60).when(F.col(tier) == "auxiliary", -20).otherwise(nothing) if tier else nothing)
             + (F.when(here, -15).otherwise(nothing) if here is not None else nothing) - F.least(F.col(miles), F.lit(3000)) / 100)
    total = hits.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return hits.withColumn("score", score).withColumn("total", F.lit(total).cast("bigint")).orderBy("score", tie).limit(k)


def search_many(routes: DataFrame, phrases: DataFrame, phrase_id: str, term: str, route: str) -> DataFrame:
    """O-3: many searches at once: routes whose words include every term of a phrase.

    ``phrases`` has one row per (phrase, term).  Both sides meet on the word, so no phrase is
    compared with a route it shares nothing with.
    """
    words = routes.select(route, F.explode(F.array_distinct(F.split("hay", " "))).alias("_w"))
    needed = phrases.select(phrase_id, fold(F.col(term)).alias("_w")).distinct()
    counts = needed.groupBy(phrase_id).agg(F.count(F.lit(1)).alias("_need"))
    got = words.join(needed, "_w").groupBy(phrase_id, route).agg(F.count(F.lit(1)).alias("_got"))
    return got.join(counts, phrase_id).filter(F.col("_got") == F.col("_need")).select(phrase_id, route)


def concat_tables(*tables: DataFrame) -> DataFrame:
    """U-1, S-12: outputs of several countries in one table; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def difference(a: DataFrame, b: DataFrame, keys: list[str], only_a: str, only_b: str) -> DataFrame:
    """U-3, J-18: keys of either table that the other lacks."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return (ka.join(kb, keys, "left_anti").withColumn("side", F.lit(only_a))
            .unionByName(kb.join(ka, keys, "left_anti").withColumn("side", F.lit(only_b))))


def merge_keys(rows: DataFrame, key: str, merges: DataFrame) -> DataFrame:
    """U-4: rows of concurrent designations under one key (``merges`` maps key to into)."""
    return (rows.join(merges.withColumnRenamed("into", "_into"), key, "left")
            .withColumn(key, F.coalesce("_into", key)).drop("_into"))


__all__ = ["assign_ids", "make_unique", "drop_remnants", "disambiguate", "longest_per", "latest_per", "chainage_length", "termini",
           "numeric_order", "top", "top_k", "haystack", "search", "search_many", "concat_tables", "difference", "merge_keys"]
