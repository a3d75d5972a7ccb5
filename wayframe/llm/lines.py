"""Line dedup: lines that an earlier line equals, or all but one word of it. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut
from .registry import query, table

# Lines of fewer words are compared as they are; longer ones within one word added, lost or changed.
NEAR_WORDS = 8
# Stands for a null id in the order of lines.
NO_ID = -(1 << 63)


BLANK = " \t\r\x0b\f"


def _words(line: Column) -> Column:
    """Words of a line that has some."""
    return F.split(F.btrim(F.lower(line), F.lit(BLANK)), "[ \\t\\r\\x0B\\f]+")


def _doc() -> Column:
    """The id in the order of lines."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def _named(docs: DataFrame) -> DataFrame:
    """(doc, tx, text): a text goes by its id and its hash, as an id may be null or stand for several texts."""
    return docs.select(_doc().alias("doc"), F.xxhash64("text").alias("tx"), "text")


def _split_lines(docs: DataFrame) -> DataFrame:
    """(doc, tx, pos, words) of every line with words."""
    return (_named(docs).select("doc", "tx", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter(F.btrim("line", F.lit(BLANK)) != "").select("doc", "tx", "pos", _words(F.col("line")).alias("words")))


def _half_keys(words: Column, n: Column) -> Column:
    """Hashes of about half the words, from the front and from the back.

    Two lines within one edit share a front or a back of half the shorter one's words; lines
    of an even number of words give a half for partners of either length.
    """
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.array_distinct(F.array(*[F.xxhash64(F.lit(side), p, F.slice(words, 1, p) if side == 0 else F.slice(words, n - p + 1, p))
                                      for side in (0, 1) for p in (low, high)]))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, n, doc, tx, pos, keys): each different line, by 128 bits of its words, with the place where it stands first."""
    lines = _split_lines(docs)
    n = F.size("words")
    keys = F.when(n >= NEAR_WORDS, _half_keys(F.col("words"), n))
    hashed = lines.select("doc", "tx", "pos", n.alias("n"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"), keys.alias("keys"))
    # Combined in each task before the shuffle, so a line that stands everywhere sends one row a task.
    return (hashed.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc", "tx", "pos")).alias("first"), F.first("keys").alias("keys"))
            .select("h1", "h2", "n", "first.doc", "first.tx", "first.pos", "keys"))


def _variants(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, doc, tx, pos, cut): the deletion variants of the wanted lines.

    A variant is a line without its word after the first ``cut`` ones, or the line itself parted
    there; its key is made of what stands before and, counted from the end, behind.  Lines with
    equal keys are equal but for at most the word at that place, so each is within one edit of
    all others.  Running sums (by exclusive or) give all keys of a line in one pass.
    Repeated rows are taken once, as equal words would undo each other there.
    """
    of_doc = wanted.groupBy("doc", "tx").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("front", "back")))).alias("_wanted"))
    some = (_named(docs).join(of_doc, ["doc", "tx"]).groupBy("doc", "tx").agg(F.first("text").alias("text"), F.first("_wanted").alias("_wanted"))
            .select("doc", "tx", "_wanted", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("_half", F.col("_wanted")[F.col("pos")])
            .filter(F.col("_half").isNotNull()).select("doc", "tx", "pos", "_half.front", "_half.back", _words(F.col("line")).alias("words")))
    n = F.size("words")
    word = some.select("doc", "tx", "pos", "front", "back", n.alias("n"), F.posexplode("words").alias("i", "word"))
    word = word.select("doc", "tx", "pos", "front", "back", "n", "i", F.xxhash64("word", "i").alias("f"), F.xxhash64("word", F.col("n") - F.col("i")).alias("b"))
    line = W.partitionBy("doc", "tx", "pos")
    ahead = line.orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = word.select("doc", "tx", "pos", "front", "back", "n", "i", "f", F.expr("bit_xor(f)").over(ahead).alias("to"), F.expr("bit_xor(b)").over(ahead).alias("done"), F.expr("bit_xor(b)").over(line).alias("all"), "b")
    low = F.floor((F.col("n") - 1) / 2)

    def row(left: Column, at: Column, pre: Column, suf: Column) -> Column:
        """``left`` words are left, ``at`` of them before the place."""
        # The front half is shared: the edit is behind it; the back half is: it is before that.
        here = (F.col("front") & (at >= low)) | (F.col("back") & (left - at >= low))
        return F.when(here, F.struct(F.xxhash64(left, at, pre, suf).alias("key"), at.cast("int").alias("cut")))

    before, behind = F.col("to").bitwiseXOR(F.col("f")), F.col("all").bitwiseXOR(F.col("done"))
    lost = row(F.col("n") - 1, F.col("i"), before, behind)
    parted = row(F.col("n"), F.col("i"), before, behind.bitwiseXOR(F.col("b")))
    at_end = F.when(F.col("i") == F.col("n") - 1, row(F.col("n"), F.col("n"), F.col("to"), F.lit(0).cast("bigint")))
    return summed.select("doc", "tx", "pos", F.explode(F.array_compact(F.array(lost, parted, at_end))).alias("v")).select("v.key", "doc", "tx", "pos", "v.cut")


def near_lines(docs: DataFrame, different: DataFrame) -> DataFrame:
    """(doc, tx, pos) of the lines within one word of an earlier different line."""
    keyed = different.filter("keys IS NOT NULL").select("doc", "tx", "pos", F.posexplode("keys").alias("side", "half"), "n")
    shared = keyed.groupBy("half").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("half")
    # A line of an odd number of words has one front and one back, of an even number two of each.
    front = F.when(F.col("n") % 2 == 1, F.col("side") < 1).otherwise(F.col("side") < 2)
    wanted = cut(keyed.join(shared, "half", "left_semi").groupBy("doc", "tx", "pos").agg(F.max(front).alias("front"), F.max(~front).alias("back")))
    variants = cut(_variants(docs, wanted))
    first = (variants.groupBy("key").agg(F.min(F.struct("doc", "tx", "pos")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("key", "first"))
    late = (variants.join(first, "key").filter(F.struct("doc", "tx", "pos") > F.col("first"))
            .groupBy("doc", "tx", "pos").agg(F.min(F.struct("first", "cut")).alias("to"))
            .select("doc", "tx", "pos", F.col("to.first.doc").alias("to_doc"), F.col("to.first.tx").alias("to_tx"), F.col("to.first.pos").alias("to_pos"), F.col("to.cut").alias("cut")))
    return _verified(docs, cut(late))


def _verified(docs: DataFrame, late: DataFrame) -> DataFrame:
    """Of the found pairs those whose words are within one edit: equal before the place and behind it."""
    needed = late.select("doc", "tx", "pos").unionByName(late.select(F.col("to_doc").alias("doc"), F.col("to_tx").alias("tx"), F.col("to_pos").alias("pos"))).distinct()
    of_doc = needed.groupBy("doc", "tx").agg(F.collect_set("pos").alias("_places"))
    words = (_named(docs).join(of_doc, ["doc", "tx"])
             .select("doc", "tx", F.posexplode(F.split("text", "\n")).alias("pos", "line"), "_places").filter(F.array_contains("_places", F.col("pos")))
             .groupBy("doc", "tx", "pos").agg(F.min("line").alias("line")).select("doc", "tx", "pos", _words(F.col("line")).alias("words")))
    words = cut(words)
    other = words.select(F.col("doc").alias("to_doc"), F.col("tx").alias("to_tx"), F.col("pos").alias("to_pos"), F.col("words").alias("to_words"))
    both = late.join(words, ["doc", "tx", "pos"]).join(other, ["to_doc", "to_tx", "to_pos"])
    n, m, at = F.size("words"), F.size("to_words"), F.col("cut")
    tail = F.greatest(n, m) - 1 - at

    def behind(words: str, size: Column) -> Column:
        return F.slice(words, F.greatest(size - tail + 1, F.lit(1)), F.greatest(tail, F.lit(0)))

    one = (F.abs(n - m) <= 1) & (F.slice("words", 1, at) == F.slice("to_words", 1, at)) & (behind("words", n) == behind("to_words", m))
    return both.filter(one).select("doc", "tx", "pos")


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc, tx, exact, near): for each text that loses lines, their places."""
    different = cut(distinct_lines(docs))
    lines = _split_lines(docs).select("doc", "tx", "pos", F.size("words").alias("n"), F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"))
    first = different.select("h1", "h2", "n", F.col("doc").alias("to_doc"), F.col("tx").alias("to_tx"), F.col("pos").alias("to_pos"))
    near = near_lines(docs, different)
    # A line goes if it isn't its words' first place, or if those words are within one word of an earlier line.
    goes = first.join(near.select(F.col("doc").alias("to_doc"), F.col("tx").alias("to_tx"), F.col("pos").alias("to_pos"), F.lit(True).alias("near")), ["to_doc", "to_tx", "to_pos"], "left")
    fate = (lines.join(goes, ["h1", "h2", "n"]).withColumn("exact", (F.col("doc") != F.col("to_doc")) | (F.col("tx") != F.col("to_tx")) | (F.col("pos") != F.col("to_pos")))
            .filter(F.col("exact") | F.col("near")).select("doc", "tx", "pos", "exact").distinct())
    return fate.groupBy("doc", "tx").agg(F.collect_set(F.when(F.col("exact"), F.col("pos"))).alias("exact"), F.collect_set(F.when(~F.col("exact"), F.col("pos"))).alias("near"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, ``text`` without the removed lines, and ``lines``, ``exact`` and ``near``: how many it had and lost.

    Columns of those three names that the documents have already are replaced.

    Lines are what line feeds part; words are what white space parts, in lower case.  Lines
    stand in the order of doc_id and place.  A line goes if an earlier one has the same words,
    or, from ``NEAR_WORDS`` words on, if an earlier one is within one word added, lost or
    changed.  It does not matter whether the earlier one stays.

    Lines without words stay and are not compared.  A null text stays null.  Rows with a null
    id stand before all others.  Several texts under one id, or under none, are documents of
    their own in the order of a hash.  Repeated rows have the same places and lose the same
    lines.
    """
    gone = removed_lines(docs.select("doc_id", "text")).select(F.col("doc").alias("__doc"), F.col("tx").alias("__tx"), F.col("exact").alias("__exact"), F.col("near").alias("__near"))
    kept = docs.drop("lines", "exact", "near").withColumns({"__doc": _doc(), "__tx": F.xxhash64("text")}).join(gone, ["__doc", "__tx"], "left")
    lines = F.split("text", "\n")
    left = F.filter(lines, lambda line, i: ~F.array_contains("__exact", i) & ~F.array_contains("__near", i))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return (kept.withColumns({"lines": size(lines), "exact": size(F.col("__exact")), "near": size(F.col("__near"))})
            .withColumn("text", F.when(F.col("__exact").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).drop("__doc", "__tx", "__exact", "__near"))


@query("op8_line_dedup")
def op8(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "lines", "exact", "near", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))
