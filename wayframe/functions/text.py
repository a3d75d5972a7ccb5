"""Text columns: cleaning, folding, splitting (P-14, P-17..P-19, P-35, P-37, P-43)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the plain letters they fold to, pairwise.
ACCENTED = "ÁÀÂÄÃÅáàâäãåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÖÕóòôöõÚÙÛÜúùûüÑñÇçÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuNnCcYyy"

# Texts that mean "not stated".
SENTINELS = ("", "N/A", "N/D", "NA", "ND", "NONE", "UNKNOWN", "NULL", "-1", "SIN DATO", "SIN DATOS")

# The marks left by UTF-8 text decoded twice.
DOUBLE_ENCODED = r"Ã[\x{80}-\x{BF}]|Â[\x{80}-\x{BF}]|â€"

# Full-width letters and digits and their ASCII forms, pairwise.
FULL_WIDTH = "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９"
HALF_WIDTH = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def null_if_sentinel(text: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """P-14: trimmed text, null when it only says that nothing is known."""
    trimmed = F.trim(text)
    return F.when(~F.upper(trimmed).isin(*sentinels), trimmed)


def unaccent(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """P-17: upper case without accents, runs of spaces as one."""
    return F.trim(F.regexp_replace(F.upper(unaccent(text)), r"\s+", " "))


def squash(text: Column) -> Column:
    """P-17: letters and digits only."""
    return F.regexp_replace(F.upper(unaccent(text)), r"[^A-Z0-9]+", "")


def words_key(text: Column) -> Column:
    """P-17: lower-case words joined by single spaces, other signs dropped."""
    return F.trim(F.regexp_replace(F.lower(unaccent(text)), r"[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    """J-30: words joined by hyphens."""
    return F.regexp_replace(words_key(text), " ", "-")


def half_width(text: Column) -> Column:
    """P-23: full-width letters and digits as ASCII."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def expand(text: Column, rules: list[tuple[str, str]]) -> Column:
    """P-18: apply an ordered list of (pattern, replacement) rules."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def expand_words(text: Column, words: dict[str, str]) -> Column:
    """P-18: replace whole words by a small fixed word list."""
    table = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def unbracket(text: Column) -> Column:
    """P-19: drop bracketed parts."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", " "), r"\s+", " "))


def double_encoded(text: Column) -> Column:
    """P-35: how many marks of double encoding a text holds (counted, not repaired)."""
    return F.regexp_count(text, F.lit(DOUBLE_ENCODED))


def mentioned_numbers(text: Column, pattern: str) -> Column:
    """P-37: distinct route numbers written in a free text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def cell_list(text: Column, pattern: str = r"[,;/]") -> Column:
    """P-37: a list cell as trimmed, non-empty items."""
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def other_names(*names: Column) -> Column:
    """P-43: distinct names that are stated, in priority order, as one text."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*names))), " ")
