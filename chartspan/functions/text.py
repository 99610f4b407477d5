"""Text expressions: terms, token estimates, truncation, clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}_]+"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def terms(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), F.lit(0))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def last_tokens(c: Column, n: int) -> Column:
    """The end of the text that holds n estimated tokens."""
    if n <= 0:
        return F.lit("")
    return F.when(F.length(c) <= 4 * n, c).otherwise(F.right(c, F.lit(4 * n)))


def head_tail(c: Column, most: int, mark: str = " [truncated] ") -> Column:
    """Of a longer text the first and the last half of what remains of `most` beside the mark; shorter ones stay."""
    if most <= 0:
        return c
    half = max(1, (most - 20) // 2)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit(mark), F.right(c, F.lit(half))))


def one_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+"))


def title_case(c: Column) -> Column:
    """Each run of letters starts with a capital: O'Neil-Smith, where initcap gives O'neil-smith."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def vocabulary_of(code: Column, missing: str | None = None) -> Column:
    """What stands before the first slash; without a slash the whole code, or `missing`."""
    whole = code if missing is None else F.lit(missing)
    return F.when(F.contains(code, F.lit("/")), F.split_part(code, F.lit("/"), F.lit(1))).otherwise(whole)


def clamp_words(c: Column, most: int) -> Column:
    return F.array_join(F.slice(F.split(one_spaced(c), " "), 1, most), " ")
