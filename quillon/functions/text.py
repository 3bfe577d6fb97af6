"""Text helpers as Column expressions: trimming, lines, stable ordering keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the line boundaries of universal newlines.
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Without white space at either end (Unicode)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def lines(c: Column) -> Column:
    """Non-empty stripped lines."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: x != "")


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def order_key(seed: str, *cols: Column) -> Column:
    """A reproducible pseudo-random order: md5 of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(c.cast("string") for c in cols)))
