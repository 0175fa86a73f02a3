"""Column expressions. All are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One grammar for numbers; `nan`, `inf`, `5_0` and `50d` are none.
NUMBER = r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"
SPACE_AROUND = r"(?U)^\s+|\s+$"


def text(c: Column) -> Column:
    """Null as empty text."""
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text(c), SPACE_AROUND, "")


def blank(c: Column) -> Column:
    return F.length(stripped(c)) == 0


def number(c: Column) -> Column:
    """A double, or null for what the grammar does not accept."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def percent(c: Column) -> Column:
    """A double from 0 to 100, or null."""
    v = number(c)
    return F.when(v.between(0, 100), v)


def iso_date(c: Column) -> Column:
    """A date written yyyy-MM-dd, or null."""
    return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


def decimal_text(c: Column) -> Column:
    """Digits, with a point and digits after them or without."""
    return c.rlike(r"\A[0-9]+(\.[0-9]+)?\z")


def differs(x: Column, y: Column, tolerance: float) -> Column:
    return F.abs(x - y) > F.lit(float(tolerance))


def among(c: Column, allowed: Iterable[str]) -> Column:
    """False for null."""
    return text(c).isin(*allowed)


def mean(*columns: Column) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / len(columns)


def combined(miss: Column, false_flip: Column) -> Column:
    """100 less the mean of two error rates."""
    return 100 - (miss + false_flip) / 2


def one_decimal(c: Column, missing: str = "—") -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit(missing)).otherwise(F.format_string("%.1f", c))


def html(c: Column) -> Column:
    """With the five special characters as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def has_term(c: Column, terms: Iterable[str]) -> Column:
    """Some term stands in the text, in any case; false for null."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(F.lower(text(c)), F.lit(term.lower()))
    return found


def trained(method: Column) -> Column:
    """Any method but zero-shot, also an empty one."""
    return F.lower(text(method)) != "zero-shot"


def haystack(*columns: Column) -> Column:
    """The fields in lower case with a space between, so that a search may span two."""
    return F.lower(F.concat_ws(" ", *[text(c) for c in columns]))


def missing_last(c: Column, ascending: bool) -> list[Column]:
    """Sort keys that put null and NaN last in either direction."""
    gone = c.isNull() | F.isnan(c)
    return [gone.asc(), c.asc() if ascending else c.desc()]


def quoted_replacement(s: str) -> str:
    """A replacement in which `$` and the backslash stand for themselves."""
    return s.replace("\\", "\\\\").replace("$", "\\$")
