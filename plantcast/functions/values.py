"""SQL fragments and column helpers for coercion and rounding.

Expressions are written as SQL text: Spark parses a whole one in a single call, where
building it from column functions would take a call to the JVM per node.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(value: float | date | datetime) -> str:
    """SQL literal of a double, a date or a timestamp without time zone."""
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ'{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE'{value.isoformat()}'"
    return f"{float(value)!r}D"


def number_sql(c: str) -> str:
    return f"nanvl(try_cast({c} AS double), CAST(NULL AS double))"


def number(c: str) -> Column:
    """Double value of a column of any type; unreadable text and NaN become null."""
    return F.expr(number_sql(c))


def number_or(c: str, default: float) -> Column:
    return F.expr(f"coalesce({number_sql(c)}, {literal(default)})")


def leading_integer(c: str) -> Column:
    """Integer that a text starts with: ``' 12ab'`` is 12, ``'ab'`` is 0, null stays null.

    A run of digits too long for a bigint gives null.
    """
    digits = rf"regexp_extract({c}, r'^\s*\+?([0-9]+)', 1)"
    return F.expr(f"CASE WHEN {digits} <> '' THEN try_cast({digits} AS bigint) WHEN {c} IS NOT NULL THEN 0L END")


def half_even_sql(c: str, digits: int = 0) -> str:
    """Round a double with ties to the even neighbour, by scaling as numpy does."""
    scale = literal(10**digits)
    return f"rint({c})" if digits == 0 else f"rint({c} * {scale}) / {scale}"


def half_even(c: str, digits: int = 0) -> Column:
    return F.expr(half_even_sql(c, digits))


def whole_sql(c: str) -> str:
    """Nearest whole number, ties to even."""
    return f"CAST(rint({c}) AS bigint)"


def truncated_sql(c: str) -> str:
    """Total cut to a whole number towards zero; nothing to add up counts as 0."""
    return f"CAST(coalesce({c}, 0) AS bigint)"
