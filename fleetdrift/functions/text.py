"""Small string helpers shared by the parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_blank(col: Column) -> Column:
    """Strip every kind of white space on both ends, not only spaces."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    Expressions that use one intermediate result many times grow exponentially
    when they are nested as plain Columns.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_quotes(col: Column) -> Column:
    return F.regexp_replace(col, '^"+|"+$', "")


def null_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """Regex group, null where the pattern or the group does not match."""
    return null_if_empty(F.regexp_extract(col, pattern, group))


def name_list(col: Column) -> Column:
    """Comma separated identifiers as an array without blanks and quotes."""
    plain = lambda part: part.rlike(r"^\w+\z")
    return F.transform(F.split(col, ","), lambda part: F.when(plain(part), part).otherwise(strip_quotes(trim_blank(part))))


def map_values(col: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """CASE over literal values."""
    chain = None
    for key, value in values.items():
        chain = (chain.when if chain is not None else F.when)(col == key, F.lit(value))
    return chain.otherwise(default if default is not None else F.lit(None))
