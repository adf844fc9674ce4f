"""Testing planned constraints and changes against the rows themselves.

Keys are counted before they are shuffled, so a value held by most rows costs
one row per task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.skew import running

# Canonical type names and the Spark type used to test a cast.
CAST_TYPES = {
    "smallint": "smallint",
    "integer": "int",
    "bigint": "bigint",
    "real": "float",
    "double precision": "double",
    "boolean": "boolean",
    "date": "date",
    "timestamp without time zone": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "text": "string",
}


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def _all_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def _counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def primary_key_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Keys with a null part, and keys held by more than one row."""
    reason = F.when(_any_null(columns), F.lit("null")).when(
        F.col("row_count") > 1, F.lit("duplicate")
    )
    return _counted(rows, columns).withColumn("reason", reason).where(F.col("reason").isNotNull())


def unique_violations(
    rows: DataFrame, columns: list[str], *, nulls_not_distinct: bool = False
) -> DataFrame:
    """Keys held by more than one row; keys with nulls count only on request."""
    if not nulls_not_distinct:
        rows = rows.where(~_any_null(columns))
    return _counted(rows, columns).where(F.col("row_count") > 1)


def foreign_key_violations(
    rows: DataFrame,
    columns: list[str],
    referenced: DataFrame,
    ref_columns: list[str],
    *,
    match: str = "simple",
) -> DataFrame:
    """Keys without a referenced row.

    ``simple``: a key with any null passes.  ``full``: all parts null passes, some
    null is a violation.  The server does not implement ``partial``.
    """
    if match not in ("simple", "full"):
        raise ValueError(f"match type {match!r} is not supported")
    if len(columns) != len(ref_columns):
        raise ValueError("columns and ref_columns differ in length")
    exempt = _any_null(columns) if match == "simple" else _all_null(columns)
    keys = _counted(rows.where(~exempt), columns)
    targets = referenced.select(*[F.col(r).alias(c) for c, r in zip(columns, ref_columns, strict=True)])
    return keys.join(targets, columns, "left_anti")


def check_violations(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows where the condition is false; null passes."""
    return rows.where(~condition)


def not_null_violations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null rows per column, for columns that have any."""
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "null_rows").where(F.col("null_rows") > 0)


def exclusion_violations(
    rows: DataFrame, equal: list[str], start: str, end: str, tie: list[str]
) -> DataFrame:
    """Rows whose range [start, end) overlaps an earlier row with equal columns.

    Instead of comparing rows pairwise, each row meets the greatest end before
    it.  Null equal columns never conflict, empty ranges overlap nothing.
    """
    candidates = rows.where(~_any_null(equal) & (F.col(start) < F.col(end)))
    seen = running(
        candidates, equal, [start, end, *tie], {"earlier_end": ("max", F.col(end))}, exclusive=True
    )
    return seen.where(F.col(start) < F.col("earlier_end"))


def row_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    return _counted(rows, key)


def rows_at_risk(graded: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows lost by drops and rewritten by type changes.

    ``counts``: pair_id, namespace, table_name, row_count.
    """
    kind = F.col("kind")
    effect = F.when(kind.isin("drop_table", "drop_column", "replace_column"), F.lit("lost")).when(
        kind == "alter_column_type", F.lit("rewritten")
    )
    located = graded.withColumn("effect", effect).where(F.col("effect").isNotNull())
    return (
        located.withColumn("table_name", F.coalesce("parent_name", "name"))
        .join(counts, ["pair_id", "namespace", "table_name"])
        .select("pair_id", "namespace", "table_name", "name", "kind", "effect", "row_count")
    )


# Other spellings of types, and the texts that stand for a boolean.
_SPELLINGS = {
    "int2": "smallint", "int4": "integer", "int": "integer", "int8": "bigint", "float4": "real", "float8": "double precision",
    "bool": "boolean", "varchar": "character varying", "char": "character", "bpchar": "character", "decimal": "numeric",
    "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone",
}
_TRUTHS = ["t", "tr", "tru", "true", "y", "ye", "yes", "on", "1", "f", "fa", "fal", "fals", "false", "n", "no", "of", "off", "0"]
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_UUID = r"^\{?[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7}\}?$"
_UNITS = "(microsecond|millisecond|second|sec|minute|min|hour|day|week|month|mon|year|decade|century|centurie|millennium)s?"
_CLOCK = r"[+-]?[0-9]+:[0-5]?[0-9](:[0-5]?[0-9](\.[0-9]+)?)?"
_INTERVAL = (
    rf"(?i)^([+-]?[0-9]+(\.[0-9]+)? *{_UNITS}( +|$))*({_CLOCK})?( *ago)?$"
    r"|^P([+-]?[0-9]+Y)?([+-]?[0-9]+M)?([+-]?[0-9]+W)?([+-]?[0-9]+D)?(T([+-]?[0-9]+H)?([+-]?[0-9]+M)?([+-]?[0-9]+(\.[0-9]+)?S)?)?$"
)
_TIME = r"^([01]?[0-9]|2[0-4]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?( ?(Z|[+-][0-9]{1,2}(:?[0-5][0-9])?))?$"
_TYPE = re.compile(r'\s*"?([a-z][a-z0-9_ ]*?)"?\s*(?:\(\s*([0-9]+)\s*(?:,\s*([0-9]+)\s*)?\))?\s*((?:with|without) time zone)?\s*((?:\[[0-9]*\])*)\s*')


@dataclass(frozen=True)
class TargetType:
    """A type text taken apart: name, modifiers and number of array dimensions."""

    name: str
    first: int | None = None
    second: int | None = None
    dimensions: int = 0


def parse_type(text: str) -> TargetType:
    found = _TYPE.fullmatch(text.lower())
    if found is None:
        raise ValueError(f"no type {text!r}")
    name = " ".join(x for x in (found[1], found[4]) if x)
    numbers = [None if n is None else int(n) for n in (found[2], found[3])]
    return TargetType(_SPELLINGS.get(name, name), *numbers, found[5].count("["))


def _without_trailing_blanks(value: Column, length: int) -> Column:
    """Whether a text fits a length; blanks beyond it are cut off, other characters are not."""
    return F.length(F.rtrim(value)) <= length


def fits(value: Column, target: TargetType) -> Column:
    """Whether a text can become a value of the type when a column is altered to it."""
    text = F.trim(value)
    if target.dimensions:
        # A text in braces; elements are separated by commas outside of quotes.
        element = TargetType(target.name, target.first, target.second)
        body = F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1)
        if target.dimensions > 1:
            raise ValueError("no cast test for arrays of arrays")
        items = F.filter(F.split(body, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.upper(F.trim(x)) != "NULL")
        plain = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), '^"|"$', ""), r'\\(.)', "$1"))
        return text.rlike(r"(?s)^\{.*\}$") & ((F.trim(body) == "") | F.forall(plain, lambda x: fits(x, element)))
    name, first, second = target.name, target.first, target.second
    if name in ("character varying", "character"):
        length = first if first is not None else (1 if name == "character" else None)
        return F.lit(True) if length is None else _without_trailing_blanks(value, length)
    if name == "numeric":
        number = text.rlike(_NUMBER)
        if first is None:
            return number
        scale = second or 0
        if first <= 38:
            return number & text.try_cast(f"decimal({first},{scale})").isNotNull()
        whole = F.regexp_extract(text, r"^[+-]?0*([0-9]*)", 1)
        return number & ~text.rlike("[eE]") & (F.length(whole) <= first - scale)
    if name == "uuid":
        return text.rlike(_UUID)
    if name == "interval":
        return (text != "") & ~text.rlike("^P?T?$") & text.rlike(_INTERVAL)
    if name in ("time without time zone", "time with time zone", "time"):
        return text.rlike(_TIME)
    if name == "boolean":
        return F.lower(text).isin(_TRUTHS)
    if name in ("json", "jsonb"):
        return F.try_parse_json(value).isNotNull()
    if name in ("smallint", "integer", "bigint"):
        return text.rlike("^[+-]?[0-9]+$") & text.try_cast(CAST_TYPES[name]).isNotNull()
    if name in CAST_TYPES:
        return text.try_cast(CAST_TYPES[name]).isNotNull() if name != "text" else F.lit(True)
    raise ValueError(f"no cast test for type {name!r}")


def cast_violations(rows: DataFrame, column: str, data_type: str) -> DataFrame:
    """Distinct values that do not fit the new type, with their row counts.

    ``data_type`` is the type's text: lengths, precision and scale, and one array
    dimension are tested too.
    """
    value = F.col(column)
    values = rows.where(value.isNotNull() & ~F.coalesce(fits(value.cast("string"), parse_type(data_type)), F.lit(False)))
    return _counted(values, [column])
