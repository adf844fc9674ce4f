"""Identifiers: quoting, system schemas, globs, sort keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_ident(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def qualified_name(*parts: Column) -> Column:
    """Quoted parts joined by dots; null parts are left out."""
    return F.concat_ws(".", *[quote_ident(part) for part in parts])


def is_user_schema(name: Column, *, strict: bool = False) -> Column:
    """True for schemas that are not the server's own.

    The default keeps the wildcard of the pattern ``pg_%``: any name starting
    with "pg" and at least one more character is dropped.  ``strict`` takes the
    underscore literally.
    """
    system = name.startswith("pg_") if strict else name.like("pg_%")
    return ~system & (name != "information_schema")


def glob_to_regex(glob: Column) -> Column:
    """Anchored regex of a glob: ``*`` any text, ``?`` one character, rest literal."""
    quoted = F.regexp_replace(glob, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(
        F.lit("(?s)^"),
        F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")),
        F.lit("$"),
    )


def sort_key(namespace: Column, parent: Column, name: Column, op: Column, kind: Column) -> Column:
    """Array to order deltas by: (namespace[, parent], name, op), then the kind.

    The kind is appended because several alterations of one column share the rest.
    """
    return F.when(parent.isNull(), F.array(namespace, name, op, kind)).otherwise(
        F.array(namespace, parent, name, op, kind)
    )
