"""Column and partition attributes of catalog rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetdrift.functions.text import map_values, null_if_empty
from fleetdrift.model import IDENTITY


def default_expression(attgenerated: Column, expression: Column) -> Column:
    """Expression as a default, null when it computes a stored generated column."""
    return F.when(attgenerated == "s", F.lit(None)).otherwise(expression)


def stored_expression(attgenerated: Column, expression: Column) -> Column:
    """Expression of a stored generated column; virtual ones keep a default instead."""
    return F.when(attgenerated == "s", expression)


def nondefault_collation(attcollation: Column, typcollation: Column, collname: Column) -> Column:
    return F.when((attcollation != 0) & (attcollation != typcollation), collname)


def identity_timing(attidentity: Column) -> Column:
    return map_values(attidentity, {"a": "ALWAYS", "d": "BY DEFAULT"})


def identity_spec(is_identity: Column, identity_generated: Column) -> Column:
    """Identity struct; the scans do not read sequence options, so those stay null."""
    timing = F.when(identity_generated == "ALWAYS", F.lit("always")).otherwise(F.lit("by_default"))
    options = [
        F.lit(False if f.name == "cycle" else None).cast(f.dataType).alias(f.name)
        for f in IDENTITY.fields[1:]
    ]
    return F.when(is_identity, F.struct(timing.alias("generated"), *options))


def column_variant(identity: Column, generated_expression: Column) -> dict[str, Column]:
    return {
        "is_identity": identity.isNotNull(),
        "is_generated_stored": generated_expression.isNotNull(),
        "is_plain": identity.isNull() & generated_expression.isNull(),
    }


def partition_strategy(code: Column) -> Column:
    """Strategy of a code, range for unknown codes."""
    return map_values(code, {"h": "hash", "l": "list", "r": "range"}, F.lit("range"))


def partition_info(strategy: Column, key: Column) -> Column:
    """Present only if both the strategy and the key are set."""
    return F.when(
        strategy.isNotNull() & key.isNotNull(),
        F.struct(partition_strategy(strategy).alias("strategy"), key.alias("partition_key")),
    )


def partition_of(parent_schema: Column, parent_table: Column, bound: Column) -> Column:
    """Present only if both parent names are set; an empty bound becomes null."""
    return F.when(
        parent_schema.isNotNull() & parent_table.isNotNull(),
        F.struct(
            parent_schema.alias("parent_namespace"),
            parent_table.alias("parent_name"),
            null_if_empty(bound).alias("partition_bound"),
        ),
    )
