"""Every rule of the catalog model as a report of its violations.

Each function takes flat model tables and returns ``db_id, rule, object,
detail``, one row per violation, instead of stopping at the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.functions.names import qualified_name
from fleetdrift.model import OVERLOADED_KINDS, SUB_OBJECT_KINDS
from fleetdrift.sources.mapping import TABLE_KEY


def _blank(name: str) -> Column:
    return F.coalesce(F.length(name) == 0, F.lit(True))


def _report(rows: DataFrame, rule: str, broken: Column, obj: Column, detail: Column) -> DataFrame:
    return rows.where(broken).select(
        "db_id",
        F.lit(rule).alias("rule"),
        obj.alias("object"),
        detail.cast("string").alias("detail"),
    )


def _own_name() -> Column:
    return F.concat_ws(".", "namespace", "name")


def _column_name() -> Column:
    return F.concat_ws(".", *TABLE_KEY[1:], "name")


# --- references: db_id, kind, namespace, name, parent_kind, arg_signature ---


def missing_parent(refs: DataFrame) -> DataFrame:
    """Columns, constraints, triggers and policies need a table as parent."""
    wrong = F.col("kind").isin(SUB_OBJECT_KINDS) & ~F.col("parent_kind").eqNullSafe(F.lit("table"))
    return _report(
        refs, "missing_parent", wrong, _own_name(), F.coalesce("parent_kind", F.lit("no parent"))
    )


def unexpected_parent(refs: DataFrame) -> DataFrame:
    wrong = ~F.col("kind").isin(SUB_OBJECT_KINDS) & F.col("parent_kind").isNotNull()
    return _report(refs, "unexpected_parent", wrong, _own_name(), F.col("parent_kind"))


def wrong_signature(refs: DataFrame) -> DataFrame:
    """Functions and procedures need an argument signature, others have none."""
    overloaded = F.col("kind").isin(OVERLOADED_KINDS)
    return _report(
        refs,
        "wrong_signature",
        overloaded == F.col("arg_signature").isNull(),
        _own_name(),
        F.when(overloaded, F.lit("missing")).otherwise(F.lit("not allowed")),
    )


def blank_names(refs: DataFrame) -> DataFrame:
    blank = _blank("namespace") | _blank("name")
    return _report(
        refs,
        "blank_name",
        blank,
        _own_name(),
        F.when(_blank("namespace"), F.lit("namespace")).otherwise(F.lit("name")),
    )


def wrong_ref_kind(objects: DataFrame, expected: str) -> DataFrame:
    """A table, schema, index or extension refers to itself by its own kind.

    ``objects``: db_id, namespace, name, ref_kind and, for indexes, table_ref_kind.
    """
    wrong = F.col("ref_kind") != expected
    detail = F.col("ref_kind")
    if expected == "index":
        wrong_table = F.col("table_ref_kind") != "table"
        detail = F.when(wrong, detail).otherwise(F.concat(F.lit("table_ref "), F.col("table_ref_kind")))
        wrong = wrong | wrong_table
    return _report(objects, "wrong_ref_kind", wrong, _own_name(), detail)


# --- columns: TABLE_KEY, name, position, data_type, default_expr, identity, generated_expression ---


def incomplete_columns(columns: DataFrame) -> DataFrame:
    problem = (
        F.when(_blank("name"), F.lit("blank name"))
        .when(_blank("data_type"), F.lit("blank type"))
        .when(F.coalesce(F.col("position") < 1, F.lit(True)), F.lit("position below 1"))
    )
    return _report(columns, "incomplete_column", problem.isNotNull(), _column_name(), problem)


def identity_bounds(columns: DataFrame) -> DataFrame:
    """Identity minimum above its maximum, when both are set."""
    low, high = F.col("identity.min_value"), F.col("identity.max_value")
    return _report(
        columns, "identity_bounds", low > high, _column_name(), F.concat_ws(" > ", low, high)
    )


def identity_and_generated(columns: DataFrame) -> DataFrame:
    both = F.col("identity").isNotNull() & F.col("generated_expression").isNotNull()
    return _report(
        columns, "identity_and_generated", both, _column_name(), F.col("generated_expression")
    )


def generated_with_default(columns: DataFrame) -> DataFrame:
    both = F.col("generated_expression").isNotNull() & F.col("default_expr").isNotNull()
    return _report(columns, "generated_with_default", both, _column_name(), F.col("default_expr"))


def identity_with_default(columns: DataFrame) -> DataFrame:
    both = F.col("identity").isNotNull() & F.col("default_expr").isNotNull()
    return _report(columns, "identity_with_default", both, _column_name(), F.col("default_expr"))


def duplicate_columns(columns: DataFrame) -> DataFrame:
    counted = columns.groupBy(*TABLE_KEY, "name").agg(F.count(F.lit(1)).alias("n"))
    return _report(counted, "duplicate_column", F.col("n") > 1, _column_name(), F.col("n"))


# --- constraints: TABLE_KEY, name, kind and the fields of all kinds ---


def empty_constraints(constraints: DataFrame) -> DataFrame:
    """Constraints without the columns, elements or expression their kind needs."""
    kind = F.col("kind")

    def empty(array: str) -> Column:
        return F.coalesce(F.size(array) <= 0, F.lit(True))

    keyed = kind.isin("primary_key", "unique", "foreign_key")
    problem = (
        F.when(keyed & empty("columns"), F.lit("columns"))
        .when((kind == "foreign_key") & empty("ref_columns"), F.lit("ref_columns"))
        .when((kind == "exclusion") & empty("elements"), F.lit("elements"))
        .when((kind == "check") & _blank("expression"), F.lit("expression"))
    )
    return _report(constraints, "empty_constraint", problem.isNotNull(), _column_name(), problem)


def unknown_constraint_columns(constraints: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns a key or foreign key names although the table lacks them."""
    named = constraints.where(F.col("kind").isin("primary_key", "unique", "foreign_key")).select(
        *TABLE_KEY, F.col("name").alias("constraint_name"), F.explode("columns").alias("name")
    )
    unknown = named.join(columns.select(*TABLE_KEY, "name"), [*TABLE_KEY, "name"], "left_anti")
    return _report(
        unknown,
        "unknown_constraint_column",
        F.lit(True),
        F.concat_ws(".", *TABLE_KEY[1:], "constraint_name"),
        F.col("name"),
    )


# --- tables, schemas, indexes, extensions ---


def partition_root_and_child(tables: DataFrame) -> DataFrame:
    """Tables that are partitioned and a partition; legal on the server, so only reported."""
    both = F.col("partition_info").isNotNull() & F.col("partition_of").isNotNull()
    return _report(
        tables,
        "partition_root_and_child",
        both,
        F.concat_ws(".", *TABLE_KEY[1:]),
        qualified_name(F.col("partition_of.parent_namespace"), F.col("partition_of.parent_name")),
    )


def foreign_namespace(tables: DataFrame) -> DataFrame:
    """Tables listed under a schema other than their own ``namespace``."""
    return _report(
        tables,
        "foreign_namespace",
        ~F.col("namespace").eqNullSafe(F.col("schema_name")),
        F.concat_ws(".", "schema_name", "table_name"),
        F.col("namespace"),
    )


def unlisted_schema(tables: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tables whose namespace is no schema of their database."""
    names = schemas.select("db_id", F.col("schema_name").alias("namespace"))
    return _report(
        tables.join(names, ["db_id", "namespace"], "left_anti"),
        "unlisted_schema",
        F.lit(True),
        F.concat_ws(".", "namespace", "table_name"),
        F.col("namespace"),
    )


def duplicate_names(objects: DataFrame, name_column: str, rule: str) -> DataFrame:
    """Schemas or extensions occurring more than once in a database."""
    counted = objects.groupBy("db_id", name_column).agg(F.count(F.lit(1)).alias("n"))
    return _report(counted, rule, F.col("n") > 1, F.col(name_column), F.col("n"))


def malformed_index_keys(indexes: DataFrame) -> DataFrame:
    """Index keys with both or neither of column and expression; indexes without keys."""
    bad = F.filter(
        "key_columns", lambda k: k["column_name"].isNull() == k["expression"].isNull()
    )
    no_keys = F.coalesce(F.size("key_columns") <= 0, F.lit(True))
    problem = F.when(no_keys, F.lit("no keys")).when(
        F.size(bad) > 0, F.concat(F.size(bad).cast("string"), F.lit(" malformed"))
    )
    return _report(indexes, "malformed_index_key", problem.isNotNull(), _column_name(), problem)


def blank_versions(extensions: DataFrame) -> DataFrame:
    return _report(extensions, "blank_version", _blank("version"), F.col("name"), F.col("version"))


# --- change rows: pair_id instead of db_id ---


def _delta_report(deltas: DataFrame, rule: str, broken: Column, detail: Column) -> DataFrame:
    keyed = deltas.withColumn("db_id", F.col("pair_id"))
    name = F.concat_ws(".", "namespace", "parent_name", "name")
    return _report(keyed, rule, broken, name, detail).withColumnRenamed("db_id", "pair_id")


def table_payload_mismatch(deltas: DataFrame) -> DataFrame:
    """Created and dropped tables whose payload is another table.

    Besides the change layout this needs ``payload_namespace, payload_name``.
    """
    wrong = ~(
        F.col("payload_namespace").eqNullSafe(F.col("namespace"))
        & F.col("payload_name").eqNullSafe(F.col("name"))
    )
    of_table = F.col("kind").isin("create_table", "drop_table")
    detail = F.concat_ws(".", "payload_namespace", "payload_name")
    return _delta_report(deltas, "table_payload_mismatch", of_table & wrong, detail)


def inconsistent_rename(deltas: DataFrame) -> DataFrame:
    """Renames whose target is not the old name, or that change nothing."""
    same = F.col("old_name").eqNullSafe(F.col("new_name"))
    problem = F.when(same, F.lit("no-op")).when(
        ~F.col("name").eqNullSafe(F.col("old_name")), F.lit("target is not the old name")
    )
    of_rename = F.col("kind").isin("rename_table", "rename_column")
    return _delta_report(deltas, "inconsistent_rename", of_rename & problem.isNotNull(), problem)


def empty_attribute_change(deltas: DataFrame) -> DataFrame:
    nothing = F.coalesce(F.size("changed"), F.lit(0)) <= 0
    return _delta_report(
        deltas, "empty_attribute_change", (F.col("kind") == "alter_table_attrs") & nothing, F.lit("no-op")
    )


def column_delta_target(deltas: DataFrame) -> DataFrame:
    """Column changes not aimed at a column, or at another one than their payload."""
    of_column = F.col("kind").isin(
        "add_column",
        "drop_column",
        "alter_column_type",
        "set_column_default",
        "set_column_nullability",
        "rename_column",
    )
    has_payload = F.col("kind").isin("add_column", "drop_column")
    problem = F.when(
        ~F.col("object_kind").eqNullSafe(F.lit("column")),
        F.concat(F.lit("target is a "), F.coalesce("object_kind", F.lit("?"))),
    ).when(
        has_payload & ~F.col("name").eqNullSafe(F.col("column.name")),
        F.concat(F.lit("payload is "), F.coalesce("column.name", F.lit("?"))),
    )
    return _delta_report(deltas, "column_delta_target", of_column & problem.isNotNull(), problem)
