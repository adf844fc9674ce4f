"""Catalog scans mapped to flat model rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.functions.columns import identity_spec, partition_info, partition_of
from fleetdrift.functions.constraints import constraint_fields, constraint_kind, deferrability, fk_parts
from fleetdrift.functions.datatypes import normalize_type
from fleetdrift.functions.indexes import index_keys, index_method
from fleetdrift.functions.text import null_if_empty
from fleetdrift.session import unsent

TABLE_KEY = ["db_id", "schema_name", "table_name"]


def map_tables(scan: DataFrame) -> DataFrame:
    """Model tables; owner, tablespace and comment are never scanned."""
    none = F.lit(None).cast("string")
    return scan.select(
        *TABLE_KEY,
        none.alias("owner"),
        none.alias("tablespace"),
        partition_info(F.col("partition_strategy"), F.col("partition_expr")).alias("partition_info"),
        partition_of(
            F.col("partition_of_schema"), F.col("partition_of_table"), F.col("partition_bound")
        ).alias("partition_of"),
        none.alias("comment"),
    )


def map_columns(scan: DataFrame) -> DataFrame:
    """Model columns: canonical type, identity struct, default only on plain columns."""
    return scan.select(
        *TABLE_KEY,
        F.col("column_name").alias("name"),
        F.col("ordinal_position").alias("position"),
        normalize_type(F.col("data_type")).alias("data_type"),
        F.col("is_nullable").alias("nullable"),
        F.when(
            ~F.col("is_identity") & ~F.col("is_generated"), null_if_empty(F.col("default_expr"))
        ).alias("default_expr"),
        null_if_empty(F.col("collation")).alias("collation"),
        identity_spec(F.col("is_identity"), F.col("identity_generated")).alias("identity"),
        F.when(F.col("is_generated"), null_if_empty(F.col("generated_expr"))).alias(
            "generated_expression"
        ),
    )


def map_indexes(scan: DataFrame) -> DataFrame:
    """Model indexes; included columns are not read from the definition."""
    return scan.select(
        *TABLE_KEY,
        F.col("index_name").alias("name"),
        index_method(F.col("index_method")).alias("method"),
        index_keys(F.col("index_definition")).alias("key_columns"),
        F.array().cast("array<string>").alias("include_columns"),
        F.col("is_unique").alias("unique"),
        null_if_empty(F.col("predicate")).alias("predicate"),
        F.lit(None).cast("string").alias("comment"),
    )


def map_constraints(scan: DataFrame) -> DataFrame:
    """Model constraints of the five kinds; rows of other kinds have a null kind."""
    # A foreign key is taken apart once for the four fields that come from its parts.
    parts = F.when(F.col("constraint_type") == "f", fk_parts(F.col("definition")))
    fields = constraint_fields(
        F.col("constraint_type"), F.col("definition"), F.col("ref_schema"), F.col("ref_table"), F.col("_parts")
    )
    return scan.withColumn("_parts", parts).select(
        *TABLE_KEY,
        F.col("constraint_name").alias("name"),
        constraint_kind(F.col("constraint_type")).alias("kind"),
        deferrability(F.col("deferrable"), F.col("initially_deferred")).alias("deferrability"),
        *[value.alias(name) for name, value in fields.items()],
    )


def missing_columns(kind: Column, named: Column, known: Column) -> Column:
    """Columns a key, unique or foreign key constraint names but its table lacks.

    Check and exclusion constraints are not tested; unknown columns of the table
    (null) count as none.
    """
    none = F.array().cast("array<string>")
    tested = kind.isin("primary_key", "unique", "foreign_key")
    return F.when(tested, F.array_except(named, F.coalesce(known, none))).otherwise(none)


def keep_valid_constraints(constraints: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split mapped constraints into ``(kept, rejected)``.

    Constraints stay only if their kind is known and no column is missing.
    """
    # One table has at most 1600 columns by the server's own limit.
    names = columns.groupBy(*TABLE_KEY).agg(F.collect_set("name").alias("_names"))
    judged = (
        constraints.join(unsent(names), TABLE_KEY, "left")
        .withColumn("_missing", missing_columns(F.col("kind"), F.col("columns"), F.col("_names")))
        .withColumn(
            "reason",
            F.when(F.col("kind").isNull(), F.lit("unknown constraint type")).when(
                F.size("_missing") > 0,
                F.concat(F.lit("missing columns: "), F.array_join("_missing", ",")),
            ),
        )
        .drop("_names", "_missing")
    )
    kept = judged.where(F.col("reason").isNull()).drop("reason")
    return kept, judged.where(F.col("reason").isNotNull())


def map_extensions(scan: DataFrame) -> DataFrame:
    return scan.select(
        "db_id",
        F.lit("public").alias("namespace"),
        F.col("extension_name").alias("name"),
        F.coalesce(null_if_empty(F.col("installed_version")), F.lit("0")).alias("version"),
    )
