"""Grading changes on the five-level scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.functions.text import map_values
from fleetdrift.model import RISK_LEVELS


def risk_of(*, concurrent_indexes: bool = True) -> Column:
    """Risk of a change row; see the README for the rule behind each level."""
    kind = F.col("kind")
    column = F.col("column")
    added = (
        F.when(column["nullable"], F.lit("SAFE"))
        .when(
            column["default_expr"].isNotNull()
            | column["identity"].isNotNull()
            | column["generated_expression"].isNotNull(),
            F.lit("WARNING"),
        )
        .otherwise(F.lit("BLOCKED"))
    )
    primary_key = F.col("constraint")["kind"] == "primary_key"
    return (
        F.when(kind == "add_column", added)
        .when(kind.isin("drop_column", "drop_table", "drop_constraint"), "DESTRUCTIVE")
        .when(kind.isin("drop_schema", "drop_extension", "drop_index"), "DESTRUCTIVE")
        .when(kind.isin("alter_column_type", "replace_index"), "DANGEROUS")
        .when(kind == "replace_column", "BLOCKED")
        .when(
            kind == "set_column_nullability",
            F.when(F.col("nullable"), F.lit("SAFE")).otherwise(F.lit("WARNING")),
        )
        .when(kind.isin("rename_table", "rename_column"), "WARNING")
        .when(kind == "create_index", "SAFE" if concurrent_indexes else "WARNING")
        .when(
            kind == "add_constraint",
            F.when(primary_key, F.lit("DANGEROUS")).otherwise(F.lit("WARNING")),
        )
        .otherwise("SAFE")
    )


def risk_rank(risk: Column) -> Column:
    """Position on the scale, 0 for SAFE."""
    ranks = {level: str(rank) for rank, level in enumerate(RISK_LEVELS)}
    return map_values(risk, ranks).cast("int")


def risk_label(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(level) for level in RISK_LEVELS]), rank)


def classify_risk(deltas: DataFrame, *, concurrent_indexes: bool = True) -> DataFrame:
    return deltas.withColumn("risk", risk_of(concurrent_indexes=concurrent_indexes))


def migration_risk(graded: DataFrame) -> DataFrame:
    """Worst risk per pair."""
    return graded.groupBy("pair_id").agg(
        risk_label(F.max(risk_rank(F.col("risk")))).alias("max_risk")
    )


def risk_gate(graded: DataFrame, max_risk: str = "DANGEROUS") -> tuple[DataFrame, DataFrame]:
    """``(allowed, refused)`` changes; BLOCKED is refused at any setting."""
    passes = (risk_rank(F.col("risk")) <= RISK_LEVELS.index(max_risk)) & (F.col("risk") != "BLOCKED")
    return graded.where(passes), graded.where(~passes)
