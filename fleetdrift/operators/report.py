"""Summaries of changes and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.operators.risk import risk_label, risk_rank
from fleetdrift.skew import running


def change_class() -> Column:
    """Column of a summary a change counts in: add, mod, del or conflict.

    A conflicting replacement is a conflict only; a rename is a modification.
    """
    op = F.col("op")
    return (
        F.when(F.coalesce("is_conflict", F.lit(False)) | (op == "conflict"), F.lit("conflict"))
        .when(op == "create", F.lit("add"))
        .when(op.isin("alter", "replace", "rename"), F.lit("mod"))
        .when(op == "drop", F.lit("del"))
    )


CLASSES = {"add": "n_add", "mod": "n_mod", "del": "n_del", "conflict": "n_conflict"}


def _counts() -> list[Column]:
    return [F.count_if(change_class() == c).alias(name) for c, name in CLASSES.items()]


def change_summary(deltas: DataFrame) -> DataFrame:
    """The four counts per pair."""
    return deltas.groupBy("pair_id").agg(*_counts())


def change_count(summary: DataFrame) -> DataFrame:
    """All changes and the conflicts among them, per pair."""
    total = sum((F.col(name) for name in CLASSES.values()), F.lit(0))
    return summary.select(
        "pair_id", total.alias("change_count"), F.col("n_conflict").alias("conflict_count")
    )


def tree_badges(deltas: DataFrame) -> DataFrame:
    """The four counts per schema and per object group in it (null: all groups)."""
    finest = deltas.groupBy("pair_id", "namespace", "object_kind").agg(*_counts())
    sums = [F.sum(name).alias(name) for name in CLASSES.values()]
    key = ["pair_id", "namespace"]
    per_schema = finest.groupBy(*key).agg(*sums)
    return finest.unionByName(per_schema, allowMissingColumns=True)


def change_detail() -> Column:
    """Short text of one change for the change table."""
    kind, name = F.col("kind"), F.col("name")
    return (
        F.when(kind.isin("add_column", "add_constraint", "create_index"), F.concat(F.lit("+"), name))
        .when(kind.isin("drop_column", "drop_constraint", "drop_index"), F.concat(F.lit("-"), name))
        .when(kind == "alter_column_type", F.concat(name, F.lit(" type change")))
        .when(kind == "set_column_default", F.concat(name, F.lit(" default")))
        .when(kind == "set_column_nullability", F.concat(name, F.lit(" nullability")))
        .when(kind.startswith("rename_"), F.concat(F.col("old_name"), F.lit("→"), F.col("new_name")))
        .when(kind.startswith("replace_"), F.concat(name, F.lit(" replaced")))
    )


def change_table(graded: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """One row per changed table: op, object, detail text, worst risk, prerequisites.

    ``dependencies``: pair_id, namespace, table_name, dependencies.
    """
    kind = F.col("kind")
    # Schemas and extensions are no tables and have no row.
    rows = graded.where(~F.col("object_kind").isin("schema", "extension")).withColumn(
        "table_name",
        F.coalesce(
            "parent_name",
            F.coalesce(F.col("index"), F.col("old_index"))["table_name"],
            F.col("name"),
        ),
    )
    # Bounded: a table has at most 1600 columns by the server's own limit, and as
    # many constraints and indexes at most as its definition lists.
    grouped = rows.groupBy("pair_id", "namespace", "table_name").agg(
        F.max(F.when(kind == "create_table", F.lit("create")).when(kind == "drop_table", F.lit("drop")))
        .alias("_whole"),
        F.array_join(F.sort_array(F.collect_list(change_detail())), ", ").alias("detail"),
        F.max(risk_rank(F.col("risk"))).alias("_rank"),
        F.count(F.lit(1)).alias("n_changes"),
    )
    result = grouped.select(
        "pair_id",
        "namespace",
        "table_name",
        F.coalesce("_whole", F.lit("alter")).alias("op"),
        "detail",
        risk_label(F.col("_rank")).alias("risk"),
        "n_changes",
    )
    if dependencies is None:
        return result
    return result.join(dependencies, ["pair_id", "namespace", "table_name"], "left").withColumn(
        "dependencies", F.coalesce("dependencies", F.lit(0))
    )


def diff_sides(lines: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """A line diff on two sides: ``sig`` and ``text`` with running line numbers.

    ``+`` lines stand on the target, ``-`` lines on the source, others on both;
    the side without the line gets blanks.
    """
    on_source, on_target = F.col("sig") != "+", F.col("sig") != "-"
    numbered = running(
        lines,
        group,
        order,
        {
            "_source": ("sum", F.when(on_source, F.lit(1)).otherwise(F.lit(0))),
            "_target": ("sum", F.when(on_target, F.lit(1)).otherwise(F.lit(0))),
        },
    )

    def side(present: Column, value: Column) -> Column:
        return F.when(present, value).otherwise(F.lit(""))

    return numbered.select(
        *lines.columns,
        side(on_source, F.col("_source").cast("string")).alias("source_line"),
        side(on_source, F.col("text")).alias("source_text"),
        side(on_target, F.col("_target").cast("string")).alias("target_line"),
        side(on_target, F.col("text")).alias("target_text"),
    )


def run_history(runs: DataFrame) -> DataFrame:
    """Runs, newest first."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id"))


def run_history_summary(runs: DataFrame) -> DataFrame:
    """Runs, changes and latest start per pair and status."""
    return runs.groupBy("pair_id", "status").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("changes").alias("changes"),
        F.max("started_at").alias("last_started_at"),
    )
