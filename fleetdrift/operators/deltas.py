"""Working with change rows: combining, selecting, ordering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.functions.names import sort_key

TARGET_REF = ["object_kind", "namespace", "parent_name", "name"]


def combine_deltas(*parts: DataFrame) -> DataFrame:
    """All change rows of several inputs, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def deltas_by_op(deltas: DataFrame, op: str) -> DataFrame:
    return deltas.where(F.col("op") == op)


def deltas_by_target(
    deltas: DataFrame, object_kind: str, namespace: str, name: str, parent_name: str | None = None
) -> DataFrame:
    """Changes of exactly one object; every part of its reference is compared."""
    wanted = dict(zip(TARGET_REF, (object_kind, namespace, parent_name, name), strict=True))
    for column, value in wanted.items():
        deltas = deltas.where(F.col(column).eqNullSafe(F.lit(value)))
    return deltas


def contains_deltas(deltas: DataFrame, items: DataFrame) -> DataFrame:
    """The ``items`` (same columns or a subset) found among the deltas."""
    known = deltas.select(*[F.col(c).alias(f"_known_{c}") for c in items.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_known_{c}")) for c in items.columns]
    return items.join(known, same, "left_semi")


def is_empty(deltas: DataFrame) -> bool:
    return deltas.isEmpty()


def filter_changes(deltas: DataFrame, risk: str = "all", op: str = "all") -> DataFrame:
    """Changes of one risk and one op; ``all`` leaves that filter out."""
    if risk != "all":
        deltas = deltas.where(F.col("risk") == risk)
    if op != "all":
        deltas = deltas.where(F.col("op") == op)
    return deltas


def delta_sort_key() -> Column:
    """Key of a change row for ordering within its pair."""
    return sort_key(
        F.col("namespace"), F.col("parent_name"), F.col("name"), F.col("op"), F.col("kind")
    )
