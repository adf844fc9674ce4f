"""Ordered operators that survive one group holding most rows.

``running`` replaces ``Window.partitionBy(group).orderBy(...)``.  It treats
ordinary groups the plain way and splits only the groups above a row limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetdrift.session import cut_lineage

# A group above this many rows no longer fits one window task comfortably.
# N rows hold at most N / HOT_ROWS such groups (10^6 for 10^12 rows).
HOT_ROWS = 1_000_000

# Lists of hot groups are broadcast up to this counted length, joined plainly beyond.
BROADCAST_GROUPS = 1_000_000

_RUNNING = {"sum": F.sum, "max": F.max, "min": F.min, "last": F.last}


def hot_groups(df: DataFrame, group: Sequence[str], more_than: int = HOT_ROWS) -> DataFrame:
    """Groups with more than ``more_than`` rows, with their size ``group_rows``."""
    return (
        df.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("group_rows"))
        .where(F.col("group_rows") > more_than)
    )


def _measured(groups: DataFrame, prefix: str) -> tuple[DataFrame, int]:
    """Hot groups with renamed keys, broadcast only if counted to be few."""
    groups = groups.select(*[F.col(c).alias(prefix + c) for c in groups.columns]).persist()
    count = groups.count()
    if count == 0:
        groups.unpersist()
    return (F.broadcast(groups) if 0 < count <= BROADCAST_GROUPS else groups), count


def _same(group: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(prefix + c)) for c in group]


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    outputs: dict[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add running aggregates over ``order`` within ``group``.

    ``outputs`` maps a new column to ``(kind, expression)``, kind one of
    ``sum``, ``max``, ``min``, ``last``.  ``exclusive`` leaves the current row out.

    Groups of at most ``hot_rows`` rows use one window each.  Larger ones are
    range partitioned on (group, order) into slices; each slice runs its own
    window and adds the carry of the slices before it.  Group sizes are counted
    here, so this is the one family of operators that runs a job when called.
    """
    hot, count = _measured(hot_groups(df, group, hot_rows).select(*group), "_hot_")
    if count == 0:
        return _running_plain(df, group, order, outputs, exclusive)
    cold = df.join(hot, _same(group, "_hot_"), "left_anti")
    large = df.join(hot, _same(group, "_hot_"), "left_semi")
    return _running_plain(cold, group, order, outputs, exclusive).unionByName(
        _running_sliced(large, group, order, outputs, exclusive)
    )


def _running_plain(df, group, order, outputs, exclusive):
    window = (
        Window.partitionBy(*group)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    )
    return df.select("*", *[_RUNNING[k](e).over(window).alias(n) for n, (k, e) in outputs.items()])


def _running_sliced(df, group, order, outputs, exclusive):
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The random last range key spreads rows that tie in every order column;
    # the checkpoint fixes the slice numbers, so both uses below agree on them.
    sliced = cut_lineage(
        df.repartitionByRange(slices, *group, *order, F.rand(7)).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    local = _running_plain(sliced, [*group, "_slice"], order, outputs, exclusive)
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    totals = sliced.groupBy(*group, "_slice").agg(
        *[
            (F.max_by(e, position) if k == "last" else _RUNNING[k](e)).alias(f"_total_{n}")
            for n, (k, e) in outputs.items()
        ]
    )
    # One row per (hot group, slice it touches): at most slices + hot groups rows.
    before = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *[F.col(c).alias(f"_carry_of_{c}") for c in [*group, "_slice"]],
        *[
            _RUNNING[k](F.col(f"_total_{n}")).over(before).alias(f"_carry_{n}")
            for n, (k, _) in outputs.items()
        ],
    )
    # Spark sends the carry to all tasks only where it measures it as small.
    joined = local.join(carry, _same([*group, "_slice"], "_carry_of_"), "left")
    return joined.select(
        *df.columns,
        *[_merge(k, F.col(f"_carry_{n}"), F.col(n)).alias(n) for n, (k, _) in outputs.items()],
    )


def _merge(kind: str, carry: Column, value: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), value).when(value.isNull(), carry).otherwise(carry + value)
    if kind == "max":
        return F.greatest(carry, value)
    if kind == "min":
        return F.least(carry, value)
    return F.coalesce(value, carry)


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    *,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Dense 1-based position of each row in its group."""
    return running(df, group, order, {name: ("sum", F.lit(1))}, hot_rows=hot_rows)


def with_places(ordered: DataFrame, name: str = "place", amount: str | None = None) -> DataFrame:
    """Add each row's place (from 1) in a sorted table: its place in its partition after all partitions before.

    With ``amount`` (a positive long column) rows take that many places, and the
    place is their last one.  The sorted rows are stored once, so both uses see
    the same partitions; the joined counts are one row per partition.
    """
    own = cut_lineage(
        ordered.select(
            "*", F.spark_partition_id().alias("_partition"), F.monotonically_increasing_id().alias("_id")
        )
    )
    counts = own.groupBy("_partition").agg(
        (F.sum(amount) if amount else F.count(F.lit(1))).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_partition", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if amount:
        # A partition of a sorted table is a task's worth of rows.
        inside = Window.partitionBy("_partition").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = own.withColumn("_inside", F.sum(amount).over(inside))
    else:
        own = own.withColumn("_inside", F.col("_id"))
    joined = own.join(starts, "_partition")
    inside = F.col("_inside") if amount else F.col("_inside") - F.col("_first") + 1
    return joined.select(*ordered.columns, (F.col("_before") + inside).alias(name))
