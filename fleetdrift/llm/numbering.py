"""Gapless numbers over huge groups: no window ever holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str,
    amount: Column | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``name``: the running sum of ``amount`` (1: a number from 0) before each row of its group.

    Each group is dealt out by a hash of the ``order`` columns into slices; a
    slice is numbered by itself and starts where the slices before it end.  The
    table of slice totals has at most groups x slices rows.  ``df`` must be
    stored or deterministic, as it is read twice; rows equal in every ``order``
    column get their numbers in any order.
    """
    amount = F.lit(1).cast("long") if amount is None else amount
    slices = slices or 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    keys = [*group, "_slice"]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        dealt.groupBy(*keys)
        .agg(F.sum(amount).alias("_total"))
        .select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return (
        local.alias("l")
        .join(totals.alias("t"), same)
        .select(*[F.col(f"l.{c}") for c in df.columns], (F.col("t._before") + F.col("l._local")).alias(name))
    )
