"""Shape of the physical plans."""

import pytest

from fleetdrift.plans.all_queries import QUERIES

CHECKED = [
    "scan_tables", "scan_columns", "scan_indexes", "scan_constraints", "map_index", "constraint_dispatch",
    "normalize_types", "snapshot_match", "change_summary", "classify_risk", "change_table", "line_diff",
    "check_exclusion", "check_foreign_key", "schema_allow_list", "ignore_patterns",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_python_or_single_task_window(name, spark, small):
    plan = plan_of(QUERIES[name](spark, small))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert word not in plan
    assert "Exchange SinglePartition" not in plan


def test_column_scan_reads_only_needed_columns(spark, small):
    plan = plan_of(QUERIES["check_condition"](spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_discount:double>" in plan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(l_discount,0.05)" in plan


def test_comparison_combines_before_it_shuffles(spark, small):
    """Copies of a column collapse before the first exchange; the second one, for
    table presence, carries attributes of changed columns only."""
    from fleetdrift.operators import compare
    from fleetdrift.plans.drift_queries import side_columns
    from fleetdrift.session import cut_lineage

    source = cut_lineage(side_columns(spark, small, "source"))
    target = cut_lineage(side_columns(spark, small, "target"))
    plan = plan_of(compare.compare_columns(source, target, derive_tables=True))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(pair_id" in line]
    assert len(exchanges) == 2
    assert plan.index("partial_min(src") > plan.index(exchanges[1].strip()[:40])


def test_unchanged_objects_are_not_shuffled_with_their_attributes(spark):
    """Only digests of all objects move; attributes follow for the objects that differ, and few others."""
    from pyspark.sql import functions as F

    from fleetdrift.operators import compare
    from fleetdrift.session import cut_lineage

    source = spark.range(20000).select(
        F.lit(1).alias("pair_id"), F.col("id").cast("string").alias("name"), F.repeat(F.lit("long text "), 20).alias("body"),
        F.array(F.struct(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))).alias("parts"),
    )
    other = F.array(F.struct(F.lit(None).cast("long").alias("a"), F.col("name").alias("b")))
    target = source.withColumn("parts", F.when(F.col("name").isin("7", "70", "700"), other).otherwise(F.col("parts")))
    matched = compare.match_changed(cut_lineage(source), cut_lineage(target), ["pair_id", "name"])
    rows = matched.collect()
    assert {"7", "70", "700"} <= {r.name for r in rows} and len(rows) < 20
    plan = plan_of(matched)
    below = plan[plan.index("BroadcastExchange") :]
    digests = below[: below.index("LeftSemi")] if "LeftSemi" in below else below
    assert plan.index("partial_min(src") < plan.index("LeftSemi")  # attributes combine above the filter
    assert "SortAggregate" not in digests and "Sort [" not in digests  # and digests need no sort
    assert "partial_min(s_d1" in digests
