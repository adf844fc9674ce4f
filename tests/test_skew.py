"""Hot groups take the split path and give the same rows."""

import pytest
from pyspark.sql import functions as F

from fleetdrift.operators import order, report, rowchecks, script
from fleetdrift.skew import positions, running
from fleetdrift.sources import snapshots


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds two thirds of 3000 rows; order values repeat."""
    number = F.col("id")
    return spark.range(3000).select(
        F.when(number % 3 < 2, F.lit(0)).otherwise(number % 50).alias("g"),
        (number * 7919 % 400).alias("k"),
        number.alias("i"),
        (number % 11).alias("v"),
    ).withColumn("g", F.when(F.col("i") % 97 == 0, F.lit(None)).otherwise(F.col("g")))


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("exclusive", [False, True])
def test_running_splits_hot_groups(rows, exclusive):
    outputs = {
        "total": ("sum", F.col("v")),
        "top": ("max", F.col("v")),
        "low": ("min", F.col("v")),
        "previous": ("last", F.col("i")),
    }
    plain = running(rows, ["g"], ["k", "i"], outputs, exclusive=exclusive)
    split = running(rows, ["g"], ["k", "i"], outputs, exclusive=exclusive, hot_rows=100)
    assert "_slice" not in split.columns
    assert as_set(plain) == as_set(split)


def test_positions_of_a_hot_group_are_dense(rows):
    numbered = positions(rows, ["g"], ["k", "i"], hot_rows=10)
    counts = numbered.groupBy("g").agg(
        F.count("*").alias("n"), F.countDistinct("position").alias("d"), F.max("position").alias("m")
    )
    assert all(r.n == r.d == r.m for r in counts.collect())


def test_ties_of_a_hot_group_are_spread(spark):
    """Rows equal in every order column still get dense positions."""
    same = spark.range(2000).select(F.lit(1).alias("g"), F.lit(1).alias("k"), "id")
    numbered = positions(same, ["g"], ["k"], hot_rows=100)
    assert sorted(r.position for r in numbered.collect()) == list(range(1, 2001))


def test_snapshot_survives_json(spark, small):
    from fleetdrift.plans.catalog_queries import snapshot_of

    documents = snapshots.assemble_snapshot(snapshot_of(spark, small))
    again = snapshots.import_snapshot(snapshots.export_snapshot(documents))
    for name in ("schemas", "tables", "columns", "constraints", "indexes", "extensions"):
        a = getattr(snapshots.flatten_snapshot(documents), name)
        b = getattr(snapshots.flatten_snapshot(again), name)
        assert as_set(a) == as_set(b), name
        assert a.count() > 0, name


def test_hot_lookup_partition_is_split(spark):
    """AQE splits the hot side of a many-to-one join instead of one long task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        many = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")
        )
        one = spark.range(60000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
        joined = many.join(one, "k", "left").groupBy("k").agg(F.count("*").alias("n"))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_operators_agree_when_every_group_is_hot(spark, small, monkeypatch):
    from fleetdrift import skew
    from fleetdrift.plans.fixtures import fixture

    lines = fixture(spark, small, "fx_line")
    order_by = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    key = F.col("obj") % 3  # three huge diffs
    lines = lines.withColumn("obj", key)
    rendered = lines.select(
        F.col("obj").alias("pair_id"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        (F.col("l_partkey") % 7 != 0).alias("transactional"),
        F.when(F.col("l_partkey") % 5 == 0, "SAFE").otherwise("DANGEROUS").alias("risk"),
    ).distinct().withColumn("forward", F.array(F.lit("a"), F.lit("b")))
    script_order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    ranges = lines.select(
        "obj", F.monotonically_increasing_id().alias("i"), F.col("l_partkey").alias("s"),
        (F.col("l_partkey") + F.col("l_linenumber")).alias("e"),
    )
    ranges = spark.createDataFrame(ranges.collect(), ranges.schema)

    def results():
        return [
            as_set(report.diff_sides(lines.distinct(), ["obj"], order_by)),
            as_set(script.transaction_units(script.statement_lines(rendered, script_order))),
            as_set(rowchecks.exclusion_violations(ranges, ["obj"], "s", "e", ["i"])),
            as_set(order.topological_order(fixture(spark, small, "fx_node"), fixture(spark, small, "fx_edge"))),
        ]

    plain = results()
    monkeypatch.setattr(skew, "hot_groups", lambda df, group, more_than=0: df.groupBy(*group).agg(F.count("*").alias("group_rows")))
    assert results() == plain
