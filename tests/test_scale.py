"""Plans and storage of runs over many large catalogs."""

from pyspark.sql import functions as F

from fleetdrift.functions.constraints import fk_action, fk_match
from fleetdrift.functions.datatypes import normalize_type
from fleetdrift.functions.indexes import _folded_body, paren_body
from fleetdrift.marks import marks, split_marked, where_marked
from fleetdrift.operators import compare, rename
from fleetdrift.plans import catalog_queries, run_queries
from fleetdrift.session import scratch, stored
from fleetdrift.sources import snapshots


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_growing_lookups_are_not_broadcast(spark, small):
    """File sizes say little about rows: the driver never holds the schemas, types or indexes of a fleet."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    for scan in (catalog_queries.columns_scan, catalog_queries.tables_scan, catalog_queries.constraints_scan):
        assert "BroadcastExchange" not in plan_of(scan(spark, small))
    # access methods are a few per database
    assert plan_of(catalog_queries.indexes_scan(spark, small)).count("BroadcastExchange") == 1
    nested = plan_of(snapshots.assemble_snapshot(catalog_queries.snapshot_of(spark, small)))
    assert nested.count("BroadcastExchange") == 1
    assert "BroadcastExchange" not in plan_of(catalog_queries.constraint_columns_exist(spark, small))


def test_stored_rows_are_read_back_and_not_broadcast(spark):
    rows = stored(spark.createDataFrame([(1, None), (2, "b")], "pair_id long, name string"))
    assert sorted(rows.collect()) == [(1, None), (2, "b")]
    assert "BroadcastExchange" not in plan_of(spark.range(9).toDF("pair_id").join(rows.where("name = 'b'"), "pair_id"))
    assert scratch(spark) != scratch(spark)


def test_a_run_reads_stored_catalogs(spark, small):
    """Neither the fixtures nor the foreign keys' texts are read again by the comparison."""
    run_queries.whole_drift(spark, small)
    for side in ("source", "target"):
        catalog = run_queries.stored_side(spark, small, side)
        for kind in ("tables", "columns", "indexes", "constraints"):
            plan = plan_of(getattr(catalog, kind))
            assert "orders.parquet" not in plan and "Exchange" not in plan and "FOREIGN" not in plan


def test_marks_find_every_key(spark):
    rows = spark.createDataFrame(
        [(i % 3, f"T{i}" if i % 7 else None) for i in range(500)], "pair_id int, name string"
    )
    keys = rows.where("name LIKE '%1'").select(F.col("pair_id").cast("long").alias("pair_id"), "name")
    marked = marks(keys, ["pair_id", "name"])
    wanted = {tuple(r) for r in keys.collect()}
    kept = [tuple(r) for r in where_marked(rows, ["pair_id", "name"], marked).collect()]
    assert wanted <= set(kept) and len(kept) < 100
    some, others = (x.collect() for x in split_marked(rows, (["pair_id", "name"], marked)))
    assert sorted(map(repr, some + others)) == sorted(map(repr, rows.collect()))
    assert not wanted & {tuple(r) for r in others}
    lower = marks(keys.withColumn("name", F.lower("name")), ["pair_id", "name"])
    assert wanted <= {tuple(r) for r in where_marked(rows, ["pair_id", "name"], lower, folded=True).collect()}
    none = marks(keys.where("false"), ["pair_id", "name"])
    assert where_marked(rows, ["pair_id", "name"], none).isEmpty()
    assert split_marked(rows, (["pair_id", "name"], none))[1].count() == 500


def test_only_renamed_rows_are_joined_with_renames(spark):
    """Other rows keep their name and are not shuffled."""
    source = stored(spark.createDataFrame(
        [(1, "s", f"t{i}", None) for i in range(2000)] + [(1, None, "t3", "x"), (None, "s", "t3", "x")],
        "pair_id long, namespace string, table_name string, note string",
    ))
    renames = spark.createDataFrame([(1, "s", "t3", "r3")], "pair_id long, namespace string, old_name string, new_name string")
    renamed = rename.apply_table_renames(source, renames)
    rows = renamed.collect()
    assert len(rows) == 2002 and [tuple(r) for r in rows if r.table_name == "r3"] == [(1, "s", "r3", None)]
    assert sum(r.table_name == "t3" for r in rows) == 2
    assert "LeftOuter" in plan_of(renamed) and plan_of(renamed).index("Union") < plan_of(renamed).index("Exchange")


def test_digests_tell_arrays_apart(spark):
    """Places of nulls, and borders of elements, make another digest."""
    lists = [None, [], [None], ["a"], [None, "a"], ["a", None], ["ab", "c"], ["a", "bc"], ["null", "a"], [""], ["", None]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "n int, names array<string>")
    digests = rows.select(*compare._digest(rows, (), ["n"])).distinct().count()
    assert digests == len(lists)


def test_short_ways_of_parsers_give_the_same(spark):
    texts = [
        "PRIMARY KEY (c1)", "a (b (c) d) e (f)", "()", ") (a)", "(a", "a)", "", None, "x(\n)y", "f(a)(b)", "(a(b)", "((a))", "a(b)c)",
    ]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(paren_body(F.col("t")).alias("a"), _folded_body(F.col("t")).alias("b"))
    assert all(r.a == r.b for r in rows.collect())
    types = {
        "varchar(100)": "character varying(100)", "decimal(8, 3)": "numeric(8, 3)", "timetz(3)": "time(3) with time zone",
        "timestamptz(6)": "timestamp(6) with time zone", "geo(3)": "geo(3)", "int4": "integer", "timestamptz": "timestamp with time zone",
        "INT8": "bigint", "varchar(10)\n": "character varying(10)", "_varchar(10)": "character varying(10)[]", "bpchar(10)": "character(10)",
    }
    found = spark.createDataFrame([(x,) for x in types], "t string").select("t", normalize_type(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in found} == types
    keys = spark.createDataFrame([("a REFERENCES b on  delete set\nnull match Full",)], "t string")
    row = keys.select(fk_action(F.col("t"), "DELETE"), fk_action(F.col("t"), "UPDATE"), fk_match(F.col("t"))).first()
    assert tuple(row) == ("set_null", "no_action", "full")
