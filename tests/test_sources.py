"""Pairs, nested snapshots, run output."""

import json

from pyspark.sql import functions as F

from fleetdrift.plans.catalog_queries import snapshot_of
from fleetdrift.sources import catalog, pairs, sinks, snapshots


def test_read_pairs_defaults_and_missing_parts(spark, tmp_path):
    full = tmp_path / "pairs.json"
    full.write_text(json.dumps({"profiles": [{"pair_id": "a", "source_snapshot": "x", "target_snapshot": "y"}]}))
    (row,) = pairs.read_pairs(spark, str(full)).collect()
    assert (row.schemas, row.ignore_patterns, row.mode) == (["public"], [], "schema-only")
    bare = tmp_path / "bare.json"
    bare.write_text("{}")
    assert pairs.read_pairs(spark, str(bare)).isEmpty()
    assert pairs.read_pairs(spark, str(tmp_path / "none.json")).isEmpty()


def test_allow_list_keeps_unlisted_databases(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "z"), (4, "a")], "db_id int, schema_name string")
    allow = spark.createDataFrame([(1, ["a"]), (2, None), (4, [])], "db_id int, schemas array<string>")
    found = catalog.allowed_schemas(rows, allow).collect()
    assert sorted(map(tuple, found)) == [(1, "a"), (2, "a"), (3, "z")]


def test_export_import_round_trip(spark, small):
    nested = snapshots.assemble_snapshot(snapshot_of(spark, small))
    texts = snapshots.export_snapshot(nested)
    again = snapshots.import_snapshot(texts)
    assert sorted(map(repr, nested.collect())) == sorted(map(repr, again.collect()))
    text = texts.where("kind = 'table'").first().json
    document = json.loads(text)
    assert list(document) == ["table", "indexes", "schema", "extension"]
    assert document["schema"] is None and document["table"]["columns"] and "\n  " in text
    assert nested.where("kind = 'table'").groupBy("db_id", "schema_name", "name").count().where("count > 2").isEmpty()


def test_find_objects_first_match_or_nothing(spark):
    objects = spark.createDataFrame([(1, "t", "b"), (1, "t", "a")], "db_id int, table_name string, schema_name string")
    wanted = spark.createDataFrame([(1, "t"), (1, "u")], "db_id int, table_name string")
    found = snapshots.find_objects(objects, wanted, ["db_id", "table_name"], ["schema_name"])
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, "t", True, "a"), (1, "u", False, None)]


def test_write_run(spark, tmp_path):
    rows = spark.range(1000).select(
        F.when(F.col("id") < 900, 0).otherwise(F.col("id")).alias("pair_id"), F.col("id").alias("line")
    )
    sinks.write_run(rows, rows, rows, str(tmp_path / "run"), file_rows=100)
    for part in ("deltas", "manifest", "statements"):
        folder = tmp_path / "run" / part
        back = spark.read.json(str(folder))
        assert back.count() == 1000 and set(back.columns) == {"line", "pair_id"}
        # the large pair is spread over files, a small one is a single file
        assert len(list((folder / "pair_id=0").glob("*.json"))) > 1
        assert len(list((folder / "pair_id=950").glob("*.json"))) == 1
    files = sorted((tmp_path / "run" / "statements" / "pair_id=0").glob("*.json"))
    # files in order of name hold the rows in order
    assert [json.loads(t)["line"] for f in files for t in f.read_text().splitlines()] == list(range(900))
