"""Whole runs on small catalogs: renames, order, exclusions, patches, written scripts."""

import random

import pytest
from pyspark.sql import functions as F

from fleetdrift.functions.constraints import constraint_fields, constraint_kind
from fleetdrift.operators import compare, migration, patch, rename
from fleetdrift.operators.compare import Catalog
from fleetdrift.operators.exclude import exclude_changes
from fleetdrift.session import cut_lineage
from fleetdrift.sources import sinks

_TABLE = (
    "pair_id long, namespace string, table_name string, owner string, tablespace string, comment string, "
    "partition_info struct<strategy:string,partition_key:string>, "
    "partition_of struct<parent_namespace:string,parent_name:string,partition_bound:string>"
)
_COLUMN = "pair_id long, namespace string, table_name string, name string, position int, data_type string, nullable boolean, default_expr string"
_INDEX = "pair_id long, namespace string, table_name string, name string, method string, key string"
_KEY = "pair_id long, namespace string, table_name string, name string, contype string, condef string"


def catalog(spark, *, schemas=(), extensions=(), tables=(), columns=(), indexes=(), keys=()):
    """A catalog from short rows: tables (pair, ns, name[, owner, comment, strategy, parent]), columns (.., name, type)."""

    def table(pair, ns, name, owner="o", comment=None, strategy=None, parent=None):
        info = (strategy, "(id)") if strategy else None
        return (pair, ns, name, owner, None, comment, info, (ns, parent, "DEFAULT") if parent else None)

    none = F.lit(None).cast("string")
    columns = [(p, ns, t, n, i, kind, *(rest or (True, None))) for i, (p, ns, t, n, kind, *rest) in enumerate(columns, 1)]
    column = spark.createDataFrame(columns, _COLUMN).select(
        "*", none.alias("collation"), F.lit(None).cast(compare.COLUMN["identity"].dataType).alias("identity"),
        none.alias("generated_expression"),
    )
    key = F.struct(F.col("key").alias("column_name"), none.alias("expression"), none.alias("opclass"), F.lit("asc").alias("sort_order"), none.alias("nulls_order"))
    index = spark.createDataFrame([(*r[:4], "btree", r[4]) for r in indexes], _INDEX).select(
        "pair_id", "namespace", "table_name", "name", "method", F.array(key).alias("key_columns"),
        F.array().cast("array<string>").alias("include_columns"), F.lit(False).alias("unique"), none.alias("predicate"), none.alias("comment"),
    )
    fields = constraint_fields(F.col("contype"), F.col("condef"), none, none)
    constraint = spark.createDataFrame(list(keys), _KEY).select(
        "pair_id", "namespace", "table_name", "name", constraint_kind(F.col("contype")).alias("kind"),
        F.lit("not_deferrable").alias("deferrability"), *[v.alias(n) for n, v in fields.items()],
    )
    return Catalog(
        spark.createDataFrame(list(schemas), "pair_id long, namespace string"),
        spark.createDataFrame(list(extensions), "pair_id long, name string, version string"),
        spark.createDataFrame([table(*t) for t in tables], _TABLE), column, index, constraint,
    )


def renames(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, namespace string, old_name string, new_name string")


def lines(df):
    return [r.statement for r in df.orderBy("line").collect()]


def swapped(spark):
    source = catalog(
        spark, schemas=[(1, "s")], extensions=[(1, "e", "1")], tables=[(1, "s", "a"), (1, "s", "b")],
        columns=[(1, "s", "a", "id", "bigint"), (1, "s", "b", "id", "bigint"), (1, "s", "b", "a_id", "bigint")],
        indexes=[(1, "s", "b", "ix", "a_id")],
        keys=[(1, "s", "a", "pk", "p", "PRIMARY KEY (id)"), (1, "s", "b", "fk", "f", "FOREIGN KEY (a_id) REFERENCES s.a (id)")],
    )
    target = catalog(
        spark, schemas=[(1, "s")], extensions=[(1, "e", "1")], tables=[(1, "s", "b"), (1, "s", "a")],
        columns=[(1, "s", "b", "id", "bigint"), (1, "s", "a", "id", "bigint"), (1, "s", "a", "b_id", "bigint")],
        indexes=[(1, "s", "a", "ix", "b_id")],
        keys=[(1, "s", "b", "pk", "p", "PRIMARY KEY (id)"), (1, "s", "a", "fk", "f", "FOREIGN KEY (b_id) REFERENCES s.b (id)")],
    )
    tables = renames(spark, [(1, "s", "a", "b"), (1, "s", "b", "a")])
    columns = spark.createDataFrame([(1, "s", "b", "a_id", "b_id")], "pair_id long, namespace string, table_name string, old_name string, new_name string")
    return source, target, tables, columns


def test_swapped_tables_differ_in_their_names_only(spark):
    """Two tables swap their names and a column gets another one: index, key and foreign key follow."""
    source, target, tables, columns = swapped(spark)
    found = migration.drift(source, target, table_renames=tables, column_renames=columns)
    assert lines(migration.plan_migration(found).up) == [
        'ALTER TABLE "s"."a" RENAME TO "a__moving"', 'ALTER TABLE "s"."b" RENAME TO "b__moving"',
        'ALTER TABLE "s"."a__moving" RENAME TO "b"', 'ALTER TABLE "s"."b__moving" RENAME TO "a"',
        'ALTER TABLE "s"."a" RENAME COLUMN "a_id" TO "b_id"',
    ]
    assert compare.compare_catalogs(patch.apply_changes(source, found), target).isEmpty()


def test_chains_of_renames(spark):
    """a to b and b to c compose where b is no table, and follow each other where it is one."""
    rows = renames(spark, [(1, "s", "a", "b"), (1, "s", "b", "c"), (2, "s", "a", "b"), (2, "s", "b", "c"), (3, "s", "a", "b"), (3, "s", "b", "a")])
    source = spark.createDataFrame([(1, "s", "a"), (2, "s", "a"), (2, "s", "b"), (3, "s", "a")], "pair_id long, namespace string, table_name string")
    target = spark.createDataFrame([(1, "s", "c"), (2, "s", "b"), (2, "s", "c"), (3, "s", "b")], source.schema)
    effective, changes = rename.rename_tables(source, target, rows)
    assert {tuple(r) for r in effective.collect()} == {(1, "s", "a", "c"), (2, "s", "a", "b"), (2, "s", "b", "c")}
    assert {(r.pair_id, r.old_name, r.new_name) for r in changes.collect()} == {
        (1, "a", "c"), (2, "a", "a__moving"), (2, "a__moving", "b"), (2, "b", "c"),
    }


def test_blocked_renames_block_others(spark):
    """c keeps its name, so b cannot take it, so a cannot take b's."""
    rows = renames(spark, [(1, "s", "a", "b"), (1, "s", "b", "c")])
    source = spark.createDataFrame([(1, "s", x) for x in "abc"], "pair_id long, namespace string, table_name string")
    effective, _ = rename.rename_tables(source, source, rows)
    assert effective.isEmpty()


def test_tables_that_point_at_each_other(spark):
    """Foreign keys leave their tables, so neither creating nor dropping waits in a circle."""
    both = dict(
        schemas=[(1, "s")], tables=[(1, "s", "a"), (1, "s", "b")],
        columns=[(1, "s", "a", "id", "bigint"), (1, "s", "b", "id", "bigint")],
        keys=[
            (1, "s", "a", "pka", "p", "PRIMARY KEY (id)"), (1, "s", "b", "pkb", "p", "PRIMARY KEY (id)"),
            (1, "s", "a", "fka", "f", "FOREIGN KEY (id) REFERENCES s.b (id)"), (1, "s", "b", "fkb", "f", "FOREIGN KEY (id) REFERENCES s.a (id)"),
        ],
    )
    full, empty = catalog(spark, **both), catalog(spark)
    up = migration.plan_migration(migration.drift(empty, full))
    assert up.unordered.isEmpty()
    created = lines(up.up)
    assert created[0] == 'CREATE SCHEMA "s"' and [x.split(" ")[0:2] for x in created[1:]][0] == ["CREATE", "TABLE"]
    assert created.index('ALTER TABLE "s"."a" ADD CONSTRAINT "fka" FOREIGN KEY ("id") REFERENCES "s"."b" ("id") NOT VALID') > max(
        i for i, x in enumerate(created) if x.startswith("CREATE TABLE")
    )
    dropped = lines(migration.plan_migration(migration.drift(full, empty)).up)
    assert [x.split(" ")[:2] for x in dropped] == [["ALTER", "TABLE"]] * 2 + [["DROP", "TABLE"]] * 2 + [["DROP", "SCHEMA"]]


def test_created_tables_have_all_their_attributes(spark):
    target = catalog(
        spark, schemas=[(1, "s")], tables=[(1, "s", "p", "me", "it's", "list"), (1, "s", "c", "me", None, None, "p")],
        columns=[(1, "s", "p", "id", "bigint", False, "1"), (1, "s", "c", "id", "bigint")],
    )
    script = migration.plan_migration(migration.drift(catalog(spark), target))
    assert lines(script.up) == [
        'CREATE SCHEMA "s"', 'CREATE TABLE "s"."p" ("id" bigint DEFAULT 1 NOT NULL) PARTITION BY LIST (id)', 'ALTER TABLE "s"."p" OWNER TO "me"',
        "COMMENT ON TABLE \"s\".\"p\" IS 'it''s'", 'CREATE TABLE "s"."c" ("id" bigint)', 'ALTER TABLE "s"."c" OWNER TO "me"',
        'ALTER TABLE "s"."p" ATTACH PARTITION "s"."c" DEFAULT',
    ]
    assert lines(script.down) == ['DROP TABLE "s"."c"', 'DROP TABLE "s"."p"', 'DROP SCHEMA "s"']


def random_catalog(spark, seed, pairs=60):
    rng = random.Random(seed)
    parts = {k: [] for k in ("schemas", "extensions", "tables", "columns", "indexes", "keys")}
    for p in range(pairs):
        for ns in rng.sample("xyz", 2):
            parts["schemas"].append((p, ns))
            for t in rng.sample("abcd", rng.randint(0, 3)):
                parts["tables"].append((p, ns, t, rng.choice("uv"), rng.choice([None, "n"]), rng.choice([None, "list"]), rng.choice([None, "q"])))
                for c in rng.sample("klm", rng.randint(1, 3)):
                    parts["columns"].append((p, ns, t, c, rng.choice(["text", "bigint"]), rng.random() < 0.5, rng.choice([None, "0"])))
                if rng.random() < 0.5:
                    parts["indexes"].append((p, ns, t, f"i{t}", rng.choice("kl")))
                if rng.random() < 0.6:
                    body = rng.choice([("p", "PRIMARY KEY (k)"), ("c", "CHECK ((k > 0))"), ("f", "FOREIGN KEY (k) REFERENCES x.a (k)")])
                    parts["keys"].append((p, ns, t, "con", *body))
        parts["extensions"] += [(p, e, rng.choice("12")) for e in rng.sample(["e", "f"], rng.randint(0, 2))]
    return catalog(spark, **parts)


def test_applying_all_changes_gives_the_target(spark):
    source, target = random_catalog(spark, 1), random_catalog(spark, 2)
    found = migration.drift(source, target)
    assert {r.object_kind for r in found.select("object_kind").distinct().collect()} == {"schema", "extension", "table", "column", "index", "constraint"}
    assert compare.compare_catalogs(patch.apply_changes(source, found), target).isEmpty()
    assert compare.compare_catalogs(source, source).isEmpty()
    # and every change has its place in a script
    script = migration.plan_migration(found)
    assert script.unordered.isEmpty()


def excluded(spark, deltas, rules):
    rows = spark.createDataFrame(rules, "pair_id long, object_kind string, glob string, attribute string")
    return exclude_changes(deltas, rows)


def test_exclusion_rules(spark):
    source = catalog(spark, tables=[(1, "s", "a", "u"), (2, "s", "a", "u")], columns=[(p, "s", "a", c, "text") for p in (1, 2) for c in "kl"])
    target = catalog(
        spark, tables=[(1, "s", "a", "v", "n"), (2, "s", "a", "v")],
        columns=[(1, "s", "a", "k", "bigint"), (1, "s", "a", "l", "text", False, None), (2, "s", "a", "k", "text"), (2, "s", "a", "l", "bigint")],
    )
    found = cut_lineage(compare.compare_catalogs(source, target))

    def kinds(*rules):
        rows = excluded(spark, found, list(rules)).collect()
        return sorted((r.pair_id, r.name, r.kind, ",".join(r.changed or [])) for r in rows)

    everything = [
        (1, "a", "alter_table_attrs", "owner,comment"), (1, "k", "alter_column_type", ""), (1, "l", "set_column_nullability", ""),
        (2, "a", "alter_table_attrs", "owner"), (2, "l", "alter_column_type", ""),
    ]
    assert kinds((None, None, "zzz*", None)) == everything
    assert kinds((None, "table", "s.*", "owner"), (1, None, "s.a.l", "nullable")) == [
        (1, "a", "alter_table_attrs", "comment"), (1, "k", "alter_column_type", ""), (2, "l", "alter_column_type", ""),
    ]
    assert kinds((None, None, "*.l", None), (None, "column", "s.a.?", "data_type"), (2, None, "s.a", None)) == [(1, "a", "alter_table_attrs", "owner,comment")]
    # a glob whose beginning is longer than a name finds nothing, repeated and overlapping rules do no harm
    assert kinds((1, None, "s.a.kkkkkkkkkkkkkkkkkkkkkk*", None)) == everything
    assert kinds(*[(None, None, "*", None)] * 3, (None, None, "s*", "owner")) == []


def test_written_scripts_hold_every_unit_in_its_range(spark, tmp_path):
    statements = [
        (p, line, f"s{p}.{line}" + "\nmore" * (line % 3), line % 4 != 0, line // 4, "SAFE") for p in (1, 2, 30) for line in range(1, 40)
    ]
    up = spark.createDataFrame(statements, "pair_id long, line long, statement string, transactional boolean, barrier long, risk string")
    folder = str(tmp_path / "run")
    sinks.write_migration(up.repartition(7), up.where("line < 3"), folder, file_rows=10)
    manifest = sinks.read_manifest(spark, folder).collect()
    for direction, rows in (("up", statements), ("down", [s for s in statements if s[1] < 3])):
        text = [r.text for r in sinks.read_script(spark, folder, direction).orderBy("line_number").collect()]
        assert "\n".join(text) == "\n".join(s[2] + ";" for s in rows)
        for unit in (m for m in manifest if m.direction == direction):
            slice_ = "\n".join(text[unit.first_line - 1 : unit.last_line])
            own = [s for s in rows if s[0] == unit.pair_id and s[3] == unit.transactional and s[2] + ";" in slice_]
            assert "\n".join(s[2] + ";" for s in own) == slice_ and len(own) == unit.statements
    assert sum(m.statements for m in manifest) == len(statements) + 6


@pytest.mark.parametrize("n", [0, 1])
def test_nothing_to_do(spark, n):
    same = catalog(spark, schemas=[(1, "s")][:n], tables=[(1, "s", "a")][:n], columns=[(1, "s", "a", "k", "text")][:n])
    script = migration.plan_migration(migration.drift(same, same))
    assert script.up.isEmpty() and script.units.isEmpty() and script.unordered.isEmpty()
