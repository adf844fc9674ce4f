"""Comparison properties on many random pairs at once."""

import random

import pytest
from pyspark.sql import functions as F

from fleetdrift.model import COLUMN, INDEX, PARTITION_INFO, PARTITION_OF
from fleetdrift.operators import compare, deltas, rename, risk, script
from fleetdrift.operators.compare import CompareOptions

FLAT = "pair_id int, namespace string, table_name string, name string, position int, data_type string, nullable boolean, default_expr string, collation string, generated string, generated_expression string"


def random_side(rng):
    rows = {}
    for _ in range(rng.randint(0, 8)):
        key = (rng.choice("st"), rng.choice("abc"), rng.choice("xyzw"))
        kind = rng.random()
        rows[key] = (
            rng.randint(1, 9), rng.choice(["int4", "text", "varchar(3)"]), rng.random() < 0.5,
            rng.choice([None, "1", "2"]) if kind > 0.4 else None, rng.choice([None, "C"]),
            rng.choice(["always", "by_default"]) if kind < 0.2 else None,
            rng.choice(["a+1", "a+2"]) if 0.2 <= kind < 0.4 else None,
        )
    return rows


def frame(spark, sides):
    rows = [(pair, *key, *value) for pair, side in enumerate(sides) for key, value in side.items()]
    flat = spark.createDataFrame(rows, FLAT)
    identity = F.struct(
        F.col("generated"), *[F.lit(None).cast("bigint") for _ in range(5)], F.lit(False)
    ).cast(COLUMN["identity"].dataType)
    return compare.normalize_columns(
        flat.withColumn("identity", F.when(F.col("generated").isNotNull(), identity)).drop("generated")
    )


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(7)
    return [random_side(rng) for _ in range(300)], [random_side(rng) for _ in range(300)]


CANONICAL = {"int4": "integer", "text": "text", "varchar(3)": "character varying(3)"}


def plain(side):
    """Attributes that changes carry; positions are informational."""
    return {k: (CANONICAL[v[1]], *v[2:]) for k, v in side.items()}


def test_applying_the_changes_gives_the_target(spark, sides):
    source, target = frame(spark, sides[0]), frame(spark, sides[1])
    changes = compare.compare_columns(source, target, derive_tables=True)
    changes = compare.attach_payload(changes, (source, target)).collect()
    state = [plain(s) for s in sides[0]]

    def value(c):
        return (c.data_type, c.nullable, c.default_expr, c.collation, c.identity and c.identity.generated, c.generated_expression)

    kinds = set()
    for d in changes:
        kinds.add(d.kind)
        db = state[d.pair_id]
        key = (d.namespace, d.parent_name, d.name)
        if d.kind == "create_table":
            db.update({(d.namespace, d.name, c.name): value(c) for c in d.table_columns})
        elif d.kind == "drop_table":
            assert len(d.table_columns) == sum(k[:2] == (d.namespace, d.name) for k in db)
            for k in [k for k in db if k[:2] == (d.namespace, d.name)]:
                del db[k]
        elif d.kind == "drop_column":
            del db[key]
        elif d.kind in ("add_column", "replace_column"):
            assert (key in db) == (d.kind == "replace_column")
            db[key] = value(d.column)
        else:
            old = list(db[key])
            if d.kind == "alter_column_type":
                old[0] = d.new_data_type
                old[3] = d.new_collation
                assert d.old_column.collation == db[key][3]
            elif d.kind == "set_column_default":
                old[2] = d.new_default
            elif d.kind == "set_column_nullability":
                old[1] = d.nullable
            db[key] = tuple(old)
    assert state == [plain(s) for s in sides[1]]
    assert kinds == {
        "create_table", "drop_table", "add_column", "drop_column", "replace_column", "alter_column_type",
        "set_column_default", "set_column_nullability",
    }


def test_comparing_a_side_with_itself_is_empty(spark, sides):
    source = frame(spark, sides[0])
    assert compare.compare_columns(source, source, derive_tables=True).isEmpty()


def test_repeated_rows_do_not_multiply(spark, sides):
    source, target = frame(spark, sides[0]), frame(spark, sides[1])
    once = compare.compare_columns(source, target).count()
    thrice = source.unionByName(source).unionByName(source)
    assert compare.compare_columns(thrice, target.unionByName(target)).count() == once


def test_case_insensitive_names_and_options(spark):
    a = [{("s", "T", "X"): (1, "int4", True, None, None, None, "a+1")}]
    b = [{("S", "t", "x"): (1, "int4", False, None, None, None, "a+2")}]
    loose = CompareOptions(case_sensitive=False, compare_generated=False)
    found = compare.compare_columns(frame(spark, a), frame(spark, b), loose).collect()
    assert [(r.kind, r.namespace, r.parent_name, r.name) for r in found] == [
        ("set_column_nullability", "s", "T", "X")
    ]
    assert compare.compare_columns(frame(spark, a), frame(spark, b)).isEmpty()
    both = compare.common_tables(frame(spark, a), frame(spark, b), loose)
    assert compare.compare_columns(frame(spark, a), frame(spark, b), loose, both).count() == 1
    twice = frame(spark, [{("s", "T", "X"): (1, "int4", True, None, None, None, None), ("s", "T", "x"): (2, "int4", True, None, None, None, None)}])
    (hidden,) = compare.colliding_names(twice, ["pair_id", "namespace", "table_name", "name"]).collect()
    assert (hidden.name, hidden.n_rows, hidden.n_spellings, hidden.kept) == ("x", 2, 2, "s.T.X")
    excluded = CompareOptions(case_sensitive=False, exclude_tables=["t*"], include_schemas=["S"])
    assert compare.compare_columns(frame(spark, a), frame(spark, b), excluded).isEmpty()


def test_table_attributes(spark):
    def tables(owner, comment):
        row = spark.createDataFrame([(1, "s", "t", owner, None, comment)], "pair_id int, namespace string, table_name string, owner string, tablespace string, comment string")
        return row.withColumn("partition_info", F.lit(None).cast(PARTITION_INFO)).withColumn(
            "partition_of", F.lit(None).cast(PARTITION_OF)
        )

    (d,) = compare.compare_tables(tables("a", "x"), tables("b", None)).collect()
    assert (d.kind, d.op, d.old_owner, d.new_owner) == ("alter_table_attrs", "alter", "a", "b")
    assert (d.changed, d.old_comment, d.new_comment) == (["owner", "comment"], "x", None)
    (r,) = script.render_statements(compare.compare_tables(tables("a", "x"), tables("b", None))).collect()
    assert r.forward == ['ALTER TABLE "s"."t" OWNER TO "b"', 'COMMENT ON TABLE "s"."t" IS NULL']
    assert r.rollback == ['ALTER TABLE "s"."t" OWNER TO "a"', """COMMENT ON TABLE "s"."t" IS 'x'"""]
    silent = CompareOptions(compare_owner=False, compare_comments=False)
    assert compare.compare_tables(tables("a", "x"), tables("b", None), silent).isEmpty()


def test_renames_need_both_ends(spark):
    source = frame(spark, [{("s", "t", "x"): (1, "text", True, None, None, None, None)}])
    target = frame(spark, [{("s", "t", "y"): (1, "text", False, None, None, None, None)}])
    schema = "pair_id int, namespace string, table_name string, old_name string, new_name string"
    renames = spark.createDataFrame([(0, "s", "t", "x", "y"), (0, "s", "t", "x", "z"), (0, "s", "t", "x", "x")], schema)
    effective, changes = rename.rename_columns(source, target, renames)
    assert [(r.kind, r.name, r.new_name) for r in changes.collect()] == [("rename_column", "x", "y")]
    rest = compare.compare_columns(rename.apply_column_renames(source, effective), target)
    assert [(r.kind, r.name) for r in rest.collect()] == [("set_column_nullability", "y")]
    assert {r.kind for r in compare.compare_columns(source, target).collect()} == {"drop_column", "add_column"}


def test_risks_and_gate(spark):
    source = frame(spark, [{("s", "t", "a"): (1, "text", True, None, None, None, None)}])
    target = frame(
        spark,
        [
            {
                ("s", "t", "a"): (1, "text", False, None, None, None, None),
                ("s", "t", "b"): (2, "text", True, None, None, None, None),
                ("s", "t", "c"): (3, "text", False, "1", None, None, None),
                ("s", "t", "d"): (4, "text", False, None, None, None, None),
            }
        ],
    )
    graded = risk.classify_risk(compare.compare_columns(source, target))
    assert {r.name: r.risk for r in graded.collect()} == {"a": "WARNING", "b": "SAFE", "c": "WARNING", "d": "BLOCKED"}
    allowed, refused = risk.risk_gate(graded, "BLOCKED")
    assert allowed.count() == 3 and [r.name for r in refused.collect()] == ["d"]
    assert risk.migration_risk(graded).collect()[0].max_risk == "BLOCKED"


def test_statements(spark):
    source = frame(spark, [{("s", "t", 'a"b'): (1, "text", True, "1", None, None, None)}])
    target = frame(spark, [{("s", "t", 'a"b'): (1, "int4", False, None, None, None, None)}])
    rows = script.render_statements(compare.compare_columns(source, target)).collect()
    assert {r.kind: (r.forward, r.rollback) for r in rows} == {
        "alter_column_type": (
            ['ALTER TABLE "s"."t" ALTER COLUMN "a""b" TYPE integer'], ['ALTER TABLE "s"."t" ALTER COLUMN "a""b" TYPE text'],
        ),
        "set_column_default": (
            ['ALTER TABLE "s"."t" ALTER COLUMN "a""b" DROP DEFAULT'], ['ALTER TABLE "s"."t" ALTER COLUMN "a""b" SET DEFAULT 1'],
        ),
        "set_column_nullability": (
            ['ALTER TABLE "s"."t" ALTER COLUMN "a""b" SET NOT NULL'], ['ALTER TABLE "s"."t" ALTER COLUMN "a""b" DROP NOT NULL'],
        ),
    }


def test_index_conflict_and_statement(spark):
    def side(method):
        key = "array(named_struct('column_name', 'c', 'expression', null, 'opclass', null, 'sort_order', 'desc', 'nulls_order', 'last'))"
        return spark.sql(
            f"SELECT 1 AS pair_id, 's' AS namespace, 't' AS table_name, 'i' AS name, '{method}' AS method, {key} AS key_columns, "
            "array('z') AS include_columns, true AS unique, 'c > 0' AS predicate, null AS comment"
        )

    changes = compare.compare_indexes(side("btree"), side("hash"))
    (d,) = script.render_statements(deltas.combine_deltas(changes)).collect()
    assert d.kind == "replace_index" and d.is_conflict and not d.transactional
    assert d.forward == [
        'DROP INDEX CONCURRENTLY "s"."i"',
        'CREATE UNIQUE INDEX CONCURRENTLY "i" ON "s"."t" USING hash ("c" DESC NULLS LAST) INCLUDE ("z") WHERE c > 0',
    ]
    assert changes.schema["index"].dataType == INDEX


def test_constraint_statements(spark):
    from fleetdrift.functions.constraints import constraint_fields, constraint_kind

    def side(definitions):
        rows = spark.createDataFrame(definitions, "name string, code string, definition string")
        none = F.lit(None).cast("string")
        fields = constraint_fields(F.col("code"), F.col("definition"), none, none)
        return rows.select(
            F.lit(1).alias("pair_id"), F.lit("s").alias("namespace"), F.lit("t").alias("table_name"), "name",
            constraint_kind(F.col("code")).alias("kind"), F.lit("deferrable_initially_deferred").alias("deferrability"),
            *[v.alias(n) for n, v in fields.items()],
        )

    target = side(
        [
            ("p", "p", "PRIMARY KEY (a, b)"),
            ("u", "u", "UNIQUE NULLS NOT DISTINCT (a)"),
            ("c", "c", "CHECK ((a > 0))"),
            ("n", "c", "CHECK ((a > 0)) NO INHERIT"),
            ("f", "f", "FOREIGN KEY (a) REFERENCES x.y (id) MATCH FULL ON DELETE SET NULL"),
            ("x", "x", "EXCLUDE USING gist (r WITH =, d WITH &&) WHERE (a > 0)"),
        ]
    )
    rows = script.render_statements(compare.compare_constraints(target.where("false"), target)).collect()
    start, end = 'ALTER TABLE "s"."t" ADD CONSTRAINT ', " DEFERRABLE INITIALLY DEFERRED"
    assert {r.name: r.forward for r in rows} == {
        "p": [start + '"p" PRIMARY KEY ("a", "b")' + end],
        "u": [start + '"u" UNIQUE NULLS NOT DISTINCT ("a")' + end],
        "c": [start + '"c" CHECK ((a > 0))' + end + " NOT VALID", 'ALTER TABLE "s"."t" VALIDATE CONSTRAINT "c"'],
        "n": [start + '"n" CHECK ((a > 0)) NO INHERIT' + end + " NOT VALID", 'ALTER TABLE "s"."t" VALIDATE CONSTRAINT "n"'],
        "f": [
            start + '"f" FOREIGN KEY ("a") REFERENCES "x"."y" ("id") MATCH FULL ON DELETE SET NULL' + end + " NOT VALID",
            'ALTER TABLE "s"."t" VALIDATE CONSTRAINT "f"',
        ],
        "x": [start + '"x" EXCLUDE USING gist (r WITH =, d WITH &&) WHERE (a > 0)' + end],
    }
