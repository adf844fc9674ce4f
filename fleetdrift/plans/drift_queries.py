"""Queries on comparing, grading, rendering and summarizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetdrift.model import PARTITION_INFO, PARTITION_OF
from fleetdrift.functions.columns import identity_spec
from fleetdrift.functions.constraints import constraint_fields, constraint_kind
from fleetdrift.operators import compare, deltas, rename, risk
from fleetdrift.operators.compare import CompareOptions
from fleetdrift.plans.fixtures import CANONICAL, ORACLE_CTES, fixture, table
from fleetdrift.plans.registry import query

# --- inputs ---


def _with_identity(columns):
    timing = F.when(F.col("identity_generated") == "always", F.lit("ALWAYS")).otherwise(F.lit("BY DEFAULT"))
    return columns.withColumn(
        "identity", identity_spec(F.col("identity_generated").isNotNull(), timing)
    ).drop("identity_generated")


def side_columns(spark, folder, side: str):
    """Columns of one side with canonical types."""
    return _with_identity(compare.normalize_columns(fixture(spark, folder, f"fx_{side}")))


def column_deltas(spark, folder, options=compare.DEFAULTS):
    return compare.compare_columns(
        side_columns(spark, folder, "source"), side_columns(spark, folder, "target"), options
    )


def all_deltas(spark, folder):
    """Table and column changes of every pair, from one comparison."""
    return compare.compare_columns(
        side_columns(spark, folder, "source"), side_columns(spark, folder, "target"), derive_tables=True
    )


def graded(spark, folder):
    return risk.classify_risk(all_deltas(spark, folder))


def side_tables(spark, folder, side: str):
    rows = fixture(spark, folder, f"fx_{side}_table")
    info = F.when(
        F.col("strategy").isNotNull(),
        F.struct(F.col("strategy"), F.lit("(c1)").alias("partition_key")).cast(PARTITION_INFO),
    )
    child = F.when(
        F.col("parent").isNotNull(),
        F.struct(F.lit("s"), F.col("parent"), F.lit(None).cast("string")).cast(PARTITION_OF),
    )
    return rows.withColumn("partition_info", info).withColumn("partition_of", child).drop("strategy", "parent")


def side_indexes(spark, folder, side: str):
    none = F.lit(None).cast("string")
    key = F.array(
        F.struct(
            F.col("key_name").alias("column_name"), none.alias("expression"), none.alias("opclass"),
            F.lit("asc").alias("sort_order"), none.alias("nulls_order"),
        )
    )
    return fixture(spark, folder, f"fx_{side}_index").select(
        "pair_id", "namespace", "table_name", "name", "method", key.alias("key_columns"),
        F.array().cast("array<string>").alias("include_columns"), F.col("is_unique").alias("unique"),
        "predicate", none.alias("comment"),
    )


def index_deltas(spark, folder):
    return compare.compare_indexes(
        side_indexes(spark, folder, "source"), side_indexes(spark, folder, "target")
    )


def side_constraints(spark, folder, side: str):
    none = F.lit(None).cast("string")
    fields = constraint_fields(F.col("contype"), F.col("condef"), none, none)
    return fixture(spark, folder, f"fx_{side}_constraint").select(
        "pair_id", "namespace", "table_name", "name", constraint_kind(F.col("contype")).alias("kind"),
        F.lit("not_deferrable").alias("deferrability"), *[v.alias(n) for n, v in fields.items()],
    )


def constraint_deltas(spark, folder):
    return compare.compare_constraints(
        side_constraints(spark, folder, "source"), side_constraints(spark, folder, "target")
    )


# --- oracle texts ---

_KEY = "pair_id, namespace, table_name, name"
_ON = " AND ".join(f"s.{k} = t.{k}" for k in _KEY.split(", "))
_DIFFERS = "s.{0} IS DISTINCT FROM t.{0}"
_REPLACED = f"({_DIFFERS.format('identity_generated')} OR {_DIFFERS.format('generated_expression')})"
_COLUMN_FIELDS = 'data_type, nullable, default_expr, "collation", identity_generated, generated_expression'


ORACLE_CTES.update(
    norm_source=f"SELECT * REPLACE ({CANONICAL.format('data_type')} AS data_type) FROM {{fx_source}}",
    norm_target=f"SELECT * REPLACE ({CANONICAL.format('data_type')} AS data_type) FROM {{fx_target}}",
    source_tables="SELECT DISTINCT pair_id, namespace, table_name FROM {fx_source}",
    target_tables="SELECT DISTINCT pair_id, namespace, table_name FROM {fx_target}",
    both_tables="SELECT * FROM {source_tables} INTERSECT SELECT * FROM {target_tables}",
)

_CHANGES = [
    ("create", "add_column", "s.name IS NULL", "t", "NULL, NULL, NULL, CAST(NULL AS BOOLEAN)"),
    ("drop", "drop_column", "t.name IS NULL", "s", "NULL, NULL, NULL, NULL"),
    ("replace", "replace_column", f"s.name IS NOT NULL AND t.name IS NOT NULL AND {_REPLACED}", "t", "NULL, NULL, NULL, NULL"),
    (
        "alter",
        "alter_column_type",
        f"s.name IS NOT NULL AND t.name IS NOT NULL AND NOT {_REPLACED} AND "
        f"({_DIFFERS.format('data_type')} OR {_DIFFERS.format('collation')})",
        "s",
        't.data_type, t."collation", NULL, NULL',
    ),
    (
        "alter",
        "set_column_default",
        f"s.name IS NOT NULL AND t.name IS NOT NULL AND NOT {_REPLACED} AND {_DIFFERS.format('default_expr')}",
        "s",
        "NULL, NULL, t.default_expr, NULL",
    ),
    (
        "alter",
        "set_column_nullability",
        f"s.name IS NOT NULL AND t.name IS NOT NULL AND NOT {_REPLACED} AND {_DIFFERS.format('nullable')}",
        "s",
        "NULL, NULL, NULL, t.nullable",
    ),
]


def _change_rows(source: str, target: str, both: str) -> str:
    key = ", ".join(f"coalesce(s.{k}, t.{k}) AS {k}" for k in _KEY.split(", "))
    parts = []
    for op, kind, where, side, extra in _CHANGES:
        new = [e.strip() for e in _split(extra)]
        fields = ", ".join(f"{side}.{c} AS {c}" for c in _COLUMN_FIELDS.split(", "))
        parts.append(
            f"SELECT '{op}' AS op, '{kind}' AS kind, {key}, {fields}, CAST({new[0]} AS VARCHAR) AS new_data_type, "
            f"CAST({new[1]} AS VARCHAR) AS new_collation, CAST({new[2]} AS VARCHAR) AS new_default, "
            f"CAST({new[3]} AS BOOLEAN) AS new_nullable "
            f"FROM {source} s FULL JOIN {target} t ON {_ON} WHERE {where}"
        )
    inner = " UNION ALL ".join(parts)
    return f"SELECT c.* FROM ({inner}) c JOIN {both} b USING (pair_id, namespace, table_name)"


def _split(text: str) -> list[str]:
    """Split at commas outside parentheses and CASE ... END; enough for the lists above."""
    out, depth, current = [], 0, ""
    for token in text.replace(",", " , ").split(" "):
        depth += token.count("(") - token.count(")") + (token == "CASE") - (token == "END")
        if token == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += " " + token
    return [*out, current]


ORACLE_CTES.update(
    column_changes=_change_rows("{norm_source}", "{norm_target}", "{both_tables}"),
    table_changes="""
SELECT 'create' AS op, 'create_table' AS kind, t.* FROM ({target_tables_only}) t
UNION ALL SELECT 'drop', 'drop_table', s.* FROM ({source_tables_only}) s""".replace(
        "({target_tables_only})", "(SELECT * FROM {target_tables} EXCEPT SELECT * FROM {source_tables})"
    ).replace("({source_tables_only})", "(SELECT * FROM {source_tables} EXCEPT SELECT * FROM {target_tables})"),
    changes="""
SELECT op, kind, pair_id, namespace, table_name, name, 'column' AS object_kind, new_nullable,
  nullable AS payload_nullable, coalesce(default_expr, identity_generated, generated_expression) IS NOT NULL AS payload_filled
FROM {column_changes}
UNION ALL
SELECT op, kind, pair_id, namespace, NULL, table_name, 'table', NULL, NULL, NULL FROM {table_changes}""",
    graded_changes="""
SELECT *, CASE WHEN kind = 'add_column' THEN CASE WHEN payload_nullable THEN 'SAFE' WHEN payload_filled THEN 'WARNING' ELSE 'BLOCKED' END
  WHEN kind IN ('drop_column', 'drop_table') THEN 'DESTRUCTIVE' WHEN kind = 'alter_column_type' THEN 'DANGEROUS'
  WHEN kind = 'replace_column' THEN 'BLOCKED' WHEN kind = 'set_column_nullability' AND NOT new_nullable THEN 'WARNING'
  ELSE 'SAFE' END AS risk FROM {changes}""",
)

# --- section: matching and change kinds ---

_PARENT = "pair_id, namespace, table_name AS parent_name, name"


@query(
    "SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, coalesce(s.namespace, t.namespace) AS namespace, "
    "coalesce(s.table_name, t.table_name) AS table_name, coalesce(s.name, t.name) AS name, "
    "s.name IS NOT NULL AS in_source, t.name IS NOT NULL AS in_target "
    f"FROM {{fx_source}} s FULL JOIN {{fx_target}} t ON {_ON}"
)
def snapshot_match(spark, folder):
    key = ["pair_id", "namespace", "table_name", "name"]
    matched = compare.match_snapshots(
        fixture(spark, folder, "fx_source"), fixture(spark, folder, "fx_target"), key
    )
    return matched.select(
        *key, F.col("src").isNotNull().alias("in_source"), F.col("tgt").isNotNull().alias("in_target")
    )


def _column_text(column="column"):
    c = F.col(column)
    return [
        c["data_type"].alias("data_type"), c["nullable"].alias("col_nullable"), c["default_expr"].alias("default_expr"),
        c["collation"].alias("collation"), c["identity"]["generated"].alias("identity_generated"),
        c["generated_expression"].alias("generated_expression"),
    ]


_PAYLOAD = 'data_type, nullable AS col_nullable, default_expr, "collation", identity_generated, generated_expression'


def _register_kind(kind: str, sql_payload: str, spark_payload):
    @query(f"SELECT op, {_PARENT}, {sql_payload} FROM {{column_changes}} WHERE kind = '{kind}'", name=kind)
    def run(spark, folder):
        rows = column_deltas(spark, folder).where(F.col("kind") == kind)
        return rows.select("op", "pair_id", "namespace", "parent_name", "name", *spark_payload())


_register_kind("add_column", _PAYLOAD, _column_text)
_register_kind("drop_column", _PAYLOAD, _column_text)
_register_kind("replace_column", _PAYLOAD, _column_text)
_register_kind("alter_column_type", "new_data_type, new_collation", lambda: ["new_data_type", "new_collation"])
_register_kind("set_column_default", "new_default", lambda: ["new_default"])
_register_kind("set_column_nullability", "new_nullable", lambda: [F.col("nullable").alias("new_nullable")])


def _table_payload(kind, side):
    """Created or dropped tables with their columns as one text."""
    sql = (
        "SELECT c.op, c.pair_id, c.namespace, c.table_name AS name, "
        "string_agg(x.name || ' ' || x.data_type, ', ' ORDER BY x.position) AS columns "
        f"FROM {{table_changes}} c JOIN {{norm_{side}}} x USING (pair_id, namespace, table_name) "
        f"WHERE c.kind = '{kind}' GROUP BY ALL"
    )

    @query(sql, name=kind)
    def run(spark, folder):
        rows = all_deltas(spark, folder).where(F.col("kind") == kind)
        columns = F.transform("table_columns", lambda c: F.concat_ws(" ", c["name"], c["data_type"]))
        return rows.select(
            "op", "pair_id", "namespace", "name", F.array_join(columns, ", ").alias("columns")
        )


_table_payload("create_table", "target")
_table_payload("drop_table", "source")

_ATTRS = ["tablespace", "strategy", "parent", "owner", "comment"]
_ATTR_SQL = ", ".join(
    f"CASE WHEN {_DIFFERS.format(a)} THEN {side}.{a} END AS {word}_{a}" for a in _ATTRS for side, word in (("s", "old"), ("t", "new"))
)
_ATTR_NAMES = {"strategy": "partition_info", "parent": "partition_of"}
_ATTR_LIST = ", ".join(f"CASE WHEN {_DIFFERS.format(a)} THEN '{_ATTR_NAMES.get(a, a)}' END" for a in _ATTRS)


@query(
    f"SELECT * FROM (SELECT pair_id, namespace, table_name AS name, concat_ws(',', {_ATTR_LIST}) AS changed, {_ATTR_SQL} "
    "FROM {fx_source_table} s JOIN {fx_target_table} t USING (pair_id, namespace, table_name)) a WHERE changed <> ''"
)
def alter_table_attrs(spark, folder):
    changed = compare.compare_tables(
        side_tables(spark, folder, "source"), side_tables(spark, folder, "target")
    ).where(F.col("kind") == "alter_table_attrs")
    plain = [F.col(f"{w}_{a}") for a in ("tablespace", "owner", "comment") for w in ("old", "new")]
    nested = [
        c
        for w in ("old", "new")
        for c in (
            F.col(f"{w}_partition_info.strategy").alias(f"{w}_strategy"),
            F.col(f"{w}_partition_of.parent_name").alias(f"{w}_parent"),
        )
    ]
    return changed.select("pair_id", "namespace", "name", F.array_join("changed", ",").alias("changed"), *plain, *nested)


_INDEX_DIFF = " OR ".join(_DIFFERS.format(c) for c in ("table_name", "method", "key_name", "is_unique", "predicate"))


@query(
    "SELECT pair_id, namespace, name, CASE WHEN s.method IS NULL THEN 'create_index' WHEN t.method IS NULL "
    "THEN 'drop_index' ELSE 'replace_index' END AS kind, t.method AS new_method, t.key_name AS new_key, "
    "t.predicate AS new_predicate FROM {fx_source_index} s FULL JOIN {fx_target_index} t USING (pair_id, namespace, name) "
    f"WHERE s.method IS NULL OR t.method IS NULL OR {_INDEX_DIFF}"
)
def index_changes(spark, folder):
    return index_deltas(spark, folder).select(
        "pair_id", "namespace", "name", "kind", F.col("index.method").alias("new_method"),
        F.get("index.key_columns", F.lit(0))["column_name"].alias("new_key"),
        F.col("index.predicate").alias("new_predicate"),
    )


@query(
    "SELECT pair_id, namespace, name, s.method AS old_method, t.method AS new_method "
    "FROM {fx_source_index} s JOIN {fx_target_index} t USING (pair_id, namespace, name) "
    f"WHERE {_INDEX_DIFF}"
)
def conflicts(spark, folder):
    found = index_deltas(spark, folder).where("is_conflict")
    return found.select(
        "pair_id", "namespace", "name", F.col("old_index.method").alias("old_method"),
        F.col("index.method").alias("new_method"),
    )


_CON_KEY = "pair_id, namespace, table_name, name"


@query(
    f"SELECT {_CON_KEY}, 'drop_constraint' AS kind, s.condef AS body FROM {{fx_source_constraint}} s "
    f"LEFT JOIN {{fx_target_constraint}} t USING ({_CON_KEY}) WHERE t.condef IS NULL OR t.condef <> s.condef UNION ALL "
    f"SELECT {_CON_KEY}, 'add_constraint', t.condef FROM {{fx_target_constraint}} t "
    f"LEFT JOIN {{fx_source_constraint}} s USING ({_CON_KEY}) WHERE s.condef IS NULL OR t.condef <> s.condef"
)
def constraint_changes(spark, folder):
    c = F.col("constraint")
    # the fixtures' definitions, put together again from the parsed fields
    body = (
        F.when(c["kind"] == "primary_key", F.concat(F.lit("PRIMARY KEY ("), F.array_join(c["columns"], ", "), F.lit(")")))
        .when(c["kind"] == "check", F.concat(F.lit("CHECK ("), c["expression"], F.lit(")")))
        .otherwise(
            F.concat(
                F.lit("FOREIGN KEY ("), F.array_join(c["columns"], ", "), F.lit(") REFERENCES "), c["ref_namespace"],
                F.lit("."), c["ref_table"], F.lit(" ("), F.array_join(c["ref_columns"], ", "), F.lit(")"),
                F.when(c["on_delete"] == "cascade", F.lit(" ON DELETE CASCADE")).otherwise(F.lit("")),
            )
        )
    )
    return constraint_deltas(spark, folder).select(
        "pair_id", "namespace", F.col("parent_name").alias("table_name"), "name", "kind", body.alias("body")
    )


_SCHEMA_SIDE = "SELECT DISTINCT o_custkey AS pair_id, lower(o_orderpriority) AS namespace FROM {orders} WHERE o_orderkey % "


@query(
    f"SELECT t.*, 'create_schema' AS kind FROM ({_SCHEMA_SIDE} 3 <> 0) t ANTI JOIN ({_SCHEMA_SIDE} 4 <> 0) s "
    "USING (pair_id, namespace) UNION ALL "
    f"SELECT s.*, 'drop_schema' FROM ({_SCHEMA_SIDE} 4 <> 0) s ANTI JOIN ({_SCHEMA_SIDE} 3 <> 0) t "
    "USING (pair_id, namespace)"
)
def schema_changes(spark, folder):
    orders = table(spark, folder, "orders")

    def side(divisor):
        return orders.where(F.col("o_orderkey") % divisor != 0).select(
            F.col("o_custkey").alias("pair_id"), F.lower("o_orderpriority").alias("namespace")
        )

    found = compare.compare_schemas(side(4), side(3))
    return found.select("pair_id", "namespace", "kind")


@query(
    "SELECT s_nationkey AS pair_id, 'e' || CAST(s_suppkey AS STRING) AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'create_extension' "
    "WHEN s_suppkey % 7 = 0 THEN 'drop_extension' ELSE 'alter_extension' END AS kind, "
    "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE '1.0' END AS old_version, "
    "CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN '1.1' ELSE '1.0' END AS new_version "
    "FROM {supplier} WHERE s_suppkey % 35 <> 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 OR s_suppkey % 3 = 0)"
)
def extension_changes(spark, folder):
    key = F.col("s_suppkey")
    rows = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("pair_id"), F.concat(F.lit("e"), key.cast("string")).alias("name"), "s_suppkey"
    )
    source = rows.where(key % 5 != 0).select("pair_id", "name", F.lit("1.0").alias("version"))
    updated = F.when(key % 3 == 0, F.lit("1.1")).otherwise(F.lit("1.0"))
    target = rows.where(key % 7 != 0).select("pair_id", "name", updated.alias("version"))
    found = compare.compare_extensions(source, target)
    return found.select("pair_id", "name", "kind", "old_version", "new_version")


@query("SELECT CAST(0 AS BIGINT) AS n_deltas")
def idempotence(spark, folder):
    source = side_columns(spark, folder, "source")
    tables = side_tables(spark, folder, "source")
    same = deltas.combine_deltas(
        compare.compare_columns(source, source, derive_tables=True), compare.compare_tables(tables, tables)
    )
    return same.agg(F.count(F.lit(1)).alias("n_deltas"))


# --- section: renames ---

_RENAME = (
    "SELECT pair_id, namespace, table_name, 'c1' AS old_name, 'c7' AS new_name FROM {source_tables} WHERE pair_id % 5 = 0"
)
ORACLE_CTES["effective_renames"] = f"""
SELECT r.* FROM ({_RENAME}) r
WHERE EXISTS (SELECT 1 FROM {{fx_source}} s WHERE s.pair_id = r.pair_id AND s.namespace = r.namespace AND s.table_name = r.table_name AND s.name = r.old_name)
  AND EXISTS (SELECT 1 FROM {{fx_target}} t WHERE t.pair_id = r.pair_id AND t.namespace = r.namespace AND t.table_name = r.table_name AND t.name = r.new_name)
  AND NOT EXISTS (SELECT 1 FROM {{fx_source}} s WHERE s.pair_id = r.pair_id AND s.namespace = r.namespace AND s.table_name = r.table_name AND s.name = r.new_name)"""
ORACLE_CTES["renamed_source"] = """
SELECT s.* REPLACE (coalesce(r.new_name, s.name) AS name) FROM {norm_source} s LEFT JOIN {effective_renames} r
  ON r.pair_id = s.pair_id AND r.namespace = s.namespace AND r.table_name = s.table_name AND r.old_name = s.name"""
ORACLE_CTES["renamed_changes"] = _change_rows("{renamed_source}", "{norm_target}", "{both_tables}")


def _column_renames(source):
    pairs = source.where(F.col("pair_id") % 5 == 0).select("pair_id", "namespace", "table_name").distinct()
    return pairs.select("*", F.lit("c1").alias("old_name"), F.lit("c7").alias("new_name"))


@query(
    "SELECT pair_id, namespace, table_name AS parent_name, old_name, new_name, 'rename_column' AS kind FROM {effective_renames}"
)
def rename_column(spark, folder):
    source, target = side_columns(spark, folder, "source"), side_columns(spark, folder, "target")
    _, changes = rename.rename_columns(source, target, _column_renames(source))
    return changes.select("pair_id", "namespace", "parent_name", "old_name", "new_name", "kind")


@query(
    "SELECT pair_id, namespace, table_name AS parent_name, name, kind, new_data_type FROM {renamed_changes} UNION ALL "
    "SELECT pair_id, namespace, table_name, old_name, 'rename_column', NULL FROM {effective_renames}"
)
def apply_renames(spark, folder):
    source, target = side_columns(spark, folder, "source"), side_columns(spark, folder, "target")
    effective, changes = rename.rename_columns(source, target, _column_renames(source))
    renamed = rename.apply_column_renames(source, effective)
    combined = deltas.combine_deltas(changes, compare.compare_columns(renamed, target))
    return combined.select("pair_id", "namespace", "parent_name", "name", "kind", "new_data_type")


_RENAMED_TABLE = (
    "SELECT o_custkey AS pair_id, lower(o_orderpriority) AS namespace, 't' || CAST(o_orderkey AS STRING) AS old_name, "
    "'t' || CAST(o_orderkey AS STRING) || '_v2' AS new_name FROM {orders} WHERE o_orderkey % 5 = 0 AND o_custkey % 11 = 0"
)


@query(
    f"SELECT pair_id, namespace, old_name, new_name FROM ({_RENAMED_TABLE}) r "
    "WHERE CAST(substr(old_name, 2) AS BIGINT) % 13 <> 0 AND CAST(substr(old_name, 2) AS BIGINT) % 3 <> 0"
)
def rename_table(spark, folder):
    orders = table(spark, folder, "orders")
    name = F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    base = orders.select(
        "o_orderkey", F.col("o_custkey").alias("pair_id"), F.lower("o_orderpriority").alias("namespace"),
        name.alias("table_name"),
    )
    annotated = base.where((F.col("o_orderkey") % 5 == 0) & (F.col("pair_id") % 11 == 0))
    renames = annotated.select(
        "pair_id", "namespace", F.col("table_name").alias("old_name"), F.concat("table_name", F.lit("_v2")).alias("new_name")
    )
    # every third annotated table has not been renamed on the target
    moved = annotated.where(F.col("o_orderkey") % 3 != 0).withColumn(
        "table_name", F.concat("table_name", F.lit("_v2"))
    )
    source = base.where(F.col("o_orderkey") % 13 != 0)
    effective, changes = rename.rename_tables(source, base.unionByName(moved), renames)
    return changes.select("pair_id", "namespace", "old_name", "new_name")


# --- section: delta sets ---

ORACLE_CTES["index_ops"] = """
SELECT pair_id, namespace, name, CASE WHEN s.method IS NULL THEN 'create' WHEN t.method IS NULL THEN 'drop' ELSE 'conflict' END AS op
FROM {fx_source_index} s FULL JOIN {fx_target_index} t USING (pair_id, namespace, name)
WHERE s.method IS NULL OR t.method IS NULL OR s.table_name <> t.table_name OR s.method <> t.method OR s.key_name <> t.key_name
  OR s.is_unique <> t.is_unique OR s.predicate IS DISTINCT FROM t.predicate"""

_BARE = "op, kind, pair_id, namespace, table_name AS parent_name, name, object_kind"
_REF = ["op", "kind", "pair_id", "namespace", "parent_name", "name", "object_kind"]


@query(
    f"SELECT {_BARE} FROM {{changes}} UNION ALL "
    "SELECT if(op = 'conflict', 'replace', op) AS op, if(op = 'conflict', 'replace', op) || '_index', pair_id, namespace, NULL, name, 'index' "
    "FROM {index_ops}"
)
def combine_deltas(spark, folder):
    combined = deltas.combine_deltas(all_deltas(spark, folder), index_deltas(spark, folder))
    return combined.select(*_REF)


@query(f"SELECT {_BARE} FROM {{changes}} WHERE op = 'alter'")
def deltas_by_op(spark, folder):
    return deltas.deltas_by_op(all_deltas(spark, folder), "alter").select(*_REF)


@query(
    f"SELECT {_BARE} FROM {{changes}} WHERE object_kind = 'column' AND namespace = '1-urgent' AND table_name = 't3' AND name = 'c2' "
    f"UNION ALL SELECT {_BARE} FROM {{changes}} WHERE object_kind = 'table' AND namespace = '4-not specified' AND name = 't13'"
)
def deltas_by_target(spark, folder):
    rows = all_deltas(spark, folder).select(*_REF)
    column = deltas.deltas_by_target(rows, "column", "1-urgent", "c2", "t3")
    return column.unionByName(deltas.deltas_by_target(rows, "table", "4-not specified", "t13"))


@query(
    "SELECT pair_id, namespace, table_name AS parent_name, name, 'set_column_default' AS kind FROM {fx_source} s "
    "WHERE EXISTS (SELECT 1 FROM {changes} c WHERE c.kind = 'set_column_default' AND c.pair_id = s.pair_id "
    "AND c.namespace = s.namespace AND c.table_name = s.table_name AND c.name = s.name)"
)
def delta_membership(spark, folder):
    items = fixture(spark, folder, "fx_source").select(
        "pair_id", "namespace", F.col("table_name").alias("parent_name"), "name", F.lit("set_column_default").alias("kind")
    )
    return deltas.contains_deltas(column_deltas(spark, folder), items)


@query(
    f"SELECT {_BARE}, concat_ws('/', namespace, table_name, name, op, kind) AS sort_key FROM {{changes}}"
)
def delta_sort_key(spark, folder):
    rows = all_deltas(spark, folder)
    keyed = rows.select(*_REF, deltas.delta_sort_key().alias("sort_key"))
    return keyed.orderBy("pair_id", "sort_key").withColumn("sort_key", F.array_join("sort_key", "/"))


@query(f"SELECT {_BARE}, risk FROM {{graded_changes}} WHERE risk = 'WARNING' AND op = 'alter'")
def change_filter(spark, folder):
    return deltas.filter_changes(graded(spark, folder), risk="WARNING", op="alter").select(*_REF, "risk")


# --- section: grading, gate, options ---


@query(f"SELECT {_BARE}, risk FROM {{graded_changes}}")
def classify_risk(spark, folder):
    return graded(spark, folder).select(*_REF, "risk")


_RANK = "CASE risk WHEN 'SAFE' THEN 0 WHEN 'WARNING' THEN 1 WHEN 'DANGEROUS' THEN 2 WHEN 'DESTRUCTIVE' THEN 3 ELSE 4 END"
_LABEL = "CASE max({0}) WHEN 0 THEN 'SAFE' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'DANGEROUS' WHEN 3 THEN 'DESTRUCTIVE' ELSE 'BLOCKED' END"


@query(f"SELECT pair_id, {_LABEL.format(_RANK)} AS max_risk FROM {{graded_changes}} GROUP BY pair_id")
def migration_risk(spark, folder):
    return risk.migration_risk(graded(spark, folder))


@query(
    f"SELECT {_BARE}, risk, risk IN ('SAFE', 'WARNING', 'DANGEROUS') AS allowed FROM {{graded_changes}}"
)
def max_risk_gate(spark, folder):
    allowed, refused = risk.risk_gate(graded(spark, folder).select(*_REF, "risk"))
    return allowed.withColumn("allowed", F.lit(True)).unionByName(
        refused.withColumn("allowed", F.lit(False))
    )


_SCOPE = (
    "namespace IN ('1-urgent', '2-high') AND NOT starts_with(table_name, 't1') AND NOT (length(table_name) = 3 AND right(table_name, 1) = '3')"
)
ORACLE_CTES.update(
    option_source=f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS generated_expression) FROM {{norm_source}} WHERE {_SCOPE}",
    option_target=f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS generated_expression) FROM {{norm_target}} WHERE {_SCOPE}",
    option_tables=f"SELECT * FROM {{both_tables}} WHERE {_SCOPE}",
)


@query(
    f"SELECT {_BARE} FROM (" + _change_rows("{option_source}", "{option_target}", "{option_tables}").replace(
        "SELECT c.*", "SELECT c.*, 'column' AS object_kind"
    ) + ") x"
)
def compare_options(spark, folder):
    options = CompareOptions(
        include_schemas=["1-urgent", "2-high"], exclude_tables=["t1*", "t?3"], compare_generated=False,
        case_sensitive=False,
    )
    source = side_columns(spark, folder, "source").withColumn("name", F.upper("name"))
    found = compare.compare_columns(source, side_columns(spark, folder, "target"), options)
    # names are reported as the source spells them
    return found.select(*_REF).withColumn("name", F.lower("name"))
