"""Queries on the model rules, over rows broken by key modulo."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetdrift.model import COLUMN, IDENTITY, OBJECT_KINDS, PARTITION_INFO, PARTITION_OF
from fleetdrift.operators import validate
from fleetdrift.plans.fixtures import ORACLE_CTES, fixture, table
from fleetdrift.plans.registry import query

# --- references: orders stand for objects of all kinds ---

_KINDS = "CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(OBJECT_KINDS)) + " END"
_REFS = f"""
SELECT o_custkey AS db_id, {_KINDS} AS kind,
  CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE lower(o_orderpriority) END AS namespace,
  CASE WHEN o_orderkey % 47 = 0 THEN NULL ELSE 'o' || CAST(o_orderkey AS STRING) END AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'view' END AS parent_kind,
  CASE WHEN o_orderkey % 5 = 0 THEN 'integer' END AS signature
FROM {{orders}}"""
ORACLE_CTES["refs"] = _REFS


def _refs(spark, folder):
    rows = spark.sql(_REFS, orders=table(spark, folder, "orders"))
    signature = F.when(F.col("signature").isNotNull(), F.array("signature"))
    return rows.withColumn("arg_signature", signature).drop("signature")


_OWN = "concat_ws('.', namespace, name) AS object"
_SUB = "('column', 'constraint', 'trigger', 'policy')"


def _sql(rule: str, source: str, where: str, obj: str, detail: str, key: str = "db_id") -> str:
    return f"SELECT {key}, '{rule}' AS rule, {obj} AS object, {detail} AS detail FROM {source} WHERE {where}"


_NAME = "concat_ws('.', namespace, name)"


@query(_sql("missing_parent", "{refs}", f"kind IN {_SUB} AND parent_kind IS DISTINCT FROM 'table'", _NAME, "coalesce(parent_kind, 'no parent')"))
def rule_missing_parent(spark, folder):
    return validate.missing_parent(_refs(spark, folder))


@query(_sql("unexpected_parent", "{refs}", f"kind NOT IN {_SUB} AND parent_kind IS NOT NULL", _NAME, "parent_kind"))
def rule_unexpected_parent(spark, folder):
    return validate.unexpected_parent(_refs(spark, folder))


@query(
    _sql(
        "wrong_signature", "{refs}", "(kind IN ('function', 'procedure')) = (signature IS NULL)", _NAME,
        "CASE WHEN kind IN ('function', 'procedure') THEN 'missing' ELSE 'not allowed' END",
    )
)
def rule_wrong_signature(spark, folder):
    return validate.wrong_signature(_refs(spark, folder))


@query(
    _sql(
        "blank_name", "{refs}", "namespace = '' OR name IS NULL", _NAME, "CASE WHEN namespace = '' THEN 'namespace' ELSE 'name' END"
    )
)
def rule_blank_name(spark, folder):
    return validate.blank_names(_refs(spark, folder))


_INDEX_REFS = """
SELECT p_size AS db_id, p_type AS namespace, p_name || CAST(p_partkey AS STRING) AS name,
  CASE WHEN p_partkey % 7 = 0 THEN 'table' ELSE 'index' END AS ref_kind,
  CASE WHEN p_partkey % 5 = 0 THEN 'view' ELSE 'table' END AS table_ref_kind
FROM {part}"""
ORACLE_CTES["index_refs"] = _INDEX_REFS


@query(
    _sql(
        "wrong_ref_kind", "{index_refs}", "ref_kind <> 'index' OR table_ref_kind <> 'table'", _NAME,
        "CASE WHEN ref_kind <> 'index' THEN ref_kind ELSE 'table_ref ' || table_ref_kind END",
    )
)
def rule_wrong_ref_kind(spark, folder):
    return validate.wrong_ref_kind(spark.sql(_INDEX_REFS, part=table(spark, folder, "part")), "index")


def _register_ref_kind(kind: str, source: str, body: str):
    """Objects of one kind that refer to themselves by another one."""
    name = f"{kind}_refs"
    ORACLE_CTES[name] = body

    @query(_sql("wrong_ref_kind", f"{{{name}}}", f"ref_kind <> '{kind}'", _NAME, "ref_kind"), name=f"rule_wrong_ref_kind_{kind}")
    def run(spark, folder):
        return validate.wrong_ref_kind(spark.sql(body, **{source: table(spark, folder, source)}), kind)


_register_ref_kind(
    "table", "orders",
    "SELECT o_custkey AS db_id, lower(o_orderpriority) AS namespace, 't' || CAST(o_orderkey AS STRING) AS name, "
    "CASE o_orderkey % 9 WHEN 0 THEN 'view' WHEN 1 THEN 'index' ELSE 'table' END AS ref_kind FROM {orders}",
)
_register_ref_kind(
    "schema", "customer",
    "SELECT c_nationkey AS db_id, 's' || CAST(c_custkey AS STRING) AS namespace, 's' || CAST(c_custkey AS STRING) AS name, "
    "CASE WHEN c_custkey % 8 = 0 THEN 'table' ELSE 'schema' END AS ref_kind FROM {customer}",
)
_register_ref_kind(
    "extension", "supplier",
    "SELECT s_nationkey AS db_id, 'public' AS namespace, 'e' || CAST(s_suppkey AS STRING) AS name, "
    "CASE WHEN s_suppkey % 6 = 0 THEN 'schema' ELSE 'extension' END AS ref_kind FROM {supplier}",
)


# --- columns: lineitems, with their natural duplicates ---

_COLUMNS = """
SELECT l_orderkey % 5 AS db_id, 's' AS schema_name, 't' || CAST(l_orderkey AS STRING) AS table_name,
  CASE WHEN l_partkey % 31 = 0 THEN '' ELSE 'c' || CAST(l_linenumber AS STRING) END AS name,
  CASE WHEN l_partkey % 37 = 0 THEN 0 ELSE l_linenumber END AS position,
  CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE 'integer' END AS data_type,
  CASE WHEN l_suppkey % 3 = 0 THEN 'd' || CAST(l_suppkey AS STRING) END AS default_expr,
  CASE WHEN l_partkey % 5 = 0 THEN 'always' END AS identity_generated,
  CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS min_value,
  CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey * 10 END AS max_value,
  CASE WHEN l_partkey % 7 = 0 THEN 'c1 + 1' END AS generated_expression
FROM {lineitem}"""
ORACLE_CTES["cols"] = _COLUMNS
_COL = "concat_ws('.', schema_name, table_name, name)"


def _columns(spark, folder):
    rows = spark.sql(_COLUMNS, lineitem=table(spark, folder, "lineitem"))
    values = {"generated": "identity_generated", "min_value": "min_value", "max_value": "max_value"}
    identity = F.struct(
        *[
            (F.col(values[f.name]) if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in IDENTITY.fields
        ]
    )
    return rows.withColumn("identity", F.when(F.col("identity_generated").isNotNull(), identity)).drop(
        "identity_generated", "min_value", "max_value"
    )


@query(
    _sql(
        "incomplete_column", "{cols}", "name = '' OR data_type IS NULL OR position < 1", _COL,
        "CASE WHEN name = '' THEN 'blank name' WHEN data_type IS NULL THEN 'blank type' ELSE 'position below 1' END",
    )
)
def rule_incomplete_column(spark, folder):
    return validate.incomplete_columns(_columns(spark, folder))


@query(
    _sql(
        "identity_bounds", "{cols}", "identity_generated IS NOT NULL AND min_value > max_value", _COL,
        "CAST(min_value AS STRING) || ' > ' || CAST(max_value AS STRING)",
    )
)
def rule_identity_bounds(spark, folder):
    return validate.identity_bounds(_columns(spark, folder))


@query(
    _sql(
        "identity_and_generated", "{cols}", "identity_generated IS NOT NULL AND generated_expression IS NOT NULL", _COL,
        "generated_expression",
    )
)
def rule_identity_and_generated(spark, folder):
    return validate.identity_and_generated(_columns(spark, folder))


@query(
    _sql("generated_with_default", "{cols}", "generated_expression IS NOT NULL AND default_expr IS NOT NULL", _COL, "default_expr")
)
def rule_generated_with_default(spark, folder):
    return validate.generated_with_default(_columns(spark, folder))


@query(
    _sql("identity_with_default", "{cols}", "identity_generated IS NOT NULL AND default_expr IS NOT NULL", _COL, "default_expr")
)
def rule_identity_with_default(spark, folder):
    return validate.identity_with_default(_columns(spark, folder))


@query(
    f"SELECT db_id, 'duplicate_column' AS rule, {_COL} AS object, CAST(count(*) AS STRING) AS detail FROM {{cols}} "
    "GROUP BY db_id, schema_name, table_name, name HAVING count(*) > 1"
)
def rule_duplicate_column(spark, folder):
    return validate.duplicate_columns(_columns(spark, folder))


# --- constraints ---

_CONSTRAINTS = """
SELECT o_orderkey % 5 AS db_id, 's' AS schema_name, 't' || CAST(o_orderkey AS STRING) AS table_name,
  'k' || CAST(o_orderkey AS STRING) AS name,
  CASE o_orderkey % 5 WHEN 0 THEN 'primary_key' WHEN 1 THEN 'unique' WHEN 2 THEN 'check' WHEN 3 THEN 'foreign_key' ELSE 'exclusion' END AS kind,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'c1,c' || CAST(o_orderkey % 9 AS STRING) END AS column_text,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'id' END AS other_text
FROM {orders}"""
ORACLE_CTES["cons"] = _CONSTRAINTS


def _constraints(spark, folder):
    rows = spark.sql(_CONSTRAINTS, orders=table(spark, folder, "orders"))

    def listed(column):
        return F.filter(F.split(column, ","), lambda c: c != "")

    return rows.select(
        "db_id", "schema_name", "table_name", "name", "kind", listed("column_text").alias("columns"),
        listed("other_text").alias("ref_columns"), listed("other_text").alias("elements"),
        F.col("other_text").alias("expression"),
    )


@query(
    "SELECT * FROM (SELECT db_id, 'empty_constraint' AS rule, concat_ws('.', schema_name, table_name, name) AS object, "
    "CASE WHEN kind IN ('primary_key', 'unique', 'foreign_key') AND column_text = '' THEN 'columns' "
    "WHEN kind = 'foreign_key' AND other_text = '' THEN 'ref_columns' WHEN kind = 'exclusion' AND other_text = '' THEN 'elements' "
    "WHEN kind = 'check' AND other_text = '' THEN 'expression' END AS detail FROM {cons}) t WHERE detail IS NOT NULL"
)
def rule_empty_constraint(spark, folder):
    return validate.empty_constraints(_constraints(spark, folder))


@query(
    "SELECT u.db_id, 'unknown_constraint_column' AS rule, concat_ws('.', u.schema_name, u.table_name, u.name) AS object, u.c AS detail "
    "FROM (SELECT *, unnest(string_split(column_text, ',')) AS c FROM {cons} WHERE column_text <> '' AND kind IN ('primary_key', 'unique', 'foreign_key')) u "
    "LEFT JOIN (SELECT DISTINCT db_id, table_name, name FROM {cols}) k ON k.db_id = u.db_id AND k.table_name = u.table_name AND k.name = u.c "
    "WHERE k.name IS NULL"
)
def rule_unknown_constraint_column(spark, folder):
    return validate.unknown_constraint_columns(_constraints(spark, folder), _columns(spark, folder))


# --- tables, schemas, extensions, indexes ---

_TABLES = """
SELECT o_orderkey % 5 AS db_id, lower(o_orderpriority) AS schema_name, 't' || CAST(o_orderkey AS STRING) AS table_name,
  CASE WHEN o_orderkey % 19 = 0 THEN 'elsewhere' ELSE lower(o_orderpriority) END AS namespace,
  CASE WHEN o_orderkey % 3 = 0 THEN 'range' END AS strategy,
  CASE WHEN o_orderkey % 4 = 0 THEN 'p' || CAST(o_orderkey % 10 AS STRING) END AS parent
FROM {orders}"""
ORACLE_CTES["tabs"] = _TABLES


def _tables(spark, folder):
    rows = spark.sql(_TABLES, orders=table(spark, folder, "orders"))
    info = F.struct(F.col("strategy"), F.lit("(c1)")).cast(PARTITION_INFO)
    child = F.struct(F.lit("s"), F.col("parent"), F.lit(None).cast("string")).cast(PARTITION_OF)
    return (
        rows.withColumn("partition_info", F.when(F.col("strategy").isNotNull(), info))
        .withColumn("partition_of", F.when(F.col("parent").isNotNull(), child))
        .drop("strategy", "parent")
    )


@query(
    _sql(
        "partition_root_and_child", "{tabs}", "strategy IS NOT NULL AND parent IS NOT NULL", "concat_ws('.', schema_name, table_name)",
        "'\"s\".\"' || parent || '\"'",
    )
)
def rule_partition_root_and_child(spark, folder):
    return validate.partition_root_and_child(_tables(spark, folder))


@query(_sql("foreign_namespace", "{tabs}", "namespace <> schema_name", "concat_ws('.', schema_name, table_name)", "namespace"))
def rule_foreign_namespace(spark, folder):
    return validate.foreign_namespace(_tables(spark, folder))


@query(
    "SELECT t.db_id, 'unlisted_schema' AS rule, concat_ws('.', namespace, table_name) AS object, namespace AS detail FROM {tabs} t "
    "WHERE NOT EXISTS (SELECT 1 FROM {tabs} s WHERE s.db_id = t.db_id AND s.schema_name = t.namespace AND s.schema_name <> '5-low')"
)
def rule_unlisted_schema(spark, folder):
    tables = _tables(spark, folder)
    schemas = tables.where(F.col("schema_name") != "5-low").select("db_id", "schema_name").distinct()
    return validate.unlisted_schema(tables, schemas)


@query(
    "SELECT db_id, 'duplicate_schema' AS rule, nspname AS object, CAST(count(*) AS STRING) AS detail FROM {fx_namespace} "
    "GROUP BY db_id, nspname HAVING count(*) > 1"
)
def rule_duplicate_schema(spark, folder):
    return validate.duplicate_names(fixture(spark, folder, "fx_namespace"), "nspname", "duplicate_schema")


@query(
    "SELECT s_nationkey AS db_id, 'duplicate_extension' AS rule, 'e' || CAST(s_suppkey % 7 AS STRING) AS object, CAST(count(*) AS STRING) AS detail "
    "FROM {supplier} GROUP BY s_nationkey, s_suppkey % 7 HAVING count(*) > 1"
)
def rule_duplicate_extension(spark, folder):
    rows = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("db_id"), F.concat(F.lit("e"), (F.col("s_suppkey") % 7).cast("string")).alias("name")
    )
    return validate.duplicate_names(rows, "name", "duplicate_extension")


@query(
    "SELECT s_nationkey AS db_id, 'blank_version' AS rule, 'e' || CAST(s_suppkey AS STRING) AS object, "
    "CASE WHEN s_suppkey % 3 = 0 THEN '' END AS detail FROM {supplier} WHERE s_suppkey % 3 < 2"
)
def rule_blank_version(spark, folder):
    third = F.col("s_suppkey") % 3
    rows = table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("db_id"), F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("name"),
        F.when(third == 0, F.lit("")).when(third == 2, F.lit("1.0")).alias("version"),
    )
    return validate.blank_versions(rows)


@query(
    "SELECT * FROM (SELECT p_size AS db_id, 'malformed_index_key' AS rule, 's.t.i' || CAST(p_partkey AS STRING) AS object, "
    "CASE p_partkey % 6 WHEN 0 THEN 'no keys' WHEN 1 THEN '1 malformed' WHEN 2 THEN '2 malformed' END AS detail FROM {part}) t WHERE detail IS NOT NULL"
)
def rule_malformed_index_key(spark, folder):
    def key(column, expression):
        return F.struct(
            F.lit(column).cast("string").alias("column_name"), F.lit(expression).cast("string").alias("expression")
        )

    kind = F.col("p_partkey") % 6
    keys = (
        F.when(kind == 0, F.array().cast("array<struct<column_name:string,expression:string>>"))
        .when(kind == 1, F.array(key("a", None), key(None, None)))
        .when(kind == 2, F.array(key("a", "(b)"), key(None, None), key("c", None)))
        .otherwise(F.array(key("a", None), key(None, "(b)")))
    )
    rows = table(spark, folder, "part").select(
        F.col("p_size").alias("db_id"), F.lit("s").alias("schema_name"), F.lit("t").alias("table_name"),
        F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("name"), keys.alias("key_columns"),
    )
    return validate.malformed_index_keys(rows)


# --- change rows ---

_DELTAS = """
SELECT o_custkey AS pair_id, lower(o_orderpriority) AS namespace, 'x' || CAST(o_orderkey AS STRING) AS name,
  CASE o_orderkey % 6 WHEN 0 THEN 'create_table' WHEN 1 THEN 'drop_table' WHEN 2 THEN 'rename_table' WHEN 3 THEN 'rename_column'
    WHEN 4 THEN 'alter_table_attrs' ELSE 'add_column' END AS kind,
  CASE WHEN o_orderkey % 6 IN (3, 5) AND o_orderkey % 10 <> 3 THEN 'column' ELSE 'table' END AS object_kind,
  CASE WHEN o_orderkey % 6 IN (3, 5) THEN 't1' END AS parent_name,
  'x' || CAST(o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS STRING) AS payload_name,
  'x' || CAST(o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS STRING) AS old_name,
  CASE WHEN o_orderkey % 8 = 0 THEN 'x' || CAST(o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS STRING) ELSE 'y' END AS new_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'u1' END AS new_owner
FROM {orders}"""
ORACLE_CTES["rule_deltas"] = _DELTAS
_DELTA = "concat_ws('.', namespace, parent_name, name)"


def _deltas(spark, folder):
    rows = spark.sql(_DELTAS, orders=table(spark, folder, "orders"))
    column = F.struct(
        *[(F.col("payload_name") if f.name == "name" else F.lit(None)).cast(f.dataType).alias(f.name) for f in COLUMN.fields]
    )
    return (
        rows.withColumn("payload_namespace", F.col("namespace"))
        .withColumn("column", F.when(F.col("kind") == "add_column", column))
        .withColumn("changed", F.when(F.col("new_owner").isNotNull(), F.array(F.lit("owner"))))
    )


@query(
    _sql(
        "table_payload_mismatch", "{rule_deltas}", "kind IN ('create_table', 'drop_table') AND payload_name <> name", _DELTA,
        "namespace || '.' || payload_name", "pair_id",
    )
)
def rule_table_payload_mismatch(spark, folder):
    return validate.table_payload_mismatch(_deltas(spark, folder))


@query(
    _sql(
        "inconsistent_rename", "{rule_deltas}", "kind IN ('rename_table', 'rename_column') AND (old_name = new_name OR name <> old_name)",
        _DELTA, "CASE WHEN old_name = new_name THEN 'no-op' ELSE 'target is not the old name' END", "pair_id",
    )
)
def rule_inconsistent_rename(spark, folder):
    return validate.inconsistent_rename(_deltas(spark, folder))


@query(
    _sql("empty_attribute_change", "{rule_deltas}", "kind = 'alter_table_attrs' AND new_owner IS NULL", _DELTA, "'no-op'", "pair_id")
)
def rule_empty_attribute_change(spark, folder):
    return validate.empty_attribute_change(_deltas(spark, folder))


@query(
    _sql(
        "column_delta_target", "{rule_deltas}",
        "kind IN ('rename_column', 'add_column') AND (object_kind <> 'column' OR (kind = 'add_column' AND payload_name <> name))", _DELTA,
        "CASE WHEN object_kind <> 'column' THEN 'target is a ' || object_kind ELSE 'payload is ' || payload_name END", "pair_id",
    )
)
def rule_column_delta_target(spark, folder):
    return validate.column_delta_target(_deltas(spark, folder))
