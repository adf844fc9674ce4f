"""Queries on summaries, scripts and run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetdrift.operators import deltas, report, risk, rowchecks, script
from fleetdrift.plans.drift_queries import _LABEL, _RANK, all_deltas, graded, index_deltas
from fleetdrift.plans.fixtures import ORACLE_CTES, fixture, table
from fleetdrift.plans.registry import query
from fleetdrift.session import cut_lineage
from fleetdrift.skew import with_places

_CLASSES = (
    "count(*) FILTER (op = 'create') AS n_add, count(*) FILTER (op IN ('alter', 'replace')) AS n_mod, "
    "count(*) FILTER (op = 'drop') AS n_del, count(*) FILTER (op = 'conflict') AS n_conflict"
)
ORACLE_CTES["mixed_changes"] = """
SELECT pair_id, namespace, object_kind, op FROM {changes}
UNION ALL SELECT pair_id, namespace, 'index', op FROM {index_ops}"""


def _mixed(spark, folder):
    return deltas.combine_deltas(all_deltas(spark, folder), index_deltas(spark, folder))


@query(f"SELECT pair_id, {_CLASSES} FROM {{mixed_changes}} GROUP BY pair_id")
def change_summary(spark, folder):
    return report.change_summary(_mixed(spark, folder))


@query(
    "SELECT pair_id, count(*) AS change_count, count(*) FILTER (op = 'conflict') AS conflict_count "
    "FROM {mixed_changes} GROUP BY pair_id"
)
def change_count(spark, folder):
    return report.change_count(report.change_summary(_mixed(spark, folder)))


@query(
    f"SELECT pair_id, namespace, object_kind, {_CLASSES} FROM {{mixed_changes}} GROUP BY pair_id, namespace, object_kind "
    f"UNION ALL SELECT pair_id, namespace, NULL, {_CLASSES} FROM {{mixed_changes}} GROUP BY pair_id, namespace"
)
def tree_badges(spark, folder):
    badges = report.tree_badges(_mixed(spark, folder))
    for name in report.CLASSES.values():
        badges = badges.withColumn(name, F.col(name).cast("bigint"))
    return badges


ORACLE_CTES["details"] = """
SELECT *, coalesce(table_name, name) AS tbl, CASE kind WHEN 'add_column' THEN '+' || name WHEN 'drop_column' THEN '-' || name
  WHEN 'alter_column_type' THEN name || ' type change' WHEN 'set_column_default' THEN name || ' default'
  WHEN 'set_column_nullability' THEN name || ' nullability' WHEN 'replace_column' THEN name || ' replaced' END AS detail
FROM {graded_changes}"""
ORACLE_CTES["edge_counts"] = (
    "SELECT 't' || CAST(node AS STRING) AS tbl, pair_id, count(DISTINCT prereq) AS n FROM {fx_edge} GROUP BY ALL"
)


@query(
    "SELECT d.pair_id, d.namespace, d.tbl AS table_name, CASE WHEN bool_or(kind = 'create_table') THEN 'create' "
    "WHEN bool_or(kind = 'drop_table') THEN 'drop' ELSE 'alter' END AS op, "
    "coalesce(string_agg(detail, ', ' ORDER BY detail), '') AS detail, "
    f"{_LABEL.format(_RANK)} AS risk, count(*) AS n_changes, coalesce(max(e.n), 0) AS dependencies "
    "FROM {details} d LEFT JOIN {edge_counts} e ON e.pair_id = d.pair_id AND e.tbl = d.tbl GROUP BY d.pair_id, d.namespace, d.tbl"
)
def change_table(spark, folder):
    edges = fixture(spark, folder, "fx_edge")
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("node"), F.lower("o_orderpriority").alias("namespace")
    )
    counts = (
        edges.distinct().groupBy("pair_id", "node").agg(F.count(F.lit(1)).alias("dependencies"))
        .join(orders, "node")
        .select(
            "pair_id", "namespace", F.concat(F.lit("t"), F.col("node").cast("string")).alias("table_name"), "dependencies"
        )
    )
    return report.change_table(graded(spark, folder), counts)


ORACLE_CTES["line_places"] = """
SELECT obj, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, sig, text,
  count(*) FILTER (sig <> '+') OVER w AS src, count(*) FILTER (sig <> '-') OVER w AS tgt
FROM {fx_line} WINDOW w AS (PARTITION BY obj ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate
  ROWS UNBOUNDED PRECEDING)"""


@query(
    "SELECT obj, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, sig, text, "
    "CASE WHEN sig <> '+' THEN CAST(src AS STRING) ELSE '' END AS source_line, CASE WHEN sig <> '+' THEN text ELSE '' END AS source_text, "
    "CASE WHEN sig <> '-' THEN CAST(tgt AS STRING) ELSE '' END AS target_line, CASE WHEN sig <> '-' THEN text ELSE '' END AS target_text "
    "FROM {line_places}"
)
def line_diff(spark, folder):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return report.diff_sides(fixture(spark, folder, "fx_line"), ["obj"], order).drop("l_shipdate")


# --- scripts ---

_T = "'\"' || namespace || '\".\"' || table_name || '\"'"
_C = "'\"' || name || '\"'"
_DEFINITION = (
    _C + " || ' ' || data_type || coalesce(' COLLATE \"' || \"collation\" || '\"', '') || coalesce(' DEFAULT ' || default_expr, '') "
    "|| CASE identity_generated WHEN 'always' THEN ' GENERATED ALWAYS AS IDENTITY' WHEN 'by_default' THEN ' GENERATED BY DEFAULT AS IDENTITY' ELSE '' END "
    "|| coalesce(' GENERATED ALWAYS AS (' || generated_expression || ') STORED', '') || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END"
)
_ALTER = f"'ALTER TABLE ' || {_T} || ' "


@query(
    f"""SELECT pair_id, namespace, table_name, name, kind, CASE kind
  WHEN 'add_column' THEN {_ALTER}ADD COLUMN ' || {_DEFINITION}
  WHEN 'drop_column' THEN {_ALTER}DROP COLUMN ' || {_C}
  WHEN 'replace_column' THEN {_ALTER}DROP COLUMN ' || {_C} || '; ' || {_ALTER}ADD COLUMN ' || {_DEFINITION}
  WHEN 'alter_column_type' THEN {_ALTER}ALTER COLUMN ' || {_C} || ' TYPE ' || new_data_type || coalesce(' COLLATE "' || new_collation || '"', '')
  WHEN 'set_column_default' THEN {_ALTER}ALTER COLUMN ' || {_C} || coalesce(' SET DEFAULT ' || new_default, ' DROP DEFAULT')
  WHEN 'set_column_nullability' THEN {_ALTER}ALTER COLUMN ' || {_C} || CASE WHEN new_nullable THEN ' DROP NOT NULL' ELSE ' SET NOT NULL' END
  END AS forward,
  CASE kind WHEN 'add_column' THEN {_ALTER}DROP COLUMN ' || {_C}
  WHEN 'drop_column' THEN {_ALTER}ADD COLUMN ' || {_DEFINITION}
  WHEN 'replace_column' THEN {_ALTER}DROP COLUMN ' || {_C} || '; ' || {_ALTER}ADD COLUMN ' || old_definition
  WHEN 'alter_column_type' THEN {_ALTER}ALTER COLUMN ' || {_C} || ' TYPE ' || data_type || coalesce(' COLLATE "' || "collation" || '"', '')
  WHEN 'set_column_default' THEN {_ALTER}ALTER COLUMN ' || {_C} || coalesce(' SET DEFAULT ' || default_expr, ' DROP DEFAULT')
  WHEN 'set_column_nullability' THEN {_ALTER}ALTER COLUMN ' || {_C} || CASE WHEN nullable THEN ' DROP NOT NULL' ELSE ' SET NOT NULL' END
  END AS rollback
FROM {{column_changes}} LEFT JOIN (SELECT pair_id, namespace, table_name, name, {_DEFINITION} AS old_definition FROM {{norm_source}}) old
  USING (pair_id, namespace, table_name, name)"""
)
def render_statement(spark, folder):
    from fleetdrift.plans.drift_queries import column_deltas

    rendered = script.render_statements(column_deltas(spark, folder))
    return rendered.select(
        "pair_id", "namespace", F.col("parent_name").alias("table_name"), "name", "kind",
        F.array_join("forward", "; ").alias("forward"), F.array_join("rollback", "; ").alias("rollback"),
    )


_INDEX_TEXT = (
    "'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || 'INDEX CONCURRENTLY \"' || name || '\" ON \"' || namespace || '\".\"' || table_name "
    "|| '\" USING ' || method || ' (\"' || key_name || '\")' || coalesce(' WHERE ' || predicate, '')"
)
_DROP_TEXT = "'DROP INDEX CONCURRENTLY \"' || namespace || '\".\"' || name || '\"'"


@query(
    f"SELECT o.pair_id, o.namespace, o.name, CASE o.op WHEN 'create' THEN t.up WHEN 'drop' THEN s.down ELSE s.down || '; ' || t.up END AS forward, "
    f"CASE o.op WHEN 'create' THEN t.down WHEN 'drop' THEN s.up ELSE t.down || '; ' || s.up END AS rollback, false AS transactional "
    f"FROM {{index_ops}} o LEFT JOIN (SELECT *, {_INDEX_TEXT} AS up, {_DROP_TEXT} AS down FROM {{fx_target_index}}) t USING (pair_id, namespace, name) "
    f"LEFT JOIN (SELECT *, {_INDEX_TEXT} AS up, {_DROP_TEXT} AS down FROM {{fx_source_index}}) s USING (pair_id, namespace, name)"
)
def render_index_statement(spark, folder):
    rendered = script.render_statements(index_deltas(spark, folder))
    return rendered.select(
        "pair_id", "namespace", "name", F.array_join("forward", "; ").alias("forward"),
        F.array_join("rollback", "; ").alias("rollback"), "transactional"
    )


ORACLE_CTES.update(
    # every change as often as it has statements
    script_lines=f"""
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY namespace, name, kind, parent, part) AS line, kind NOT LIKE '%index' AS transactional, rank
FROM (
  SELECT pair_id, namespace, name, kind, coalesce(table_name, '') AS parent, {_RANK} AS rank,
    unnest(range(CASE WHEN kind = 'replace_column' THEN 2 ELSE 1 END)) AS part FROM {{graded_changes}}
  UNION ALL SELECT pair_id, namespace, name, if(op = 'conflict', 'replace', op) || '_index', '',
    map {{'create': 0, 'drop': 3, 'conflict': 2}}[op], unnest(range(CASE WHEN op = 'conflict' THEN 2 ELSE 1 END)) FROM {{index_ops}}
) lines""",
    script_units="""
SELECT *, sum(CASE WHEN transactional THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS barrier
FROM {script_lines}""",
)


@query(
    f"SELECT pair_id, min(line) AS start_line, max(line) AS end_line, transactional, {_LABEL.format('rank')} AS max_risk, "
    "CASE WHEN transactional THEN 'shares one transaction' ELSE 'cannot run in a transaction' END AS reason "
    "FROM {script_units} GROUP BY pair_id, barrier, transactional"
)
def transaction_units(spark, folder):
    rendered = script.render_statements(risk.classify_risk(_mixed(spark, folder)))
    rows = rendered.select(
        "pair_id", "namespace", "name", "kind", F.coalesce("parent_name", F.lit("")).alias("parent"),
        "transactional", "risk", "forward",
    )
    # numbered and counted below: computed once
    lines = script.statement_lines(cut_lineage(rows), ["namespace", "name", "kind", "parent"])
    return script.transaction_units(lines)


ORACLE_CTES["line_counts"] = (
    "SELECT o_custkey AS pair_id, lower(o_orderpriority) AS namespace, 't' || CAST(l_orderkey AS STRING) AS tbl, count(*) AS row_count "
    "FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey GROUP BY ALL"
)


def _row_counts(spark, folder):
    """Rows per table: lineitems per order stand for the rows of that table."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("pair_id"), F.lower("o_orderpriority").alias("namespace"), "o_orderkey"
    )
    counts = rowchecks.row_counts(table(spark, folder, "lineitem"), ["l_orderkey"])
    return counts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "pair_id", "namespace", F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("table_name"), "row_count"
    )


@query(
    "SELECT d.pair_id, d.namespace, d.tbl AS table_name, d.name, d.kind, 'ACCESS EXCLUSIVE' AS lock_mode, r.row_count, "
    "CASE risk WHEN 'SAFE' THEN 'ok' WHEN 'WARNING' THEN '' WHEN 'DANGEROUS' THEN 'warn' ELSE 'err' END AS severity "
    "FROM {details} d LEFT JOIN {line_counts} r ON r.pair_id = d.pair_id AND r.namespace = d.namespace AND r.tbl = d.tbl"
)
def lock_estimate(spark, folder):
    return script.lock_estimate(graded(spark, folder), _row_counts(spark, folder))


@query(
    "SELECT d.pair_id, d.namespace, d.tbl AS table_name, d.name, d.kind, "
    "CASE WHEN kind = 'alter_column_type' THEN 'rewritten' ELSE 'lost' END AS effect, r.row_count "
    "FROM {details} d JOIN {line_counts} r ON r.pair_id = d.pair_id AND r.namespace = d.namespace AND r.tbl = d.tbl "
    "WHERE kind IN ('drop_table', 'drop_column', 'replace_column', 'alter_column_type')"
)
def rows_at_risk(spark, folder):
    return rowchecks.rows_at_risk(graded(spark, folder), _row_counts(spark, folder))


# --- history ---


@query(
    "SELECT pair_id, status, count(*) AS runs, CAST(sum(changes) AS BIGINT) AS changes, "
    "CAST(epoch_us(max(started_at)) AS BIGINT) AS last_started FROM {fx_run} GROUP BY ALL"
)
def run_history_summary(spark, folder):
    summary = report.run_history_summary(fixture(spark, folder, "fx_run"))
    return summary.select("pair_id", "status", "runs", "changes", F.unix_micros(F.col("last_started_at").cast("timestamp")).alias("last_started"))


@query(
    "SELECT run_id, pair_id, status, changes, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS place FROM {fx_run}"
)
def run_history(spark, folder):
    runs = report.run_history(fixture(spark, folder, "fx_run"))
    return with_places(runs).select("run_id", "pair_id", "status", "changes", "place")
