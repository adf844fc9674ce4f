"""Queries on whole runs: all kinds of objects from two catalogs to an ordered script."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetdrift.functions.constraints import constraint_fields, constraint_kind, fk_parts
from fleetdrift.model import COLUMN, PARTITION_INFO, PARTITION_OF
from fleetdrift.operators import compare, exclude, migration, patch, report, risk, script
from fleetdrift.operators.compare import Catalog
from fleetdrift.plans.fixtures import CANONICAL, ORACLE_CTES, fixture
from fleetdrift.plans.drift_queries import _LABEL, _RANK
from fleetdrift.plans.registry import query
from fleetdrift.session import checkpoint_folder, stored
from fleetdrift.sources import sinks, snapshots


def _null():
    return F.lit(None).cast("string")


def catalog(spark, folder, side: str) -> Catalog:
    """The catalogs of one side (``source`` or ``target``), one per customer."""
    tables = fixture(spark, folder, f"mx_{side}_table").select(
        "*", _null().alias("tablespace"), F.lit(None).cast(PARTITION_INFO).alias("partition_info"),
        F.lit(None).cast(PARTITION_OF).alias("partition_of"),
    )
    columns = fixture(spark, folder, f"mx_{side}_column").select(
        "*", _null().alias("collation"), F.lit(None).cast(COLUMN["identity"].dataType).alias("identity"),
        _null().alias("generated_expression"),
    )
    key = F.struct(
        F.col("key_name").alias("column_name"), _null().alias("expression"), _null().alias("opclass"),
        F.lit("asc").alias("sort_order"), _null().alias("nulls_order"),
    )
    indexes = fixture(spark, folder, f"mx_{side}_index").select(
        "pair_id", "namespace", "table_name", "name", "method", F.array(key).alias("key_columns"),
        F.array().cast("array<string>").alias("include_columns"), F.lit(False).alias("unique"),
        _null().alias("predicate"), _null().alias("comment"),
    )
    # A foreign key is taken apart once for all fields that come from its parts.
    parts = F.when(F.col("contype") == "f", fk_parts(F.col("condef")))
    fields = constraint_fields(F.col("contype"), F.col("condef"), _null(), _null(), F.col("_parts"))
    constraints = fixture(spark, folder, f"mx_{side}_key").withColumn("_parts", parts).select(
        "pair_id", "namespace", "table_name", "name", constraint_kind(F.col("contype")).alias("kind"),
        F.lit("not_deferrable").alias("deferrability"), *[v.alias(n) for n, v in fields.items()],
    )
    pairs = fixture(spark, folder, "mx_base").select("pair_id").distinct()
    if side == "source":
        pairs, version = pairs.where("pair_id % 4 <> 0"), F.lit("1.0")
    else:
        pairs, version = pairs.where("pair_id % 5 <> 0"), F.when(F.col("pair_id") % 3 == 0, "1.1").otherwise("1.0")
    return Catalog(
        schemas=tables.select("pair_id", "namespace").distinct(),
        extensions=pairs.select("pair_id", F.lit("ext").alias("name"), version.alias("version")),
        tables=tables,
        columns=compare.normalize_columns(columns),
        indexes=indexes,
        constraints=constraints,
    )


def annotations(spark, folder):
    """Renames of tables and columns, some of objects that are on one side only."""
    base = fixture(spark, folder, "mx_base")
    old = F.concat(F.lit("t"), F.col("k").cast("string"))
    new = F.concat(F.lit("r"), F.col("k").cast("string"))
    tables = base.where("k % 19 = 0").select("pair_id", "namespace", old.alias("old_name"), new.alias("new_name"))
    columns = base.where("k % 23 = 0").select(
        "pair_id", "namespace", old.alias("table_name"), F.lit("c2").alias("old_name"), F.lit("c9").alias("new_name")
    )
    return tables, columns


_CATALOGS: dict[tuple[str, str, str], Catalog] = {}


def stored_side(spark, folder, side: str) -> Catalog:
    """The catalogs of one side, stored once per session: runs read them several times."""
    key = (spark.sparkContext.applicationId, folder, side)
    if key not in _CATALOGS:
        _CATALOGS[key] = compare.stored_catalog(catalog(spark, folder, side))
    return _CATALOGS[key]


_DRIFTS: dict[tuple[str, str], DataFrame] = {}


def whole_drift(spark, folder):
    """The graded changes of both catalogs, stored once per session: many reports read them."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _DRIFTS:
        tables, columns = annotations(spark, folder)
        source, target = (stored_side(spark, folder, side) for side in ("source", "target"))
        _DRIFTS[key] = stored(migration.drift(source, target, table_renames=tables, column_renames=columns))
    return _DRIFTS[key]


_PLANS: dict[tuple[str, str], migration.Migration] = {}


def whole_plan(spark, folder) -> migration.Migration:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _PLANS:
        _PLANS[key] = migration.plan_migration(whole_drift(spark, folder))
    return _PLANS[key]


# --- the same in SQL: objects of both sides are matched by k, not by name ---

_T = "'\"' || ns || '\".\"' || nm || '\"'"
_H = "'\"' || hns || '\".\"' || hnm || '\"'"
_FK = f"""'ALTER TABLE ' || {_T} || ' ADD CONSTRAINT "fk' || k || '" FOREIGN KEY ("c1") REFERENCES ' || {_H} || ' ("c1") NOT VALID'"""
_VALIDATE = f"""'ALTER TABLE ' || {_T} || ' VALIDATE CONSTRAINT "fk' || k || '"'"""
_INDEX = f"""'CREATE INDEX CONCURRENTLY "ix' || k || '" ON ' || {_T} || ' USING ' || CASE WHEN k % 14 = 0 THEN 'hash' ELSE 'btree' END || ' ("' || cc || '")'"""
_UNINDEX = """'DROP INDEX CONCURRENTLY "' || ns || '"."ix' || k || '"'"""
_ALTER = f"'ALTER TABLE ' || {_T}"
_CREATE = (
    f"""'CREATE TABLE ' || {_T} || ' ("c1" bigint NOT NULL, "' || cc || '" ' || CASE WHEN k % 7 = 0 THEN 'text' ELSE 'character varying(100)' END"""
    """ || CASE WHEN k % 5 <> 0 THEN ' DEFAULT d' ELSE '' END || CASE WHEN k % 9 <> 0 THEN ', "c3" integer' ELSE '' END"""
    """ || ', CONSTRAINT "pk' || k || '" PRIMARY KEY ("c1"))'"""
)
_OWNER = f"""{_ALTER} || ' OWNER TO "' || new_owner || '"'"""
_COMMENT = f"'COMMENT ON TABLE ' || {_T} || ' IS ' || CASE WHEN noted_t THEN '''note''' ELSE 'NULL' END"
_BOTH, _NEW, _OLD = "in_s AND in_t", "in_t AND NOT in_s", "in_s AND NOT in_t"
_FK_ADDED = f"(({_BOTH} AND fk_t AND NOT fk_s) OR ({_NEW} AND fk_t))"
_FK_DROPPED = f"(({_BOTH} AND fk_s AND NOT fk_t) OR ({_OLD} AND fk_s))"
_IX_S, _IX_T = "(in_s AND k % 5 <> 0)", "(in_t AND k % 4 <> 0)"

# kind, op, object kind, condition, parent, name, statements, risk
_ROWS = [
    ("rename_table", "rename", "table", f"{_BOTH} AND k % 19 = 0", "NULL", "'t' || k",
     f"""['ALTER TABLE "' || ns || '"."t' || k || '" RENAME TO "r' || k || '"']""", "WARNING"),
    ("create_table", "create", "table", _NEW, "NULL", "nm", f"[{_CREATE}, {_OWNER}, CASE WHEN noted_t THEN {_COMMENT} END]", "SAFE"),
    ("drop_table", "drop", "table", _OLD, "NULL", "nm", f"['DROP TABLE ' || {_T}]", "DESTRUCTIVE"),
    ("alter_table_attrs", "alter", "table", f"{_BOTH} AND (old_owner <> new_owner OR noted_s <> noted_t)", "NULL", "nm",
     f"[CASE WHEN old_owner <> new_owner THEN {_OWNER} END, CASE WHEN noted_s <> noted_t THEN {_COMMENT} END]", "SAFE"),
    ("rename_column", "rename", "column", f"{_BOTH} AND k % 23 = 0", "nm", "'c2'", f"""[{_ALTER} || ' RENAME COLUMN "c2" TO "c9"']""", "WARNING"),
    ("add_column", "create", "column", f"{_BOTH} AND k % 9 <> 0 AND k % 11 = 0", "nm", "'c3'", f"""[{_ALTER} || ' ADD COLUMN "c3" integer']""", "SAFE"),
    ("drop_column", "drop", "column", f"{_BOTH} AND k % 9 = 0 AND k % 11 <> 0", "nm", "'c3'", f"""[{_ALTER} || ' DROP COLUMN "c3"']""", "DESTRUCTIVE"),
    ("alter_column_type", "alter", "column", f"{_BOTH} AND k % 7 = 0", "nm", "cc", f"""[{_ALTER} || ' ALTER COLUMN "' || cc || '" TYPE text']""", "DANGEROUS"),
    ("set_column_default", "alter", "column", f"{_BOTH} AND k % 5 = 0", "nm", "cc", f"""[{_ALTER} || ' ALTER COLUMN "' || cc || '" DROP DEFAULT']""", "SAFE"),
    ("create_index", "create", "index", f"{_IX_T} AND NOT {_IX_S}", "NULL", "'ix' || k", f"[{_INDEX}]", "SAFE"),
    ("drop_index", "drop", "index", f"{_IX_S} AND NOT {_IX_T}", "NULL", "'ix' || k", f"[{_UNINDEX}]", "DESTRUCTIVE"),
    ("replace_index", "replace", "index", f"{_IX_S} AND {_IX_T} AND k % 14 = 0", "NULL", "'ix' || k", f"[{_UNINDEX}, {_INDEX}]", "DANGEROUS"),
    ("add_constraint", "create", "constraint", f"{_BOTH} AND k % 10 = 0", "nm", "'pk' || k",
     f"""[{_ALTER} || ' ADD CONSTRAINT "pk' || k || '" PRIMARY KEY ("c1")']""", "DANGEROUS"),
    ("add_constraint", "create", "constraint", _FK_ADDED, "nm", "'fk' || k", f"[{_FK}, {_VALIDATE}]", "WARNING"),
    ("drop_constraint", "drop", "constraint", _FK_DROPPED, "nm", "'fk' || k", f"""[{_ALTER} || ' DROP CONSTRAINT "fk' || k || '"']""", "DESTRUCTIVE"),
]
_RISKS = "SELECT pair_id, k, ns, '{kind}' AS kind, '{op}' AS op, '{obj}' AS object_kind, {parent} AS parent_name, {name} AS name, {sql} AS statements, '{risk}' AS risk FROM {{mx_named}} WHERE {where}"

ORACLE_CTES.update(
    mx_named="""
SELECT *, namespace AS ns, CASE WHEN k % 19 = 0 AND in_t THEN 'r' ELSE 't' END || k AS nm, 's' || (hub % 3) AS hns,
  CASE WHEN hub % 19 = 0 AND hub % 17 <> 0 THEN 'r' ELSE 't' END || hub AS hnm, CASE WHEN k % 23 = 0 AND in_t THEN 'c9' ELSE 'c2' END AS cc,
  'u' || (k % 5) AS old_owner, 'u' || CASE WHEN k % 7 = 0 THEN 9 ELSE k % 5 END AS new_owner, k % 3 = 0 AS noted_s, k % 12 IN (3, 6, 9) AS noted_t
FROM {mx_base}""",
    mx_schema="SELECT pair_id, namespace AS ns, bool_or(in_s) AS in_s, bool_or(in_t) AS in_t FROM {mx_base} GROUP BY ALL",
    mx_extension="""
SELECT pair_id, pair_id % 4 <> 0 AS in_s, pair_id % 5 <> 0 AS in_t, CASE WHEN pair_id % 3 = 0 THEN '1.1' ELSE '1.0' END AS version
FROM (SELECT DISTINCT pair_id FROM {mx_base})""",
    mx_changes=" UNION ALL ".join(
        _RISKS.replace("{{", "{").replace("}}", "}").replace("{kind}", r[0]).replace("{op}", r[1]).replace("{obj}", r[2])
        .replace("{parent}", r[4]).replace("{name}", r[5]).replace("{sql}", r[6]).replace("{risk}", r[7]).replace("{where}", r[3])
        for r in _ROWS
    )
    + """
UNION ALL SELECT pair_id, NULL, ns, CASE WHEN in_t THEN 'create_schema' ELSE 'drop_schema' END, CASE WHEN in_t THEN 'create' ELSE 'drop' END,
  'schema', NULL, ns, [CASE WHEN in_t THEN 'CREATE' ELSE 'DROP' END || ' SCHEMA "' || ns || '"'], CASE WHEN in_t THEN 'SAFE' ELSE 'DESTRUCTIVE' END
FROM {mx_schema} WHERE in_s <> in_t
UNION ALL SELECT pair_id, NULL, 'public', CASE WHEN NOT in_s THEN 'create_extension' WHEN NOT in_t THEN 'drop_extension' ELSE 'alter_extension' END,
  CASE WHEN NOT in_s THEN 'create' WHEN NOT in_t THEN 'drop' ELSE 'alter' END, 'extension', NULL, 'ext',
  [CASE WHEN NOT in_s THEN 'CREATE EXTENSION "ext" VERSION ''' || version || '''' WHEN NOT in_t THEN 'DROP EXTENSION "ext"'
    ELSE 'ALTER EXTENSION "ext" UPDATE TO ''' || version || '''' END], CASE WHEN in_s AND NOT in_t THEN 'DESTRUCTIVE' ELSE 'SAFE' END
FROM {mx_extension} WHERE in_s <> in_t OR (in_s AND version <> '1.0')""",
    mx_nodes="""
SELECT *, concat_ws(chr(1), ns, parent_name, name, op, kind) AS node_key, concat_ws(chr(1), ns, parent_name, name, op, kind) AS node FROM {mx_changes}""",
    # who waits for whom, relation by relation
    mx_edges="""
SELECT DISTINCT a.pair_id, a.node, b.node AS prereq FROM {mx_nodes} a JOIN {mx_nodes} b ON b.pair_id = a.pair_id AND a.node <> b.node AND (
  (a.k = b.k AND b.kind IN ('create_table', 'rename_table')
    AND a.kind NOT IN ('create_table', 'rename_table', 'drop_table', 'drop_index'))
  OR (a.k = b.k AND a.kind = 'drop_table' AND b.kind IN ('drop_index', 'drop_constraint'))
  OR (a.k = b.k AND a.kind = 'alter_column_type' AND b.kind IN ('drop_index', 'rename_column'))
  OR (a.k = b.k AND a.kind = 'set_column_default' AND b.kind = 'rename_column')
  OR (a.k = b.k AND a.kind IN ('create_index', 'replace_index') AND b.kind IN ('alter_column_type', 'rename_column'))
  OR (a.kind = 'create_table' AND b.kind = 'create_schema' AND a.ns = b.ns)
  OR (a.kind = 'drop_schema' AND b.kind = 'drop_table' AND a.ns = b.ns))
UNION
SELECT a.pair_id, a.node, b.node FROM {mx_nodes} a JOIN {mx_base} f ON f.pair_id = a.pair_id AND f.k = a.k AND a.name LIKE 'fk%' AND a.kind = 'add_constraint'
  JOIN {mx_nodes} b ON b.pair_id = a.pair_id AND b.k = f.hub AND (b.kind IN ('create_table', 'rename_table') OR (b.kind = 'add_constraint' AND b.name LIKE 'pk%'))
UNION
SELECT b.pair_id, b.node, a.node FROM {mx_nodes} a JOIN {mx_base} f ON f.pair_id = a.pair_id AND f.k = a.k AND a.kind = 'drop_constraint'
  JOIN {mx_nodes} b ON b.pair_id = a.pair_id AND b.k = f.hub AND b.kind = 'drop_table'""",
    mx_paths="""
WITH RECURSIVE paths AS (
  SELECT n.pair_id, n.node, [n.node_key] AS path FROM {mx_nodes} n
  WHERE NOT EXISTS (SELECT 1 FROM {mx_edges} e WHERE e.pair_id = n.pair_id AND e.node = n.node)
  UNION
  SELECT e.pair_id, e.node, list_append(p.path, n.node_key) FROM paths p
  JOIN {mx_edges} e ON e.pair_id = p.pair_id AND e.prereq = p.node
  JOIN {mx_nodes} n ON n.pair_id = e.pair_id AND n.node = e.node)
SELECT pair_id, node, max(struct_pack(len := len(path), path := path)) AS best FROM paths GROUP BY pair_id, node""",
    mx_script="""
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY best, part) AS line, statement, object_kind <> 'index' AS transactional, risk
FROM (SELECT n.pair_id, best, object_kind, risk, unnest(list_filter(statements, lambda x: x IS NOT NULL)) AS statement,
    unnest(range(len(list_filter(statements, lambda x: x IS NOT NULL)))) AS part
  FROM {mx_nodes} n JOIN {mx_paths} p ON p.pair_id = n.pair_id AND p.node = n.node)""",
)


# Foreign keys of created and dropped tables stand in the table's change until the script is planned.
ORACLE_CTES["mx_drift"] = """
SELECT * FROM {mx_changes} WHERE NOT (kind IN ('add_constraint', 'drop_constraint') AND k IN (SELECT k FROM {mx_base} WHERE in_s <> in_t))"""


@query("SELECT pair_id, object_kind, ns AS namespace, parent_name, name, op, kind, risk FROM {mx_drift}")
def drift_all_kinds(spark, folder):
    return whole_drift(spark, folder).select("pair_id", "object_kind", "namespace", "parent_name", "name", "op", "kind", "risk")


@query("SELECT pair_id, line, statement, transactional, risk FROM {mx_script}")
def migration_script(spark, folder):
    planned = whole_plan(spark, folder)
    return planned.up.select("pair_id", "line", "statement", "transactional", "risk")


ORACLE_CTES["mx_units"] = """
SELECT *, sum(CASE WHEN transactional THEN 0 ELSE 1 END) OVER (PARTITION BY pair_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS barrier,
  row_number() OVER (ORDER BY pair_id, line) AS line_number FROM {mx_script}"""


@query(
    "SELECT line_number, statement || ';' AS text, pair_id, transactional, min(line_number) OVER u AS first_line, max(line_number) OVER u AS last_line, "
    "count(*) OVER u AS statements FROM {mx_units} WINDOW u AS (PARTITION BY pair_id, barrier, transactional)"
)
def migration_folder(spark, folder):
    """The written script read back, every line with the unit whose range it is in."""
    target = f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    planned = whole_plan(spark, folder)
    sinks.write_migration(planned.up, planned.down, target)
    lines = sinks.read_script(spark, target, "up")
    units = sinks.read_manifest(spark, target).where("direction = 'up'").drop("direction")
    each = units.withColumn("line_number", F.explode(F.sequence("first_line", "last_line")))
    return lines.join(each, "line_number")


@query(
    f"SELECT pair_id, min(line) AS start_line, max(line) AS end_line, transactional, {_LABEL.format(_RANK)} AS max_risk "
    "FROM {mx_units} GROUP BY pair_id, barrier, transactional"
)
def migration_units(spark, folder):
    return whole_plan(spark, folder).units.drop("reason")


@query(
    f"SELECT pair_id, {_LABEL.format(_RANK)} AS max_risk, count(*) FILTER (risk IN ('SAFE', 'WARNING', 'DANGEROUS')) AS allowed, "
    "count(*) FILTER (risk IN ('DESTRUCTIVE', 'BLOCKED')) AS refused FROM {mx_drift} GROUP BY pair_id"
)
def run_risk(spark, folder):
    """Worst risk, and the two sides of the gate, over all kinds of changes."""
    graded = whole_drift(spark, folder)
    allowed, refused = risk.risk_gate(graded)
    sides = allowed.select("pair_id", F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(
        refused.select("pair_id", F.lit(0).alias("a"), F.lit(1).alias("r"))
    )
    counts = sides.groupBy("pair_id").agg(F.sum("a").alias("allowed"), F.sum("r").alias("refused"))
    return risk.migration_risk(graded).join(counts, "pair_id")


_SUMMARY = (
    "count(*) FILTER (op = 'create') AS n_add, count(*) FILTER (op IN ('alter', 'rename')) AS n_mod, "
    "count(*) FILTER (op = 'drop') AS n_del, count(*) FILTER (op = 'replace') AS n_conflict"
)


@query(
    f"SELECT pair_id, CAST(NULL AS VARCHAR) AS namespace, CAST(NULL AS VARCHAR) AS object_kind, {_SUMMARY} FROM {{mx_drift}} GROUP BY pair_id UNION ALL "
    f"SELECT pair_id, ns, object_kind, {_SUMMARY} FROM {{mx_drift}} GROUP BY pair_id, ns, object_kind UNION ALL "
    f"SELECT pair_id, ns, NULL, {_SUMMARY} FROM {{mx_drift}} GROUP BY pair_id, ns"
)
def run_summary(spark, folder):
    """The four counts per pair, schema and object group over all kinds of changes (null: all of them)."""
    found = whole_drift(spark, folder)
    total = report.change_summary(found)
    counts = total.unionByName(report.tree_badges(found), allowMissingColumns=True)
    return counts.select("pair_id", "namespace", "object_kind", *[F.col(n).cast("long").alias(n) for n in report.CLASSES.values()])


@query(
    "SELECT pair_id, ns AS namespace, CASE WHEN object_kind IN ('schema', 'extension') THEN NULL WHEN object_kind = 'index' THEN "
    "(SELECT b.nm FROM {mx_named} b WHERE b.k = d.k AND b.pair_id = d.pair_id) ELSE coalesce(parent_name, name) END AS table_name, name, kind, "
    "CASE WHEN object_kind IN ('schema', 'extension') THEN 'NONE' WHEN object_kind = 'index' THEN 'SHARE UPDATE EXCLUSIVE' "
    "WHEN kind = 'add_constraint' AND name LIKE 'fk%' THEN 'SHARE ROW EXCLUSIVE' "
    "WHEN kind = 'alter_table_attrs' AND (SELECT b.old_owner = b.new_owner FROM {mx_named} b WHERE b.k = d.k AND b.pair_id = d.pair_id) "
    "THEN 'SHARE UPDATE EXCLUSIVE' ELSE 'ACCESS EXCLUSIVE' END AS lock_mode, "
    "CASE risk WHEN 'SAFE' THEN 'ok' WHEN 'WARNING' THEN '' WHEN 'DANGEROUS' THEN 'warn' ELSE 'err' END AS severity FROM {mx_drift} d"
)
def run_locks(spark, folder):
    """Lock mode of every change, of all kinds."""
    none = spark.createDataFrame([], "pair_id long, namespace string, table_name string, row_count long")
    return script.lock_estimate(whole_drift(spark, folder), none).drop("row_count")


ORACLE_CTES["mx_details"] = """
SELECT d.pair_id, d.ns AS namespace, kind, risk, CASE WHEN kind = 'rename_table' THEN name WHEN object_kind = 'index' THEN b.nm
    ELSE coalesce(parent_name, name) END AS table_name,
  CASE WHEN kind IN ('add_column', 'add_constraint', 'create_index') THEN '+' || name
    WHEN kind IN ('drop_column', 'drop_constraint', 'drop_index') THEN '-' || name
    WHEN kind = 'alter_column_type' THEN name || ' type change' WHEN kind = 'set_column_default' THEN name || ' default'
    WHEN kind = 'rename_table' THEN name || '→r' || d.k WHEN kind = 'rename_column' THEN 'c2→c9' WHEN kind = 'replace_index' THEN name || ' replaced' END AS detail
FROM {mx_drift} d JOIN {mx_named} b ON b.pair_id = d.pair_id AND b.k = d.k WHERE object_kind NOT IN ('schema', 'extension')"""


@query(
    "SELECT pair_id, namespace, table_name, CASE WHEN bool_or(kind = 'create_table') THEN 'create' WHEN bool_or(kind = 'drop_table') THEN 'drop' "
    f"ELSE 'alter' END AS op, coalesce(string_agg(detail, ', ' ORDER BY detail), '') AS detail, {_LABEL.format(_RANK)} AS risk, count(*) AS n_changes "
    "FROM {mx_details} GROUP BY pair_id, namespace, table_name"
)
def run_change_table(spark, folder):
    """One row per changed table over all kinds of changes; schemas and extensions are no tables."""
    return report.change_table(whole_drift(spark, folder))


@query(
    "SELECT object_kind, (SELECT count(*) FROM {mx_drift} d WHERE d.object_kind = o.object_kind) AS n_changes, CAST(0 AS BIGINT) AS n_left "
    "FROM (SELECT unnest(['schema', 'extension', 'table', 'column', 'index', 'constraint']) AS object_kind) o"
)
def apply_changes(spark, folder):
    """Changes of every kind, and how many are left once they are applied to the source."""
    source, target = (stored_side(spark, folder, side) for side in ("source", "target"))
    found = whole_drift(spark, folder)
    left = compare.compare_catalogs(compare.stored_catalog(patch.apply_changes(source, found)), target)
    kinds = spark.createDataFrame([(k,) for k in ("schema", "extension", "table", "column", "index", "constraint")], "object_kind string")
    for name, rows in (("n_changes", found), ("n_left", left)):
        counts = rows.groupBy("object_kind").agg(F.count(F.lit(1)).alias(name))
        kinds = kinds.join(counts, "object_kind", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return kinds


_RULES = [
    (None, "column", "s0.*", "default"),
    (None, None, "s1.t1*", None),
    (None, "table", "s?.t*", "comment"),
    (None, "index", "*ix?5", None),
    (7, None, "s2.*", None),
]


@query(
    "SELECT pair_id, object_kind, ns AS namespace, parent_name, name, kind, "
    "kind = 'alter_table_attrs' AND (SELECT b.old_owner <> b.new_owner FROM {mx_named} b WHERE b.k = d.k AND b.pair_id = d.pair_id) AS owner_left "
    "FROM (SELECT *, concat_ws('.', ns, parent_name, name) AS own FROM {mx_drift}) d "
    "WHERE NOT (object_kind = 'column' AND kind = 'set_column_default' AND own LIKE 's0.%') AND NOT own LIKE 's1.t1%' "
    "AND NOT (object_kind = 'index' AND own LIKE '%ix_5') AND NOT (pair_id = 7 AND own LIKE 's2.%') "
    "AND NOT (kind = 'alter_table_attrs' AND own LIKE 's_.t%' AND (SELECT b.old_owner = b.new_owner FROM {mx_named} b WHERE b.k = d.k AND b.pair_id = d.pair_id))"
)
def exclusion_rules(spark, folder):
    """Drift without what overlapping rules leave out, whole objects and attributes."""
    rules = spark.createDataFrame(_RULES, "pair_id long, object_kind string, glob string, attribute string")
    left = exclude.exclude_changes(whole_drift(spark, folder), rules)
    owner = (F.col("kind") == "alter_table_attrs") & F.array_contains("changed", "owner")
    return left.select(
        "pair_id", "object_kind", "namespace", "parent_name", "name", "kind", F.coalesce(owner, F.lit(False)).alias("owner_left")
    )


_LOOKUP = list(snapshots.LOOKUPS)
_ASKED = f"""
SELECT k, pair_id AS db_id, lookup, namespace, parent, CASE lookup WHEN 'schema_by_name' THEN namespace WHEN 'extension_by_name'
    THEN CASE WHEN k % 3 = 0 THEN 'ext' ELSE 'none' END WHEN 'column_by_name' THEN 'c' || CAST(k % 4 AS STRING)
    WHEN 'index_by_qname' THEN 'ix' || CAST(k AS STRING) WHEN 'index_by_ref' THEN 'ix' || CAST(k AS STRING) ELSE parent END AS name
FROM (SELECT k, pair_id, CASE k % 8 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_LOOKUP))} END AS lookup,
    CASE WHEN k % 7 = 0 THEN 's' || CAST(k % 4 AS STRING) ELSE namespace END AS namespace, 't' || CAST(k AS STRING) AS parent FROM {{mx_base}}) x"""
ORACLE_CTES["mx_asked"] = _ASKED


@query(
    "SELECT a.db_id, a.lookup, a.namespace, a.parent, a.name, CASE a.lookup WHEN 'schema_by_name' THEN s.ns IS NOT NULL "
    "WHEN 'extension_by_name' THEN a.name = 'ext' AND a.db_id % 4 <> 0 WHEN 'column_by_name' THEN c.name IS NOT NULL "
    "WHEN 'index_by_qname' THEN i.name IS NOT NULL WHEN 'index_by_ref' THEN i.name IS NOT NULL ELSE t.table_name IS NOT NULL END AS found, "
    "CASE a.lookup WHEN 'schema_by_name' THEN NULL WHEN 'extension_by_name' THEN CASE WHEN a.name = 'ext' AND a.db_id % 4 <> 0 THEN '1.0' END "
    f"WHEN 'column_by_name' THEN {CANONICAL.format('c.data_type')} WHEN 'index_by_qname' THEN i.method WHEN 'index_by_ref' THEN i.method ELSE t.owner END AS detail "
    "FROM {mx_asked} a LEFT JOIN (SELECT DISTINCT pair_id, namespace AS ns FROM {mx_source_table}) s ON s.pair_id = a.db_id AND s.ns = a.name "
    "LEFT JOIN {mx_source_table} t ON t.pair_id = a.db_id AND t.namespace = a.namespace AND t.table_name = a.name "
    "LEFT JOIN {mx_source_index} i ON i.pair_id = a.db_id AND i.namespace = a.namespace AND i.name = a.name "
    "LEFT JOIN {mx_source_column} c ON c.pair_id = a.db_id AND c.namespace = a.namespace AND c.table_name = a.parent AND c.name = a.name"
)
def object_lookups(spark, folder):
    """A batch of all eight lookups, hits and misses."""
    c = catalog(spark, folder, "source")

    def model(rows):
        return rows.withColumnsRenamed({"pair_id": "db_id", "namespace": "schema_name"})

    snapshot = snapshots.Snapshot(*[model(x) for x in (c.schemas, c.tables, c.columns, c.constraints, c.indexes, c.extensions)])
    asked = spark.sql(_ASKED, mx_base=fixture(spark, folder, "mx_base")).drop("k")
    return snapshots.look_up(snapshot, asked)


@query(
    "SELECT object_kind, (SELECT count(*) FROM {mx_drift} d WHERE false AND d.object_kind = o.object_kind) AS n_deltas "
    "FROM (SELECT unnest(['schema', 'extension', 'table', 'column', 'index', 'constraint']) AS object_kind) o"
)
def idempotence_all_kinds(spark, folder):
    """Catalogs compared with themselves: no change of any kind."""
    same = catalog(spark, folder, "source")
    found = compare.compare_catalogs(same, same).groupBy("object_kind").agg(F.count(F.lit(1)).alias("n_deltas"))
    kinds = spark.createDataFrame([(k,) for k in ("schema", "extension", "table", "column", "index", "constraint")], "object_kind string")
    return kinds.join(found, "object_kind", "left").withColumn("n_deltas", F.coalesce("n_deltas", F.lit(0)))


# Names of which some differ in case only: every fourth table once more in capitals.
_SPELLED = """
SELECT pair_id, namespace, table_name, owner FROM {mx_source_table}
UNION ALL SELECT pair_id, upper(namespace), upper(table_name), 'other' FROM {mx_source_table} WHERE owner = 'u4'"""
ORACLE_CTES["mx_spelled"] = _SPELLED


def _spelled(spark, folder):
    return spark.sql(_SPELLED, mx_source_table=fixture(spark, folder, "mx_source_table"))


@query(
    "SELECT pair_id, lower(namespace) AS namespace, lower(table_name) AS table_name, count(*) AS n_rows, "
    "count(DISTINCT namespace || '.' || table_name) AS n_spellings, min(namespace || '.' || table_name) AS kept "
    "FROM {mx_spelled} GROUP BY ALL HAVING count(*) > 1"
)
def colliding_names(spark, folder):
    return compare.colliding_names(_spelled(spark, folder), ["pair_id", "namespace", "table_name"])


@query(
    "SELECT coalesce(s.pair_id, t.pair_id) AS pair_id, coalesce(s.table_name, t.table_name) AS name, CASE WHEN t.table_name IS NULL THEN 'drop_table' "
    "WHEN s.table_name IS NULL THEN 'create_table' ELSE 'alter_table_attrs' END AS kind FROM "
    "(SELECT pair_id, namespace AS ns, table_name, owner FROM {mx_source_table} WHERE namespace IN ('s0', 's1') AND table_name NOT LIKE 't1%') s FULL JOIN "
    "(SELECT pair_id, namespace AS ns, table_name, owner FROM {mx_target_table} WHERE namespace IN ('s0', 's1') AND table_name NOT LIKE 't1%') t "
    "ON s.pair_id = t.pair_id AND s.ns = t.ns AND s.table_name = t.table_name WHERE s.owner IS DISTINCT FROM t.owner"
)
def compare_options_tables(spark, folder):
    """Table names, schemas, list and glob in other letter cases; comments left out."""
    options = compare.CompareOptions(include_schemas=["S0", "s1"], exclude_tables=["T1*"], compare_comments=False, case_sensitive=False)
    source, target = (catalog(spark, folder, side).tables for side in ("source", "target"))
    shouted = source.withColumns({"namespace": F.upper("namespace"), "table_name": F.upper("table_name")})
    found = compare.compare_tables(shouted, target, options)
    return found.select("pair_id", F.lower("name").alias("name"), "kind")
