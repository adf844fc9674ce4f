"""Catalog tables derived from the driver's tables.

The driver's data has no catalogs, so each catalog relation is a deterministic
projection: orders are tables, lineitems columns, customers schemas or pairs,
parts indexes, suppliers extensions.  Each text below runs in Spark and DuckDB;
``{name}`` stands for another fixture or a driver table.  Flags are aggregated
by their character codes, which keeps Spark's aggregation on hashes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetdrift.session import stored
from fleetdrift.skew import positions

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]

# Type descriptions used by the fixtures and their canonical form.
RAW_TYPES = {
    "int4": "integer",
    "varchar(100)": "character varying(100)",
    "_text": "text[]",
    "numeric(10,2)": "numeric(10,2)",
    "timestamptz(6)": "timestamp(6) with time zone",
    '"char"': '"char"',
    "bpchar(10)": "character(10)",
    "float8": "double precision",
    "_int4[]": "integer[]",
    "bool": "boolean",
    "INT8": "bigint",
    "app_money": "app_money",
    "timestamp(3) without time zone": "timestamp(3) without time zone",
    "decimal(8,3)[]": "numeric(8,3)[]",
    "timetz": "time with time zone",
    "  integer  ": "integer",
}


def _case(subject: str, values: list[str], shift: int = 0) -> str:
    arms = [f"WHEN {i} THEN '{values[(i + shift) % len(values)]}'" for i in range(len(values))]
    return f"CASE {subject} {' '.join(arms)} END"


def text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


CANONICAL = "CASE {0} " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in RAW_TYPES.items()) + " END"

FIXTURES = {
    # --- one catalog capture per database (db_id 0..4) ---
    "fx_namespace": f"""
SELECT {{each_db}} AS db_id, c_custkey AS oid,
  CASE c_custkey % 20 WHEN 0 THEN 'pg_toast' WHEN 1 THEN 'information_schema' WHEN 2 THEN 'pgboss'
    ELSE lower(c_mktsegment) || '_' || {text('c_custkey')} END AS nspname
FROM {{customer}}""",
    "fx_class": f"""
SELECT o_orderkey % 5 AS db_id, o_orderkey AS oid, o_custkey AS relnamespace,
  't' || {text('o_orderkey')} AS relname,
  CASE o_orderstatus WHEN 'F' THEN 'p' WHEN 'O' THEN 'u' ELSE 't' END AS relpersistence,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'p'
    WHEN o_orderkey % 11 = 0 THEN 'v' ELSE 'r' END AS relkind,
  o_orderpriority = '5-LOW' AND o_orderkey % 4 < 3 AS relispartition,
  'FOR VALUES IN (' || {text('o_orderkey')} || ')' AS bound_expr, CAST(NULL AS BIGINT) AS relam
FROM {{orders}}
UNION ALL
SELECT p_partkey % 5, -1 - p_partkey, p_partkey, 'i' || {text('p_partkey')}, 'p', 'i', FALSE,
  CAST(NULL AS STRING), p_partkey % 5
FROM {{part}}""",
    "fx_partitioned": f"""
SELECT o_orderkey % 5 AS db_id, o_orderkey AS partrelid,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'r' WHEN '2-HIGH' THEN 'l' ELSE 'h' END AS partstrat,
  'RANGE (c' || {text('o_orderkey % 7')} || ')' AS partkey
FROM {{orders}} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "fx_inherits": """
SELECT o_orderkey % 5 AS db_id, o_orderkey AS inhrelid, o_orderkey - 5 * (o_orderkey % 8) AS inhparent
FROM {orders} WHERE o_orderpriority = '5-LOW'
UNION ALL
SELECT o_orderkey % 5, o_orderkey, o_orderkey + 5
FROM {orders} WHERE o_orderpriority = '5-LOW' AND o_orderkey % 50 = 0""",
    "fx_attribute": f"""
SELECT l_orderkey % 5 AS db_id, l_orderkey AS attrelid,
  l_linenumber - CASE WHEN min(l_suppkey) % 50 = 0 THEN 8 ELSE 0 END AS attnum,
  'c' || {text('min(l_partkey)')} AS attname, min(l_partkey) AS atttypid,
  {_case('min(l_partkey) % 16', list(RAW_TYPES))} AS format_type,
  min(ascii(l_linestatus)) = 70 AS attnotnull,
  CASE WHEN min(ascii(l_returnflag)) = 82 THEN CASE WHEN min(l_suppkey) % 2 = 0 THEN 'a' ELSE 'd' END
    ELSE '' END AS attidentity,
  CASE WHEN min(ascii(l_returnflag)) = 78 AND min(l_suppkey) % 4 = 0 THEN 's'
    WHEN min(ascii(l_returnflag)) = 78 AND min(l_suppkey) % 8 = 2 THEN 'v' ELSE '' END AS attgenerated,
  min(l_quantity) > 45 AS attisdropped,
  CASE min(l_suppkey) % 3 WHEN 0 THEN 0 WHEN 1 THEN min(l_suppkey) ELSE min(l_partkey) % 100 END
    AS attcollation
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber""",
    "fx_default": f"""
SELECT l_orderkey % 5 AS db_id, l_orderkey AS adrelid,
  l_linenumber - CASE WHEN min(l_suppkey) % 50 = 0 THEN 8 ELSE 0 END AS adnum,
  'nextval(' || {text('min(l_suppkey)')} || ')' AS expr
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber
HAVING min(ascii(l_returnflag)) <> 82 AND min(l_suppkey) % 2 = 0""",
    "fx_type": """
SELECT {each_db} AS db_id, p_partkey AS oid,
  CASE p_partkey % 3 WHEN 0 THEN p_partkey % 100 ELSE 0 END AS typcollation
FROM {part}""",
    "fx_collation": f"""
SELECT {{each_db}} AS db_id, s_suppkey AS oid, 'coll_' || {text('s_suppkey')} AS collname
FROM {{supplier}}""",
    "fx_pg_index": f"""
SELECT p_partkey % 5 AS db_id, -1 - p_partkey AS indexrelid, p_partkey AS indrelid,
  p_size % 2 = 0 AS indisunique, p_partkey % 6 = 0 AS indisprimary, p_partkey % 9 = 0 AS indisexclusion,
  'CREATE INDEX i ON public.t USING btree (' || CASE p_partkey % 6 WHEN 0 THEN 'email'
    WHEN 1 THEN 'a DESC NULLS LAST, "B" text_pattern_ops' WHEN 2 THEN '(lower(email)) DESC, b'
    WHEN 3 THEN 'lower(email)' WHEN 4 THEN 'coalesce(a, b), c ASC' ELSE 'score NULLS FIRST' END || ')'
    || CASE WHEN p_partkey % 7 = 0 THEN ' INCLUDE (z)' ELSE '' END AS indexdef,
  CASE WHEN p_partkey % 4 = 0 THEN 'deleted_at IS NULL' END AS predicate
FROM {{part}}""",
    "fx_am": """
SELECT {each_db} AS db_id, CAST(r_regionkey AS BIGINT) AS oid,
  CASE r_regionkey WHEN 0 THEN 'btree' WHEN 1 THEN 'HASH' WHEN 2 THEN 'gin' WHEN 3 THEN 'custom_am'
    ELSE 'brin' END AS amname
FROM {region}""",
    "fx_pg_constraint": f"""
SELECT o_orderkey % 5 AS db_id, o_orderkey AS conrelid, 'k' || {text('o_orderkey')} AS conname,
  CASE o_orderkey % 6 WHEN 0 THEN 'p' WHEN 1 THEN 'u' WHEN 2 THEN 'c' WHEN 3 THEN 'f' WHEN 4 THEN 'x'
    ELSE 'n' END AS contype,
  CASE o_orderkey % 6 WHEN 0 THEN 'PRIMARY KEY (c1, "c' || {text('o_orderkey % 7')} || '")'
    WHEN 1 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'UNIQUE NULLS NOT DISTINCT (c2)'
      ELSE 'UNIQUE (c2, c3)' END
    WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'CHECK ((c1 > 0)) NO INHERIT'
      ELSE 'CHECK ((c1 > 0))' END
    WHEN 3 THEN 'FOREIGN KEY (c1) REFERENCES s' || {text('o_orderkey % 4')} || '.t'
      || {text('o_custkey')} || ' (id)' || CASE o_orderkey % 5 WHEN 0 THEN ' MATCH FULL'
      WHEN 1 THEN ' ON UPDATE SET NULL ON DELETE CASCADE' WHEN 2 THEN ' ON DELETE SET DEFAULT'
      ELSE '' END
    WHEN 4 THEN 'EXCLUDE USING gist (room WITH =, during WITH &&)'
      || CASE WHEN o_orderkey % 4 = 0 THEN ' WHERE (c1 > 0)' ELSE '' END
    ELSE 'NOT NULL c1' END AS condef,
  CASE WHEN o_orderkey % 6 = 3 AND o_orderkey % 4 = 1 THEN o_orderkey - 5 * (o_orderkey % 8) END
    AS confrelid,
  o_orderstatus = 'O' AS condeferrable, o_orderpriority = '1-URGENT' AS condeferred
FROM {{orders}}""",
    "fx_extension": f"""
SELECT CAST(floor(s_suppkey / 37) AS BIGINT) AS db_id, 'ext_' || {text('s_suppkey % 37')} AS name,
  '1.' || {text('s_nationkey')} AS default_version,
  CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE '1.' || {text('s_nationkey % 3')} END AS installed_version
FROM {{supplier}}""",
    # --- columns before and after, one pair per customer ---
    "fx_col": """
SELECT l_orderkey AS tbl, l_linenumber AS pos, min(l_partkey) AS p, min(l_suppkey) AS s,
  min(ascii(l_linestatus)) AS ls
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "fx_source": f"""
SELECT o.o_custkey AS pair_id, lower(o.o_orderpriority) AS namespace, 't' || {text('x.tbl')} AS table_name,
  'c' || {text('x.pos')} AS name, x.pos AS position, {_case('x.p % 16', list(RAW_TYPES))} AS data_type,
  x.ls = 79 AS nullable, CASE WHEN x.s % 2 = 0 THEN 'd' || {text('x.s')} END AS default_expr,
  CASE WHEN x.s % 11 = 0 THEN 'C' END AS collation,
  CASE WHEN x.p % 23 = 0 THEN 'always' END AS identity_generated,
  CASE WHEN x.p % 29 = 0 THEN 'c1 + ' || {text('x.s % 2')} END AS generated_expression
FROM {{fx_col}} x JOIN {{orders}} o ON o.o_orderkey = x.tbl
WHERE (x.p + x.pos) % 10 <> 0 AND x.tbl % 13 <> 0""",
    "fx_target": f"""
SELECT o.o_custkey AS pair_id, lower(o.o_orderpriority) AS namespace, 't' || {text('x.tbl')} AS table_name,
  'c' || {text('x.pos')} AS name, x.pos AS position,
  CASE WHEN x.p % 7 = 0 THEN {_case('x.p % 16', list(RAW_TYPES), shift=1)}
    ELSE {_case('x.p % 16', list(RAW_TYPES))} END AS data_type,
  CASE WHEN x.s % 5 = 0 THEN x.ls = 70 ELSE x.ls = 79 END AS nullable,
  CASE WHEN x.s % 3 = 0 THEN NULL WHEN x.s % 2 = 0 THEN 'd' || {text('x.s')} END AS default_expr,
  CASE WHEN x.s % 11 = 0 AND x.p % 2 = 0 THEN 'C' WHEN x.s % 37 = 0 THEN 'POSIX' END AS collation,
  CASE WHEN x.p % 23 = 0 THEN CASE WHEN x.s % 4 = 0 THEN 'by_default' ELSE 'always' END END
    AS identity_generated,
  CASE WHEN x.p % 29 = 0 THEN 'c1 + '
    || {text('x.s % 2 + CASE WHEN x.s % 6 = 0 THEN 1 ELSE 0 END')} END AS generated_expression
FROM {{fx_col}} x JOIN {{orders}} o ON o.o_orderkey = x.tbl
WHERE (x.p + x.pos) % 10 <> 1 AND x.tbl % 17 <> 0""",
    # --- tables, indexes, constraints, schemas, extensions before and after ---
    "fx_source_table": f"""
SELECT o_custkey AS pair_id, lower(o_orderpriority) AS namespace, 't' || {text('o_orderkey')} AS table_name,
  'u' || {text('o_orderkey % 5')} AS owner, CASE WHEN o_orderkey % 4 = 0 THEN 'fast' END AS tablespace,
  CASE WHEN o_orderkey % 3 = 0 THEN 'note ' || o_orderstatus END AS comment,
  CASE WHEN o_orderkey % 6 = 0 THEN 'range' END AS strategy,
  CASE WHEN o_orderkey % 6 = 1 THEN 'p' || {text('o_orderkey % 10')} END AS parent
FROM {{orders}} WHERE o_orderkey % 13 <> 0""",
    "fx_target_table": f"""
SELECT o_custkey AS pair_id, lower(o_orderpriority) AS namespace, 't' || {text('o_orderkey')} AS table_name,
  'u' || {text('CASE WHEN o_orderkey % 7 = 0 THEN 9 ELSE o_orderkey % 5 END')} AS owner,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'slow' ELSE 'fast' END END AS tablespace,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 8 <> 0 THEN 'note ' || o_orderstatus END AS comment,
  CASE WHEN o_orderkey % 6 = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'list' ELSE 'range' END END AS strategy,
  CASE WHEN o_orderkey % 6 = 1 THEN 'p' || {text('o_orderkey % 10 + CASE WHEN o_orderkey % 14 = 0 THEN 1 ELSE 0 END')} END AS parent
FROM {{orders}} WHERE o_orderkey % 17 <> 0""",
    "fx_source_index": f"""
SELECT p_size AS pair_id, lower(p_type) AS namespace, 't' || {text('p_partkey % 50')} AS table_name,
  'i' || {text('p_partkey')} AS name, CASE p_partkey % 3 WHEN 0 THEN 'btree' WHEN 1 THEN 'hash' ELSE 'gin' END AS method,
  'c' || {text('p_partkey % 8')} AS key_name, p_partkey % 2 = 0 AS is_unique,
  CASE WHEN p_partkey % 4 = 0 THEN 'deleted_at IS NULL' END AS predicate
FROM {{part}} WHERE p_partkey % 10 <> 0""",
    "fx_target_index": f"""
SELECT p_size AS pair_id, lower(p_type) AS namespace, 't' || {text('p_partkey % 50')} AS table_name,
  'i' || {text('p_partkey')} AS name,
  CASE WHEN p_partkey % 11 = 0 THEN 'brin' ELSE CASE p_partkey % 3 WHEN 0 THEN 'btree' WHEN 1 THEN 'hash' ELSE 'gin' END END AS method,
  'c' || {text('CASE WHEN p_partkey % 13 = 0 THEN 99 ELSE p_partkey % 8 END')} AS key_name, p_partkey % 2 = 0 AS is_unique,
  CASE WHEN p_partkey % 4 = 0 AND p_partkey % 7 <> 0 THEN 'deleted_at IS NULL' END AS predicate
FROM {{part}} WHERE p_partkey % 10 <> 1""",
    "fx_source_constraint": f"""
SELECT o_custkey AS pair_id, lower(o_orderpriority) AS namespace, 't' || {text('o_orderkey')} AS table_name,
  'k' || {text('o_orderkey')} AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'c' ELSE 'f' END AS contype,
  CASE o_orderkey % 3 WHEN 0 THEN 'PRIMARY KEY (c1)' WHEN 1 THEN 'CHECK ((c1 > ' || {text('o_orderkey % 4')} || '))'
    ELSE 'FOREIGN KEY (c1) REFERENCES s.t (id)' END AS condef
FROM {{orders}} WHERE o_orderkey % 10 <> 0""",
    "fx_target_constraint": f"""
SELECT o_custkey AS pair_id, lower(o_orderpriority) AS namespace, 't' || {text('o_orderkey')} AS table_name,
  'k' || {text('o_orderkey')} AS name,
  CASE o_orderkey % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'c' ELSE 'f' END AS contype,
  CASE o_orderkey % 3 WHEN 0 THEN 'PRIMARY KEY (c1' || CASE WHEN o_orderkey % 7 = 0 THEN ', c2)' ELSE ')' END
    WHEN 1 THEN 'CHECK ((c1 > ' || {text('o_orderkey % 8')} || '))'
    ELSE 'FOREIGN KEY (c1) REFERENCES s.t (id)' || CASE WHEN o_orderkey % 5 = 0 THEN ' ON DELETE CASCADE' ELSE '' END END AS condef
FROM {{orders}} WHERE o_orderkey % 10 <> 1""",
    # --- whole catalogs before and after, one pair per customer: table k is the order k ---
    "mx_base": f"""
SELECT o.o_custkey AS pair_id, o.o_orderkey AS k, 's' || {text('o.o_orderkey % 3')} AS namespace,
  o.o_orderkey % 13 <> 0 AS in_s, o.o_orderkey % 17 <> 0 AS in_t, h.hub,
  o.o_orderkey <> h.hub AND o.o_orderkey % 6 <> 0 AND h.hub % 13 <> 0 AS fk_s,
  o.o_orderkey <> h.hub AND o.o_orderkey % 8 <> 0 AND h.hub % 17 <> 0 AS fk_t
FROM {{orders}} o JOIN (SELECT o_custkey, min(o_orderkey) AS hub FROM {{orders}} GROUP BY o_custkey) h
  ON h.o_custkey = o.o_custkey""",
    "mx_source_table": f"""
SELECT pair_id, namespace, 't' || {text('k')} AS table_name, 'u' || {text('k % 5')} AS owner,
  CASE WHEN k % 3 = 0 THEN 'note' END AS comment FROM {{mx_base}} WHERE in_s""",
    "mx_target_table": f"""
SELECT pair_id, namespace, CASE WHEN k % 19 = 0 THEN 'r' ELSE 't' END || {text('k')} AS table_name,
  'u' || {text('CASE WHEN k % 7 = 0 THEN 9 ELSE k % 5 END')} AS owner,
  CASE WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'note' END AS comment FROM {{mx_base}} WHERE in_t""",
    "mx_source_column": f"""
SELECT pair_id, namespace, 't' || {text('k')} AS table_name, 'c' || {text('n')} AS name, n AS position,
  CASE n WHEN 1 THEN 'bigint' WHEN 2 THEN 'varchar(100)' ELSE 'int4' END AS data_type, n <> 1 AS nullable,
  CASE WHEN n = 2 THEN 'd' END AS default_expr
FROM {{mx_base}} JOIN {{mx_number}} ON in_s AND (n < 3 OR k % 11 <> 0)""",
    "mx_target_column": f"""
SELECT pair_id, namespace, CASE WHEN k % 19 = 0 THEN 'r' ELSE 't' END || {text('k')} AS table_name,
  CASE WHEN n = 2 AND k % 23 = 0 THEN 'c9' ELSE 'c' || {text('n')} END AS name, n AS position,
  CASE n WHEN 1 THEN 'bigint' WHEN 2 THEN CASE WHEN k % 7 = 0 THEN 'text' ELSE 'varchar(100)' END ELSE 'int4' END AS data_type,
  n <> 1 AS nullable, CASE WHEN n = 2 AND k % 5 <> 0 THEN 'd' END AS default_expr
FROM {{mx_base}} JOIN {{mx_number}} ON in_t AND (n < 3 OR k % 9 <> 0)""",
    "mx_number": "SELECT CAST(r_regionkey AS INTEGER) AS n FROM {region} WHERE r_regionkey BETWEEN 1 AND 3",
    "mx_source_key": f"""
SELECT pair_id, namespace, 't' || {text('k')} AS table_name, 'pk' || {text('k')} AS name, 'p' AS contype,
  'PRIMARY KEY (c1)' AS condef FROM {{mx_base}} WHERE in_s AND k % 10 <> 0
UNION ALL
SELECT pair_id, namespace, 't' || {text('k')}, 'fk' || {text('k')}, 'f',
  'FOREIGN KEY (c1) REFERENCES s' || {text('hub % 3')} || '.t' || {text('hub')} || ' (c1)' FROM {{mx_base}} WHERE in_s AND fk_s""",
    "mx_target_key": f"""
SELECT pair_id, namespace, CASE WHEN k % 19 = 0 THEN 'r' ELSE 't' END || {text('k')} AS table_name, 'pk' || {text('k')} AS name,
  'p' AS contype, 'PRIMARY KEY (c1)' AS condef FROM {{mx_base}} WHERE in_t
UNION ALL
SELECT pair_id, namespace, CASE WHEN k % 19 = 0 THEN 'r' ELSE 't' END || {text('k')}, 'fk' || {text('k')}, 'f',
  'FOREIGN KEY (c1) REFERENCES s' || {text('hub % 3')} || '.' || CASE WHEN hub % 19 = 0 THEN 'r' ELSE 't' END
  || {text('hub')} || ' (c1)' FROM {{mx_base}} WHERE in_t AND fk_t""",
    "mx_source_index": f"""
SELECT pair_id, namespace, 't' || {text('k')} AS table_name, 'ix' || {text('k')} AS name, 'btree' AS method, 'c2' AS key_name
FROM {{mx_base}} WHERE in_s AND k % 5 <> 0""",
    "mx_target_index": f"""
SELECT pair_id, namespace, CASE WHEN k % 19 = 0 THEN 'r' ELSE 't' END || {text('k')} AS table_name, 'ix' || {text('k')} AS name,
  CASE WHEN k % 14 = 0 THEN 'hash' ELSE 'btree' END AS method, CASE WHEN k % 23 = 0 THEN 'c9' ELSE 'c2' END AS key_name
FROM {{mx_base}} WHERE in_t AND k % 4 <> 0""",
    # --- dependency graphs, one per customer ---
    "fx_node": """
SELECT o_custkey AS pair_id, o_orderkey AS node,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
  o_orderpriority || '#' || lpad(CAST(o_orderkey AS STRING), 10, '0') AS node_key
FROM {orders}""",
    "fx_edge": """
SELECT DISTINCT a.pair_id, a.node, b.node AS prereq
FROM {fx_node} a JOIN {fx_node} b ON a.pair_id = b.pair_id
  AND (b.rn = floor(a.rn / 2) OR (a.rn % 3 = 0 AND b.rn = floor(a.rn / 3)))""",
    "fx_edge_cyclic": """
SELECT pair_id, node, prereq FROM {fx_edge}
UNION ALL
SELECT a.pair_id, a.node, b.node FROM {fx_node} a JOIN {fx_node} b ON a.pair_id = b.pair_id
WHERE a.rn = 1 AND b.rn = 3 AND a.pair_id % 10 = 0""",
    "fx_edge_unknown": """
SELECT pair_id, node, prereq FROM {fx_edge}
UNION ALL
SELECT pair_id, node, -node FROM {fx_node} WHERE node % 97 = 0 AND node > 0""",
    "fx_run": """
SELECT event_id AS run_id, ts AS started_at, user_id % 10 AS pair_id,
  CASE event_type WHEN 'purchase' THEN 'applied' WHEN 'view' THEN 'applied (dry)' WHEN 'signup' THEN 'pending'
    WHEN 'click' THEN 'rolled-back' ELSE 'failed' END AS status, event_id % 30 AS changes
FROM {events}""",
    "fx_line": """
SELECT l_orderkey AS obj, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
  CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END AS sig,
  'c' || CAST(l_partkey AS STRING) AS text
FROM {lineitem}""",
}

_NAME = re.compile(r"\{(\w+)\}")
_EACH_DB = {"spark": "explode(sequence(0L, 4L))", "duckdb": "unnest(generate_series(0, 4))"}


def with_fixtures(sql: str, ctes: dict[str, str] | None = None) -> str:
    """DuckDB text of ``sql`` with every fixture it needs as a CTE in front."""
    known = {**FIXTURES, **(ctes or {}), **ORACLE_CTES}
    order: list[str] = []

    def visit(body: str) -> None:
        for name in _NAME.findall(body):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)

    def plain(body: str) -> str:
        return _NAME.sub(lambda m: m[1], body.replace("{each_db}", _EACH_DB["duckdb"]))

    parts = [f"{name} AS MATERIALIZED ({plain(known[name])})" for name in order]
    return (f"WITH {', '.join(parts)} " if parts else "") + plain(sql)


# CTEs that only oracles use; filled by the query modules.
ORACLE_CTES: dict[str, str] = {}


_OPENED: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once per session."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPENED:
        _OPENED[key] = spark.read.parquet(path)
    return _OPENED[key]


def fixture(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fixture as a DataFrame; graphs avoid the per-customer windows and joins."""
    if name in DRIVER_TABLES:
        return table(spark, folder, name)
    if name == "fx_node":
        return _nodes(spark, folder)
    if name in ("fx_edge", "fx_edge_cyclic", "fx_edge_unknown"):
        return _edges(_nodes(spark, folder), name)
    if name == "mx_base":
        # Every relation of a whole catalog comes from these rows: stored once per session.
        key = (spark.sparkContext.applicationId, f"{folder}/{name}")
        if key not in _OPENED:
            _OPENED[key] = stored(_projected(spark, folder, name))
        return _OPENED[key]
    return _projected(spark, folder, name)


def _projected(spark: SparkSession, folder: str, name: str) -> DataFrame:
    body = FIXTURES[name].replace("{each_db}", _EACH_DB["spark"])
    needed = {n: fixture(spark, folder, n) for n in dict.fromkeys(_NAME.findall(body))}
    return spark.sql(body, **needed)


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.concat(
        F.col("o_orderpriority"), F.lit("#"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    )
    nodes = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("node"), key.alias("node_key")
    )
    return positions(nodes, ["pair_id"], ["node"], "rn")


def _edges(nodes: DataFrame, name: str) -> DataFrame:
    by_number = nodes.select("pair_id", F.col("node").alias("prereq"), F.col("rn").alias("prereq_rn"))

    def linked(rows: DataFrame, number) -> DataFrame:
        return rows.withColumn("prereq_rn", number).join(by_number, ["pair_id", "prereq_rn"]).select(
            "pair_id", "node", "prereq"
        )

    halves = linked(nodes, F.floor(F.col("rn") / 2))
    thirds = linked(nodes.where(F.col("rn") % 3 == 0), F.floor(F.col("rn") / 3))
    edges = halves.unionByName(thirds).distinct()
    if name == "fx_edge_cyclic":
        first = nodes.where((F.col("rn") == 1) & (F.col("pair_id") % 10 == 0))
        return edges.unionByName(linked(first, F.lit(3).cast("bigint")))
    if name == "fx_edge_unknown":
        stray = nodes.where((F.col("node") % 97 == 0) & (F.col("node") > 0))
        return edges.unionByName(stray.select("pair_id", "node", (-F.col("node")).alias("prereq")))
    return edges


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
