"""Queries on dependency order."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetdrift.operators import order
from fleetdrift.plans.fixtures import ORACLE_CTES, fixture
from fleetdrift.plans.registry import query

# Every path from a root to a node; the best one per node is longest, then greatest.
_PATHS = """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT pair_id, node, prereq FROM {edges}), paths AS (
  SELECT n.pair_id, n.node, [n.node_key] AS path FROM {fx_node} n
  WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.pair_id = n.pair_id AND e.node = n.node)
  UNION ALL
  SELECT e.pair_id, e.node, list_append(p.path, n.node_key) FROM paths p
  JOIN e ON e.pair_id = p.pair_id AND e.prereq = p.node
  JOIN {fx_node} n ON n.pair_id = e.pair_id AND n.node = e.node)
SELECT pair_id, node, max(struct_pack(len := len(path), path := path)) AS best FROM paths GROUP BY pair_id, node"""
ORACLE_CTES["best_paths"] = _PATHS.replace("{edges}", "{fx_edge}")


@query(
    "SELECT pair_id, node, CAST(best.len AS INTEGER) AS level, array_to_string(best.path, '/') AS path, "
    "row_number() OVER (PARTITION BY pair_id ORDER BY best.len, best.path) AS position, "
    "row_number() OVER (PARTITION BY pair_id, best.len ORDER BY best.path) AS rank FROM {best_paths}"
)
def topological_order(spark, folder):
    ordered = order.topological_order(fixture(spark, folder, "fx_node"), fixture(spark, folder, "fx_edge"))
    # As in the SQL, a path without any key is null.
    path = F.when(F.size(F.array_compact("path")) > 0, F.array_join("path", "/"))
    return order.with_paths(ordered).select("pair_id", "node", "level", path.alias("path"), "position", "rank")


@query(
    "SELECT pair_id, node, row_number() OVER (PARTITION BY pair_id ORDER BY best.len DESC, best.path DESC) AS undo_position FROM {best_paths}"
)
def rollback_order(spark, folder):
    ordered = order.topological_order(fixture(spark, folder, "fx_node"), fixture(spark, folder, "fx_edge"))
    return order.rollback_order(ordered).select("pair_id", "node", "undo_position")


# Nodes that need, directly or not, a node that needs itself.
ORACLE_CTES["needs"] = """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT pair_id, node, prereq FROM {fx_edge_cyclic} WHERE pair_id % 10 = 0), closure AS (
  SELECT pair_id, node, prereq FROM e
  UNION
  SELECT c.pair_id, c.node, e.prereq FROM closure c JOIN e ON e.pair_id = c.pair_id AND e.node = c.prereq)
SELECT DISTINCT pair_id, node, prereq FROM closure"""


ORACLE_CTES["stuck"] = """
SELECT DISTINCT n.pair_id, n.node FROM {needs} n JOIN (SELECT pair_id, node FROM {needs} WHERE node = prereq) c
  ON c.pair_id = n.pair_id AND (c.node = n.prereq OR c.node = n.node)"""


@query(
    "SELECT s.pair_id, s.node, n.node_key, count(*) AS open_prerequisites, "
    "EXISTS (SELECT 1 FROM {needs} m WHERE m.pair_id = s.pair_id AND m.node = s.node AND m.prereq = s.node) AS in_cycle FROM {stuck} s "
    "JOIN {fx_node} n ON n.pair_id = s.pair_id AND n.node = s.node "
    "JOIN (SELECT DISTINCT pair_id, node, prereq FROM {fx_edge_cyclic}) e ON e.pair_id = s.pair_id AND e.node = s.node "
    "JOIN {stuck} p ON p.pair_id = e.pair_id AND p.node = e.prereq GROUP BY ALL"
)
def cycle_report(spark, folder):
    return order.cycle_report(fixture(spark, folder, "fx_node"), fixture(spark, folder, "fx_edge_cyclic"))


@query(
    "SELECT e.pair_id, e.node, e.prereq, 'unknown prerequisite' AS problem FROM {fx_edge_unknown} e ANTI JOIN {fx_node} n "
    "ON n.pair_id = e.pair_id AND n.node = e.prereq"
)
def unknown_prerequisite(spark, folder):
    return order.unknown_prerequisites(fixture(spark, folder, "fx_node"), fixture(spark, folder, "fx_edge_unknown"))


@query(
    "SELECT n.pair_id, n.node, n.node_key FROM {fx_node} n ANTI JOIN {fx_edge} e ON n.pair_id = e.pair_id AND n.node = e.node"
)
def root_nodes(spark, folder):
    roots = order.root_nodes(fixture(spark, folder, "fx_node"), fixture(spark, folder, "fx_edge"))
    return roots.select("pair_id", "node", "node_key")


@query(
    "SELECT n.pair_id, n.node, count(DISTINCT e.prereq) AS dependencies FROM {fx_node} n LEFT JOIN {fx_edge} e "
    "ON n.pair_id = e.pair_id AND n.node = e.node GROUP BY ALL"
)
def dependency_count(spark, folder):
    return order.dependency_count(fixture(spark, folder, "fx_node"), fixture(spark, folder, "fx_edge"))


@query("SELECT DISTINCT pair_id, node, prereq FROM {fx_edge}")
def distinct_prerequisites(spark, folder):
    edges = fixture(spark, folder, "fx_edge")
    return order.distinct_prerequisites(edges.unionByName(edges.where(F.col("node") % 2 == 0)))
