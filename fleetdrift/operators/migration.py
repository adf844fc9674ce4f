"""A whole run: renames, comparison, exclusions, risk, order, statements, transaction units."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetdrift.operators import compare, dependencies, exclude, order, rename, risk, script
from fleetdrift.operators.compare import DEFAULTS, Catalog, CompareOptions
from fleetdrift.session import cut_lineage, stored


def drift(
    source: Catalog,
    target: Catalog,
    *,
    table_renames: DataFrame | None = None,
    column_renames: DataFrame | None = None,
    rules: DataFrame | None = None,
    options: CompareOptions = DEFAULTS,
    concurrent_indexes: bool = True,
) -> DataFrame:
    """Graded changes of all kinds from source to target.

    Renames are annotations (see ``rename``); column renames name their table as
    the source does and their new column as the target does.
    """
    renamed_rows = []
    tables = columns = None
    if table_renames is not None:
        tables, rows = rename.rename_tables(source.tables, target.tables, table_renames)
        tables = cut_lineage(tables)
        renamed_rows.append(rows)
    if column_renames is not None:
        # Columns are looked up on the target under their table's new name.
        moved = source if tables is None else _stored(rename.rename_catalog(source, tables))
        annotated = cut_lineage(column_renames if tables is None else rename.apply_table_renames(column_renames, tables))
        effective, rows = rename.rename_columns(moved.columns, target.columns, annotated)
        renamed_rows.append(rows)
        source = _stored(rename.rename_catalog(moved, None, cut_lineage(effective)))
    elif tables is not None:
        source = _stored(rename.rename_catalog(source, tables))
    found = compare.compare_catalogs(source, target, options)
    for rows in renamed_rows:
        found = found.unionByName(rows)
    if rules is not None:
        found = exclude.exclude_changes(found, rules)
    return risk.classify_risk(found, concurrent_indexes=concurrent_indexes)


def _stored(renamed: Catalog) -> Catalog:
    """A renamed catalog with the joins done that gave it its names: a comparison reads it several times."""
    kinds = ("tables", "columns", "indexes", "constraints")
    return replace(renamed, **{k: stored(getattr(renamed, k)) for k in kinds})


@dataclass(frozen=True)
class Migration:
    """``changes`` with their ``position``; statements up and down with ``line``; units; changes that have no order."""

    changes: DataFrame
    up: DataFrame
    down: DataFrame
    units: DataFrame
    unordered: DataFrame


def plan_migration(graded: DataFrame, *, concurrent_indexes: bool = True) -> Migration:
    """Order graded changes by what they need and render them.

    The way back runs the rollback statements in reverse order.  Pairs whose
    changes wait for each other in a circle have no order and no statements.
    """
    split = dependencies.split_foreign_keys(graded.drop("risk"))
    # Read by the edges, the walk and the statements: computed once.
    nodes = cut_lineage(dependencies.with_nodes(risk.classify_risk(split, concurrent_indexes=concurrent_indexes)))
    walked = cut_lineage(order.walk(nodes, dependencies.change_edges(nodes)))
    places = walked.where("ordered").select("pair_id", "node", "position")
    rendered = cut_lineage(script.render_statements(nodes.join(places, ["pair_id", "node"])))
    up = script.statement_lines(rendered, ["position"])
    undone = rendered.withColumn("position", -F.col("position"))
    down = script.statement_lines(undone, ["position"], "rollback")
    return Migration(
        rendered, up, down, script.transaction_units(up),
        walked.where("NOT ordered").select("pair_id", "node", "node_key", "missing", "in_cycle"),
    )
