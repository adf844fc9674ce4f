"""Which change has to wait for which, from what the changes hold.

A change gives and needs states of objects: ``+`` an object is there as it shall
be, ``=`` a column has its new name, ``-`` nothing uses an object's old state any
more.  Whoever needs a state
waits for all that give it, so one equi-join on (pair, state) finds all edges:

* tables wait for their schema and the parent of a partition, columns and indexes
  for their table, keys of indexes and constraints for their columns, a foreign
  key for the table, the columns and the keys it points to;
* a schema is dropped after its tables, a table after what points to it, a column
  is dropped or altered after the indexes and constraints on it are gone;
* a constraint is added after its old form is dropped, a name taken after the
  table that had it has moved.

Foreign keys of created and dropped tables are changes of their own, so tables
that point at each other do not wait for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.model import CONSTRAINT
from fleetdrift.operators.compare import DELTA_FIELDS
from fleetdrift.operators.deltas import delta_sort_key
from fleetdrift.operators.rename import HELD

# Less than any character of a name; names hold no control characters of this kind.
_SEPARATOR = "\u0001"


def split_foreign_keys(deltas: DataFrame) -> DataFrame:
    """Foreign keys of created and dropped tables as changes of their own.

    A table's change becomes itself without them and one change per key, in one
    pass over the changes.
    """
    whole = F.col("kind").isin("create_table", "drop_table")
    is_key = lambda c: c["kind"] == "foreign_key"
    none = F.array().cast(DELTA_FIELDS["table_constraints"])
    keys = F.when(whole, F.filter(F.coalesce("table_constraints", none), is_key)).otherwise(none)
    itself = F.array(F.lit(None).cast(CONSTRAINT))
    rows = deltas.withColumn("_key", F.explode(F.concat(itself, keys)))
    created, own = F.col("kind") == "create_table", F.col("_key").isNull()
    of_key = {
        "op": F.when(created, "create").otherwise("drop"),
        "kind": F.when(created, "add_constraint").otherwise("drop_constraint"),
        "object_kind": F.lit("constraint"),
        "namespace": F.col("namespace"),
        "parent_name": F.col("name"),
        "name": F.col("_key.name"),
        "constraint": F.col("_key"),
    }
    rest = F.when(whole, F.filter("table_constraints", lambda c: ~is_key(c))).otherwise(F.col("table_constraints"))
    of_itself = {n: F.col(n) for n in DELTA_FIELDS} | {"table_constraints": rest}
    others = [c for c in deltas.columns if c not in DELTA_FIELDS]
    return rows.select(
        *others, *[F.when(own, of_itself[n]).otherwise(of_key.get(n, F.lit(None))).alias(n) for n in DELTA_FIELDS]
    )


def with_nodes(deltas: DataFrame) -> DataFrame:
    """Changes with ``node`` and the ``node_key`` that breaks ties, unique in a pair."""
    key = F.array_join(delta_sort_key(), _SEPARATOR)
    return deltas.withColumn("node_key", key).withColumn("node", F.xxhash64("node_key", "object_kind"))


def _state(sign: str, kind: str, *names: Column) -> Column:
    """Name of a state; null if any part is."""
    return F.concat(*[x for n in (F.lit(sign + kind), *names) for x in (F.lit(_SEPARATOR), n)])


def _states() -> tuple[Column, Column]:
    """States that a change gives, and those that it needs."""
    kind, ns, name = F.col("kind"), F.col("namespace"), F.col("name")
    none = F.array().cast("array<string>")
    constraint = F.col("constraint")
    table = F.coalesce("parent_name", "index.table_name", "old_index.table_name")

    def listed(*states: Column) -> Column:
        return F.array_compact(F.array(*states))

    def columns(sign: str, names: Column, of: tuple[Column, Column] = (ns, table)) -> Column:
        return F.transform(F.coalesce(names, none), lambda c: _state(sign, "column", *of, c))

    def index_columns(index: Column) -> Column:
        return F.concat(F.array_compact(F.transform(index["key_columns"], lambda k: k["column_name"])), F.coalesce(index["include_columns"], none))

    def together(*arrays: Column) -> Column:
        return F.array_compact(F.flatten(F.array(*[F.coalesce(a, none) for a in arrays])))

    constrained = F.concat(
        F.coalesce(constraint["columns"], none), F.coalesce(F.transform(constraint["elements"], lambda e: e["column_or_expr"]), none)
    )
    foreign = constraint["kind"] == "foreign_key"
    unique = constraint["kind"].isin("primary_key", "unique")
    target = (constraint["ref_namespace"], constraint["ref_table"])
    has_key = F.exists("table_constraints", lambda c: c["kind"].isin("primary_key", "unique"))
    new_parent, old_parent = F.col("new_partition_of"), F.col("old_partition_of")
    own_constraint = _state("-", "constraint", ns, table, name)
    old_index, new_index = index_columns(F.col("old_index")), index_columns(F.col("index"))

    gives = (
        F.when(kind == "create_schema", listed(_state("+", "schema", ns)))
        .when(kind == "create_table", listed(_state("+", "table", ns, name), F.when(has_key, _state("+", "key", ns, name))))
        .when(
            kind == "drop_table",
            listed(_state("-", "schema", ns), _state("-", "table", old_parent["parent_namespace"], old_parent["parent_name"])),
        )
        .when(kind == "rename_table", listed(_state("+", "table", ns, F.col("new_name")), _state("-", "name", ns, F.col("old_name"))))
        .when(kind == "rename_column", listed(*[_state(x, "column", ns, table, F.col("new_name")) for x in "+="]))
        .when(kind.isin("add_column", "alter_column_type", "replace_column"), listed(_state("+", "column", ns, table, name)))
        .when(kind == "drop_index", together(listed(_state("-", "table", ns, table)), columns("-", old_index)))
        .when(kind == "replace_index", columns("-", F.array_except(old_index, new_index)))
        .when(kind == "add_constraint", listed(F.when(unique, _state("+", "key", ns, table))))
        .when(
            kind == "drop_constraint",
            together(
                listed(
                    own_constraint, _state("-", "table", ns, table), F.when(foreign, _state("-", "table", *target)),
                    F.when(foreign, _state("-", "key", *target)),
                ),
                columns("-", constrained),
                F.when(foreign, columns("-", constraint["ref_columns"], target)),
            ),
        )
        .otherwise(none)
    )
    on_table = _state("+", "table", ns, table)
    needs = (
        F.when(kind == "drop_schema", listed(_state("-", "schema", ns)))
        .when(
            kind == "create_table",
            listed(_state("+", "schema", ns), _state("+", "table", new_parent["parent_namespace"], new_parent["parent_name"])),
        )
        .when(kind == "drop_table", listed(_state("-", "table", ns, name)))
        .when(
            kind == "rename_table",
            listed(
                F.when(~F.col("new_name").endswith(HELD), _state("-", "name", ns, F.col("new_name"))),
                F.when(F.col("old_name").endswith(HELD), _state("+", "table", ns, F.col("old_name"))),
            ),
        )
        .when(
            kind == "alter_table_attrs",
            listed(_state("+", "table", ns, name), _state("+", "table", new_parent["parent_namespace"], new_parent["parent_name"])),
        )
        .when(
            kind.isin("drop_column", "alter_column_type", "replace_column"),
            listed(on_table, _state("-", "column", ns, table, name), _state("=", "column", ns, table, name)),
        )
        .when(kind.startswith("set_column"), listed(on_table, _state("=", "column", ns, table, name)))
        .when(kind.isin("create_index", "replace_index"), together(listed(on_table), columns("+", new_index)))
        .when(
            kind == "add_constraint",
            together(
                listed(on_table, own_constraint, F.when(foreign, _state("+", "table", *target)), F.when(foreign, _state("+", "key", *target))),
                columns("+", constrained),
                F.when(foreign, columns("+", constraint["ref_columns"], target)),
            ),
        )
        .when(kind == "drop_constraint", together(listed(on_table, F.when(unique, _state("-", "key", ns, table)))))
        .when(F.col("parent_name").isNotNull(), listed(on_table))
        .otherwise(none)
    )
    return gives, needs


def change_edges(nodes: DataFrame) -> DataFrame:
    """``pair_id, node, prereq`` among changes (``with_nodes``).

    A state that very many changes need, such as a schema, has few that give it,
    and the other way round: AQE splits the hot side.
    """
    gives, needs = _states()
    given = nodes.select("pair_id", F.col("node").alias("prereq"), F.explode(F.array_distinct(gives)).alias("state"))
    needed = nodes.select("pair_id", "node", F.explode(F.array_distinct(needs)).alias("state"))
    return (
        needed.join(given, ["pair_id", "state"]).where(F.col("node") != F.col("prereq")).select("pair_id", "node", "prereq").distinct()
    )
