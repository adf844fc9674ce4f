"""Renames by explicit annotation; never guessed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.marks import marks, split_marked, where_marked
from fleetdrift.operators.compare import TABLE, Catalog, change_rows
from fleetdrift.session import cut_lineage


#: Ends the name that a table has while its new name is still taken.
HELD = "__moving"


def composed(renames: DataFrame, source: DataFrame) -> DataFrame:
    """Annotations followed through names that the source does not have: a to b and b to c are a to c.

    One round per link of the longest chain; annotations that lead back are none.
    """
    on_new = ["pair_id", "namespace", "new_name"]
    moves = cut_lineage(
        renames.select("pair_id", "namespace", "old_name", "new_name").groupBy("pair_id", "namespace", "old_name")
        .agg(F.min("new_name").alias("new_name"))
    )
    # Names that no rename leads to are not asked for.
    names = source.select("pair_id", "namespace", F.col("table_name").alias("new_name"))
    taken = cut_lineage(where_marked(names, on_new, marks(moves, on_new)).join(moves, on_new, "left_semi").distinct())
    starts = moves
    seen = moves.select("pair_id", "namespace", "old_name", F.array("old_name").alias("passed"), "new_name")
    while True:
        following = starts.select("pair_id", "namespace", F.col("old_name").alias("new_name"), F.col("new_name").alias("_next"))
        onward = seen.join(following, on_new, "left").join(taken.withColumn("_taken", F.lit(True)), on_new, "left")
        moved = F.col("_next").isNotNull() & F.col("_taken").isNull() & ~F.array_contains("passed", F.col("new_name"))
        stepped = cut_lineage(
            onward.select(
                "pair_id", "namespace", "old_name", F.when(moved, F.array_append("passed", "new_name")).otherwise(F.col("passed")).alias("passed"),
                F.when(moved, F.col("_next")).otherwise(F.col("new_name")).alias("new_name"), moved.alias("moved"),
            )
        )
        seen = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return seen.drop("passed").where("old_name <> new_name")


def rename_tables(
    source: DataFrame, target: DataFrame, renames: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(effective renames, rename_table deltas)`` for tables.

    ``renames`` has ``pair_id, namespace, old_name, new_name``.  A rename applies
    only if the old table exists in the source, the new one in the target, and
    the new name is free in the source or given up by another rename that
    applies.  A name given up that way is reached in two steps, so chains and
    swaps can run one statement at a time.
    """
    key = ["pair_id", "namespace"]
    moves = cut_lineage(composed(renames, source))

    def named(rows: DataFrame, name: str) -> DataFrame:
        """Tables that a rename names, and few others."""
        tables = rows.select(*key, F.col("table_name").alias(name))
        return where_marked(tables, [*key, name], marks(moves, [*key, name]))

    taken = named(source, "new_name")
    moves = moves.join(named(source, "old_name"), [*key, "old_name"], "left_semi").join(named(target, "new_name"), [*key, "new_name"], "left_semi")
    # Of two renames to one name the one from the smaller name applies.
    moves = cut_lineage(moves.groupBy(*key, "new_name").agg(F.min("old_name").alias("old_name")))
    while True:
        given_up = moves.select(*key, F.col("old_name").alias("new_name"))
        blocked = cut_lineage(moves.join(taken, [*key, "new_name"], "left_semi").join(given_up, [*key, "new_name"], "left_anti"))
        if blocked.isEmpty():
            break
        moves = cut_lineage(moves.join(blocked.select(*key, "old_name"), [*key, "old_name"], "left_anti"))
    effective = moves.select(*key, "old_name", "new_name")
    waits = given_up.withColumn("_waits", F.lit(True))
    steps = F.when(
        F.col("_waits"),
        F.array(F.struct("old_name", F.col("_held").alias("new_name")), F.struct(F.col("_held").alias("old_name"), "new_name")),
    ).otherwise(F.array(F.struct("old_name", "new_name")))
    rows = (
        effective.join(waits, [*key, "new_name"], "left")
        .withColumn("_held", F.concat("old_name", F.lit(HELD)))
        .select(*key, F.explode(steps).alias("_step"))
        .select(*key, "_step.*", F.lit("rename_table").alias("kind"))
    )
    changes = change_rows(
        rows,
        object_kind=F.lit("table"),
        namespace=F.col("namespace"),
        name=F.col("old_name"),
        old_name=F.col("old_name"),
        new_name=F.col("new_name"),
    )
    return effective, changes


def apply_table_renames(source: DataFrame, effective: DataFrame) -> DataFrame:
    """Source rows under the new table names, ready to be compared."""
    names = effective.select(
        "pair_id", "namespace", F.col("old_name").alias("table_name"), F.col("new_name").alias("_new")
    )
    some, others = split_marked(source, (TABLE, marks(names, TABLE)))
    renamed = some.join(names, TABLE, "left").withColumn("table_name", F.coalesce("_new", "table_name"))
    return others.unionByName(renamed.select(*source.columns))


def rename_columns(
    source: DataFrame, target: DataFrame, renames: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(effective renames, rename_column deltas)`` for columns.

    ``renames`` has ``pair_id, namespace, table_name, old_name, new_name``.
    """

    def named(rows: DataFrame, name: str) -> DataFrame:
        """Columns that a rename names, and few others."""
        columns = rows.select(*TABLE, F.col("name").alias(name))
        return where_marked(columns, [*TABLE, name], marks(renames, [*TABLE, name]))

    effective = (
        renames.where(F.col("old_name") != F.col("new_name"))
        .join(named(source, "old_name"), [*TABLE, "old_name"], "left_semi")
        .join(named(target, "new_name"), [*TABLE, "new_name"], "left_semi")
        .join(named(source, "new_name"), [*TABLE, "new_name"], "left_anti")
        .dropDuplicates([*TABLE, "old_name"])
    )
    changes = change_rows(
        effective.withColumn("kind", F.lit("rename_column")),
        object_kind=F.lit("column"),
        namespace=F.col("namespace"),
        parent_name=F.col("table_name"),
        name=F.col("old_name"),
        old_name=F.col("old_name"),
        new_name=F.col("new_name"),
    )
    return effective, changes


def apply_column_renames(source: DataFrame, effective: DataFrame) -> DataFrame:
    """Source columns under their new names, ready to be compared."""
    key = [*TABLE, "name"]
    names = effective.select(*TABLE, F.col("old_name").alias("name"), F.col("new_name").alias("_new"))
    some, others = split_marked(source, (key, marks(names, key)))
    renamed = some.join(names, key, "left").withColumn("name", F.coalesce("_new", "name"))
    return others.unionByName(renamed.select(*source.columns))


def _renamed(name: Column, names: Column) -> Column:
    """``name`` looked up in a map of new names, itself where there is none."""
    return F.coalesce(F.get(F.map_values(F.map_filter(names, lambda old, _: old == name)), F.lit(0)), name)


def _maps(renames: DataFrame, group: list[str], name: str) -> DataFrame:
    """New names by old ones.  A group is a table's columns, at most 1600 by the server's own limit."""
    entries = F.map_from_entries(F.collect_list(F.struct("old_name", "new_name")))
    return renames.groupBy(*group).agg(entries.alias(name))


def _with(struct: str, **fields: Column) -> Column:
    out = F.col(struct)
    for field, value in fields.items():
        out = out.withField(field, value)
    return out


def rename_catalog(
    source: Catalog, tables: DataFrame | None = None, columns: DataFrame | None = None
) -> Catalog:
    """The source under its new names, wherever they are used.

    ``tables`` and ``columns`` are effective renames; column renames name their
    table as the source does.  Table names stand in columns, indexes, constraints,
    foreign key targets and parents of partitions; column names in keys and
    included columns of indexes, in constraints and in foreign key targets.
    Expressions are texts and stay as they are.  Rows that no rename is about are
    not joined; the source is read twice for that.
    """
    found = source
    of_target = ["pair_id", "ref_namespace", "ref_table"]
    if columns is not None:
        names = _maps(columns, TABLE, "_names")
        none = F.create_map().cast("map<string,string>")

        def looked_up(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
            on = names.select(*[F.col(a).alias(b) for a, b in zip(TABLE, keys, strict=True)], F.col("_names").alias(column))
            return rows.join(on, keys, "left").withColumn(column, F.coalesce(column, none))

        def each(array: str, names: str) -> Column:
            return F.transform(array, lambda c: _renamed(c, F.col(names)))

        def keys_of(array: str) -> Column:
            return F.transform(array, lambda k: k.withField("column_name", _renamed(k["column_name"], F.col("_own"))))

        marked = marks(names, TABLE)
        own_indexes, other_indexes = split_marked(found.indexes, (TABLE, marked))
        own_constraints, other_constraints = split_marked(found.constraints, (TABLE, marked), (of_target, marked))
        indexes = looked_up(own_indexes, TABLE, "_own")
        constraints = looked_up(looked_up(own_constraints, TABLE, "_own"), of_target, "_ref")
        found = replace(
            found,
            columns=apply_column_renames(found.columns, columns),
            indexes=other_indexes.unionByName(indexes.withColumns(
                {"key_columns": keys_of("key_columns"), "include_columns": each("include_columns", "_own")}
            ).select(*found.indexes.columns)),
            constraints=other_constraints.unionByName(constraints.withColumns(
                {
                    "columns": each("columns", "_own"),
                    "ref_columns": each("ref_columns", "_ref"),
                    "elements": F.transform(
                        "elements", lambda e: e.withField("column_or_expr", _renamed(e["column_or_expr"], F.col("_own")))
                    ),
                }
            ).select(*found.constraints.columns)),
        )
    if tables is not None:
        names = tables.select("pair_id", "namespace", "old_name", F.col("new_name").alias("_new"))
        marked = marks(names, ["pair_id", "namespace", "old_name"])

        def target_of(rows: DataFrame, namespace: Column, name: Column, output: str) -> DataFrame:
            """``output``: the new name of the table that the two columns name."""
            keyed = rows.withColumns({"_ns": namespace, "_name": name})
            on = names.select("pair_id", F.col("namespace").alias("_ns"), F.col("old_name").alias("_name"), F.col("_new").alias("_to"))
            return keyed.join(on, ["pair_id", "_ns", "_name"], "left").withColumn(output, F.coalesce("_to", name)).drop("_ns", "_name", "_to")

        def own_name(rows: DataFrame) -> DataFrame:
            return target_of(rows, F.col("namespace"), F.col("table_name"), "table_name")

        parent_ns, parent_name = F.col("partition_of.parent_namespace"), F.col("partition_of.parent_name")
        keyed = found.tables.withColumns({"_parent_ns": parent_ns, "_parent_name": parent_name})
        own_tables, other_tables = split_marked(keyed, (TABLE, marked), (["pair_id", "_parent_ns", "_parent_name"], marked))
        partitions = target_of(own_name(own_tables), parent_ns, parent_name, "_parent")
        parent = F.when(F.col("partition_of").isNotNull(), _with("partition_of", parent_name=F.col("_parent")))
        own_constraints, other_constraints = split_marked(found.constraints, (TABLE, marked), (of_target, marked))
        referring = target_of(own_name(own_constraints), F.col("ref_namespace"), F.col("ref_table"), "ref_table")
        found = replace(
            found,
            tables=other_tables.select(*found.tables.columns).unionByName(
                partitions.withColumn("partition_of", parent).select(*found.tables.columns)
            ),
            columns=apply_table_renames(found.columns, tables),
            indexes=apply_table_renames(found.indexes, tables),
            constraints=other_constraints.unionByName(referring.select(*found.constraints.columns)),
        )
    return found
