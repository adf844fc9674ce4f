"""Comparing source and target catalogs of many pairs at once.

Inputs are flat model tables keyed by ``pair_id``; the source is the state
before, the target the state after.  All change rows share one layout
(``DELTA_FIELDS``), so the kinds combine with a plain union.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetdrift.functions.datatypes import normalize_type
from fleetdrift.functions.text import map_values
from fleetdrift.marks import marks, where_marked
from fleetdrift.model import COLUMN, CONSTRAINT, INDEX, PARTITION_INFO, PARTITION_OF
from fleetdrift.session import cut_lineage, stored
from fleetdrift.sources.pairs import matches_any

TABLE = ["pair_id", "namespace", "table_name"]

# Layout of a change row.  A type change always names the new type and collation
# (null: the type's own) and, in ``old_column``, the old ones; ``new_default`` null
# means "drop the default".  ``changed`` lists the table attributes that differ,
# whose old_ and new_ fields hold both values, null where there is none.
DELTA_FIELDS: dict[str, T.DataType] = {
    "op": T.StringType(),
    "kind": T.StringType(),
    "object_kind": T.StringType(),
    "namespace": T.StringType(),
    "parent_name": T.StringType(),
    "name": T.StringType(),
    "column": COLUMN,
    "old_column": COLUMN,
    "table_columns": T.ArrayType(COLUMN),
    "table_constraints": T.ArrayType(CONSTRAINT),
    "new_data_type": T.StringType(),
    "using_expression": T.StringType(),
    "new_collation": T.StringType(),
    "new_default": T.StringType(),
    "nullable": T.BooleanType(),
    "old_name": T.StringType(),
    "new_name": T.StringType(),
    "changed": T.ArrayType(T.StringType()),
    "old_owner": T.StringType(),
    "new_owner": T.StringType(),
    "old_tablespace": T.StringType(),
    "new_tablespace": T.StringType(),
    "old_comment": T.StringType(),
    "new_comment": T.StringType(),
    "old_partition_info": PARTITION_INFO,
    "new_partition_info": PARTITION_INFO,
    "old_partition_of": PARTITION_OF,
    "new_partition_of": PARTITION_OF,
    "index": INDEX,
    "old_index": INDEX,
    "constraint": CONSTRAINT,
    "new_version": T.StringType(),
    "old_version": T.StringType(),
    "is_conflict": T.BooleanType(),
}
DELTA = T.StructType([T.StructField(n, t) for n, t in DELTA_FIELDS.items()])


@dataclass(frozen=True)
class CompareOptions:
    """Switches of a comparison; the defaults compare everything."""

    include_schemas: list[str] | None = None
    exclude_tables: list[str] = field(default_factory=list)
    compare_owner: bool = True
    compare_comments: bool = True
    compare_extension_versions: bool = True
    compare_generated: bool = True
    case_sensitive: bool = True


DEFAULTS = CompareOptions()


# The operation each kind of change stands for.
KIND_OPS = {
    "create_table": "create",
    "drop_table": "drop",
    "rename_table": "rename",
    "alter_table_attrs": "alter",
    "add_column": "create",
    "drop_column": "drop",
    "replace_column": "replace",
    "alter_column_type": "alter",
    "set_column_default": "alter",
    "set_column_nullability": "alter",
    "rename_column": "rename",
    "create_index": "create",
    "drop_index": "drop",
    "replace_index": "replace",
    "add_constraint": "create",
    "drop_constraint": "drop",
    "create_schema": "create",
    "drop_schema": "drop",
    "create_extension": "create",
    "drop_extension": "drop",
    "alter_extension": "alter",
}


def change_rows(rows: DataFrame, **fields: Column) -> DataFrame:
    """Rows with a ``kind`` as change rows: the given fields, nulls elsewhere."""
    kinds = F.col("kind")
    values = {"op": map_values(kinds, KIND_OPS), "kind": kinds, **fields}
    return rows.select(
        "pair_id",
        *[
            (values[n] if n in values else F.lit(None).cast(t)).alias(n)
            for n, t in DELTA_FIELDS.items()
        ],
    )


def with_kinds(matched: DataFrame, kinds: dict[str, Column]) -> DataFrame:
    """One row per kind of change whose condition holds; others are dropped.

    Unchanged objects, most of all, leave before anything is built for them.
    """
    holds = {kind: F.coalesce(c, F.lit(False)) for kind, c in kinds.items()}
    found = F.array_compact(F.array(*[F.when(c, F.lit(kind)) for kind, c in holds.items()]))
    return matched.where(reduce(lambda a, b: a | b, holds.values())).select(
        "*", F.explode(found).alias("kind")
    )


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def _either(field: str) -> Column:
    """A field of the source object, or of the target where there is no source."""
    return F.coalesce(F.col("src")[field], F.col("tgt")[field])


def _missing_sides() -> tuple[Column, Column, Column]:
    created, dropped = F.col("src").isNull(), F.col("tgt").isNull()
    return created, dropped, ~created & ~dropped


def _differ(*attributes: str) -> Column:
    return reduce(
        lambda a, b: a | b,
        [~F.col(f"src.{a}").eqNullSafe(F.col(f"tgt.{a}")) for a in attributes],
    )


def in_scope(rows: DataFrame, options: CompareOptions, table_column: str | None = None) -> DataFrame:
    """Apply schema list and table globs of the options."""

    def fold(name: Column) -> Column:
        return name if options.case_sensitive else F.lower(name)

    def folded(names: list[str]) -> list[str]:
        return names if options.case_sensitive else [n.lower() for n in names]

    if options.include_schemas is not None:
        rows = rows.where(fold(F.col("namespace")).isin(folded(options.include_schemas)))
    if options.exclude_tables and table_column:
        rows = rows.where(~matches_any(fold(F.col(table_column)), folded(options.exclude_tables)))
    return rows


def _folded(rows: DataFrame, key: list[str], options: CompareOptions) -> DataFrame:
    """The key columns as comparison sees them."""
    names = [c if options.case_sensitive or c == "pair_id" else F.lower(c).alias(c) for c in key]
    return rows.select(*names)


def _in_tables(matched: DataFrame, tables: DataFrame, options: CompareOptions) -> DataFrame:
    return matched.join(_folded(tables, TABLE, options), TABLE, "left_semi")


def colliding_names(rows: DataFrame, key: list[str]) -> DataFrame:
    """Objects of one side that comparison without regard to case, or repetition, makes one.

    One row per folded key with the number of rows and of different spellings;
    comparison itself goes on with the smallest of them.
    """
    folded = [c if c == "pair_id" else F.lower(c).alias(c) for c in key]
    spelled = F.concat_ws(".", *[F.col(c) for c in key if c != "pair_id"])
    return (
        rows.select(*folded, spelled.alias("spelled"))
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("spelled").alias("n_spellings"),
            F.min("spelled").alias("kept"),
        )
        .where(F.col("n_rows") > 1)
    )


def match_snapshots(
    source: DataFrame,
    target: DataFrame,
    key: list[str],
    options: CompareOptions = DEFAULTS,
) -> DataFrame:
    """Pair every object of both sides by identity: key, ``src`` and ``tgt`` structs.

    A missing side is null; a struct holds all columns but ``pair_id``, names as
    that side spells them.  This is one aggregation of both inputs instead of a
    full outer join: repeated rows of one object collapse to the smallest before
    they are shuffled, instead of meeting in one task and multiplying there.
    """
    folded = [
        c if options.case_sensitive or c == "pair_id" else F.lower(c).alias(c) for c in key
    ]
    item = F.struct(*[c for c in source.columns if c != "pair_id"])
    left = source.select(*folded, item.alias("src"))
    right = target.select(*folded, item.alias("tgt"))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(*key).agg(F.min("src").alias("src"), F.min("tgt").alias("tgt"))


def _digest(rows: DataFrame, ignored: tuple[str, ...], key: list[str]) -> list[Column]:
    """128 bits of all attributes of an object, nulls told apart, as two longs."""
    parts: list[Column] = []
    for f in rows.schema.fields:
        if f.name in ignored or f.name in key:
            continue
        own = F.col(f.name)
        json = F.to_json(own, {"ignoreNullFields": "false"})
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.AtomicType):
            # The hash takes element by element and passes nulls over.
            parts += [own, F.size(own), F.when(F.exists(own, lambda x: x.isNull()), json)]
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            parts.append(json)
        else:
            parts.append(own)
        parts.append(own.isNull())
    return [F.xxhash64(F.lit(seed), *parts).alias(f"d{seed}") for seed in (1, 2)]


def match_changed(
    source: DataFrame,
    target: DataFrame,
    key: list[str],
    options: CompareOptions = DEFAULTS,
    ignored: tuple[str, ...] = (),
) -> DataFrame:
    """``match_snapshots`` of the objects that differ, and of few others.

    Keys and digests of all objects meet first.  What differs marks its key, the
    marks are sent to all tasks (see ``marks``), and only marked objects are read
    with their attributes and shuffled.
    ``ignored`` attributes make no difference.
    """

    def folded(rows: DataFrame) -> list[Column]:
        return [(F.col(c) if options.case_sensitive or c == "pair_id" else F.lower(c)).alias(c) for c in key]

    def slim(rows: DataFrame, side: str) -> DataFrame:
        digests = _digest(rows, ignored, [] if not options.case_sensitive else key)
        return rows.select(*folded(rows), *digests).select(*key, *[F.col(d).alias(f"{side}_{d}") for d in ("d1", "d2")])

    both = slim(source, "s").unionByName(slim(target, "t"), allowMissingColumns=True)
    columns = [f"{side}_{d}" for d in ("d1", "d2") for side in "st"]
    found = both.groupBy(*key).agg(
        *[x for c in columns for x in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))]
    )
    same = reduce(
        lambda a, b: a & b,
        [
            F.col(f"s_{d}_low").eqNullSafe(F.col(f"t_{d}_low")) & F.col(f"s_{d}_high").eqNullSafe(F.col(f"t_{d}_high"))
            & (F.col(f"s_{d}_low") == F.col(f"s_{d}_high"))
            for d in ("d1", "d2")
        ],
    )
    marked = marks(found.where(~F.coalesce(same, F.lit(False))), key)
    sides = [where_marked(x, key, marked, folded=not options.case_sensitive) for x in (source, target)]
    return match_snapshots(*sides, key, options)


def normalize_columns(columns: DataFrame) -> DataFrame:
    """Canonical type names, so that two spellings of one type are no change."""
    return columns.withColumn("data_type", normalize_type(F.col("data_type")))


def compare_columns(
    source: DataFrame,
    target: DataFrame,
    options: CompareOptions = DEFAULTS,
    tables: DataFrame | None = None,
    *,
    derive_tables: bool = False,
) -> DataFrame:
    """Column changes in tables present on both sides.

    Columns have ``pair_id, namespace, table_name, name`` and the model's column
    attributes.  ``tables`` lists tables on both sides (``common_tables``);
    without it a table counts as present where it has a column, and
    ``derive_tables`` adds the created and dropped tables that follow from that,
    with their columns.

    A changed identity or generated expression replaces the column, which covers
    its other differences too.  A changed position alone is no change.
    """

    def packed(rows: DataFrame) -> DataFrame:
        column = F.struct(*COLUMN.fieldNames()).cast(COLUMN)
        return in_scope(rows, options, "table_name").select(*TABLE, "name", column.alias("column"))

    if tables is None:
        matched = match_snapshots(packed(source), packed(target), [*TABLE, "name"], options)
    else:
        plain = [in_scope(x, options, "table_name").select(*TABLE, *COLUMN.fieldNames()) for x in (source, target)]
        matched = match_changed(*plain, [*TABLE, "name"], options, ("position",))
        matched = matched.select(*TABLE, "name", *[_packed(side, COLUMN, "column") for side in ("src", "tgt")])
    created, dropped, both = _missing_sides()
    replacing = ["column.identity"]
    if options.compare_generated:
        replacing.append("column.generated_expression")
    replaced = _differ(*replacing)
    retyped = _differ("column.data_type", "column.collation")
    redefaulted = _differ("column.default_expr")
    renullabled = _differ("column.nullable")
    # Unchanged columns only tell that their table exists: they go on without
    # their attributes, so whatever follows moves little more than the changes.
    touched = ~both | replaced | retyped | redefaulted | renullabled
    matched = matched.select(
        *TABLE,
        "name",
        (~created).alias("has_source"),
        (~dropped).alias("has_target"),
        F.when(touched, F.col("src")).alias("src"),
        F.when(touched, F.col("tgt")).alias("tgt"),
    )
    created, dropped = ~F.col("has_source"), ~F.col("has_target")
    kinds: dict[str, Column] = {}
    if tables is None:
        # A table has at most 1600 columns per side, so no window is large.
        table = Window.partitionBy(*TABLE)
        matched = matched.select(
            "*",
            F.max("has_source").over(table).alias("in_source"),
            F.max("has_target").over(table).alias("in_target"),
            F.min("name").over(table).alias("first_name"),
        )
        in_both = F.col("in_source") & F.col("in_target")
        if derive_tables:
            own = F.coalesce(F.col("src.column"), F.col("tgt.column"))
            whole = F.sort_array(F.collect_list(F.when(~in_both, own)).over(table))
            matched = matched.withColumn("table_columns", whole)
        first = F.col("name") == F.col("first_name")
        if derive_tables:
            kinds = {
                "create_table": first & ~F.col("in_source"),
                "drop_table": first & ~F.col("in_target"),
            }
        created, dropped = in_both & created, in_both & dropped
    else:
        matched = _in_tables(matched, tables, options)

    kept = both & ~replaced
    changed = with_kinds(
        matched,
        {
            **kinds,
            "add_column": created,
            "drop_column": dropped,
            "replace_column": both & replaced,
            "alter_column_type": kept & retyped,
            "set_column_default": kept & redefaulted,
            "set_column_nullability": kept & renullabled,
        },
    )
    of_table = _is("create_table", "drop_table")
    table_name = _either("table_name")
    old, new = F.col("src.column"), F.col("tgt.column")
    altered = ["alter_column_type", "set_column_default", "set_column_nullability"]
    is_retyped = _is("alter_column_type")
    return change_rows(
        changed,
        object_kind=F.when(of_table, F.lit("table")).otherwise(F.lit("column")),
        namespace=_either("namespace"),
        parent_name=F.when(~of_table, table_name),
        name=F.when(of_table, table_name).otherwise(_either("name")),
        **({"table_columns": F.when(of_table, F.col("table_columns"))} if derive_tables and tables is None else {}),
        column=F.when(_is("add_column", "replace_column"), new).when(_is("drop_column"), old),
        old_column=F.when(_is("replace_column", *altered), old),
        new_data_type=F.when(is_retyped, F.col("tgt.column.data_type")),
        new_collation=F.when(is_retyped, F.col("tgt.column.collation")),
        new_default=F.when(_is("set_column_default"), F.col("tgt.column.default_expr")),
        nullable=F.when(_is("set_column_nullability"), F.col("tgt.column.nullable")),
    )


def _packed(side: str, schema: T.StructType, name: str) -> Column:
    """A side of a match with its attributes in one struct, beside its names."""
    own = F.struct(*[F.col(f"{side}.{n}").alias(n) for n in schema.fieldNames()]).cast(schema)
    names = [F.col(f"{side}.{n}").alias(n) for n in ("namespace", "table_name", "name")]
    return F.when(F.col(side).isNotNull(), F.struct(*names, own.alias(name))).alias(side)


def common_tables(
    source: DataFrame, target: DataFrame, options: CompareOptions = DEFAULTS
) -> DataFrame:
    left, right = (_folded(side, TABLE, options) for side in (source, target))
    return left.distinct().join(right, TABLE, "left_semi")


def compare_tables(
    source: DataFrame, target: DataFrame, options: CompareOptions = DEFAULTS
) -> DataFrame:
    """Created, dropped and altered tables.

    ``changed`` tells which attributes differ, so a cleared one is no unchanged one.
    """
    matched = match_changed(
        in_scope(source, options, "table_name"), in_scope(target, options, "table_name"), TABLE, options
    )
    created, dropped, both = _missing_sides()
    attributes = ["tablespace", "partition_info", "partition_of"]
    if options.compare_owner:
        attributes.append("owner")
    if options.compare_comments:
        attributes.append("comment")
    differing = F.array_compact(F.array(*[F.when(both & _differ(a), F.lit(a)) for a in attributes]))
    rows = with_kinds(
        matched.withColumn("changed", differing),
        {"create_table": created, "drop_table": dropped, "alter_table_attrs": F.size("changed") > 0},
    )
    altered = _is("alter_table_attrs")
    sides = {}
    for a in attributes:
        # A created table has all its new values, a dropped one all its old ones.
        holds = ~altered | F.array_contains("changed", a)
        sides[f"old_{a}"] = F.when(holds, F.col(f"src.{a}"))
        sides[f"new_{a}"] = F.when(holds, F.col(f"tgt.{a}"))
    return change_rows(
        rows,
        object_kind=F.lit("table"),
        namespace=_either("namespace"),
        name=_either("table_name"),
        changed=F.when(altered, F.col("changed")),
        **sides,
    )


def attach_payload(
    deltas: DataFrame,
    columns: tuple[DataFrame, DataFrame],
    constraints: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Fill ``table_columns`` and ``table_constraints`` of created and dropped tables.

    Each pair is (source, target).  Without constraints tables have none.
    """
    key = ["pair_id", "namespace", "name", "kind"]
    # Most tables are on both sides: lists are made for created and dropped ones only.
    whole = cut_lineage(deltas.where(_is("drop_table", "create_table")).select(*key).distinct())

    def listed(sides: tuple[DataFrame, DataFrame], item: Column, name: str) -> DataFrame:
        parts = []
        for kind, rows in zip(("drop_table", "create_table"), sides, strict=True):
            tables = whole.where(F.col("kind") == kind).select("pair_id", "namespace", F.col("name").alias("table_name"))
            own = where_marked(rows, TABLE, marks(tables, TABLE)).join(tables, TABLE, "left_semi")
            parts.append(
                # A table has at most 1600 columns by the server's own limit, and few constraints.
                own.groupBy(*TABLE)
                .agg(F.sort_array(F.collect_list(item)).alias(name))
                .select("pair_id", "namespace", F.col("table_name").alias("name"), F.lit(kind).alias("kind"), name)
            )
        return parts[0].unionByName(parts[1])

    column = F.struct(*COLUMN.fieldNames()).cast(COLUMN)
    deltas = deltas.join(listed(columns, column, "_columns"), key, "left")
    deltas = deltas.withColumn("table_columns", F.coalesce("table_columns", "_columns"))
    if constraints is not None:
        constraint = F.struct(*CONSTRAINT.fieldNames()).cast(CONSTRAINT)
        deltas = deltas.join(listed(constraints, constraint, "_constraints"), key, "left")
        deltas = deltas.withColumn("table_constraints", F.coalesce("table_constraints", "_constraints"))
    return deltas.select("pair_id", *DELTA_FIELDS)


def compare_indexes(
    source: DataFrame, target: DataFrame, options: CompareOptions = DEFAULTS
) -> DataFrame:
    """Created, dropped and replaced indexes.

    An index has no ALTER for its method, keys, predicate or included columns:
    any difference replaces it.  The same name with another definition is also
    reported as a conflict.
    """

    plain = [in_scope(x, options, "table_name").select("pair_id", "namespace", *INDEX.fieldNames()) for x in (source, target)]
    matched = match_changed(*plain, ["pair_id", "namespace", "name"], options, ("comment",))
    matched = matched.select("pair_id", "namespace", "name", *[_packed(side, INDEX, "index") for side in ("src", "tgt")])
    created, dropped, both = _missing_sides()
    compared = ["table_name", "method", "key_columns", "include_columns", "unique", "predicate"]
    replaced = both & _differ(*[f"index.{c}" for c in compared])
    rows = with_kinds(
        matched, {"create_index": created, "drop_index": dropped, "replace_index": replaced}
    )
    return change_rows(
        rows,
        object_kind=F.lit("index"),
        namespace=_either("namespace"),
        name=_either("name"),
        index=F.col("tgt.index"),
        old_index=F.col("src.index"),
        is_conflict=_is("replace_index"),
    )


def compare_constraints(
    source: DataFrame,
    target: DataFrame,
    options: CompareOptions = DEFAULTS,
    tables: DataFrame | None = None,
) -> DataFrame:
    """Added and dropped constraints; a changed definition is a drop and an add.

    With ``tables`` (``common_tables``) constraints of created or dropped tables
    yield no changes of their own: they stand in the table's (``attach_payload``).
    """

    plain = [in_scope(x, options, "table_name").select(*TABLE, *CONSTRAINT.fieldNames()) for x in (source, target)]
    matched = match_changed(*plain, [*TABLE, "name"], options)
    matched = matched.select(*TABLE, "name", *[_packed(side, CONSTRAINT, "constraint") for side in ("src", "tgt")])
    if tables is not None:
        matched = _in_tables(matched, tables, options)
    created, dropped, both = _missing_sides()
    attributes = [n for n in CONSTRAINT.fieldNames() if n != "name"]
    changed = both & _differ(*[f"constraint.{a}" for a in attributes])
    rows = with_kinds(
        matched, {"drop_constraint": dropped | changed, "add_constraint": created | changed}
    )
    return change_rows(
        rows,
        object_kind=F.lit("constraint"),
        namespace=_either("namespace"),
        parent_name=_either("table_name"),
        name=_either("name"),
        constraint=F.when(_is("drop_constraint"), F.col("src.constraint")).otherwise(
            F.col("tgt.constraint")
        ),
    )


def compare_schemas(
    source: DataFrame, target: DataFrame, options: CompareOptions = DEFAULTS
) -> DataFrame:
    """Created and dropped schemas (``pair_id, namespace``)."""
    matched = match_snapshots(
        in_scope(source, options), in_scope(target, options), ["pair_id", "namespace"], options
    )
    created, dropped, _ = _missing_sides()
    rows = with_kinds(matched, {"create_schema": created, "drop_schema": dropped})
    return change_rows(
        rows, object_kind=F.lit("schema"), namespace=_either("namespace"), name=_either("namespace")
    )


def compare_extensions(
    source: DataFrame, target: DataFrame, options: CompareOptions = DEFAULTS
) -> DataFrame:
    """Created, dropped and updated extensions (``pair_id, name, version``)."""
    matched = match_snapshots(source, target, ["pair_id", "name"], options)
    created, dropped, both = _missing_sides()
    kinds = {"create_extension": created, "drop_extension": dropped}
    if options.compare_extension_versions:
        kinds["alter_extension"] = both & _differ("version")
    return change_rows(
        with_kinds(matched, kinds),
        object_kind=F.lit("extension"),
        namespace=F.lit("public"),
        name=_either("name"),
        new_version=F.col("tgt.version"),
        old_version=F.col("src.version"),
    )


@dataclass(frozen=True)
class Catalog:
    """One side of many pairs: a table per kind of object, as the ``compare_`` functions take them."""

    schemas: DataFrame
    extensions: DataFrame
    tables: DataFrame
    columns: DataFrame
    indexes: DataFrame
    constraints: DataFrame


def stored_catalog(catalog: Catalog) -> Catalog:
    """The catalog with its tables stored: a comparison reads each of them several times."""
    return Catalog(**{f.name: stored(getattr(catalog, f.name)) for f in fields(Catalog)})


def compare_catalogs(source: Catalog, target: Catalog, options: CompareOptions = DEFAULTS) -> DataFrame:
    """Changes of all six kinds of objects; created and dropped tables carry columns, constraints and attributes."""
    # Both are read several times: computed once.
    common = stored(common_tables(source.tables, target.tables, options))
    tables = attach_payload(
        stored(compare_tables(source.tables, target.tables, options)),
        (source.columns, target.columns),
        (source.constraints, target.constraints),
    )
    parts = [
        compare_schemas(source.schemas, target.schemas, options),
        compare_extensions(source.extensions, target.extensions, options),
        tables,
        compare_columns(source.columns, target.columns, options, common),
        compare_indexes(source.indexes, target.indexes, options),
        compare_constraints(source.constraints, target.constraints, options, common),
    ]
    return reduce(DataFrame.unionByName, parts)
