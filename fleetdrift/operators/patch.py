"""Applying changes to catalogs: the inverse of comparing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.model import COLUMN, CONSTRAINT, INDEX
from fleetdrift.operators.compare import TABLE, Catalog, stored_catalog
from fleetdrift.operators.rename import HELD, rename_catalog
from fleetdrift.session import cut_lineage, stored

_ATTRIBUTES = ["owner", "tablespace", "comment", "partition_info", "partition_of"]


def _of(deltas: DataFrame, *kinds: str) -> DataFrame:
    return deltas.where(F.col("kind").isin(*kinds))


def _without(rows: DataFrame, key: list[str], gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def _fields(struct: str, schema, leave: tuple[str, ...] = ()) -> list[Column]:
    return [F.col(f"{struct}.{n}").alias(n) for n in schema.fieldNames() if n not in leave]


def effective_renames(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table and column renames among changes; names that are held on the way are left out again."""
    key = ["pair_id", "namespace"]
    steps = _of(deltas, "rename_table").select(*key, "old_name", "new_name")
    starts = steps.where(~F.col("old_name").endswith(HELD))
    ends = steps.where(F.col("old_name").endswith(HELD)).select(
        *key, F.col("old_name").alias("new_name"), F.col("new_name").alias("_last")
    )
    tables = starts.join(ends, [*key, "new_name"], "left").select(*key, "old_name", F.coalesce("_last", "new_name").alias("new_name"))
    columns = _of(deltas, "rename_column").select(*key, F.col("parent_name").alias("table_name"), "old_name", "new_name")
    return tables, columns


def _tables(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    named = [*TABLE[:2], F.col("name").alias("table_name")]
    changed = _of(deltas, "alter_table_attrs").select(
        *named, F.col("changed").alias("_changed"), *[F.col(f"new_{a}").alias(f"_{a}") for a in _ATTRIBUTES]
    )
    kept = _without(rows, TABLE, _of(deltas, "drop_table").select(*named)).join(changed, TABLE, "left")
    altered = {
        a: F.when(F.coalesce(F.array_contains("_changed", a), F.lit(False)), F.col(f"_{a}")).otherwise(F.col(a)) for a in _ATTRIBUTES
    }
    created = _of(deltas, "create_table").select(*named, *[F.col(f"new_{a}").alias(a) for a in _ATTRIBUTES])
    return kept.withColumns(altered).select(*TABLE, *_ATTRIBUTES).unionByName(created)


def _columns(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    key = [*TABLE, "name"]
    of_column = [*TABLE[:2], F.col("parent_name").alias("table_name"), "name"]
    of_table = [*TABLE[:2], F.col("name").alias("table_name")]
    kept = _without(rows.select(*TABLE, *COLUMN.fieldNames()), TABLE, _of(deltas, "drop_table").select(*of_table))
    kept = _without(kept, key, _of(deltas, "drop_column", "replace_column").select(*of_column))
    kind = F.col("kind")

    def last(of: str, value: Column) -> Column:
        return F.max(F.when(kind == of, F.struct(value.alias("to"))))

    # All alterations of one column meet in one row; each kind occurs once.
    folded = _of(deltas, "alter_column_type", "set_column_default", "set_column_nullability").groupBy(
        "pair_id", "namespace", F.col("parent_name").alias("table_name"), "name"
    ).agg(
        last("alter_column_type", F.struct("new_data_type", "new_collation")).alias("_type"),
        last("set_column_default", F.col("new_default")).alias("_default"),
        last("set_column_nullability", F.col("nullable")).alias("_nullable"),
    )
    altered = {
        "data_type": F.when(F.col("_type").isNotNull(), F.col("_type.to.new_data_type")).otherwise(F.col("data_type")),
        "collation": F.when(F.col("_type").isNotNull(), F.col("_type.to.new_collation")).otherwise(F.col("collation")),
        "default_expr": F.when(F.col("_default").isNotNull(), F.col("_default.to")).otherwise(F.col("default_expr")),
        "nullable": F.when(F.col("_nullable").isNotNull(), F.col("_nullable.to")).otherwise(F.col("nullable")),
    }
    kept = kept.join(folded, key, "left").withColumns(altered).select(*TABLE, *COLUMN.fieldNames())
    added = _of(deltas, "add_column", "replace_column").select(*of_column[:-1], *_fields("column", COLUMN))
    whole = _of(deltas, "create_table").select(*of_table, F.explode("table_columns").alias("_column"))
    return kept.unionByName(added).unionByName(whole.select(*TABLE, *_fields("_column", COLUMN)))


def _indexes(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    key = ["pair_id", "namespace", "name"]
    kept = _without(rows, key, _of(deltas, "drop_index", "replace_index")).select("pair_id", "namespace", *INDEX.fieldNames())
    new = _of(deltas, "create_index", "replace_index").select("pair_id", "namespace", *_fields("index", INDEX))
    return kept.unionByName(new)


def _constraints(rows: DataFrame, deltas: DataFrame) -> DataFrame:
    of_constraint = [*TABLE[:2], F.col("parent_name").alias("table_name"), "name"]
    of_table = [*TABLE[:2], F.col("name").alias("table_name")]
    kept = _without(rows.select(*TABLE, *CONSTRAINT.fieldNames()), TABLE, _of(deltas, "drop_table").select(*of_table))
    kept = _without(kept, [*TABLE, "name"], _of(deltas, "drop_constraint").select(*of_constraint))
    added = _of(deltas, "add_constraint").select(*of_constraint[:-1], *_fields("constraint", CONSTRAINT))
    whole = _of(deltas, "create_table").select(*of_table, F.explode("table_constraints").alias("_constraint"))
    return kept.unionByName(added).unionByName(whole.select(*TABLE, *_fields("_constraint", CONSTRAINT)))


def apply_changes(source: Catalog, deltas: DataFrame) -> Catalog:
    """The source after the changes: ``compare_catalogs(apply_changes(a, changes from a to b), b)`` is empty.

    Renames come first, as in a script; the other changes name objects by their
    new names.
    """
    # Every kind of object reads the changes several times: they are computed once.
    deltas = stored(deltas)
    tables, columns = (cut_lineage(x) for x in effective_renames(deltas))
    # Column renames name their table as it is called after table renames.
    source = stored_catalog(rename_catalog(stored_catalog(rename_catalog(source, tables)), None, columns))
    schema_key, extension_key = ["pair_id", "namespace"], ["pair_id", "name"]
    schemas = _without(source.schemas, schema_key, _of(deltas, "drop_schema")).select(*schema_key)
    changed = _of(deltas, "drop_extension", "alter_extension")
    extensions = _without(source.extensions, extension_key, changed).select(*extension_key, "version")
    new = _of(deltas, "create_extension", "alter_extension").select(*extension_key, F.col("new_version").alias("version"))
    return Catalog(
        schemas=schemas.unionByName(_of(deltas, "create_schema").select(*schema_key)),
        extensions=extensions.unionByName(new),
        tables=_tables(source.tables, deltas),
        columns=_columns(source.columns, deltas),
        indexes=_indexes(source.indexes, deltas),
        constraints=_constraints(source.constraints, deltas),
    )
