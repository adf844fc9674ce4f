"""Nested snapshots: assembling, exporting, importing, looking up objects."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetdrift.functions.text import map_values
from fleetdrift.model import COLUMN, CONSTRAINT, EXTENSION, INDEX, SCHEMA, TABLE
from fleetdrift.session import unsent
from fleetdrift.skew import positions
from fleetdrift.sources.mapping import TABLE_KEY, missing_columns


@dataclass(frozen=True)
class Snapshot:
    """Flat model tables of many databases (see ``sources.mapping``)."""

    schemas: DataFrame
    tables: DataFrame
    columns: DataFrame
    constraints: DataFrame
    indexes: DataFrame
    extensions: DataFrame


def _ref(kind: str, namespace: str, name: str):
    return F.struct(
        F.lit(kind).alias("kind"),
        F.struct(F.col(namespace).alias("namespace"), F.col(name).alias("name")).alias("qname"),
    ).alias("ref")


def group_columns(columns: DataFrame) -> DataFrame:
    """Columns per table in order of position (gaps allowed)."""
    item = F.struct(*COLUMN.fieldNames())
    # A table has at most 1600 columns by the server's own limit.
    return columns.groupBy(*TABLE_KEY).agg(F.sort_array(F.collect_list(item)).alias("columns"))


def group_indexes(indexes: DataFrame) -> DataFrame:
    """Indexes per table in order of name.

    A list is as long as a table has indexes, all of which the server itself
    opens at once to plan a statement.
    """
    item = F.struct(*INDEX.fieldNames())
    return indexes.groupBy(*TABLE_KEY).agg(F.sort_array(F.collect_list(item)).alias("indexes"))


def group_constraints(constraints: DataFrame) -> DataFrame:
    """Constraints per table in order of name; a list is as long as a table has constraints."""
    item = F.struct(*CONSTRAINT.fieldNames())
    return constraints.groupBy(*TABLE_KEY).agg(F.sort_array(F.collect_list(item)).alias("constraints"))


def _empty(data_type) -> Column:
    return F.array().cast(data_type)


_FIELDS = {"table": TABLE, "indexes": T.ArrayType(INDEX), "schema": SCHEMA, "extension": EXTENSION}


def _document(rows: DataFrame, kind: str, namespace: str, name: str, **fields: Column) -> DataFrame:
    return rows.select(
        "db_id",
        F.lit(kind).alias("kind"),
        F.col(namespace).alias("schema_name"),
        F.col(name).alias("name"),
        *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in _FIELDS.items()],
    )


def assemble_snapshot(snapshot: Snapshot) -> DataFrame:
    """Nested documents of all databases: one per table, schema and extension.

    ``db_id, kind, schema_name, name`` and the nested object: a table with its
    columns, constraints and indexes, a schema, or an extension.  A database is
    the documents of its ``db_id``, however many there are.

    Indexes of tables that were not scanned vanish, so do tables of schemas that
    were not; schemas without tables stay; constraints naming a column their
    table lacks are left out.
    """
    none = F.lit(None).cast("string")
    scanned = snapshot.tables.join(unsent(snapshot.schemas), ["db_id", "schema_name"], "left_semi")
    # All lists are grouped on the table key they are joined on, so each is shuffled once.
    tables = (
        scanned.join(unsent(group_columns(snapshot.columns)), TABLE_KEY, "left")
        .join(unsent(group_constraints(snapshot.constraints)), TABLE_KEY, "left")
        .join(unsent(group_indexes(snapshot.indexes)), TABLE_KEY, "left")
    )
    names = F.transform("columns", lambda c: c["name"])
    valid = F.filter(
        "constraints",
        lambda c: c["kind"].isNotNull()
        & (F.size(missing_columns(c["kind"], c["columns"], names)) == 0),
    )
    table = F.struct(
        _ref("table", "schema_name", "table_name"),
        F.coalesce("columns", _empty(TABLE["columns"].dataType)).alias("columns"),
        F.coalesce(valid, _empty(TABLE["constraints"].dataType)).alias("constraints"),
        "owner",
        "tablespace",
        "partition_info",
        "partition_of",
        "comment",
    )
    indexes = F.coalesce("indexes", _empty(T.ArrayType(INDEX)))
    schema = F.struct(
        _ref("schema", "schema_name", "schema_name"), none.alias("owner"), none.alias("comment")
    )
    extension = F.struct(
        _ref("extension", "namespace", "name"),
        "version",
        none.alias("installed_schema"),
        none.alias("comment"),
    )
    return (
        _document(tables, "table", "schema_name", "table_name", table=table, indexes=indexes)
        .unionByName(_document(snapshot.schemas, "schema", "schema_name", "schema_name", schema=schema))
        .unionByName(_document(snapshot.extensions, "extension", "namespace", "name", extension=extension))
    )


def export_snapshot(documents: DataFrame, *, indented: bool = True) -> DataFrame:
    """One JSON text per document, with all empty fields written out."""
    options = {"pretty": str(indented).lower(), "ignoreNullFields": "false"}
    return documents.select(
        "db_id", "kind", "schema_name", "name", F.to_json(F.struct(*_FIELDS), options).alias("json")
    )


def import_snapshot(texts: DataFrame) -> DataFrame:
    """Nested documents from JSON texts; the reverse of ``export_snapshot``."""
    nested = F.from_json("json", T.StructType([T.StructField(k, t) for k, t in _FIELDS.items()]))
    return texts.select("db_id", "kind", "schema_name", "name", nested.alias("d")).select(
        "db_id", "kind", "schema_name", "name", "d.*"
    )


def _in_order(objects: DataFrame, documents: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``schema_order`` and ``name``: places from 0 of the schema in its database and of the object in the schema."""
    listed = documents.where("kind = 'schema'").select("db_id", "schema_name").distinct()
    schemas = positions(listed, ["db_id"], ["schema_name"], "_schema")
    placed = positions(objects, ["db_id", "schema_name"], order, "_place")
    return placed.join(unsent(schemas), ["db_id", "schema_name"], "left").select(
        *objects.columns,
        (F.col("_schema") - 1).cast("int").alias("schema_order"),
        (F.col("_place") - 1).cast("int").alias(name),
    )


def all_tables(documents: DataFrame) -> DataFrame:
    """Every table with its place: schema order, then table order within it."""
    tables = documents.where("kind = 'table'").select(
        "db_id", "schema_name", F.col("name").alias("table_name"), "table"
    )
    return _in_order(tables, documents, ["table_name"], "table_order")


def all_indexes(documents: DataFrame) -> DataFrame:
    """Every index with its place: schema order, then index order (table, name) within it."""
    indexes = documents.where("kind = 'table'").select(
        "db_id", "schema_name", F.explode("indexes").alias("index")
    )
    named = indexes.select("*", F.col("index.table_name").alias("_table"), F.col("index.name").alias("_name"))
    return _in_order(named, documents, ["_table", "_name"], "index_order").drop("_table", "_name")


def flatten_snapshot(documents: DataFrame) -> Snapshot:
    """Flat model tables of nested documents."""
    schemas = documents.where("kind = 'schema'").select("db_id", "schema_name")
    nested = documents.where("kind = 'table'").select(
        "db_id", "schema_name", F.col("name").alias("table_name"), "table", "indexes"
    )
    tables = nested.select(
        *TABLE_KEY, "table.owner", "table.tablespace", "table.partition_info", "table.partition_of",
        "table.comment",
    )
    columns = nested.select(*TABLE_KEY, F.explode("table.columns").alias("c")).select(
        *TABLE_KEY, "c.*"
    )
    constraints = nested.select(*TABLE_KEY, F.explode("table.constraints").alias("c")).select(
        *TABLE_KEY, "c.*"
    )
    indexes = nested.select("db_id", "schema_name", F.explode("indexes").alias("i")).select(
        "db_id", "schema_name", "i.*"
    )
    extensions = documents.where("kind = 'extension'").select(
        "db_id",
        F.col("schema_name").alias("namespace"),
        "name",
        F.col("extension.version").alias("version"),
    )
    return Snapshot(schemas, tables, columns, constraints, indexes, extensions)


def find_objects(objects: DataFrame, wanted: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Batch lookup: each wanted key with the first matching object or nulls.

    ``key`` may be any prefix of an object's identity: ``[db_id, schema_name]``,
    ``[db_id, schema_name, table_name]``, ``[db_id, name]`` ...  First means
    smallest in ``order``.
    """
    rest = [c for c in objects.columns if c not in key]
    first = objects.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_found")
    )
    return wanted.join(first, key, "left").select(
        *wanted.columns, F.col("_found").isNotNull().alias("found"), "_found.*"
    )


# The eight lookups and the kind of object each finds.  The kind that
# a reference names is not looked at.
LOOKUPS = {
    "schema_by_name": "schema", "extension_by_name": "extension", "table_by_qname": "table", "table_by_ref": "table",
    "table_by_name": "table", "index_by_qname": "index", "index_by_ref": "index", "column_by_name": "column",
}


def look_up(snapshot: Snapshot, requests: DataFrame) -> DataFrame:
    """All lookups of a batch in one join: the first match of each request, or nulls.

    ``requests``: db_id, lookup (see ``LOOKUPS``), namespace, parent (the table of
    a column), name.  Names that a lookup does not use are ignored.  Adds found
    and detail: a table's owner, an index's method, an extension's version, a
    column's type.  Tables and indexes are found in schemas that exist only;
    first means first in the order of the snapshot.
    """
    none = F.lit(None).cast("string")
    schema = snapshot.schemas.select("db_id", "schema_name").distinct()

    def objects(kind: str, rows: DataFrame, namespace: Column, parent: Column, name: Column, place: Column, detail: Column) -> DataFrame:
        return rows.select(
            "db_id", F.lit(kind).alias("kind"), namespace.alias("namespace"), parent.alias("parent"), name.alias("name"),
            place.cast("string").alias("place"), detail.alias("detail"),
        )

    own = F.col("schema_name")
    in_schema = [x.join(schema, ["db_id", "schema_name"], "left_semi") for x in (snapshot.tables, snapshot.indexes, snapshot.columns)]
    everything = [
        objects("schema", schema, none, none, own, F.lit(""), none),
        objects("extension", snapshot.extensions, none, none, F.col("name"), F.col("version"), F.col("version")),
        objects("table", in_schema[0], own, none, F.col("table_name"), F.lit(""), F.col("owner")),
        objects("index", in_schema[1], own, none, F.col("name"), F.col("table_name"), F.col("method")),
        objects("column", in_schema[2], own, F.col("table_name"), F.col("name"), F.lpad(F.col("position").cast("string"), 10, "0"), F.col("data_type")),
    ]
    key = ["db_id", "kind", "namespace", "parent", "name"]
    first = reduce(DataFrame.unionByName, everything).groupBy(*key).agg(F.min(F.struct("place", "detail")).alias("_first"))
    kind = map_values(F.col("lookup"), LOOKUPS)
    nested = F.col("_kind").isin("table", "index", "column")
    # Requests and objects meet on one key, whatever they look for.
    asked = requests.withColumn("_kind", kind).withColumns(
        {"_namespace": F.when(nested, F.col("namespace")), "_parent": F.when(F.col("_kind") == "column", F.col("parent"))}
    )
    same = (
        (F.col("r.db_id") == F.col("o.db_id")) & (F.col("r._kind") == F.col("o.kind")) & (F.col("r.name") == F.col("o.name"))
        & F.col("r._namespace").eqNullSafe(F.col("o.namespace")) & F.col("r._parent").eqNullSafe(F.col("o.parent"))
    )
    return asked.alias("r").join(first.alias("o"), same, "left").select(
        *[f"r.{c}" for c in requests.columns], F.col("o._first").isNotNull().alias("found"), F.col("o._first.detail").alias("detail")
    )
