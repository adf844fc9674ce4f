"""Leaving changes out by rules: whole objects, or attributes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetdrift.functions.names import glob_to_regex
from fleetdrift.functions.text import map_values
from fleetdrift.operators.compare import DELTA_FIELDS

#: Characters of a glob's literal beginning that rules are looked up by.
PREFIX_CHARS = 12
# The attribute that a kind of change is about; tables list theirs in ``changed``.
KIND_ATTRIBUTES = {
    "alter_column_type": "data_type",
    "set_column_default": "default",
    "set_column_nullability": "nullable",
    "alter_extension": "version",
}
_OBJECT = ["pair_id", "object_kind", "namespace", "parent_name", "name"]


def qualified(namespace: Column, parent: Column, name: Column) -> Column:
    """The name that globs are matched with: ``namespace.name`` or ``namespace.table.name``."""
    return F.concat_ws(".", namespace, parent, name)


def _found(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """``_OBJECT`` and ``attribute`` of every rule that holds for an object.

    Rules are looked up by the literal beginning of their glob: an object asks for
    each beginning of its own name that some rule of its length may have, so no
    object meets rules that begin otherwise.
    """
    start = F.regexp_extract("glob", r"^([^*?]*)", 1)
    keyed = rules.select(
        F.col("pair_id").alias("_pair"), F.col("object_kind").alias("_kind"), "attribute",
        glob_to_regex(F.col("glob")).alias("_regex"), F.substring(start, 1, PREFIX_CHARS).alias("_start"),
    )
    own = qualified(F.col("namespace"), F.col("parent_name"), F.col("name"))
    lengths = F.sequence(F.lit(0), F.least(F.length("_own"), F.lit(PREFIX_CHARS)))
    asked = (
        objects.withColumn("_own", own)
        .withColumn("_start", F.explode(F.transform(lengths, lambda n: F.substring("_own", 1, n))))
        # rules of the object's own pair, and rules of all pairs
        .withColumn("_pair", F.explode(F.array("pair_id", F.lit(None).cast(objects.schema["pair_id"].dataType))))
    )
    rule, row = keyed.alias("r"), asked.alias("o")
    same = F.col("o._start").eqNullSafe(F.col("r._start")) & F.col("o._pair").eqNullSafe(F.col("r._pair"))
    fits = F.col("r._kind").isNull() | (F.col("r._kind") == F.col("o.object_kind"))
    return (
        row.join(rule, same & fits)
        .where(F.expr("o._own rlike r._regex"))
        .select(*[f"o.{c}" for c in _OBJECT], "r.attribute")
    )


def exclude_changes(deltas: DataFrame, rules: DataFrame) -> DataFrame:
    """Change rows without what the rules leave out.

    ``rules``: pair_id (null: every pair), object_kind (null: every kind), glob
    (of ``namespace.name`` or ``namespace.table.name``) and attribute (null: the
    whole object).  An attribute is masked inside its change; a change with
    nothing left is no change.  Created, dropped, renamed and replaced objects
    are left out by rules without an attribute only.
    """
    objects = deltas.select(*_OBJECT).distinct()
    hits = _found(objects, rules).groupBy(*_OBJECT).agg(
        F.max(F.col("attribute").isNull()).alias("_whole"),
        F.collect_set("attribute").alias("_masked"),
    )
    same = F.lit(True)
    for c in _OBJECT:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"h.{c}"))
    rows = deltas.alias("d").join(hits.alias("h"), same, "left").select(
        "d.*", F.coalesce("h._whole", F.lit(False)).alias("_whole"),
        F.coalesce("h._masked", F.array().cast("array<string>")).alias("_masked"),
    )

    def masked(attribute: str) -> Column:
        return F.array_contains("_masked", attribute)

    kind = F.col("kind")
    about = map_values(kind, KIND_ATTRIBUTES)
    retyped = kind == "alter_column_type"
    same_type = F.col("new_data_type").eqNullSafe(F.col("old_column.data_type"))
    same_collation = F.col("new_collation").eqNullSafe(F.col("old_column.collation"))
    # A type change holds type and collation: either may be masked.
    type_left, collation_left = ~masked("data_type") & ~same_type, ~masked("collation") & ~same_collation
    left = F.array_except("changed", "_masked")
    empty = (
        F.when(kind == "alter_table_attrs", F.size(left) == 0)
        .when(retyped, ~(type_left | collation_left))
        .when(about.isNotNull(), F.array_contains("_masked", about))
        .otherwise(F.lit(False))
    )
    values = {
        "changed": left,
        "new_data_type": F.when(retyped & masked("data_type"), F.col("old_column.data_type")).otherwise(F.col("new_data_type")),
        "new_collation": F.when(retyped & masked("collation"), F.col("old_column.collation")).otherwise(F.col("new_collation")),
    }
    for attribute in ("owner", "tablespace", "comment", "partition_info", "partition_of"):
        for side in ("old", "new"):
            name = f"{side}_{attribute}"
            values[name] = F.when((kind != "alter_table_attrs") | ~masked(attribute), F.col(name))
    others = [c for c in deltas.columns if c not in DELTA_FIELDS]
    return rows.where(~F.col("_whole") & ~F.coalesce(empty, F.lit(False))).select(
        *others, *[(values[n] if n in values else F.col(n)).alias(n) for n in DELTA_FIELDS]
    )
