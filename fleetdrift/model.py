"""Fixed vocabularies and row types of the catalog model."""

from __future__ import annotations

from pyspark.sql import types as T

# Kinds of catalog objects.
OBJECT_KINDS = [
    "schema", "extension", "table", "view", "materialized_view", "index", "sequence", "function",
    "procedure", "enum", "composite_type", "domain_type", "column", "constraint", "trigger", "policy",
]
SUB_OBJECT_KINDS = ["column", "constraint", "trigger", "policy"]
OVERLOADED_KINDS = ["function", "procedure"]
# Delta operations and the five risk levels, mildest first.
DELTA_OPS = ["create", "drop", "alter", "rename", "replace"]
RISK_LEVELS = ["SAFE", "WARNING", "DANGEROUS", "DESTRUCTIVE", "BLOCKED"]
# Index access methods with their own name in the model.
INDEX_METHODS = ["btree", "hash", "gist", "gin", "brin", "spgist"]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
_NAMES = T.ArrayType(_S)

QNAME = _struct(namespace=_S, name=_S)
OBJECT_REF = _struct(kind=_S, qname=QNAME)
IDENTITY = _struct(
    generated=_S, start=_L, increment=_L, min_value=_L, max_value=_L, cache=_L, cycle=_B
)
COLUMN = _struct(
    position=_I, name=_S, data_type=_S, nullable=_B, default_expr=_S, collation=_S,
    identity=IDENTITY, generated_expression=_S,
)
EXCLUSION_ELEMENT = _struct(column_or_expr=_S, operator=_S, opclass=_S)
CONSTRAINT = _struct(
    name=_S, kind=_S, deferrability=_S, columns=_NAMES, index_method=_S, nulls_not_distinct=_B,
    expression=_S, no_inherit=_B, ref_namespace=_S, ref_table=_S, ref_columns=_NAMES, on_delete=_S,
    on_update=_S, match_type=_S, elements=T.ArrayType(EXCLUSION_ELEMENT), predicate=_S,
)
KEY_COLUMN = _struct(column_name=_S, expression=_S, opclass=_S, sort_order=_S, nulls_order=_S)
# An index lists its table first, so that sorted indexes follow the order of tables.
INDEX = _struct(
    table_name=_S, name=_S, method=_S, key_columns=T.ArrayType(KEY_COLUMN), include_columns=_NAMES,
    unique=_B, predicate=_S, comment=_S,
)
PARTITION_INFO = _struct(strategy=_S, partition_key=_S)
PARTITION_OF = _struct(parent_namespace=_S, parent_name=_S, partition_bound=_S)
TABLE = _struct(
    ref=OBJECT_REF, columns=T.ArrayType(COLUMN), constraints=T.ArrayType(CONSTRAINT), owner=_S,
    tablespace=_S, partition_info=PARTITION_INFO, partition_of=PARTITION_OF, comment=_S,
)
SCHEMA = _struct(ref=OBJECT_REF, owner=_S, comment=_S)
EXTENSION = _struct(ref=OBJECT_REF, version=_S, installed_schema=_S, comment=_S)
PAIR = _struct(
    pair_id=_S, source_snapshot=_S, target_snapshot=_S, schemas=_NAMES, ignore_patterns=_NAMES, mode=_S
)
