"""Scalar functions: Columns in, Columns out, all inside the JVM."""

from fleetdrift.functions.columns import (
    column_variant,
    default_expression,
    identity_spec,
    nondefault_collation,
    partition_info,
    partition_of,
    partition_strategy,
    stored_expression,
)
from fleetdrift.functions.constraints import (
    check_expression,
    constraint_fields,
    constraint_kind,
    deferrability,
    exclusion_elements,
    fk_action,
    fk_match,
    fk_target,
    parse_columns,
)
from fleetdrift.functions.datatypes import normalize_type
from fleetdrift.functions.indexes import index_keys, index_method, key_column, paren_body, split_top_level
from fleetdrift.functions.names import glob_to_regex, is_user_schema, qualified_name, quote_ident, sort_key

__all__ = [
    "check_expression", "column_variant", "constraint_fields", "constraint_kind", "default_expression",
    "deferrability", "exclusion_elements", "fk_action", "fk_match", "fk_target", "glob_to_regex",
    "identity_spec", "index_keys", "index_method", "is_user_schema", "key_column",
    "nondefault_collation", "normalize_type", "paren_body", "parse_columns", "partition_info",
    "partition_of", "partition_strategy", "qualified_name", "quote_ident", "sort_key",
    "split_top_level", "stored_expression",
]
