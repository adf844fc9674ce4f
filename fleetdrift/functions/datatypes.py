"""Canonical names of described column types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetdrift.functions.text import let, trim_blank

# Other spellings of a type and the canonical name they stand for.
TYPE_ALIASES = {
    "int2": "smallint",
    "int4": "integer",
    "int": "integer",
    "int8": "bigint",
    "float4": "real",
    "float8": "double precision",
    "bool": "boolean",
    "bpchar": "character",
    "char": "character",
    "varchar": "character varying",
    "decimal": "numeric",
    "timetz": "time with time zone",
    "timestamptz": "timestamp with time zone",
}
# Names that are canonical already, whatever their case.
CANONICAL_TYPES = [
    "smallint", "integer", "bigint", "real", "double precision", "boolean", "character",
    "character varying", "numeric", "time with time zone", "time without time zone",
    "timestamp with time zone", "timestamp without time zone", "bytea", "text", "name", "oid", "uuid",
    "json", "jsonb", "xml", "inet", "cidr", "macaddr", "macaddr8", "bit", "bit varying", "date",
    "interval", "money", "point", "line", "lseg", "box", "path", "polygon", "circle", "tsvector",
    "tsquery", "pg_lsn", "txid_snapshot",
]

_DIMENSIONS = r"(?:\[\d*\])+$"
_MODIFIER = r"\([^)]+\)$"
_ZONE = r" with(?:out)? time zone$"


def _without(text: Column, ending: str, pattern: str) -> Column:
    """Cut a suffix; texts without its last character skip the pattern."""
    return F.when(text.endswith(ending), F.regexp_replace(text, pattern, "")).otherwise(text)


def _suffix(text: Column, ending: str, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 0)
    return F.when(text.endswith(ending), found).otherwise(F.lit(""))


def normalize_type(raw: Column) -> Column:
    """Canonical type text of a server's type description.

    Aliases become their long names in any case, a leading underscore becomes
    an array suffix, modifiers go before a time-zone clause, unknown names pass.
    """
    # One leading underscore marks an array, tested before trimming.
    is_array = raw.startswith("_") & ~raw.startswith("__")
    suffix = F.when(raw.endswith("[]"), F.lit("")).otherwise(F.lit("[]"))
    unprefixed = F.when(is_array, F.concat(F.substr(raw, F.lit(2)), suffix)).otherwise(raw)

    aliases = F.create_map(*[F.lit(x) for x in chain(*TYPE_ALIASES.items())])

    def canonical(bare: Column) -> Column:
        lower = F.lower(bare)
        return F.coalesce(aliases[lower], F.when(lower.isin(CANONICAL_TYPES), lower), bare)

    def assemble(name: Column, base: Column, text: Column) -> Column:
        return F.concat(
            _without(name, "zone", _ZONE),
            _suffix(base, ")", _MODIFIER),
            _suffix(name, "zone", _ZONE),
            _suffix(text, "]", _DIMENSIONS),
        )

    built = let(
        trim_blank(unprefixed),
        lambda text: let(
            _without(text, "]", _DIMENSIONS),
            lambda base: let(
                canonical(trim_blank(_without(base, ")", _MODIFIER))),
                lambda name: assemble(name, base, text),
            ),
        ),
    )
    # Most descriptions are canonical as they stand, or plain names or aliases with a modifier at most.
    first = F.substring_index(raw, "(", 1)
    sized = raw.rlike(r"^[a-z0-9]+\([0-9, ]+\)\z") & ~first.isin([a for a, name in TYPE_ALIASES.items() if name.endswith("zone")])
    modified = F.concat(F.coalesce(aliases[first], first), F.substr(raw, F.length(first) + 1))
    return (
        F.when(raw.isin(CANONICAL_TYPES), raw).when(raw.isin(list(TYPE_ALIASES)), aliases[raw])
        .when(sized, modified).otherwise(built)
    )
