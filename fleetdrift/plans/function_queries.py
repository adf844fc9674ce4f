"""Queries on the scalar functions, over definitions derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetdrift.functions import columns as fcol
from fleetdrift.functions import constraints as fcon
from fleetdrift.functions import indexes as fidx
from fleetdrift.functions.datatypes import CANONICAL_TYPES, TYPE_ALIASES, normalize_type
from fleetdrift.functions.names import glob_to_regex, qualified_name, quote_ident
from fleetdrift.plans.catalog_queries import key_text
from fleetdrift.plans.fixtures import ORACLE_CTES, fixture, table
from fleetdrift.plans.registry import query

# Raw type texts built from parts, so that the expected text can be built from
# the same parts: spelling, case, modifier, array suffix or prefix, blanks.
_SPELLINGS = {**TYPE_ALIASES, **{c: c for c in CANONICAL_TYPES}, "app_money": "app_money", "varbit": "varbit"}


def _pick(subject: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {subject} {arms} END"


_N = len(_SPELLINGS)
_PARTS = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {_pick(f'l_partkey % {_N}', list(_SPELLINGS))} AS spelling,
  {_pick(f'l_partkey % {_N}', list(_SPELLINGS.values()))} AS canonical,
  CASE l_suppkey % 4 WHEN 0 THEN '(' || CAST(l_linenumber AS STRING) || ')' WHEN 1 THEN '(10,' || CAST(l_linenumber AS STRING) || ')' ELSE '' END AS modifier,
  CASE l_linenumber WHEN 1 THEN '[]' WHEN 2 THEN '[][]' WHEN 3 THEN '[4]' ELSE '' END AS dims,
  l_linenumber = 5 AS prefixed, l_linenumber = 6 AS padded, l_suppkey % 3 = 0 AS shouted
FROM {{lineitem}}"""
_RAW = f"""
SELECT *, CASE WHEN prefixed THEN '_' || spelling WHEN padded THEN '  ' || spelling || modifier || dims || ' '
  WHEN shouted AND spelling NOT IN ('app_money', 'varbit') THEN upper(spelling) || modifier || dims
  ELSE spelling || modifier || dims END AS raw_type
FROM ({_PARTS}) parts"""
_EXPECTED = """
CASE WHEN prefixed THEN canonical || '[]'
  WHEN modifier <> '' AND (canonical LIKE '% with time zone' OR canonical LIKE '% without time zone')
    THEN replace(replace(canonical, ' with time zone', ''), ' without time zone', '') || modifier
      || CASE WHEN canonical LIKE '%without%' THEN ' without time zone' ELSE ' with time zone' END || dims
  ELSE canonical || modifier || dims END"""
ORACLE_CTES["fx_raw_type"] = _RAW


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw_type, {_EXPECTED} AS data_type FROM {{fx_raw_type}}")
def normalize_types(spark, folder):
    raw = spark.sql(_RAW, lineitem=table(spark, folder, "lineitem"))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "raw_type",
        normalize_type(F.col("raw_type")).alias("data_type"),
    )


def _joined(array):
    return F.array_join(array, ",")


def _definitions(spark, folder):
    return fixture(spark, folder, "fx_pg_constraint")


_K = "CAST(substr(conname, 2) AS BIGINT)"
def _d():
    return F.col("condef")


# name -> (Spark column, SQL expression, condition on the constraint type)
_CONSTRAINT_FUNCTIONS = {
    "parse_columns": (
        lambda: _joined(fcon.parse_columns(_d())),
        f"CASE contype WHEN 'p' THEN 'c1,c' || CAST({_K} % 7 AS STRING) WHEN 'u' THEN "
        "CASE WHEN condef LIKE '%NULLS%' THEN 'c2' ELSE 'c2,c3' END END",
        "pu",
    ),
    "primary_key": (
        lambda: _joined(fcon.key_columns(_d())), f"'c1,c' || CAST({_K} % 7 AS STRING)", "p",
    ),
    "unique_flag": (
        lambda: fcon.nulls_not_distinct(_d()), f"{_K} % 4 = 1", "u",
    ),
    "check_expression": (
        lambda: fcon.check_expression(_d()),
        f"CASE WHEN {_K} % 4 = 0 THEN 'CHECK ((c1 > 0)) NO INHERIT' ELSE '(c1 > 0)' END",
        "c",
    ),
    "check_no_inherit": (lambda: fcon.check_no_inherit(_d()), f"{_K} % 4 = 0", "c"),
    "fk_delete_action": (
        lambda: fcon.fk_action(_d(), "DELETE"),
        f"CASE {_K} % 5 WHEN 1 THEN 'cascade' WHEN 2 THEN 'set_default' ELSE 'no_action' END",
        "f",
    ),
    "fk_update_action": (
        lambda: fcon.fk_action(_d(), "UPDATE"),
        f"CASE {_K} % 5 WHEN 1 THEN 'set_null' ELSE 'no_action' END",
        "f",
    ),
    "fk_match": (
        lambda: fcon.fk_match(_d()), f"CASE {_K} % 5 WHEN 0 THEN 'full' ELSE 'simple' END", "f",
    ),
    "foreign_key_columns": (
        lambda: F.concat_ws(">", _joined(fcon.fk_columns(_d())), _joined(fcon.fk_ref_columns(_d()))),
        "CASE contype WHEN 'f' THEN 'c1>id' ELSE '?>?' END",
        "pucfx",
    ),
    "exclusion": (
        lambda: F.concat_ws("/", fcon.exclusion_method(_d()), fcon.exclusion_body(_d()), fcon.exclusion_predicate(_d())),
        f"'gist/room WITH =, during WITH &&' || CASE WHEN {_K} % 4 = 0 THEN '/c1 > 0' ELSE '' END",
        "x",
    ),
    "exclusion_elements": (
        lambda: F.array_join(
            F.transform(
                fcon.exclusion_elements(fcon.exclusion_body(_d())),
                lambda e: F.concat_ws(" ", e["column_or_expr"], e["operator"]),
            ),
            ";",
        ),
        "CASE contype WHEN 'x' THEN 'room =,;during &&' ELSE '? =' END",
        "pucfx",
    ),
    "constraint_deferrability": (
        lambda: fcon.deferrability(F.col("condeferrable"), F.col("condeferred")),
        "CASE WHEN condeferrable AND condeferred THEN 'deferrable_initially_deferred' "
        "WHEN condeferrable THEN 'deferrable_initially_immediate' ELSE 'not_deferrable' END",
        "pucfxn",
    ),
}


def _register_constraint_function(name, spark_column, sql, types):
    kinds = ", ".join(f"'{t}'" for t in types)

    @query(
        f"SELECT db_id, conname, {sql} AS value FROM {{fx_pg_constraint}} WHERE contype IN ({kinds})", name=name
    )
    def run(spark, folder):
        rows = _definitions(spark, folder).where(F.col("contype").isin(*types))
        return rows.select("db_id", "conname", spark_column().alias("value"))


for _name, (_column, _sql, _types) in _CONSTRAINT_FUNCTIONS.items():
    _register_constraint_function(_name, _column, _sql, _types)


@query(
    "SELECT db_id, partrelid, CASE WHEN partrelid % 3 = 0 THEN 'range' ELSE "
    "CASE partstrat WHEN 'h' THEN 'hash' WHEN 'l' THEN 'list' ELSE 'range' END END AS strategy FROM {fx_partitioned}"
)
def partition_strategy(spark, folder):
    code = F.when(F.col("partrelid") % 3 == 0, F.lit("z")).otherwise(F.col("partstrat"))
    return fixture(spark, folder, "fx_partitioned").select(
        "db_id", "partrelid", fcol.partition_strategy(code).alias("strategy")
    )


@query(
    "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'btree' WHEN 1 THEN 'hash' WHEN 2 THEN 'gin' WHEN 3 THEN 'btree' "
    "WHEN 4 THEN 'brin' WHEN 5 THEN 'spgist' WHEN 6 THEN 'gist' ELSE 'btree' END AS method FROM {part}"
)
def index_method(spark, folder):
    names = ["btree", "HASH", "gin", "custom_am", "Brin", "SPGIST", "gist", ""]
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("p_partkey") % 8)
    return table(spark, folder, "part").select("p_partkey", fidx.index_method(name).alias("method"))


_BODY = (
    "CASE p % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'a DESC NULLS LAST, \"B\" text_pattern_ops' "
    "WHEN 2 THEN '(lower(email)) DESC, b' WHEN 3 THEN 'lower(email)' WHEN 4 THEN 'coalesce(a, b), c ASC' "
    "ELSE 'score NULLS FIRST' END"
)
_SPLIT = (
    "CASE p % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'a DESC NULLS LAST;\"B\" text_pattern_ops' "
    "WHEN 2 THEN '(lower(email)) DESC;b' WHEN 3 THEN 'lower(email)' WHEN 4 THEN 'coalesce(a, b);c ASC' "
    "ELSE 'score NULLS FIRST' END"
)
ORACLE_CTES["index_number"] = "SELECT db_id, indrelid AS p, indexdef FROM {fx_pg_index}"


@query(f"SELECT db_id, p, CASE WHEN p % 10 = 0 THEN NULL ELSE {_BODY} END AS body FROM {{index_number}}")
def paren_body(spark, folder):
    # every tenth definition loses its closing parentheses
    text = F.when(F.col("indrelid") % 10 == 0, F.replace("indexdef", F.lit(")"), F.lit(""))).otherwise(
        F.col("indexdef")
    )
    return fixture(spark, folder, "fx_pg_index").select(
        "db_id", F.col("indrelid").alias("p"), fidx.paren_body(text).alias("body")
    )


@query(f"SELECT db_id, p, {_SPLIT} AS parts FROM {{index_number}}")
def split_top_level(spark, folder):
    parts = fidx.split_top_level(fidx.paren_body(F.col("indexdef")))
    return fixture(spark, folder, "fx_pg_index").select(
        "db_id", F.col("indrelid").alias("p"), F.array_join(parts, ";").alias("parts")
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 4 = 3 THEN NULL ELSE "
    "'c' || CAST(l_partkey AS STRING) END AS column_name, "
    "CASE WHEN l_partkey % 4 = 3 THEN '(f(c' || CAST(l_partkey AS STRING) || '))' || "
    "CASE l_suppkey % 3 WHEN 1 THEN ' ASC' WHEN 2 THEN ' desc' ELSE '' END || "
    "CASE l_linenumber % 3 WHEN 1 THEN ' NULLS FIRST' WHEN 2 THEN ' nulls last' ELSE '' END END AS expression, "
    "CASE WHEN l_partkey % 4 = 2 THEN 'text_ops' END AS opclass, "
    "CASE WHEN l_suppkey % 3 = 2 THEN 'desc' ELSE 'asc' END AS sort_order, "
    "CASE l_linenumber % 3 WHEN 1 THEN 'first' WHEN 2 THEN 'last' END AS nulls_order FROM {lineitem}"
)
def key_column(spark, folder):
    name = F.concat(F.lit("c"), F.col("l_partkey").cast("string"))
    kind = F.col("l_partkey") % 4
    subject = (
        F.when(kind == 1, F.concat(F.lit('"'), name, F.lit('"')))
        .when(kind == 2, F.concat(name, F.lit("  text_ops")))
        .when(kind == 3, F.concat(F.lit("(f("), name, F.lit("))")))
        .otherwise(name)
    )
    direction = F.when(F.col("l_suppkey") % 3 == 1, " ASC").when(F.col("l_suppkey") % 3 == 2, " desc")
    nulls = F.when(F.col("l_linenumber") % 3 == 1, " NULLS FIRST").when(
        F.col("l_linenumber") % 3 == 2, " nulls last"
    )
    entry = F.concat_ws("", subject, direction, nulls)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fidx.key_column(entry).alias("k")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "k.*")


@query(
    "SELECT db_id, p, CASE p % 6 WHEN 0 THEN 'email|||asc|' WHEN 1 THEN 'a|||desc|last;B||text_pattern_ops|asc|' "
    "WHEN 2 THEN '|(lower(email)) DESC||desc|;b|||asc|' WHEN 3 THEN 'lower(email)|||asc|' "
    "WHEN 4 THEN 'coalesce(a,||b)|asc|;c|||asc|' ELSE 'score|||asc|first' END AS key_columns FROM {index_number}"
)
def index_keys(spark, folder):
    keys = fixture(spark, folder, "fx_pg_index").select(
        "db_id", F.col("indrelid").alias("p"), fidx.index_keys(F.col("indexdef")).alias("k")
    )
    return keys.select("db_id", "p", key_text("k").alias("key_columns"))


@query(
    "SELECT c_custkey, '\"' || replace(n, '\"', '\"\"') || '\"' AS quoted, "
    "'\"' || lower(c_mktsegment) || '\".\"' || replace(n, '\"', '\"\"') || '\"' AS fqn FROM "
    "(SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_name || '\"x' ELSE c_name END AS n FROM {customer}) t"
)
def quote_identifiers(spark, folder):
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit('"x'))).otherwise(F.col("c_name"))
    return table(spark, folder, "customer").select(
        "c_custkey",
        quote_ident(name).alias("quoted"),
        qualified_name(F.lower("c_mktsegment"), name).alias("fqn"),
    )


@query(
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN starts_with(t, 't1') WHEN 1 THEN length(t) = 4 AND right(t, 1) = '7' "
    "WHEN 2 THEN false ELSE t LIKE '%0%' END AS matched FROM (SELECT o_orderkey, 't' || CAST(o_orderkey AS STRING) AS t FROM {orders}) o"
)
def glob_match(spark, folder):
    globs = ["t1*", "t??7", "t.[0-9]*", "*0*"]
    glob = F.get(F.array(*[F.lit(g) for g in globs]), F.col("o_orderkey") % 4)
    name = F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.regexp_like(name, glob_to_regex(glob)).alias("matched")
    )
