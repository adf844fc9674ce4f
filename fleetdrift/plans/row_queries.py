"""Queries testing planned constraints against the driver's own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetdrift.operators import rowchecks
from fleetdrift.plans.fixtures import table, union_all
from fleetdrift.plans.registry import query

_KEYED = (
    "SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount FROM {lineitem}"
)


def _lineitem(spark, folder):
    key = F.when(F.col("l_orderkey") % 17 != 0, F.col("l_orderkey"))
    return table(spark, folder, "lineitem").withColumn("l_orderkey", key)


@query(
    "SELECT l_orderkey, l_linenumber, count(*) AS row_count, CASE WHEN l_orderkey IS NULL THEN 'null' ELSE 'duplicate' END AS reason "
    f"FROM ({_KEYED}) t GROUP BY l_orderkey, l_linenumber HAVING l_orderkey IS NULL OR count(*) > 1"
)
def check_primary_key(spark, folder):
    return rowchecks.primary_key_violations(_lineitem(spark, folder), ["l_orderkey", "l_linenumber"])


@query(
    f"SELECT l_orderkey, l_linenumber, count(*) AS row_count, false AS nulls_equal FROM ({_KEYED}) t WHERE l_orderkey IS NOT NULL "
    "GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL "
    f"SELECT l_orderkey, l_linenumber, count(*), true FROM ({_KEYED}) t GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
)
def check_unique(spark, folder):
    rows, key = _lineitem(spark, folder), ["l_orderkey", "l_linenumber"]
    distinct = rowchecks.unique_violations(rows, key).withColumn("nulls_equal", F.lit(False))
    equal = rowchecks.unique_violations(rows, key, nulls_not_distinct=True)
    return distinct.unionByName(equal.withColumn("nulls_equal", F.lit(True)))


@query(
    f"SELECT l_orderkey, count(*) AS row_count FROM ({_KEYED}) t WHERE l_orderkey IS NOT NULL AND NOT EXISTS "
    "(SELECT 1 FROM {orders} o WHERE o.o_orderkey = t.l_orderkey AND o.o_orderkey % 13 <> 0) GROUP BY l_orderkey"
)
def check_foreign_key(spark, folder):
    parents = table(spark, folder, "orders").where(F.col("o_orderkey") % 13 != 0)
    return rowchecks.foreign_key_violations(_lineitem(spark, folder), ["l_orderkey"], parents, ["o_orderkey"])


@query(
    "SELECT k, l, count(*) AS row_count FROM (SELECT CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_orderkey END AS k, "
    "CASE WHEN l_orderkey % 34 = 0 THEN NULL ELSE l_linenumber END AS l FROM {lineitem}) t WHERE NOT (k IS NULL AND l IS NULL) "
    "AND NOT EXISTS (SELECT 1 FROM {lineitem} p WHERE p.l_orderkey = k AND p.l_linenumber = l AND p.l_orderkey % 13 <> 0) GROUP BY k, l"
)
def check_foreign_key_full(spark, folder):
    key = F.col("l_orderkey")
    lines = table(spark, folder, "lineitem")
    rows = lines.select(
        F.when(key % 17 != 0, key).alias("k"), F.when(key % 34 != 0, F.col("l_linenumber")).alias("l")
    )
    parents = lines.where(key % 13 != 0)
    return rowchecks.foreign_key_violations(rows, ["k", "l"], parents, ["l_orderkey", "l_linenumber"], match="full")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM {lineitem} WHERE NOT (l_discount < 0.05)"
)
def check_condition(spark, folder):
    bad = rowchecks.check_violations(table(spark, folder, "lineitem"), F.col("l_discount") < 0.05)
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query(
    f"SELECT 'l_orderkey' AS column_name, count(*) AS null_rows FROM ({_KEYED}) t WHERE l_orderkey IS NULL"
)
def check_not_null(spark, folder):
    return rowchecks.not_null_violations(_lineitem(spark, folder), ["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "SELECT event_id, user_id FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before "
    "FROM (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 1000) AS BIGINT) * 1000 AS e FROM {events}) r WHERE s < e) w WHERE s < before"
)
def check_exclusion(spark, folder):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    length = F.floor(F.col("value") * 1000) * 1000
    rows = table(spark, folder, "events").select("event_id", "user_id", start.alias("s"), (start + length).alias("e"))
    return rowchecks.exclusion_violations(rows, ["user_id"], "s", "e", ["event_id"]).select("event_id", "user_id")


@query(
    "SELECT v, count(*) AS row_count FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS STRING) END AS v FROM {orders}) t "
    "WHERE v IS NOT NULL AND TRY_CAST(v AS INTEGER) IS NULL GROUP BY v"
)
def check_cast(spark, folder):
    third = F.col("o_orderkey") % 3
    value = F.when(third == 0, F.col("o_orderpriority")).when(third == 1, F.col("o_custkey").cast("string"))
    return rowchecks.cast_violations(table(spark, folder, "orders").select(value.alias("v")), "v", "integer")


# Values of a text column and what is wrong with each for one new type.
_TEXTS = """
SELECT o_orderkey % 11 AS i, CASE o_orderkey % 11 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_custkey AS STRING) || '  '
  WHEN 2 THEN chr(123) || CAST(o_custkey AS STRING) || ',NULL,"' || CAST(o_orderkey % 70000 AS STRING) || '"' || chr(125)
  WHEN 3 THEN '0' || lpad(CAST(o_orderkey AS STRING), 7, '0') || '-0000-4000-8000-00000000000' || CAST(o_orderkey % 3 * 5 AS STRING)
  WHEN 4 THEN CAST(o_orderkey % 30 AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' days' ELSE ' moons' END
  WHEN 5 THEN CAST(o_custkey AS STRING) || '.' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')
  WHEN 6 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'yes' WHEN o_orderkey % 4 = 1 THEN 'maybe' ELSE 'OFF' END
  WHEN 7 THEN CAST(o_orderkey % 30 AS STRING) || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0')
  WHEN 8 THEN '99.9995' WHEN 9 THEN chr(123) || CAST(o_orderkey AS STRING) ELSE '-32769' END AS v
FROM {orders}"""
# Type text, and when a value does not fit it.
_FITS = [
    ("character varying(4)", "length(rtrim(v)) > 4"),
    ("character(8)", "length(rtrim(v)) > 8"),
    ("numeric(5,3)", "NOT regexp_full_match(trim(v), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') OR TRY_CAST(trim(v) AS DECIMAL(5,3)) IS NULL"),
    ("numeric(3)", "NOT regexp_full_match(trim(v), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)') OR TRY_CAST(trim(v) AS DECIMAL(3,0)) IS NULL"),
    ("uuid", "NOT regexp_full_match(v, '[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+-[0-9a-f]+')  OR length(v) <> 36 OR length(split_part(v, '-', 1)) <> 8 OR NOT regexp_full_match(v, '.*')"),
    ("interval", "NOT (v LIKE '% days' OR (i IN (7) AND regexp_full_match(v, '[0-9]+:[0-9]+')))"),
    ("time without time zone", "i <> 7 OR TRY_CAST(split_part(v, ':', 1) AS INTEGER) > 24"),
    ("boolean", "NOT (v IN ('yes', 'OFF') OR trim(v) IN ('0', '1'))"),
    ("smallint", "NOT regexp_full_match(trim(v), '-?[0-9]+') OR TRY_CAST(trim(v) AS SMALLINT) IS NULL"),
    ("smallint[]", "i <> 2 OR TRY_CAST(split_part(v, '\"', 2) AS SMALLINT) IS NULL OR TRY_CAST(split_part(substr(v, 2), ',', 1) AS SMALLINT) IS NULL"),
    ("character varying(6)[]", "i <> 2"),
]


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS data_type, v, count(*) AS row_count FROM ({_TEXTS}) t WHERE {wrong} GROUP BY v" for name, wrong in _FITS
    )
)
def check_cast_modifiers(spark, folder):
    """Values that do not fit types with modifiers, arrays and types without a Spark counterpart."""
    texts = spark.sql(_TEXTS, orders=table(spark, folder, "orders"))
    parts = [rowchecks.cast_violations(texts, "v", name).select(F.lit(name).alias("data_type"), "v", "row_count") for name, _ in _FITS]
    return union_all(parts)
