"""Comparison pairs: which snapshot to compare with which, and what to skip."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetdrift.functions.names import glob_to_regex
from fleetdrift.model import PAIR


def with_pair_defaults(pairs: DataFrame) -> DataFrame:
    """Fill what a pair leaves open: schema ``public``, no globs, schemas only."""
    none = F.array().cast("array<string>")
    return pairs.select(
        "pair_id",
        "source_snapshot",
        "target_snapshot",
        F.coalesce("schemas", F.array(F.lit("public"))).alias("schemas"),
        F.coalesce("ignore_patterns", none).alias("ignore_patterns"),
        F.coalesce("mode", F.lit("schema-only")).alias("mode"),
    )


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of JSON documents with a ``profiles`` list.

    A missing file or a missing list is an empty result, not an error.
    """
    from pyspark.sql import types as T

    document = T.StructType([T.StructField("profiles", T.ArrayType(PAIR))])
    try:
        documents = spark.read.schema(document).json(path, multiLine=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        documents = spark.createDataFrame([], document)
    return with_pair_defaults(documents.select(F.explode("profiles").alias("p")).select("p.*"))


def without_ignored(
    rows: DataFrame, pairs: DataFrame, name_column: str, *, id_column: str = "pair_id"
) -> DataFrame:
    """Rows whose name matches none of their pair's ``ignore_patterns``.

    The globs of one pair become one alternation, so each row is tested once.
    """
    regexes = pairs.where(F.size("ignore_patterns") > 0).select(
        id_column,
        F.array_join(F.transform("ignore_patterns", glob_to_regex), "|").alias("_ignored"),
    )
    return (
        rows.join(regexes, id_column, "left")
        .where(F.col("_ignored").isNull() | ~F.expr(f"{name_column} rlike _ignored"))
        .drop("_ignored")
    )


def matches_any(name, globs: list[str]):
    """True if ``name`` matches one of some literal globs."""
    if not globs:
        return F.lit(False)
    patterns = [F.regexp_like(name, glob_to_regex(F.lit(g))) for g in globs]
    result = patterns[0]
    for pattern in patterns[1:]:
        result = result | pattern
    return result
