"""Corpus pipeline: toxicity, similarity join, decontamination, secrets, packing.

Each stage takes the documents its predecessor kept.  All but the last return
the columns of documents; the last one the packed pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetdrift.llm import decontaminate, jaccard, packing, secrets, toxicity
from fleetdrift.llm.queries import table, tokenizer_path
from fleetdrift.llm.storage import prepared, stored


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _with_safe_names(stage: Stage) -> Stage:
    """Run a stage on documents whose other columns cannot clash with names that operators add."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepared(spark)
        names = docs.columns
        safe = [c if c in ("doc_id", "text") else f"_{c}_{i}" for i, c in enumerate(names)]
        out = stage(spark, docs.toDF(*safe), sf_dir)
        return out.select(*[F.col(f"`{x}`").alias(c) for x, c in zip(safe, names, strict=True)])

    return run_stage


@_with_safe_names
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, docs.columns).where("predicted = 0")


@_with_safe_names
def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; rows without words all stay.

    Rows equal in every column are one; of different rows with the smallest doc_id
    one stays.
    """
    keyed = docs.withColumn("_row", F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns]))
    groups = jaccard.similar_groups(keyed.select("doc_id", "text", "_row"), ["doc_id", "_row"])
    best = (
        groups.where("n_shingles > 0 AND doc_id = component_id").groupBy("component_id").agg(F.min("_row").alias("_kept"))
    )
    rest = groups.where("n_shingles = 0 OR component_id IS NULL").select(F.col("_row").alias("_kept"))
    kept = best.select("_kept").unionByName(rest).distinct()
    # Both sides and the aggregation are dealt by the row's hash: the texts move once.
    return keyed.join(kept, F.col("_row") == F.col("_kept"), "left_semi").dropDuplicates(["_row"])


@_with_safe_names
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(found, same, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows the new text."""
    masked = _with_safe_names(lambda _, rows, __: secrets.redact_secrets(rows))(spark, docs, sf_dir)
    if "n_chars" not in docs.columns:
        return masked
    number = F.length("text").cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), number).otherwise(F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    prepared(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("similarity join", drop_similar),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Learned scores and components can't be told in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that pass; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
