"""Registered queries of the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetdrift.llm import (
    conversations, decontaminate, hnsw, jaccard, language, licenses, negatives, packing, secrets, shards, toxicity, warc, webpages,
)
from fleetdrift.llm.conversations import REPAIR_SQL
from fleetdrift.llm.jaccard import JACCARD_SQL
from fleetdrift.llm.licenses import LICENSES_SQL
from fleetdrift.llm.negatives import NEGATIVES_SQL
from fleetdrift.llm.secrets import SECRETS_SQL
from fleetdrift.llm.storage import prepared, scratch
from fleetdrift.llm.warc import WARC_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = lambda spark, folder: function(prepared(spark), folder)
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_site_templates(spark: SparkSession, folder: str) -> DataFrame:
    return webpages.extract_texts(table(spark, folder, "pages"), ["page_id", "url"])


@query(SECRETS_SQL)
def op2_credential_linking(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query()
def op3_hnsw_search(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op4_nnpu_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train_toxicity(docs, labels)
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.held_out(scored.doc_id).alias("held_out"), "score", "predicted")


@query()
def op5_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return shards.balanced_shards(table(spark, folder, "documents"), ["doc_id"])


@query()
def op6_ftrl_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    languages, model = language.train_language(docs)
    found = language.predict_language(docs, languages, model)
    return found.select("doc_id", language.held_out(found.doc_id).alias("held_out"), "lang_pred", "score")


@query(LICENSES_SQL)
def op7_license_templates(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"), ["doc_id"])


@query(JACCARD_SQL)
def op8_combination_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, folder, "documents"), ["doc_id"])


@query()
def op9_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("text_hash")


@query()
def op10_histogram_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@query(REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return conversations.repair_report(rows, conversations.damaged(rows))


@query(NEGATIVES_SQL)
def op12_angular_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    # A seventh of the labels is wrong, so that anchors meet near rows of another label.
    wrong = (F.col("label").cast("long") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, wrong).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


@query(WARC_SQL)
def op13_revisit_resolution(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch(spark)
    warc.write_archives(warc.page_records(table(spark, folder, "pages")), archives)
    return warc.resolved(warc.read_archives(spark, archives, payloads=False))
