"""Writing the result of a comparison run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetdrift.session import cut_lineage
from fleetdrift.skew import with_places

# Rows per written file.
FILE_ROWS = 1_000_000

# Parts of a run and the column their rows are ordered by.
_ORDER = {"deltas": "position", "manifest": "start_line", "statements": "line"}


def write_run(
    deltas: DataFrame,
    units: DataFrame,
    statements: DataFrame,
    folder: str,
    file_rows: int = FILE_ROWS,
) -> None:
    """One folder per run: ordered deltas, transaction units, statements.

    Rows are range partitioned by pair and their order, so a pair of any size is
    written by as many tasks as it needs, and its files in order of name hold its
    rows in order.
    """
    for name, df in (("deltas", deltas), ("manifest", units), ("statements", statements)):
        order = [c for c in ("pair_id", _ORDER[name]) if c in df.columns]
        (
            df.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("maxRecordsPerFile", file_rows)
            .partitionBy("pair_id")
            .json(f"{folder}/{name}")
        )


def _scripted(statements: DataFrame) -> DataFrame:
    """Statements with the lines they take in the script of all pairs, ``first_line`` to ``last_line``."""
    text = F.concat("statement", F.lit(";"))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    ordered = statements.withColumns({"text": text, "_lines": lines.cast("long")}).orderBy("pair_id", "line")
    placed = with_places(ordered, "last_line", amount="_lines")
    return placed.withColumn("first_line", F.col("last_line") - F.col("_lines") + 1).drop("_lines")


def write_migration(up: DataFrame, down: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """``up.sql``, ``down.sql`` and a ``manifest`` of the units' line ranges in them.

    ``up`` and ``down`` are ``statement_lines``.  A script holds the statements of
    all pairs one after the other; its text files in order of name are the script,
    whatever number of tasks wrote them.
    """
    manifests = []
    for direction, statements in (("up", up), ("down", down)):
        scripted = cut_lineage(_scripted(statements))
        (
            scripted.repartitionByRange("first_line").sortWithinPartitions("first_line").select("text")
            .write.mode("overwrite").option("maxRecordsPerFile", file_rows).text(f"{folder}/{direction}.sql")
        )
        manifests.append(
            scripted.groupBy("pair_id", "barrier", "transactional")
            .agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.count(F.lit(1)).alias("statements"))
            .select("pair_id", F.lit(direction).alias("direction"), "transactional", "first_line", "last_line", "statements")
        )
    both = manifests[0].unionByName(manifests[1])
    both.repartitionByRange("direction", "first_line").sortWithinPartitions("direction", "first_line").write.mode("overwrite").json(f"{folder}/manifest")


def read_script(spark: SparkSession, folder: str, direction: str) -> DataFrame:
    """``line_number`` and ``text`` of every line of a written script."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)", 1).cast("long")
    lines = spark.read.text(f"{folder}/{direction}.sql").select(
        part.alias("_part"), name.alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text"),
    )
    # Inside a block ids follow the lines; the stored lines fix them.
    ordered = cut_lineage(lines).orderBy("_part", "_file", "_start", "_row")
    return with_places(ordered, "line_number").select("line_number", "text")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(
        "pair_id long, direction string, transactional boolean, first_line long, last_line long, statements long"
    ).json(f"{folder}/manifest")
