"""Tables between two jobs, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetdrift.session import checkpoint_folder, configure

#: Texts sent to a Python worker at once: some megabytes for ordinary documents.
_BATCH_ROWS = "2000"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that these operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH_ROWS)
    return configure(spark)


_OWNED: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    # The application may have stopped its context already.
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, below this application's own part of it, which goes when the application ends."""
    folder = f"{checkpoint_folder(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _OWNED:
        _OWNED.add(folder)
        atexit.register(_delete, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs its unfinished tasks, not the work before.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
