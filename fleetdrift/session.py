"""Session set-up and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators rely on.  Lookups of many rows against one
# row per key are plain equi-joins: AQE splits their hot partitions, also when
# that costs the operator above it another exchange.
_RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


# Set once per application: recording the call site of every Column costs more
# than building the Column.
_STATIC = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app_name: str = "fleetdrift", **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_STATIC, **_RUNTIME, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for data between jobs: ``spark.checkpoint.dir`` of the session.

    Where that is unset it lies in the warehouse, which the cluster shares too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unsent(df: DataFrame) -> DataFrame:
    """``df``, which the next join does not broadcast: its rows grow with the fleet.

    Before they are read, Spark goes by the size of files, which says little about
    the rows that come from them: a compressed file holds hundreds of times its
    size in rows of a hash table, and the driver has to hold that table.
    """
    return df.hint("merge")


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

    Like ``cut_lineage``, for rows that are many or mostly null: columns take a
    small part of the space that whole rows take, and readers fetch only theirs.
    Joins do not broadcast a stored table (see ``unsent``).
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return unsent(spark.read.schema(df.schema).parquet(path))
