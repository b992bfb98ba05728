"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "foldwise", cpus: str = "8", folder: str | None = None) -> SparkSession:
    """A local session for tests and the bench, its tables in ``folder``; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = (
        builder.appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: below the session's ``spark.checkpoint.dir``.

    A session that does not set it uses the warehouse, which all executors share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "foldwise-tables")
    return os.path.join(folder, spark.sparkContext.applicationId)


def release(spark: SparkSession) -> None:
    """Delete the tables this application has written; for the end of a run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _STAGED if k[0] == spark.sparkContext.applicationId]:
        del _STAGED[key]


def materialise(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, so a plan that is
    read several times is computed once, and later reads are column-pruned.
    """
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), uuid.uuid4().hex)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foldwise_written = True
    out._foldwise_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` wrote and nothing reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._foldwise_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a written table: itself if ``materialise`` made it."""
    return df if getattr(df, "_foldwise_written", False) else materialise(df)


# Bytes of rows that may be copied to every task.
BROADCAST_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it proves small; else left to a shuffled join.

    For tables of the experiment's size (samples by groups).  It is written once,
    so that measuring and joining it do not compute it twice.  Files may be packed far
    tighter than rows are in memory, so rows times their width count too; the rows are known
    from the files' footers.
    """
    kept = written(df)
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES:
        size = max(size, kept.count() * kept._jdf.schema().defaultSize())
    return F.broadcast(kept) if size <= BROADCAST_BYTES else kept


_STAGED: dict[tuple, DataFrame] = {}


def _files(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of what lies in a folder of tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def staged(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Build a named intermediate table once per application, input state and settings, and reuse it.

    ``key`` ends with the folder of the input tables.
    """
    full = (spark.sparkContext.applicationId, *key, _files(spark, key[-1]), spark.conf.get("foldwise.groupRows", None))
    if full not in _STAGED:
        _STAGED[full] = materialise(build())
    return _STAGED[full]
