"""Tables written in the middle of a job.

They go to the folder the cluster names in ``spark.checkpoint.dir``, which the
driver and all executors share, so a lost executor loses none of them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder.  Where none is configured the session must be local, and a temporary folder does."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="lodegraph-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: cuts lineage and is computed once however often it is used.

    Shuffle files of the write go with it, where the session can do so.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` returned; nothing may read them any more."""
    for table in tables:
        jvm = table.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(table._written_at)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "16m") -> None:
    """Hands Python at most ``rows`` rows or about ``size`` bytes at once: with whole texts, the default takes several times the memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
