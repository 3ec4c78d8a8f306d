"""Tables in the folder that driver and executors share: what iterative operators cut their lineage with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="cellweave-")
    return _own[app]


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/cellweave/{label}-{uuid.uuid4().hex}"


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_cellweave_path", None)
        if path is not None:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later stages survive lost executors.

    With ``clean`` the shuffle files of the write go as soon as it is done, not when the driver's JVM happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    was = spark.conf.get(_CLEAN, None)
    if clean:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(_CLEAN) if was is None else spark.conf.set(_CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._cellweave_path = path
    return out
