"""Session defaults used by tests, the bench and interactive work, and shared intermediates.

On a cluster the submitter owns the settings; the library reads only
``spark.checkpoint.dir``, the folder that all executors share.
"""

from __future__ import annotations

import atexit
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
_USED: set[str] = set()


def local_session(cores: str | int = 8, *, memory: str = "8g", name: str = "gradeloom") -> SparkSession:
    """A session on this machine alone, with a checkpoint folder of its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster shares; an error where none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return f"{configured.rstrip('/')}/gradeloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Materialise a frame that two or more branches read: a table in the shared checkpoint folder.

    Reliable (a lost executor re-reads files, nothing is recomputed) and
    columnar, so that later branches still prune columns and know sizes.
    ``forget`` deletes these tables; it also runs when the program ends.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    delete_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this application when the program ends."""
    if folder not in _USED:
        _USED.add(folder)
        atexit.register(_forget_quietly, spark, folder)


def forget(spark: SparkSession, folder: str | None = None) -> None:
    """Delete the intermediates of this application; frames that still read them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or checkpoint_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _forget_quietly(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        forget(spark, folder)
