"""A numbered commit log in a folder: one small file per commit, of which no number is taken twice.

A commit is written beside the log and moved to the next free number by a
rename that refuses to overwrite. Of two writers that want one number the file
system lets one through; the other reads the log again, and finds either a
conflict with what was committed or the next number. Readers see whole commits
only. The file system must rename without overwriting in one step, as HDFS and
object stores with conditional puts do.
"""

from __future__ import annotations

import json
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitConflict(ValueError):
    """The log holds a commit with the same value in the column that must be unique."""


def _files(spark: SparkSession, folder: str):
    hadoop = spark._jvm.org.apache.hadoop
    path = hadoop.fs.Path(folder)
    return hadoop, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All commits of the log, with ``version``, their number."""
    hadoop, path, fs = _files(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], f"version bigint, {schema}")
    return spark.read.schema(f"version bigint, {schema}").json(folder)


def last_version(spark: SparkSession, folder: str) -> int:
    """The number of the newest commit; -1 for an empty log."""
    hadoop, path, fs = _files(spark, folder)
    if not fs.exists(path):
        return -1
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return max((int(name.split(".")[0]) for name in names if name.endswith(".json") and not name.startswith((".", "_"))), default=-1)


def commit(spark: SparkSession, folder: str, row: dict, schema: str, unique: str) -> int:
    """Append ``row`` under the next number, unless the log has another with its value of ``unique``; gives the number."""
    hadoop, path, fs = _files(spark, folder)
    fs.mkdirs(path)
    context = hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    keep = spark._jvm.java.lang.reflect.Array.newInstance(hadoop.fs.Options.Rename.NONE.getClass(), 1)
    keep[0] = hadoop.fs.Options.Rename.NONE
    while True:
        version = last_version(spark, folder) + 1
        if commits(spark, folder, schema).where((F.col("version") < version) & (F.col(unique) == row[unique])).limit(1).count():
            raise CommitConflict(f"{unique} exists: {row[unique]}")
        draft = hadoop.fs.Path(path, f"_draft-{uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray((json.dumps({"version": version, **row}, sort_keys=True) + "\n").encode()))
        finally:
            stream.close()
        try:
            context.rename(draft, hadoop.fs.Path(path, f"{version:020d}.json"), keep)
            return version
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" not in str(error.java_exception.getClass()):
                raise
