"""Tables partitioned by exam: replacing and removing whole partitions.

A replacement is written to Spark's staging folder first and moved into place
partition by partition when all of it is there (dynamic partition overwrite), so
a write that fails leaves every old partition, and partitions that get no new
rows are never touched. Run again, it gives the same tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.changes import PURGE_ORDER


def write_partitions(rows: DataFrame, path: str, by: str = "exam_id") -> None:
    """A new table, its rows gathered by partition so that each has few files."""
    rows.repartition(by).write.mode("errorifexists").partitionBy(by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str = "exam_id") -> None:
    """The partitions that ``rows`` has rows for are replaced by them; all others stay as they are, file by file."""
    rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def drop_partitions(spark: SparkSession, path: str, values: Iterable, by: str = "exam_id") -> int:
    """Remove whole partitions; those that aren't there count for nothing. Gives how many were removed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(fs.delete(hadoop.Path(f"{path}/{by}={value}"), True) for value in values)


def read_partitions(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table with its columns as they were given; an emptied table has no rows."""
    names = spark.createDataFrame([], schema).columns
    return spark.read.schema(schema).parquet(path).select(*names)


def apply_indicators(path: str, incoming: DataFrame, broken: DataFrame) -> None:
    """Replace-all of the indicators per exam; an exam whose new rows break a rule keeps its old partition."""
    replace_partitions(incoming.join(broken.select("exam_id").distinct(), "exam_id", "left_anti"), path)


def apply_purge(spark: SparkSession, paths: Mapping[str, str], exams: DataFrame) -> dict[str, int]:
    """Remove the given exams from all tables, those that point to others first.

    ``exams`` are the few that a person chose to purge. A run that ends half-way
    leaves no row that points to a missing one, and can be repeated.
    """
    gone = sorted(row.exam_id for row in exams.select("exam_id").distinct().collect())
    order = sorted(paths, key=lambda name: PURGE_ORDER.index(name))
    return {name: drop_partitions(spark, paths[name], gone) for name in order}
