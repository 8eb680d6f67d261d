"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import delete_at_exit, forget

#: The white space of the text contracts, space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where unset, one beside the warehouse tables."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and a lost executor costs a reread only.

    The application's folder is deleted when the program ends, a table that
    nothing reads any more by ``done_with``.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/text-{spark.sparkContext.applicationId}"
    delete_at_exit(spark, folder)
    path = f"{folder}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def done_with(*tables: DataFrame) -> None:
    """Delete stored tables of which all readers have been stored themselves."""
    for own in tables:
        forget(own.sparkSession, own.stored_at)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete shuffle files that no frame refers to any more.

    It does so when the driver's collector finds their plans unused, which on a
    driver with much memory may be long after; a step with large shuffles asks.
    """
    gc.collect()
    spark._jvm.System.gc()


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the first of wanted_1, wanted_2, ... that is no column of ``df``."""
    taken, name, k = {c.lower() for c in df.columns}, wanted, 0
    while name.lower() in taken:
        name, k = f"{wanted}_{k + 1}", k + 1
    return name


_HELD: dict = {}


def held(key, make):
    """What a worker process keeps between tasks, such as a tokenizer with its words: one thing at a time, another takes its place."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def lowered(text: Column) -> Column:
    """A-Z to a-z, nothing else. Texts of ASCII alone take the quicker function, which does the same for them."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable; a stored table.

    Large star and small star rounds, each a grouped minimum and a join; every
    round's links are written to the shared folder. Stops when a round changes
    nothing, which a count and a sum of hashes tell, after about the logarithm
    of the longest path. Stars around their smallest node end at once.
    """

    def told(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = told(edges)
    while before[0]:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionAll(least.select("a", F.col("low").alias("b")))
        edges, old = stored(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name), edges
        done_with(old)
        before, last = told(edges), before
        if before == last:
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    found = stored(found, f"{name}-found")
    done_with(edges)
    return found
