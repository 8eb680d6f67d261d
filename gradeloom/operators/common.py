"""Small building blocks shared by the operators.

Everything here keeps working when one key holds a large share of all rows:
``latest`` and ``top`` cut every key to its first rows before the shuffle
(window group limit), ``count_per`` pre-aggregates, and the running helpers
split a long key into bounded chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import cut

CHOICES = ("A", "B", "C", "D", "E")
RESOLVED = (*CHOICES, "blank", "multiple", "boundary_cross")

# Rows of one key that a running helper lets a single task hold.
CHUNK_WIDTH = 1 << 16
SPAN_CHUNKS = 1 << 24


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every key; Spark cuts to ``k`` per key before shuffling."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def latest(df: DataFrame, keys: Sequence[str] | str, order: Sequence[str] | str = "seq") -> DataFrame:
    """Newest revision per key. ``order`` must be total within the key."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    order = [order] if isinstance(order, str) else list(order)
    return top(df, keys, [F.col(name).desc() for name in order])


def count_per(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def yes(condition: Column) -> Column:
    """Fail closed: an unknown condition is not met."""
    return F.coalesce(condition, F.lit(False))


def rate(hits: Column, total: Column, digits: int = 6) -> Column:
    """Rounded share; NULL when the denominator is zero."""
    return F.round(F.try_divide(hits.cast("double"), total.cast("double")), digits)


def reasons(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that hold, in the order given."""
    marks = F.array(*[F.when(yes(rule), F.lit(name)) for name, rule in rules.items()])
    return F.filter(marks, lambda item: item.isNotNull())


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule. Rows that break nothing produce nothing."""
    return df.select(*keys, F.explode(reasons(rules)).alias("rule"))


class ConstraintError(ValueError):
    """Raised by ``enforce`` when a table breaks one of its rules."""


def enforce(broken: DataFrame, limit: int = 5) -> None:
    """Strict mode: raise when any violation exists, naming the first few."""
    found = broken.limit(limit).collect()
    if found:
        raise ConstraintError("; ".join(str(row.asDict()) for row in found))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, width: int = CHUNK_WIDTH
) -> DataFrame:
    """Inclusive running sum of ``value`` by the unique integer clock ``order``.

    Exact for any key size and any spread of the clock: sums inside chunks of
    ``width`` ticks, sums of chunks inside spans of ``SPAN_CHUNKS`` chunks, and
    sums of spans, of which a 64-bit clock has no more than that. No task
    orders a whole hot key, or all sparse ticks of a table.
    """
    chunked = df.withColumn("_chunk", F.expr(f"`{order}` div {width}")).withColumn("_span", F.expr(f"_chunk div {SPAN_CHUNKS}"))
    chunks = chunked.groupBy(*keys, "_span", "_chunk").agg(F.sum(value).alias("_total"))
    spans = chunks.groupBy(*keys, "_span").agg(F.sum("_total").alias("_total"))
    before = lambda part, by: F.coalesce(F.sum("_total").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = spans.select(*keys, "_span", before(keys, "_span").alias("_above"))
    chunks = chunks.select(*keys, "_span", "_chunk", before([*keys, "_span"], "_chunk").alias("_below"))
    offsets = chunks.join(above, [*keys, "_span"]).select(*keys, "_chunk", (F.col("_above") + F.col("_below")).alias("_offset"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.withColumn("_inside", F.sum(value).over(inside))
    return (
        summed.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .drop("_chunk", "_span", "_offset", "_inside")
    )


def dense_number(df: DataFrame, keys: Sequence[str], order: str, name: str, width: int = CHUNK_WIDTH) -> DataFrame:
    """1-based position by ``order`` within ``keys`` (or over the whole table)."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", name, width).drop("_one")


def sliced(df: DataFrame, order: Sequence[str | Column], name: str = "slices") -> DataFrame:
    """Rows range-partitioned by ``order``, written once, with ``_slice``: the partition, counted in that order.

    Neighbours in the order stay together and a key of any size is cut into as
    many slices as it needs. What one slice must know of those before it goes
    through ``previous`` and ``running``, which look at one row per slice.
    """
    return cut(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), name)


def previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``value`` of the row before within ``keys``, over ``sliced`` rows; NULL for the first. ``order`` is unique within the keys."""
    last = df.groupBy(*keys, "_slice").agg(F.max_by(value, order).alias("_end"))
    ends = last.select(*keys, "_slice", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_before"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order)
    return (
        df.withColumn("_inside", F.lag(value).over(inside)).withColumn("_place", F.row_number().over(inside)).join(ends, [*keys, "_slice"])
        .withColumn(name, F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("_inside"))).drop("_inside", "_place", "_before")
    )


def running(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys``, over ``sliced`` rows."""
    totals = df.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("_inside", F.sum(value).over(inside)).join(offsets, [*keys, "_slice"])
    return summed.withColumn(name, F.col("_offset") + F.col("_inside")).drop("_inside", "_offset")


def merged(df: DataFrame) -> DataFrame:
    """This side of a join is sorted and merged, never sent whole to every task.

    For rows that an explode or a generated range makes: Spark takes them to be
    as few bytes as the rows they come from, and would collect them on the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by ``keys`` over as many tasks as a shuffle has, small ones not put together again.

    For rows that an explode is about to multiply: what they become stays where
    it is, and joins and groups that hold ``keys`` need no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def expand_range(df: DataFrame, low: str | Column, high: str | Column, name: str) -> DataFrame:
    """One row per integer of [low, high]; turns interval membership into an equi join."""
    low = F.col(low) if isinstance(low, str) else low
    high = F.col(high) if isinstance(high, str) else high
    return df.where(low <= high).withColumn(name, F.explode(F.sequence(low, high)))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with their rank span (``below``, ``upto``] and the group size ``n``.

    Equal values are counted before the shuffle, the rank is a streaming
    running sum, so no group is ever collected.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_count"))
    totals = counts.groupBy(*keys).agg(F.sum("_count").alias("n"))
    running = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("_count").over(running))
    return ranked.join(totals, list(keys)).withColumn("below", F.col("upto") - F.col("_count")).drop("_count")


def at_rank(rank: Column) -> Column:
    """Picks the row of ``ranked_values`` that holds the 1-based rank."""
    return (F.col("below") < rank) & (F.col("upto") >= rank)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    ranked = ranked_values(df, keys, value)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when(at_rank(low), F.col(value))) + F.max(F.when(at_rank(high), F.col(value)))) / 2).alias(name)
    )


def position_in_chunks(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position by (chunk, order) within ``keys``; only one chunk is ever sorted in one task.

    ``chunk`` must be non-decreasing in ``order``.
    """
    chunked = df.withColumn("_chunk", chunk)
    totals = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = chunked.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*keys, "_chunk"]).withColumn(name, F.col("_offset") + F.col("_inside")).drop("_chunk", "_offset", "_inside")
    )
