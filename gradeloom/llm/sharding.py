"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Shard sizes are fixed first: counts at most one apart. Every shard is cut into
blocks of bounded size, also exact. How many rows of each input partition go to
each block is drawn before any row moves, from the distribution that a uniform
permutation of all rows would give: a tree over the partitions starts with the
block sizes, and at each node the rows that fall to its left half are drawn
without replacement (multivariate hypergeometric). Each draw is seeded by its
node alone, so a task that walks from the root to its partition sees the same
numbers as every other, and no task or driver holds the matrix. What all tasks
get is one row count a partition.

A task then permutes its partition and deals the rows to the blocks in these
counts, rows are exchanged by block, and each block is permuted again: row
order in a shard is uniform too. Rows are written with their partition and
place before counting, so that a lost executor's work is redone alike.

Defined results: null texts and ids are rows like any other; repeated rows are
placed apart; with fewer rows than shards some shards are empty; an empty table
gives no rows. Other columns are carried along; the columns ``shard`` and
``slot`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import stored

#: Rows of one block at most: what the second permutation holds.
BLOCK_ROWS = 1 << 18
#: Fixed value: the library's generator draws from fewer than 10^9 rows.
_DRAWN = 10**9


def block_sizes(rows: int, shards: int, most: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, shard) of every block: shards differ by one row at most, and so do the blocks of a shard."""
    sizes, owner = [], []
    for shard in range(shards):
        own = rows // shards + (shard < rows % shards)
        blocks = max(-(-own // most), 1)
        sizes += [own // blocks + (b < own % blocks) for b in range(blocks)]
        owner += [shard] * blocks
    return np.asarray(sizes, np.int64), np.asarray(owner, np.int64)


def large_hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows, taken without replacement, are good, by inversion; for counts of any size.

    Probabilities relative to the mode come from running products of their
    ratios, over 40 standard deviations to both sides; what lies beyond has less
    weight than a double can tell.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    total = good + bad
    if low == high:
        return low
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    spread = 40 * math.isqrt(int(drawn * (good / total) * (bad / total) * ((total - drawn) / max(total - 1, 1))) + 1) + 40
    first, last = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(first, last, dtype=np.float64)  # weight(k + 1) / weight(k)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    weight = np.r_[0.0, np.cumsum(ratio)]
    sums = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def drawn_apart(rng: np.random.Generator, sizes: np.ndarray, drawn: int) -> np.ndarray:
    """How many of ``drawn`` rows, taken without replacement, come from each of several kinds."""
    total = int(sizes.sum())
    if len(sizes) == 1:
        return np.asarray([drawn], np.int64)
    if total < _DRAWN:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    half = len(sizes) // 2
    left = large_hypergeometric(rng, int(sizes[:half].sum()), int(sizes[half:].sum()), drawn)
    return np.r_[drawn_apart(rng, sizes[:half], left), drawn_apart(rng, sizes[half:], drawn - left)]


def matrix_row(counts: np.ndarray, sizes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Row ``k`` of the communication matrix: how many rows of partition ``k`` go to each block."""
    upto = np.r_[0, np.cumsum(counts)]
    low, high = 0, len(counts)
    while high - low > 1:
        half = (low + high) // 2
        left = drawn_apart(np.random.default_rng([seed, low, high]), sizes, int(upto[half] - upto[low]))
        sizes, low, high = (left, low, half) if k < half else (sizes - left, half, high)
    return sizes


def _sender(parts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, seed: int):
    """Adds the block to rows (part, place, ...); a partition's rows may come in any order and several tasks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] | None = None
        for batch in batches:
            part, place = batch.column("part").to_numpy(), batch.column("place").to_numpy()
            block = np.empty(len(part), np.int64)
            for own in np.unique(part).tolist():
                if known is None or known[0] != own:
                    k = int(np.searchsorted(parts, own))
                    dealt = np.repeat(np.arange(len(sizes)), matrix_row(counts, sizes, k, seed))
                    known = own, np.random.default_rng([seed, len(counts), k]).permutation(dealt)
                here = part == own
                block[here] = known[1][place[here]]
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", *batch.schema.names])

    return send


def _settler(sizes: np.ndarray, owner: np.ndarray, seed: int):
    """Shard and slot of rows (block, ...) sorted by block, part and place."""
    first = np.r_[0, np.cumsum(sizes)][:-1]
    first = first - first[np.searchsorted(owner, owner)]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = None, 0
        for batch in batches:
            block = batch.column("block").to_numpy()
            slot = np.empty(len(block), np.int64)
            edges = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if low == high:
                    continue
                if known is None or known[0] != block[low]:
                    own = int(block[low])
                    known, at = (own, first[own] + np.random.default_rng([seed, own]).permutation(int(sizes[own]))), 0
                slot[low:high] = known[1][at : at + high - low]
                at += high - low
            rest = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("block", "part", "place")]
            names = [c for c in batch.schema.names if c not in ("block", "part", "place")]
            yield pa.RecordBatch.from_arrays([pa.array(owner[block], pa.int32()), pa.array(slot), *rest], ["shard", "slot", *names])

    return settle


def shuffled(rows: DataFrame, shards: int = 40, *, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard): a uniform permutation of all rows."""
    given = rows.drop("shard", "slot")
    names = given.columns
    plain = given.toDF(*[f"c{i}" for i in range(len(names))])
    place = F.monotonically_increasing_id()
    numbered = plain.withColumn("place", place).select(F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("place"), *plain.columns)
    kept = stored(numbered, "numbered")
    counted = sorted(tuple(r) for r in kept.groupBy("part").count().collect())  # one count a partition
    if not counted:
        return given.select(F.lit(0).cast("int").alias("shard"), F.lit(0).cast("long").alias("slot"), *[F.col(f"`{c}`") for c in names]).limit(0)
    parts, counts = (np.asarray([r[i] for r in counted], np.int64) for i in (0, 1))
    sizes, owner = block_sizes(int(counts.sum()), shards, block_rows)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    sent = kept.mapInArrow(_sender(parts, counts, sizes, seed), f"block long, part long, place long, {kinds}")
    met = sent.repartition("block").sortWithinPartitions("block", "part", "place")
    placed = met.mapInArrow(_settler(sizes, owner, seed + 1), f"shard int, slot long, {kinds}")
    return placed.toDF("shard", "slot", *names)


def write_shards(rows: DataFrame, path: str, shards: int = 40, **options) -> None:
    """``rows`` written to one folder per shard, each file in slot order."""
    done = shuffled(rows, shards, **options)
    done.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
