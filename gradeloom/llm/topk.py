"""Exact top-k by inner product as a Voronoi join.

Pivots part the vectors into cells. Each cell has a summary: rows, its greatest
distance from the pivot, and the smallest such distances. With them a query q
knows for every cell of pivot p, by Cauchy-Schwarz,

    q.p - |q| d  <=  q.x  <=  q.p + |q| r      (x at distance d, all within r)

so the k best lower bounds over all summaries give a score that its k-th result
reaches, and it is sent only to cells whose upper bound reaches that score.
Cells are cut into blocks of bounded size by a hash of the id, as are the
queries of a cell; each pair of blocks is solved by one matrix product, and the
best k of each query go on to the final ranking.

Pivots are vectors themselves, those with the smallest hashes of their ids, at
most ``MAX_PIVOTS`` of them: pivots and summaries are the only things sent to
all tasks, and their size is bounded by that number.

Defined results: vectors that are null, empty, or hold null or non-finite
components, or without an id, take no part; vectors of different lengths never
meet (more than ``max_pivots`` lengths are an error); rows with
equal id and vector count once, and a row with the query's id is its own; ties
go to the smaller id; an empty table gives no rows. Scores are exact: products
are summed in float64 where they stay below 2**53, else as integers of any size
that fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import stored

SCALE = 1024
K = 10
MAX_PIVOTS = 1024
#: Rows of a cell that a pivot is chosen for, rows of a block, and queries of a block.
CELL_ROWS = 4096
BLOCK_ROWS = 4096
QUERY_ROWS = 2048


def quantized(vector: Column) -> Column:
    """floor(1024 x) of every component; null if a component is null or not finite, or there is none."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce((F.size(vector) > 0) & sound, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_list()).astype(np.int64) if len(values) else np.zeros((0, 0), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 2.0**53 else a @ b.T


def _by_length(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from frame.groupby(frame["v"].map(len), sort=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * (x @ pivots.T) + (pivots**2).sum(1), 0))


def _assigner(pivots: dict[int, tuple[np.ndarray, np.ndarray]]):
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, own in _by_length(frame):
                cells, centers = pivots[size]
                distance = _distances(_matrix(own["v"]), centers)
                near = distance.argmin(1)
                # A little more than the distance, for bounds that hold in floating point.
                yield own.assign(cell=cells[near], distance=distance[np.arange(len(own)), near] * (1 + 1e-9) + 1e-3)

    return assign


def _router(pivots, summaries: dict[int, tuple[int, float, list[float]]], k: int):
    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, own in _by_length(frame):
                cells, centers = pivots[size]
                known = [(i, summaries[int(c)]) for i, c in enumerate(cells) if int(c) in summaries]
                if not known:
                    continue
                index = np.asarray([i for i, _ in known])
                radius = np.asarray([s[1] for _, s in known])
                nearest = [(i, d) for i, s in known for d in s[2]]
                q = _matrix(own["v"]).astype(float)
                norm = np.sqrt((q**2).sum(1)) * (1 + 1e-9)
                to_pivot = q @ centers.astype(float).T
                lower = to_pivot[:, [i for i, _ in nearest]] - norm[:, None] * np.asarray([d for _, d in nearest])
                # The query's own row may be among the nearest ones, so one more than k bounds the k-th of the others.
                floor = np.partition(lower, -k - 1, axis=1)[:, -k - 1] if lower.shape[1] > k else np.full(len(q), -np.inf)
                floor -= 1e-6 * np.abs(floor) + 1
                reach = to_pivot[:, index] + norm[:, None] * radius + 1 >= floor[:, None]
                rows, columns = np.nonzero(reach)
                yield pd.DataFrame({"query_id": own["id"].to_numpy()[rows], "q": own["v"].to_numpy()[rows], "cell": cells[index[columns]], "floor": floor[rows]})

    return route


def _solver(k: int):
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        scores = _products(_matrix(queries["q"]), _matrix(data["v"]))
        ids, asked = data["id"].to_numpy(), queries["query_id"].to_numpy()
        floors = queries["floor"].to_numpy()
        out = []
        for i in range(len(asked)):
            found = np.flatnonzero((scores[i] >= floors[i]) & (ids != asked[i]))
            own = scores[i][found]
            if len(found) > k:
                least = np.partition(own, -k)[-k]
                found, own = found[own >= least], own[own >= least]
                best = np.lexsort((ids[found], -own))[:k]
                found, own = found[best], own[best]
            out.append(pd.DataFrame({"query_id": asked[i], "vec_id": ids[found], "score": own}))
        return pd.concat(out)

    return solve


def top_k(
    data: DataFrame, queries: DataFrame, *, k: int = K, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, max_pivots: int = MAX_PIVOTS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``data`` (id, v) with the highest inner product for each of ``queries`` (id, v).

    ``v`` are arrays of long without nulls, as ``quantized`` gives them.
    """
    spark = data.sparkSession
    data = stored(data.select("id", "v").where("id IS NOT NULL AND size(v) > 0").distinct(), "vectors")
    queries = queries.select("id", "v").where("id IS NOT NULL AND size(v) > 0").distinct()
    lengths = {r.n: r["count"] for r in data.groupBy(F.size("v").alias("n")).count().limit(max_pivots + 1).collect()}
    if len(lengths) > max_pivots:
        raise ValueError(f"vectors of more than {max_pivots} lengths")
    result = "query_id long, vec_id long, score long"
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots, cell = {}, 0
    for size, rows in lengths.items():
        wanted = min(max(1, -(-rows // cell_rows)), max(1, max_pivots // len(lengths)))
        chosen = data.where(F.size("v") == size).orderBy(F.xxhash64("id"), "id", "v").limit(wanted).collect()
        pivots[size] = (np.arange(cell, cell + len(chosen)), np.asarray([r.v for r in chosen], np.int64))
        cell += len(chosen)
    assigned = stored(data.mapInPandas(_assigner(pivots), "id long, v array<long>, cell long, distance double"), "cells")
    nearest = assigned.select("cell", "distance", F.row_number().over(Window.partitionBy("cell").orderBy("distance")).alias("place")).where(F.col("place") <= k + 1)
    nearest = nearest.groupBy("cell").agg(F.array_sort(F.collect_list("distance")).alias("nearest"))
    summary = assigned.groupBy("cell").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).join(nearest, "cell")
    summaries = {int(r.cell): (r["rows"], r.radius, list(r.nearest)) for r in summary.collect()}
    blocks = {c: -(-rows // block_rows) for c, (rows, _, _) in summaries.items()}
    routed = stored(queries.where(F.size("v").isin(list(lengths))).mapInPandas(_router(pivots, summaries, k), "query_id long, q array<long>, cell long, floor double"), "routed-queries")
    asked = {int(r.cell): -(-r["count"] // query_rows) for r in routed.groupBy("cell").count().collect()}
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    number = lambda of: F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col("cell"))
    part = lambda of, id: F.pmod(F.xxhash64(id), number(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), number(of).cast("long") - 1))
    wanted = assigned.where(F.col("cell").isin(list(asked)))
    left = routed.select("*", part(asked, "query_id").alias("query_block"), every(blocks).alias("block"))
    right = wanted.select("id", "v", "cell", part(blocks, "id").alias("block"), every(asked).alias("query_block"))
    keys = ("cell", "block", "query_block")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_solver(k), result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
