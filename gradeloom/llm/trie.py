"""Prefix trie of conversations by range minima over sorted common prefixes.

A conversation is the sequence of its turns (role, text); every distinct
sequence of first d turns is a node of depth d, from the root without turns.
Each turn becomes 16 bytes of its SHA-256, so that a conversation is one binary
key of 16 bytes a turn (and the lengths of its texts) whatever its texts hold.

Conversations are sorted by key and id over range partitions, where copies are
told apart by id, so that a sequence that a third of all conversations share is
split like any other. A partition computes the common prefix of each row with
the one before, and a sparse table of minima over these. A prefix is a
candidate at the first row that has it. Every candidate searches both ways by
halving steps through the table, independently of all others and without a
stack: to the right for the last row that has it, to the left for the first row
of its parent. What a node tells of its subtree are differences of running sums
over its interval of rows, and a range minimum of ids.

Only prefixes of a partition's first or last row can go on in another one.
These open nodes, at most two paths a partition, come out with partial counts
and are summed over partitions, less what the seam between two partitions
counts twice; all others are done where they were found. The ids that end in
one open node are hashed in order by one task, streaming, as SHA-256 demands.

Defined results: rows without conv_id belong to no conversation; null role or
text is empty; turns of one conversation go by turn (null first), then role,
then digest, and repeated rows are turns of their own; an empty table has no
nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import stored

WIDTH = 16  # bytes of a turn in a key
_NONE = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, key, chars): the turn digests of each conversation in order, and the code points of its texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    narrow = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).alias("turn"))
    own = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return own.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.chars").alias("chars"))


def rebuilt(given: DataFrame, *, group: int = 100, most: int = 6) -> DataFrame:
    """Sequences with the first h turns, h = crc32(conv_id) % ``most``, taken from the conversation that heads their group of ids."""
    heads = given.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head"), F.substring("key", 1, WIDTH * (most - 1)).alias("head_key"), F.slice("chars", 1, most - 1).alias("head_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = given.withColumns({"head": F.col("conv_id") - F.col("conv_id") % group, "h": h}).join(heads, "head", "left")
    key = F.concat(F.coalesce(F.substring("head_key", F.lit(1), WIDTH * F.col("h")), F.lit(b"")), F.expr(f"substring(key, {WIDTH} * h + 1)"))
    chars = F.concat(F.coalesce(F.slice("head_chars", F.lit(1), F.col("h")), F.array().cast("array<long>")), F.slice("chars", F.col("h") + 1, F.size("chars")))
    return both.select("conv_id", key.alias("key"), chars.alias("chars"))


class Minima:
    """Sparse table: level k holds the minima of 2^k entries from each place on."""

    def __init__(self, values: np.ndarray):
        self.levels, width = [values], 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of the entries low to high, both included."""
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - (1 << k) + 1])
        return out

    def right(self, row: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place that is reached from ``row`` over entries of at least ``least``."""
        row, top = row.copy(), len(self.levels[0]) - 1
        for k in reversed(range(len(self.levels))):
            ahead = row + (1 << k) <= top
            row[ahead] += np.where(self.levels[k][row[ahead] + 1] >= least[ahead], 1 << k, 0)
        return row

    def left(self, row: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from which ``row`` is reached over entries of at least ``least``."""
        row = row.copy()
        for k in reversed(range(len(self.levels))):
            behind = row - (1 << k) >= 0
            row[behind] -= np.where(self.levels[k][row[behind] - (1 << k) + 1] >= least[behind], 1 << k, 0)
        return row


def common(lanes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Turns that each row shares with the one before; -1 for the first."""
    least = np.minimum(sizes[:-1], sizes[1:])
    stops = np.cumsum(least)
    pair = np.repeat(np.arange(len(least)), least)
    at = np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - least, least)
    differ = (lanes[starts[:-1][pair] + at] != lanes[starts[1:][pair] + at]).any(axis=1)
    out = least.copy()
    where = np.flatnonzero(differ)[::-1]
    out[pair[where]] = at[where]  # from the back, so that the first difference stays
    return np.r_[-1, out]


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0 to count - 1, for each count in turn."""
    stops = np.cumsum(counts)
    return np.arange(stops[-1] if len(stops) else 0) - np.repeat(stops - counts, counts)


def ends_hash(ids: np.ndarray, digest=None):
    """SHA-256 over comma-joined ids, to be continued."""
    text = ",".join(map(str, ids.tolist())).encode()
    if digest is None:
        return hashlib.sha256(text)
    digest.update(b"," + text)
    return digest


def nodes(ids: np.ndarray, keys: list[bytes], chars: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray | list]:
    """The nodes of one partition's sorted rows, as columns."""
    m = len(ids)
    starts = np.r_[0, np.cumsum(sizes)]
    lanes = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    shared = common(lanes, starts[:-1], sizes)
    minima, least_id = Minima(shared), Minima(ids)
    # Code points of the first d turns of row i, at starts[i] + i + d.
    sums = np.r_[0, np.cumsum(chars)]
    until = sums[np.repeat(starts[:-1], sizes + 1) + _ranges(sizes + 1)] - np.repeat(sums[starts[:-1]], sizes + 1)
    base = starts[:-1] + np.arange(m)
    total = until[base + sizes]
    fresh = np.r_[0, (total - until[base + np.maximum(shared, 0)])[1:]]  # of the nodes that row i adds; the first row is the seam's
    leaf = np.r_[shared[1:] < sizes[:-1], True]
    all_sums, new_sums, leaf_sums = (np.r_[0, np.cumsum(x)] for x in (total, fresh, leaf))
    # Candidates: the prefixes that row i has and the row before has not.
    count = sizes - shared
    first = np.r_[0, np.cumsum(count)]
    row = np.repeat(np.arange(m), count)
    depth = _ranges(count) + shared[row] + 1
    last = minima.right(row, depth)
    above = minima.left(row, depth - 1)
    parent = np.where(depth > 0, first[above] + depth - 1 - (shared[above] + 1), -1)
    children = np.bincount(parent[depth > 0], minlength=len(row))
    low_chars = np.where(depth > 0, until[base[row] + np.maximum(depth - 1, 0)], 0)
    new = new_sums[last + 1] - new_sums[row + 1] + np.where(row > 0, total[row] - low_chars, 0)
    same = np.r_[False, (shared[1:] == sizes[:-1]) & (shared[1:] == sizes[1:])]  # a copy of the row before
    group_end = np.flatnonzero(np.r_[~same[1:], True])
    copies = group_end[np.searchsorted(group_end, np.arange(m))] + 1
    n_ends = np.where(sizes[row] == depth, copies[row] - row, 0)
    return {
        "row": row, "depth": depth, "last": last, "parent": parent, "conv_id": least_id.between(row, last), "n_convs": last - row + 1,
        "n_children": children, "n_leaves": leaf_sums[last + 1] - leaf_sums[row], "chars": all_sums[last + 1] - all_sums[row], "base": low_chars, "new": new,
        "n_ends": n_ends, "until": until[base[row] + depth], "total": total[row], "whole": sizes[row] == depth, "tail_whole": sizes[last] == depth,
    }


_FIELDS = {
    "part": pa.int32(), "id": pa.binary(), "parent_id": pa.binary(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(),
    "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string(), "ends": pa.list_(pa.int64()),
    "chars": pa.int64(), "base": pa.int64(), "new": pa.int64(), "until": pa.int64(), "total": pa.int64(), "at_first": pa.bool_(), "at_last": pa.bool_(), "whole": pa.bool_(), "tail_whole": pa.bool_(),
}
_KIND = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
_ROWS = 1 << 16


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition: done ones have an ends_sha256; open ones an id and what is known of them here."""
    held = list(batches)
    if not sum(b.num_rows for b in held):
        return
    table = pa.Table.from_batches(held).combine_chunks()
    ids, keys = table["conv_id"].to_numpy(), table["key"].to_pylist()
    lists = table["chars"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    got = nodes(ids, keys, lists.flatten().to_numpy(), sizes)
    m, part = len(ids), TaskContext.get().partitionId()
    open_ = (got["row"] == 0) | (got["last"] == m - 1)
    saved = got["chars"] - got["n_convs"] * got["base"] - got["new"]
    name = {-1: None}

    def named(k: int) -> bytes | None:
        if k not in name:
            name[k] = hashlib.sha256(keys[got["row"][k]][: WIDTH * int(got["depth"][k])]).digest()[:WIDTH] + int(got["depth"][k]).to_bytes(8, "big")
        return name[k]

    for low in range(0, len(open_), _ROWS):
        part_of = slice(low, low + _ROWS)
        own, up, here = open_[part_of], got["parent"][part_of], range(low, min(low + _ROWS, len(open_)))
        up_open = (up >= 0) & open_[up]
        runs = [ids[r : r + e] for r, e in zip(got["row"][part_of].tolist(), got["n_ends"][part_of].tolist(), strict=True)]
        columns = {
            "part": np.full(len(own), part, np.int32),
            "id": [named(k) if o else None for k, o in zip(here, own.tolist(), strict=True)],
            "parent_id": [named(k) if o else None for k, o in zip(up.tolist(), up_open.tolist(), strict=True)],
            "parent_conv_id": pa.array(got["conv_id"][up], mask=(up < 0) | up_open),
            "saved_tokens": pa.array(saved[part_of], mask=own),
            "ends_sha256": [None if o else ends_hash(r).hexdigest() if len(r) else _NONE for o, r in zip(own.tolist(), runs, strict=True)],
            "ends": [r if o and len(r) else None for o, r in zip(own.tolist(), runs, strict=True)],
            "at_first": got["row"][part_of] == 0, "at_last": got["last"][part_of] == m - 1,
        }
        arrays = [pa.array(columns[c] if c in columns else got[c][part_of], kind) if not isinstance(columns.get(c), pa.Array) else columns[c].cast(kind) for c, kind in _FIELDS.items()]
        yield pa.RecordBatch.from_arrays(arrays, list(_FIELDS))


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, ends) by id and partition; the ids of one node follow each other through one hash."""
    open_id, digest = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("id").to_pylist(), batch.column("ends"), strict=True):
            if key != open_id:
                if digest is not None:
                    done.append((open_id, digest.hexdigest()))
                open_id, digest = key, None
            digest = ends_hash(ids.values.to_numpy(), digest)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["id", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_id], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["id", "ends_sha256"])


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(given: DataFrame) -> DataFrame:
    """One row per node of the trie of ``given`` (conv_id, key, chars).

    conv_id (smallest member; its first ``depth`` turns are the node's prefix),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.
    """
    rows = stored(given.select(F.col("conv_id").cast("long").alias("conv_id"), "key", "chars"), "sequences")
    dealt = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = stored(dealt.mapInArrow(_partition, ", ".join(f"{c} {_KIND[k]}" for c, k in _FIELDS.items())), "nodes")
    open_, done = found.where("id IS NOT NULL"), found.where("id IS NULL")
    # Seams: how deep the first row of a partition agrees with the last row of the one before, one row a partition.
    parts = open_.where("depth = 0").select("part", F.lag("part").over(Window.orderBy("part")).alias("before"))
    tail = open_.where("at_last").select(F.col("part").alias("before"), "id", "tail_whole")
    head = open_.where("at_first").select("part", "id", "depth", "until")
    seams = parts.join(head, "part").join(tail, ["before", "id"]).groupBy("part", "before").agg(F.max("depth").alias("seam"), F.max("until").alias("seam_chars"), F.max_by("tail_whole", "depth").alias("repeated"))
    back = seams.where("repeated").select(F.col("before").alias("part"), F.lit(1).alias("not_leaf"))
    met = open_.join(seams.select("part", "seam", "seam_chars"), "part", "left").join(back, "part", "left")
    seam, at_first = F.coalesce("seam", F.lit(-1)), F.col("at_first")
    # The first row counts as the first of its node, unless the node began in an earlier partition.
    first_new = F.when(at_first, F.col("total") - F.when(seam >= F.col("depth"), F.col("seam_chars")).otherwise(F.col("base"))).otherwise(0)
    partial = met.select(
        "id", "parent_id", "depth", "conv_id", "n_convs", "chars", "base",
        (F.col("n_children") - F.when(at_first & ~F.col("whole") & (seam > F.col("depth")), 1).otherwise(0)).alias("n_children"),
        (F.col("n_leaves") - F.when(F.col("at_last"), F.coalesce("not_leaf", F.lit(0))).otherwise(0)).alias("n_leaves"),
        (F.col("new") + first_new).alias("new"),
    )
    merged = partial.groupBy("id", "parent_id", "depth", "base").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "chars", "new")]
    ).withColumn("saved_tokens", F.col("chars") - F.col("n_convs") * F.col("base") - F.col("new"))
    merged = stored(merged, "open")
    ends = open_.where("ends IS NOT NULL").select("id", "part", "ends").repartition("id").sortWithinPartitions("id", "part")
    ends = ends.select("id", "ends").mapInArrow(_hashed_ends, "id binary, ends_sha256 string")
    up = merged.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("up_conv"))
    whole = merged.join(up, "parent_id", "left").join(ends, "id", "left")
    whole = whole.withColumns({"parent_conv_id": F.col("up_conv"), "ends_sha256": F.coalesce("ends_sha256", F.lit(_NONE))})
    # Parents of done nodes: within their partition, or an open node of it.
    ups = open_.select("part", F.col("id").alias("parent_id")).join(up, "parent_id")
    closed = done.join(ups, ["part", "parent_id"], "left").withColumn("parent_conv_id", F.coalesce("up_conv", "parent_conv_id"))
    return closed.select(*_RESULT).unionAll(whole.select(*_RESULT))
