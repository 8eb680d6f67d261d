"""Upload quotas per session: limits on file size, files, bytes and session age."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.common import running_sum
from gradeloom.session import cut


@dataclass(frozen=True)
class Limits:
    # Defaults of an upload session.
    file_bytes: int = 50 * 1024 * 1024
    session_bytes: int = 1024 * 1024 * 1024
    files: int = 200
    seconds: int = 15 * 60


def _seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def quota(uploads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Conservative form: every upload that is not too large counts against its session.

    Running counts and sums are built from bounded chunks of the clock, so a
    session of any size is fine.
    """
    starts = uploads.groupBy("session_id").agg(F.min(_seconds("ts")).alias("_start"))
    sized = uploads.withColumn("_counted", F.when(F.col("bytes") <= limits.file_bytes, F.col("bytes")).otherwise(F.lit(0)))
    rows = running_sum(sized, ["session_id"], "seq", "_counted", "used_bytes")
    fits = rows.withColumn("_fit", (F.col("bytes") <= limits.file_bytes).cast("bigint"))
    rows = running_sum(fits, ["session_id"], "seq", "_fit", "used_files").join(starts, "session_id")
    reason = (
        F.when(_seconds("ts") - F.col("_start") >= limits.seconds * 1_000_000, "session_expired")
        .when(F.col("bytes") > limits.file_bytes, "file_too_large").when(F.col("used_files") > limits.files, "too_many_files")
        .when(F.col("used_bytes") > limits.session_bytes, "session_full").otherwise("accepted")
    )
    return rows.select("session_id", "seq", "bytes", "used_files", "used_bytes", reason.alias("decision"))


def decide(start: int, files: int, used: int, at: int, size: int, limits: Limits) -> str:
    """Exact decision of one upload given what its session has accepted so far."""
    if at - start >= limits.seconds * 1_000_000:
        return "session_expired"
    if size > limits.file_bytes:
        return "file_too_large"
    if files >= limits.files:
        return "too_many_files"
    return "session_full" if used + size > limits.session_bytes else "accepted"


def quota_exact(uploads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Exact form: a rejected upload uses nothing, so what a session accepts depends on all it accepted before.

    Uploads are sorted by (session, ts, seq) over range partitions; the part of
    a session in one partition is a chunk, of which the smallest upload that
    could still be accepted is kept. A round takes, for every open session, the
    first chunk after its frontier that holds an upload small enough for the
    room left, and scans that chunk alone. Chunks in between accept nothing and
    are never read for it. A session accepts at most ``files`` uploads, so it
    has at most as many rounds; most end in one. No task sees more of a session
    than one chunk.
    """
    rows = uploads.select("session_id", "seq", "bytes", _seconds("ts").alias("at"))
    dealt = rows.repartitionByRange("session_id", "at", "seq").withColumn("part", F.spark_partition_id())
    rows = cut(dealt.sortWithinPartitions("session_id", "at", "seq"), "uploads")
    starts = rows.groupBy("session_id").agg(F.min("at").alias("start"))
    live = (F.col("at") - F.col("start") < limits.seconds * 1_000_000) & (F.col("bytes") <= limits.file_bytes)
    chunks = rows.join(starts, "session_id").groupBy("session_id", "part", "start").agg(F.min(F.when(live, F.col("bytes"))).alias("least"))
    chunks = cut(chunks, "chunks")
    state = chunks.select("session_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("used")).distinct()
    states, scanned = [state], []
    while True:
        ahead = chunks.join(state.withColumnRenamed("part", "frontier"), "session_id").where(
            (F.col("part") > F.col("frontier")) & (F.col("files") < limits.files) & (F.col("least") <= limits.session_bytes - F.col("used"))
        )
        following = cut(ahead.groupBy("session_id", "start", "files", "used").agg(F.min("part").alias("part")), "following")
        if following.isEmpty():
            break
        found = rows.join(following, ["session_id", "part"]).repartition("session_id", "part").sortWithinPartitions("session_id", "part", "at", "seq")
        done = cut(found.mapInPandas(_scanner(limits), "session_id bigint, part int, seq bigint, bytes bigint, decision string, files bigint, used bigint, last boolean"), "scanned")
        scanned.append(done.select("session_id", "part", "seq", "bytes", "decision"))
        state = done.where("last").select("session_id", "part", "files", "used")
        states.append(state)
    return _decided(rows, chunks, states, scanned, limits)


def _scanner(limits: Limits):
    """Decides the rows of chunks in order; the last row of each carries the state after it."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, files, used, held = None, 0, 0, []
        for frame in frames:
            out = []
            for row in frame[["session_id", "part", "seq", "bytes", "at", "start", "files", "used"]].itertuples(index=False):
                if (row.session_id, row.part) != chunk:
                    out += [(*r, True) for r in held]
                    chunk, files, used, held = (row.session_id, row.part), row.files, row.used, []
                decision = decide(row.start, files, used, row.at, row.bytes, limits)
                if decision == "accepted":
                    files, used = files + 1, used + row.bytes
                out += [(*r, False) for r in held]
                held = [(row.session_id, row.part, row.seq, row.bytes, decision, files, used)]
            yield pd.DataFrame(out, columns=_SCANNED)
        yield pd.DataFrame([(*r, True) for r in held], columns=_SCANNED)

    return scan


_SCANNED = ["session_id", "part", "seq", "bytes", "decision", "files", "used", "last"]


def _decided(rows: DataFrame, chunks: DataFrame, states: list[DataFrame], scanned: list[DataFrame], limits: Limits) -> DataFrame:
    """All decisions: of scanned chunks as scanned; in the others nothing fits the state that reached them."""
    known = reduce(DataFrame.unionByName, [s.withColumnRenamed("part", "upto") for s in states])
    reached = chunks.join(known, "session_id").where("upto < part").groupBy("session_id", "part", "start").agg(F.max_by(F.struct("files", "used"), "upto").alias("state"))
    out = rows
    for done in scanned:
        out = out.join(done.select("session_id", "part").distinct(), ["session_id", "part"], "left_anti")
    decision = (
        F.when(F.col("at") - F.col("start") >= limits.seconds * 1_000_000, "session_expired")
        .when(F.col("bytes") > limits.file_bytes, "file_too_large").when(F.col("state.files") >= limits.files, "too_many_files").otherwise("session_full")
    )
    rest = out.join(reached, ["session_id", "part"]).select("session_id", "seq", "bytes", decision.alias("decision"))
    return reduce(DataFrame.unionByName, [*[d.drop("part") for d in scanned], rest])
