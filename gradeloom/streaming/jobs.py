"""Structured Streaming jobs. Sinks are tables in a shared folder; nothing passes through the driver."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gradeloom.operators.changes import late_decisions
from gradeloom.operators.common import latest
from gradeloom.operators.quota import Limits, decide
from gradeloom.sources.files import content_hash, drop_artifacts, file_name, sniff_type


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """Image files as they arrive; unreadable types are kept as rows with a NULL type."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    named = drop_artifacts(files.withColumn("file_name", file_name(F.col("path"))), "file_name")
    return named.withColumn("type", sniff_type(F.col("content"))).withColumn("sha256", content_hash(F.col("content"))).drop("content")


def stream_ingest(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First arrival of every content per exam; state is dropped once the watermark passes.

    ``files``: exam_id, sha256, at. A content that comes back after the delay
    is caught by the batch ingest against the source table.
    """
    return files.withWatermark("at", delay).dropDuplicatesWithinWatermark(["exam_id", "sha256"])


def stream_sessions(uploads: DataFrame, gap: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Files and bytes per closed upload session. ``uploads``: session_id, at, bytes."""
    windows = uploads.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), "session_id")
    return windows.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).select(
        "session_id", F.col("w.start").alias("opened"), F.col("w.end").alias("closes"), "files", "bytes"
    )


def stream_progress(work: DataFrame) -> DataFrame:
    """Done and total per room, in update mode. ``work``: room_id, done."""
    return work.groupBy("room_id").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("done").cast("bigint")).alias("done"))


def observed_progress(work: DataFrame, name: str = "progress") -> DataFrame:
    """``work`` (room_id, done) with its rows and finished rows counted per micro-batch on the way, for ``ProgressRows``."""
    done = F.coalesce(F.sum(F.col("done").cast("bigint")), F.lit(0))
    return work.observe(name, F.count(F.lit(1)).alias("total"), done.alias("done"))


class ProgressRows(StreamingQueryListener):
    """Turns the counts that streams observe into rows: one per query and micro-batch, with running totals and what is pending.

    Add it with ``spark.streams.addListener``. It holds four numbers a
    micro-batch; ``rows`` empties it.
    """

    def __init__(self, name: str = "progress"):
        self.name = name
        self.seen: list[tuple] = []
        self.totals: dict[str, tuple[int, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        counted = event.progress.observedMetrics.get(self.name)
        if counted is not None:
            run = str(event.progress.runId)
            total, done = self.totals.get(run, (0, 0))
            total, done = total + counted["total"], done + counted["done"]
            self.totals[run] = total, done
            self.seen.append((run, event.progress.batchId, counted["total"], counted["done"], total, done, total - done))

    def onQueryTerminated(self, event) -> None:
        self.totals.pop(str(event.runId), None)
        self.ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Until the events of a query that has ended are all here; Spark sends them after it."""
        until = time.monotonic() + seconds
        while str(query.runId) not in self.ended and time.monotonic() < until:
            time.sleep(0.05)

    def rows(self, spark: SparkSession) -> DataFrame:
        """Progress rows since the last call."""
        seen, self.seen = self.seen, []
        return spark.createDataFrame(seen, "run_id string, batch bigint, batch_total bigint, batch_done bigint, total bigint, done bigint, pending bigint")


@contextmanager
def progress_rows(spark: SparkSession, name: str = "progress") -> Iterator[ProgressRows]:
    """A listener for the queries that run inside."""
    listener = ProgressRows(name)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)


#: Buckets that sessions are dealt to; each is one key of the state.
BUCKETS = 256
#: Decisions that are handed over at once.
ANSWERS = 100_000
DECISIONS = np.asarray(["accepted", "session_full", "too_many_files", "file_too_large", "session_expired"], dtype=object)


def _unpacked(raw, width: int) -> np.ndarray:
    """Rows of ``width`` numbers."""
    return np.frombuffer(raw or b"", np.int64).reshape(-1, width)


class Admission(StatefulProcessor):
    """Decides the uploads of each session in (at, seq) order, whatever order they arrive in.

    A key is a bucket of sessions: every call to the state store is a trip, so a
    batch makes a few of them a bucket and none a session. Arrivals wait in a
    list, packed, until the watermark has passed their time: nothing earlier can
    come then. One timer a bucket stands at the earliest time that waits. Once
    the start of a session is final, an arrival that is certain to be refused
    (expired, too large, or the files are used up) is answered at once, so that
    a hot session keeps no long list. A session that has expired stays as its
    number: a later upload is expired, it does not open a new session.
    """

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "rows binary, timer bigint")  # session, start, files, used
        self.gone = handle.getValueState("gone", "sessions binary")
        self.waiting = handle.getListState("waiting", "rows binary")  # session, at, seq, bytes

    def _gone(self) -> np.ndarray:
        return _unpacked((self.gone.get() or (None,))[0], 1)[:, 0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        held, timer = self.live.get() or (None, -1)
        live, gone = _unpacked(held, 4), self._gone()
        came = np.concatenate([_unpacked(None, 4), *(_arrivals(frame, key[0]) for frame in rows)])
        session, at, size = came[:, 0], came[:, 1], came[:, 3]
        old = np.isin(session, gone)
        live = _opened(live, came[~old])
        place = np.minimum(np.searchsorted(live[:, 0], session), max(len(live) - 1, 0))
        decision = np.full(len(came), -1)
        if len(live):
            start, files = live[place, 1], live[place, 2]
            sure = start <= done  # no earlier start can come
            decision[sure & (files >= self.limits.files)] = 2
            decision[sure & (size > self.limits.file_bytes)] = 3
            decision[sure & (at - start >= self.limits.seconds * 1_000_000)] = 4
        decision[old] = 4
        told = decision >= 0
        yield from _answers(key[0], came[told], decision[told])
        wait = came[~told]
        if len(wait):
            self.waiting.appendValue((wait.tobytes(),))
            timer = self._timed(timer, int(wait[:, 1].min()))
        self.live.update((live.tobytes(), timer))

    def _timed(self, timer: int, earliest: int) -> int:
        """The bucket's one timer, moved forward to ``earliest`` if that comes first."""
        wanted = -(-earliest // 1000)
        if timer < 0 or wanted < timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(wanted)
            return wanted
        return timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = timerValues.getCurrentWatermarkInMs() * 1000
        live = _unpacked(self.live.get()[0], 4).copy()
        rows = np.concatenate([_unpacked(None, 4), *(_unpacked(row[0], 4) for row in self.waiting.get())])
        ready, later, timer = rows[rows[:, 1] <= done], rows[rows[:, 1] > done], -1
        ready = ready[np.lexsort((ready[:, 2], ready[:, 1], ready[:, 0]))]
        yield from _answers(key[0], ready, self._decided(live, ready))
        if len(later):
            self.waiting.put([(later.tobytes(),)])
            timer = self._timed(-1, int(later[:, 1].min()))
        else:
            self.waiting.clear()
        over = (live[:, 1] + self.limits.seconds * 1_000_000 <= done) & ~np.isin(live[:, 0], later[:, 0])
        if over.any():
            self.gone.update((np.union1d(self._gone(), live[over, 0]).tobytes(),))
        self.live.update((live[~over].tobytes(), timer))

    def _decided(self, live: np.ndarray, ready: np.ndarray) -> np.ndarray:
        """Places in ``DECISIONS`` for rows by session, in order; ``live`` takes what is accepted."""
        place, out, names = np.searchsorted(live[:, 0], ready[:, 0]), [], {name: i for i, name in enumerate(DECISIONS)}
        own = start = files = used = None
        for i, at, size in zip(place.tolist(), ready[:, 1].tolist(), ready[:, 3].tolist(), strict=True):
            if i != own:
                if own is not None:
                    live[own, 2:] = files, used
                own, (start, files, used) = i, live[i, 1:].tolist()
            decision = decide(start, files, used, at, size, self.limits)
            if decision == "accepted":
                files, used = files + 1, used + size
            out.append(names[decision])
        if own is not None:
            live[own, 2:] = files, used
        return np.asarray(out, np.int64)

    def close(self) -> None:
        pass


def _arrivals(frame: pd.DataFrame, bucket: int) -> np.ndarray:
    """Rows (session, at, seq, bytes) as numbers; bucket -1 holds the uploads without a session, as session 0."""
    at = frame["at"].astype("datetime64[us]").astype("int64")
    session = frame["session_id"] if bucket >= 0 else np.zeros(len(frame), np.int64)
    return np.column_stack([np.asarray(x).astype(np.int64) for x in (session, at, _whole(frame["seq"]), _whole(frame["bytes"]))])


def _whole(values: pd.Series) -> pd.Series:
    if values.isna().any():
        raise ValueError(f"an upload without {values.name}")
    return values


def _opened(live: np.ndarray, came: np.ndarray) -> np.ndarray:
    """Sessions with those that ``came``, each from its earliest upload, sorted."""
    sessions, at = np.unique(came[:, 0], return_inverse=True)
    first = np.full(len(sessions), np.iinfo(np.int64).max)
    np.minimum.at(first, at, came[:, 1])
    fresh = np.column_stack([sessions, first, np.zeros((len(sessions), 2), np.int64)])
    both = np.concatenate([live, fresh])
    both = both[np.argsort(both[:, 0], kind="stable")]  # what is held comes before what came
    new = np.r_[True, both[1:, 0] != both[:-1, 0]] if len(both) else np.zeros(0, bool)
    out = both[new]
    if len(both):
        out[:, 1] = np.minimum.reduceat(both[:, 1], np.flatnonzero(new))
    return out


def _answers(bucket: int, rows: np.ndarray, decision: np.ndarray) -> Iterator[pd.DataFrame]:
    """Decisions (session_id, seq, at, bytes, decision) of rows (session, at, seq, bytes)."""
    for first in range(0, len(rows), ANSWERS):
        session, at, seq, size = rows[first : first + ANSWERS].T
        frame = pd.DataFrame({"session_id": session, "seq": seq, "at": pd.to_datetime(at, unit="us"), "bytes": size, "decision": DECISIONS[decision[first : first + ANSWERS]]})
        yield frame if bucket >= 0 else frame.assign(session_id=pd.Series(None, index=frame.index, dtype="Int64"))


#: The state store that the state API needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB) -> Iterator[None]:
    """Queries started inside keep their state in ``provider``; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stream_quota(uploads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Accept or reject uploads exactly as ``quota_exact`` does, as soon as the watermark allows.

    ``uploads``: session_id, seq, at (timestamp), bytes; the watermark is on
    ``at``. Uploads up to the watermark's delay late are decided in their place;
    later ones Spark drops. Gives session_id, seq, at, bytes, decision. Start the
    query in a session whose state store is ``ROCKSDB``.
    """
    bucket = F.when(F.col("session_id").isNotNull(), F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS))).otherwise(-1)
    return uploads.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Admission(limits), outputStructType="session_id bigint, seq bigint, at timestamp, bytes bigint, decision string", outputMode="Append", timeMode="EventTime"
    )


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now into a parquet folder, then stop."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_batch(rows: DataFrame, target: str, batch: int) -> None:
    """One folder per micro-batch, overwritten when the batch is retried."""
    rows.write.mode("overwrite").parquet(f"{target}/batch={batch:012d}")


def latest_writer(target: str, key: str, order: str = "seq") -> Callable[[DataFrame, int], None]:
    """Latest-wins log: each micro-batch adds its newest row per key; readers use ``latest_table``."""
    return lambda rows, batch: write_batch(latest(rows, key, order), target, batch)


def latest_table(spark: SparkSession, target: str, key: str, order: str = "seq") -> DataFrame:
    return latest(spark.read.parquet(target), key, order)


def compact(spark: SparkSession, target: str, compacted: str, key: str, order: str = "seq") -> None:
    """Write the current state as a fresh log with a single batch."""
    write_batch(latest_table(spark, target, key, order).drop("batch"), compacted, 0)


def guard_writer(applied: str, rejected: str, key_now: DataFrame, detection_now: DataFrame, sources: DataFrame) -> Callable[[DataFrame, int], None]:
    """Stream-static check of decisions against the current key and detection; two sinks."""

    def apply(rows: DataFrame, batch: int) -> None:
        judged = late_decisions(rows, key_now, detection_now, sources)
        write_batch(judged.where("outcome = 'applied'"), applied, batch)
        write_batch(judged.where("outcome <> 'applied'"), rejected, batch)

    return apply
