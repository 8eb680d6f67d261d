"""Streams replayed from the given tables, and the batch forms they must agree with."""

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators import grading as G
from gradeloom.operators.common import latest
from gradeloom.operators.quota import Limits, quota, quota_exact
from gradeloom.plans.registry import SHARED, query
from gradeloom.session import checkpoint_dir
from gradeloom.streaming import jobs as J

LIMITS = Limits(file_bytes=9_000_000, session_bytes=100_000_000, files=30, seconds=30 * 86400)


def workspace(v) -> str:
    return f"{checkpoint_dir(v.spark)}/stream-{uuid4().hex}"


def replay(v, rows: DataFrame, folder: str) -> DataFrame:
    """The rows as a file stream."""
    rows.write.parquet(f"{folder}/in")
    return v.spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


def replay_batches(v, rows: DataFrame, batch, n: int, folder: str) -> DataFrame:
    """The rows as a file stream of ``n`` micro-batches, one file each, in order."""
    dealt = rows.withColumn("_batch", batch.cast("int"))
    dealt.write.partitionBy("_batch").parquet(f"{folder}/arrivals")  # each file below reads its own rows alone
    kept = v.spark.read.schema(dealt.schema).parquet(f"{folder}/arrivals")
    for k in range(n):
        kept.where(F.col("_batch") == k).drop("_batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def read(v, path: str) -> DataFrame:
    return v.spark.read.parquet(path)


@query("quota", "W15", """
SELECT session_id, seq, bytes, used_files, used_bytes, CASE WHEN old THEN 'session_expired' WHEN bytes > 9000000 THEN 'file_too_large' WHEN used_files > 30 THEN 'too_many_files' WHEN used_bytes > 100000000 THEN 'session_full' ELSE 'accepted' END AS decision
FROM (SELECT *, ts - min(ts) OVER (PARTITION BY session_id) >= INTERVAL 30 DAY AS old, CAST(sum(CASE WHEN bytes <= 9000000 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS used_files,
  CAST(sum(CASE WHEN bytes <= 9000000 THEN bytes ELSE 0 END) OVER w AS BIGINT) AS used_bytes FROM v_uploads WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))""")
def quota_query(v):
    return quota(v.uploads, LIMITS)


# Uploads one after the other in (ts, seq) order; what a session has accepted goes from step to step.
SHARED["o_quota_steps"] = """
SELECT session_id, seq, ts, bytes, ts - min(ts) OVER (PARTITION BY session_id) >= INTERVAL 30 DAY AS old, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS i FROM v_uploads"""
QUOTA_EXACT = """
WITH RECURSIVE steps AS MATERIALIZED (SELECT * FROM o_quota_steps),
walk AS (
  SELECT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS files, CAST(0 AS BIGINT) AS used, '' AS decision FROM (SELECT DISTINCT session_id FROM steps)
  UNION ALL
  SELECT session_id, i, seq, ts, bytes, files + CAST(decision = 'accepted' AS BIGINT), used + CASE WHEN decision = 'accepted' THEN bytes ELSE 0 END, decision
  FROM (SELECT s.session_id, s.i, s.seq, s.ts, s.bytes, w.files, w.used, CASE WHEN old THEN 'session_expired' WHEN s.bytes > 9000000 THEN 'file_too_large' WHEN w.files >= 30 THEN 'too_many_files' WHEN w.used + s.bytes > 100000000 THEN 'session_full' ELSE 'accepted' END AS decision
        FROM walk w JOIN steps s ON s.session_id = w.session_id AND s.i = w.i + 1))
SELECT session_id, seq, bytes, decision FROM walk WHERE i > 0"""


@query("quota_exact", "W15", QUOTA_EXACT)
def quota_exact_query(v):
    return quota_exact(v.uploads, LIMITS)


@query("stream_quota", "ST2", QUOTA_EXACT + " AND ts <= (SELECT max(ts) - INTERVAL 1 DAY FROM v_uploads)")
def stream_quota(v):
    """Six micro-batches; every third upload arrives in the batch after its own, within the watermark's delay of a day."""
    folder = workspace(v)
    uploads = v.uploads.select("session_id", "seq", F.col("ts").cast("timestamp").alias("at"), "bytes")
    edges = uploads.agg(F.min("at").cast("double").alias("low"), F.max("at").cast("double").alias("high")).first()
    late = F.when(F.col("seq") % 3 == 0, 43_200).otherwise(0)
    batch = F.least(F.floor((F.col("at").cast("double") + late - edges.low) * 6 / (edges.high - edges.low)), F.lit(5))
    stream = J.stream_quota(replay_batches(v, uploads, batch, 6, folder).withWatermark("at", "1 day"), LIMITS)
    with J.state_store(v.spark):
        J.run_available(stream, f"{folder}/out", f"{folder}/check")
    decided = F.col("at").cast("double") <= F.lit(edges.high - 86_400)  # what the last watermark has passed
    return read(v, f"{folder}/out").where(decided).select("session_id", "seq", "bytes", "decision")


@query("stream_ingest", "ST1", "SELECT DISTINCT exam_id, sha256(content) AS sha256 FROM v_files")
def stream_ingest(v):
    """One file a second in four micro-batches; contents come back within the delay at these sizes, as a batch of scans does."""
    folder = workspace(v)
    files = v.files.select("exam_id", F.sha2("content", 256).alias("sha256"), F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("file_id") * 10).alias("at"))
    last = files.agg(F.max("at")).first()[0]
    batch = F.least(F.floor((F.col("at").cast("double") - 1.7e9) * 4 / F.greatest(F.lit(last).cast("double") - 1.7e9, F.lit(1e-3))), F.lit(3))
    J.run_available(J.stream_ingest(replay_batches(v, files, batch, 4, folder)), f"{folder}/out", f"{folder}/check")
    return read(v, f"{folder}/out").select("exam_id", "sha256")


@query("stream_sessions", "ST3", """
WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS fresh FROM v_uploads),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT session_id, min(ts) AS opened, max(ts) + INTERVAL 15 MINUTE AS closes, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY session_id, n
HAVING max(ts) + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM v_uploads)""")
def stream_sessions(v):
    folder = workspace(v)
    uploads = v.uploads.select("session_id", F.col("ts").cast("timestamp").alias("at"), "bytes")
    J.run_available(J.stream_sessions(replay(v, uploads, folder)), f"{folder}/out", f"{folder}/check")
    return read(v, f"{folder}/out")


@query("stream_latest", "ST4 W1", "SELECT source_id, seq, student_number FROM o_identity")
def stream_latest(v):
    folder = workspace(v)
    log = v.identities.select("source_id", "seq", "student_number")
    J.run_batches(replay(v, log, folder), J.latest_writer(f"{folder}/out", "source_id"), f"{folder}/check")
    return J.latest_table(v.spark, f"{folder}/out", "source_id").select("source_id", "seq", "student_number")


def sheets_done(v):
    seen = latest(v.detections, "source_id").select("source_id", "detection_id")
    work = G.active_sources(v.sources, "student").join(seen, "source_id", "left")
    return work.select("source_id", "room_id", F.col("detection_id").isNotNull().alias("done"))


@query("stream_progress", "ST5", """
SELECT s.room_id, count(*) AS total, count(d.detection_id) AS done FROM o_students s LEFT JOIN o_detection d ON d.source_id = s.source_id GROUP BY s.room_id""")
def stream_progress(v):
    folder = workspace(v)
    work = sheets_done(v)
    counts = J.stream_progress(replay_batches(v, work, F.pmod("source_id", F.lit(4)), 4, folder))
    J.run_batches(counts, lambda rows, batch: J.write_batch(rows.withColumn("seq", F.lit(batch)), f"{folder}/out", batch), f"{folder}/check", "update")
    return latest(read(v, f"{folder}/out"), "room_id").select("room_id", "total", "done")


@query("stream_progress_rows", "ST5", """
WITH b AS (SELECT s.source_id % 4 AS batch, count(*) AS batch_total, count(d.detection_id) AS batch_done FROM o_students s LEFT JOIN o_detection d ON d.source_id = s.source_id GROUP BY s.source_id % 4)
SELECT batch, batch_total, batch_done, CAST(sum(batch_total) OVER w AS BIGINT) AS total, CAST(sum(batch_done) OVER w AS BIGINT) AS done, CAST(sum(batch_total - batch_done) OVER w AS BIGINT) AS pending
FROM b WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)""")
def stream_progress_rows(v):
    """What the stream observes of each micro-batch, as rows."""
    folder = workspace(v)
    work = J.observed_progress(replay_batches(v, sheets_done(v), F.pmod("source_id", F.lit(4)), 4, folder))
    with J.progress_rows(v.spark) as listener:
        query = J.run_batches(J.stream_progress(work), lambda rows, batch: J.write_batch(rows, f"{folder}/out", batch), f"{folder}/check", "update")
        listener.wait(query)
    return listener.rows(v.spark).where("batch_total > 0").select("batch", "batch_total", "batch_done", "total", "done", "pending")


@query("stream_guard", "ST6", "SELECT seq, source_id, question, outcome FROM o_late")
def stream_guard(v):
    folder = workspace(v)
    writer = J.guard_writer(f"{folder}/applied", f"{folder}/rejected", G.current_key(v.keys, v.sources), latest(v.detections, "source_id"), v.sources)
    J.run_batches(replay(v, v.overrides, folder), writer, f"{folder}/check")
    return read(v, f"{folder}/applied").unionByName(read(v, f"{folder}/rejected")).select("seq", "source_id", "question", "outcome")
