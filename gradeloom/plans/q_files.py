"""File level queries over the document table: every document is a file."""

from uuid import uuid4

from pyspark.sql import functions as F

from gradeloom.plans.registry import SHARED, placed, query, widen
from gradeloom.session import checkpoint_dir
from gradeloom.sources import exports, publish
from gradeloom.sources import files as S


def written(v, name: str, rows, key: str) -> str:
    """A folder in the shared place with one text file for each value of ``key``; rows come in order."""
    path = f"{checkpoint_dir(v.spark)}/{name}-{uuid4().hex}"
    rows.write.partitionBy(key).text(path)
    return path


def images(v):
    """Documents as image bytes: a PNG header with the size in it, a JPEG header, or plain text."""
    k = F.col("file_id") % 4
    size = F.unhex(F.concat(F.lpad(F.hex(100 + F.col("file_id") % 900), 8, "0"), F.lpad(F.hex(200 + F.col("file_id") % 700), 8, "0")))
    text = F.encode("content", "UTF-8")
    content = F.when(k == 0, F.concat(F.unhex(F.lit(S.PNG_SIGNATURE + "0000000D49484452")), size, text)).when(k == 1, F.concat(F.unhex(F.lit("FFD8FFE0")), text)).otherwise(text)
    return v.files.withColumn("bytes", content)


@query("sniff_type", "S2", """
SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS type, CASE WHEN file_id % 4 = 0 THEN 100 + file_id % 900 END AS width, CASE WHEN file_id % 4 = 0 THEN 200 + file_id % 700 END AS height FROM v_files""")
def sniff_type(v):
    size = S.png_size(F.col("bytes"))
    return widen(images(v).select("file_id", S.sniff_type(F.col("bytes")).alias("type"), size["width"].alias("width"), size["height"].alias("height")), "width", "height")


@query("drop_artifacts", "S3", "SELECT file_id, file_name FROM v_files WHERE lower(file_name) NOT IN ('.ds_store', 'thumbs.db')")
def drop_artifacts(v):
    return S.drop_artifacts(v.files.select("file_id", "file_name"), "file_name")


@query("content_hash", "S4", "SELECT file_id, sha256(content) AS sha256, 'input/originals/' || substr(sha256(content), 1, 2) || '/' || sha256(content) AS path FROM v_files")
def content_hash(v):
    digest = S.content_hash(F.col("content"))
    return v.files.select("file_id", digest.alias("sha256"), S.blob_path(digest).alias("path"))


SHARED["o_known"] = """
SELECT exam_id, sha256, min(file_id) AS source_id, min_by(purpose, file_id) AS purpose, min_by(coalesce(room_id, -1), file_id) AS room, CASE WHEN min(file_id) % 9 = 0 THEN 1 ELSE 0 END AS archived
FROM (SELECT *, sha256(content) AS sha256 FROM v_files WHERE file_id % 3 = 0) GROUP BY ALL"""


@query("ingest_sources", "S5", """
WITH f AS (SELECT file_id, exam_id, sha256(content) AS sha256, CASE WHEN file_id % 17 = 0 THEN 'key' ELSE purpose END AS purpose, CASE WHEN file_id % 17 = 0 THEN NULL WHEN file_id % 19 = 0 THEN room_id + 1 ELSE room_id END AS room_id FROM v_files),
o AS (SELECT f.exam_id, f.sha256, min(f.file_id) AS owner, arg_min(f.purpose, f.file_id) AS fp, arg_min(coalesce(f.room_id, -1), f.file_id) AS fr FROM f GROUP BY ALL)
SELECT f.file_id, f.exam_id, f.sha256, f.purpose, f.room_id, k.source_id, CASE WHEN f.purpose <> coalesce(k.purpose, o.fp) THEN 'purpose_conflict'
  WHEN f.purpose = 'student' AND coalesce(f.room_id, -1) <> CASE WHEN k.source_id IS NOT NULL THEN k.room ELSE o.fr END THEN 'room_conflict'
  WHEN k.source_id IS NOT NULL THEN CASE WHEN k.archived = 1 THEN 'reactivated' ELSE 'existing' END WHEN f.file_id = o.owner THEN 'accepted' ELSE 'duplicate' END AS decision
FROM f JOIN o ON o.exam_id = f.exam_id AND o.sha256 = f.sha256 LEFT JOIN o_known k ON k.exam_id = f.exam_id AND k.sha256 = f.sha256""")
def ingest_sources(v):
    hashed = v.files.withColumn("sha256", S.content_hash(F.col("content"))).drop("content")
    known = hashed.where("file_id % 3 = 0").groupBy("exam_id", "sha256").agg(F.min(F.struct("file_id", "purpose", "room_id")).alias("m")).select(
        "exam_id", "sha256", F.col("m.file_id").alias("source_id"), F.col("m.purpose").alias("purpose"), F.col("m.room_id").alias("room_id"),
        F.when(F.col("m.file_id") % 9 == 0, 1).otherwise(0).alias("archived"))
    k17, k19 = F.col("file_id") % 17 == 0, F.col("file_id") % 19 == 0
    batch = hashed.withColumn("purpose", F.when(k17, "key").otherwise(F.col("purpose"))).withColumn(
        "room_id", F.when(~k17, F.when(k19, F.col("room_id") + 1).otherwise(F.col("room_id"))))
    return S.ingest_sources(batch, known)


@query("list_sources", "S6", "SELECT source_id, exam_id, purpose, room_id, row_number() OVER (PARTITION BY exam_id ORDER BY created_at, source_id) AS place FROM o_active")
def list_sources(v):
    return placed(S.list_sources(v.sources).select("source_id", "exam_id", "purpose", "room_id"), "exam_id")


@query("list_archived_sources", "S7", "SELECT source_id, exam_id, purpose, room_id, row_number() OVER (PARTITION BY exam_id ORDER BY created_at DESC, source_id) AS place FROM v_sources WHERE archived = 1 AND purpose = 'student'")
def list_archived(v):
    return placed(S.list_sources(v.sources, archived=True, purpose="student").select("source_id", "exam_id", "purpose", "room_id"), "exam_id")


@query("verify_integrity", "S9", """
SELECT file_id AS source_id, 'b/' || CAST(file_id AS VARCHAR) AS path, CASE WHEN file_id % 13 = 0 THEN 'missing' WHEN file_id % 11 = 0 THEN 'mismatch' ELSE 'ok' END AS status FROM v_files""")
def verify_integrity(v):
    path = F.concat(F.lit("b/"), F.col("file_id").cast("string"))
    recorded = v.files.select(F.col("file_id").alias("source_id"), path.alias("path"), S.content_hash(F.col("content")).alias("sha256"))
    stored = v.files.where("file_id % 13 <> 0").select(path.alias("path"), F.when(F.col("file_id") % 11 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))
    return S.verify_integrity(recorded, stored)


@query("orphan_blobs", "J9", """
SELECT DISTINCT sha256(content) AS sha256 FROM v_files WHERE exam_id % 5 = 0 EXCEPT SELECT sha256(content) FROM v_files WHERE exam_id % 5 <> 0""")
def orphan_blobs(v):
    hashed = v.files.select("exam_id", S.content_hash(F.col("content")).alias("sha256"))
    return S.orphan_blobs(hashed, v.files.where("exam_id % 5 = 0").select("exam_id"))


@query("export_runs", "S20", "SELECT seq, exam_id, room_id, run_id, status, row_number() OVER (PARTITION BY exam_id ORDER BY seq DESC, run_id) AS place FROM v_export_runs")
def export_runs(v):
    from gradeloom.sources.publish import export_runs as history

    return placed(history(v.export_runs), "exam_id")


@query("unique_filenames", "W11", """
WITH RECURSIVE u AS (SELECT room_id, source_id, number, coalesce(unknown_ordinal, 1) AS asked, row_number() OVER (PARTITION BY room_id ORDER BY source_id) AS i
  FROM o_record WHERE record_type IS NOT NULL AND NOT coalesce(number BETWEEN 1 AND 999999, false)),
p(room_id, i, place, used) AS (SELECT room_id, i, asked, [asked] FROM u WHERE i = 1
  UNION ALL SELECT u.room_id, u.i, x.place, list_append(p.used, x.place) FROM p JOIN u ON u.room_id = p.room_id AND u.i = p.i + 1,
    LATERAL (SELECT min(c) AS place FROM (SELECT unnest(range(u.asked, u.asked + len(p.used) + 1)) AS c) WHERE NOT list_contains(p.used, c)) x)
SELECT room_id, source_id, number, 'no-' || CASE WHEN number < 10 THEN '0' ELSE '' END || number || CASE WHEN n > 1 THEN '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n ELSE '' END || '.jpg' AS file_name
FROM (SELECT *, row_number() OVER (PARTITION BY room_id, number ORDER BY source_id) AS n FROM o_record WHERE record_type IS NOT NULL AND number BETWEEN 1 AND 999999)
UNION ALL SELECT u.room_id, u.source_id, u.number, 'unknown-' || CASE WHEN p.place < 10 THEN '0' ELSE '' END || p.place || '.jpg' FROM u JOIN p ON p.room_id = u.room_id AND p.i = u.i""")
def unique_filenames(v):
    from gradeloom.plans.q_state import records
    from gradeloom.sources.publish import unique_filenames as names

    return names(records(v).where("record_type IS NOT NULL"))


@query("snapshot_documents", "S17", """
WITH i AS (SELECT source_id, map_from_entries(list(row(position, n) ORDER BY position)) AS indicators FROM o_snapshot_indicators GROUP BY source_id),
a AS (SELECT source_id, list(struct_pack(question := question, answer := answer, origin := origin) ORDER BY question, answer, origin) AS answers FROM o_snapshot_answers GROUP BY source_id)
SELECT s.exam_id, s.room_id, s.source_id, CAST(to_json(struct_pack(answers := a.answers, blocked := s.blocked, detection_id := s.detection_id, exam_id := s.exam_id, identity_confirmed := s.identity_confirmed, identity_origin := s.identity_origin,
  indicators := i.indicators, key_id := s.key_id, max := s.max, number := s.number, original_name := s.original_name, record_id := s.record_id, record_type := s.record_type, review_issues := s.review_issues,
  room_id := s.room_id, score := s.score, source_id := s.source_id, status := s.status, unknown_ordinal := s.unknown_ordinal)) AS VARCHAR) AS document
FROM o_snapshot s LEFT JOIN i ON i.source_id = s.source_id LEFT JOIN a ON a.source_id = s.source_id""")
def snapshot_documents(v):
    from gradeloom.plans.q_state import snapshot
    from gradeloom.sources.publish import snapshot_documents as documents

    return documents(snapshot(v))


@query("append_detections", "S15", "SELECT source_id, detection_id, exam_id, pipeline_version FROM v_detections JOIN v_sources USING (source_id)")
def append_detections(v):
    """Appended to the shared folder in two batches, and read back: no raster column is kept."""
    from uuid import uuid4

    from gradeloom.session import checkpoint_dir

    rows = v.detections.join(v.sources.select("source_id", "exam_id"), "source_id").withColumn("aligned", F.lit(None).cast("binary"))
    path = f"{checkpoint_dir(v.spark)}/detections-{uuid4().hex}"
    for batch in ("detection_id % 2 = 0", "detection_id % 2 <> 0"):
        S.append_detections(rows.where(batch), path)
    written = v.spark.read.parquet(path)
    if "aligned" in written.columns:
        raise ValueError("the raster column was written")
    return written.select("source_id", "detection_id", F.col("exam_id").cast(rows.schema["exam_id"].dataType).alias("exam_id"), "pipeline_version")


def customer_files(v) -> str:
    """One file of customer names for each nation, in customer order."""
    rows = v.customer.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").select("c_nationkey", F.col("c_name").alias("value"))
    return written(v, "customers", rows, "c_nationkey")


SHARED["o_customer_files"] = """
SELECT c_nationkey AS nation, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY c_nationkey"""


def of_nation(files):
    return files.withColumn("nation", F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("int"))


@query("scan_files", "S1", "SELECT nation, CAST(strlen(content) AS BIGINT) AS length, true AS has_extension FROM o_customer_files")
def scan_files(v):
    found = S.scan_files(v.spark, customer_files(v), extensions=("txt",))
    return of_nation(found).select("nation", "length", "has_extension")


@query("inventory", "S10", "SELECT nation, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS length, 'error' AS status FROM o_customer_files")
def inventory(v):
    return of_nation(S.inventory(v.spark, customer_files(v))).select("nation", "sha256", "length", "status")


@query("artifact_manifest", "S18", "SELECT nation, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS length FROM o_customer_files")
def artifact_manifest(v):
    return of_nation(publish.artifact_manifest(v.spark, customer_files(v))).select("nation", "sha256", "length")


@query("publish", "S19", "SELECT o_orderkey AS source_id, o_custkey, o_orderstatus FROM orders")
def publish_query(v):
    """Orders published in two runs, of which the second fails its check and stays invisible."""
    root = f"{checkpoint_dir(v.spark)}/published-{uuid4().hex}"
    rows = v.orders.select(F.col("o_orderkey").alias("source_id"), "o_custkey", "o_orderstatus")
    publish.publish(lambda: rows, v.spark, root, "first")
    moving = iter((rows, rows.where("source_id % 7 <> 1")))  # a table that changes between writing and checking
    try:
        publish.publish(lambda: next(moving), v.spark, root, "second")
    except publish.SnapshotChanged:
        pass
    return publish.published(v.spark, root).drop("run_id")


@query("read_answer_keys", "S13", "SELECT CAST(key_id AS VARCHAR) AS key_id, CAST(question AS INT) AS question, choice1 AS choice FROM v_keys")
def read_answer_keys(v):
    """The first choice of every key, written as one document for each exam and read back."""
    answers = v.keys.groupBy("exam_id", "key_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("question").cast("string"), "choice1"))).alias("answers"))
    one = answers.groupBy("exam_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("key_id").cast("string"), "answers"))).alias("keys"))
    return exports.read_answer_keys(v.spark, written(v, "keys", one.select("exam_id", F.to_json("keys").alias("value")), "exam_id"))


def result_documents(v) -> str:
    """One results document for each room: its active sheets, each with the newest observations of its first questions."""
    from gradeloom.operators import grading as G
    from gradeloom.operators.review import newest_observations

    item = F.struct("question", F.col("state").alias("classification"), F.array("choice").alias("selected"), "auto_resolved")
    seen = newest_observations(v.observations).groupBy("source_id").agg(F.array_sort(F.collect_list(item)).alias("answers"))
    sheets = G.active_sources(v.sources, "student").join(seen, "source_id", "left").join(v.exams.select("exam_id", "question_count"), "exam_id")
    result = F.struct(
        F.struct(F.col("source_id").cast("string").alias("id"), "original_name").alias("source"), F.lit("teacher_reviewed").alias("status"),
        F.struct(F.lit("v10").alias("pipeline_version"), "answers").alias("detection"),
    )
    rooms = sheets.groupBy("room_id", "exam_id", "question_count").agg(F.collect_list(result).alias("results"))
    document = F.struct(
        F.lit(2).alias("schema_version"), F.lit("run").alias("run_id"), F.struct(F.col("exam_id").cast("string").alias("id"), "question_count").alias("exam"),
        F.struct(F.col("room_id").cast("string").alias("id")).alias("room"), "results",
    )
    return written(v, "results", rooms.select("room_id", F.to_json(document).alias("value")), "room_id")


@query("read_export_results", "S12", """
SELECT CAST(exam_id AS VARCHAR) AS exam_id, CAST(room_id AS VARCHAR) AS room_id, CAST(source_id AS VARCHAR) AS source_id, original_name, 'teacher_reviewed' AS status FROM o_students""")
def read_export_results(v):
    return exports.read_export_results(v.spark, result_documents(v))[0].select("exam_id", "room_id", "source_id", "original_name", "status")


@query("read_export_observations", "S12", """
SELECT source_id, CAST(question AS INT) AS question, state, choice, auto_resolved FROM (
  SELECT CAST(b.source_id AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY b.source_id ORDER BY b.question) AS question, b.state, b.choice, b.auto_resolved, e.question_count
  FROM o_observed b JOIN o_students s ON s.source_id = b.source_id JOIN v_exams e ON e.exam_id = s.exam_id) WHERE question <= question_count""")
def read_export_observations(v):
    observations = exports.read_export_results(v.spark, result_documents(v))[1]
    return observations.select("source_id", "question", "state", F.get("selected", F.lit(0)).alias("choice"), "auto_resolved")


SHARED["o_template_files"] = """
SELECT template_row, list(struct_pack(b := block_index, s := question_start, e := question_end, x := x0, dx := dx, y := y0, dy := dy) ORDER BY block_index) AS b FROM v_blocks GROUP BY template_row"""


@query("read_template", "S14", """
SELECT CAST(template_row AS VARCHAR) AS template_id, CAST(unnest(b).b AS BIGINT) AS block_index, unnest(b).s AS question_start, unnest(b).e AS question_end, unnest(b).x + 4 * unnest(b).dx AS right_edge, unnest(b).y + 5 * unnest(b).dy AS bottom_edge
FROM o_template_files""")
def read_template(v):
    """A template document for each part, 500 to a file, written and read back: the edges of its blocks."""
    lines = lambda start, step, cells: F.transform(F.sequence(F.lit(0), F.lit(cells)), lambda i: (F.col(start) + i * F.col(step)).cast("int"))
    block = F.struct(
        F.col("block_index").cast("int").alias("block_index"), F.col("question_start").cast("int").alias("question_start"), F.col("question_end").cast("int").alias("question_end"), F.lit(5).alias("rows"), F.lit(4).alias("choice_count"),
        lines("x0", "dx", 4).alias("col_boundaries"), lines("y0", "dy", 5).alias("row_boundaries"), F.lit("configured").alias("geometry_state"))
    template = F.struct(F.col("template_row").cast("string").alias("id"), F.lit(1).alias("version"), F.lit(770).alias("width"), F.lit(300).alias("height"), "answer_blocks")
    documents = v.blocks.groupBy("template_row").agg(F.array_sort(F.collect_list(block)).alias("answer_blocks"))
    shelves = documents.groupBy(F.floor(F.col("template_row") / 500).alias("shelf")).agg(F.to_json(F.collect_list(template)).alias("value"))
    blocks = exports.read_template(v.spark, written(v, "templates", shelves.select("shelf", "value"), "shelf"))[1]
    edges = F.element_at("cols", -1).alias("right_edge"), F.element_at("rows", -1).alias("bottom_edge")
    return widen(blocks.select("template_id", "block_index", "question_start", "question_end", *edges), "block_index", "question_start", "question_end", "right_edge", "bottom_edge")
