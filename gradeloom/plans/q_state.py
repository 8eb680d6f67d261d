"""Review state, effective answers, snapshots and status over every sheet."""

from pyspark.sql import functions as F

from gradeloom.operators import grading as G
from gradeloom.operators import review as R
from gradeloom.operators.common import latest
from gradeloom.plans.registry import SHARED, placed, query

SHARED.update(
    o_detection="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM v_detections) WHERE rn = 1",
    o_review="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM v_reviews) WHERE rn = 1",
    o_partial="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM v_partials) WHERE rn = 1",
    o_identity="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM v_identities) WHERE rn = 1",
    o_state="""
SELECT s.source_id, s.exam_id, s.room_id, d.detection_id, d.pipeline_version, d.failure, d.has_registration, d.candidate, d.confidence, d.confidence_margin,
       d.requires_review, d.selective_auto_accept, r.review_id, r.key_id AS review_key, r.student_number AS review_number, r.origin AS review_origin, i.origin AS identity_origin,
       CASE WHEN r.review_id IS NOT NULL AND (i.seq IS NULL OR r.created_at > i.created_at) THEN r.student_number ELSE i.student_number END AS number
FROM o_students s LEFT JOIN o_detection d ON d.source_id = s.source_id LEFT JOIN o_identity i ON i.source_id = s.source_id
LEFT JOIN o_review r ON r.source_id = s.source_id AND r.detection_id IS NOT DISTINCT FROM d.detection_id""",
    o_observed="""
SELECT source_id, question, state, choice, state IN ('single_mark', 'blank') AND block_ok = 1 AS auto_resolved FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, question ORDER BY observed_at DESC, o1 DESC, o2 DESC, o3 DESC) AS rn FROM v_observations) WHERE rn = 1""",
    o_override="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, question, key_id, detection_id ORDER BY seq DESC) AS rn FROM v_overrides) WHERE rn = 1",
    o_answers="""
SELECT t.*, k.key_id, CAST(q.question AS INT) AS question, b.state, b.choice, b.auto_resolved, o.answer IS NOT NULL AS overridden,
       CASE WHEN t.review_key = k.key_id THEN a.answer WHEN o.answer IS NOT NULL THEN o.answer
            WHEN t.pipeline_version = 'v10' AND t.has_registration = 1 AND b.auto_resolved THEN CASE b.state WHEN 'single_mark' THEN b.choice ELSE 'blank' END END AS answer
FROM o_state t JOIN o_confirmed_key k ON k.exam_id = t.exam_id CROSS JOIN range(1, 8) q(question)
LEFT JOIN o_observed b ON b.source_id = t.source_id AND b.question = q.question
LEFT JOIN o_override o ON o.source_id = t.source_id AND o.question = q.question AND o.key_id = k.key_id AND o.detection_id IS NOT DISTINCT FROM t.detection_id
LEFT JOIN v_review_answers a ON a.review_id = t.review_id AND a.question = q.question""",
    o_record="""
SELECT s.source_id, s.exam_id, s.room_id, s.original_name, k.key_id, r.created_at AS r_at,
       CASE WHEN part THEN 'partial_review' WHEN comp THEN 'complete_review' END AS record_type,
       CASE WHEN part THEN partial_id WHEN comp THEN review_id END AS record_id,
       CASE WHEN part THEN p_detection WHEN comp THEN r.detection_id END AS detection_id,
       CASE WHEN part THEN p_number WHEN comp THEN r.student_number END AS number,
       CASE WHEN part AND NOT p_confirmed THEN unknown_ordinal END AS unknown_ordinal,
       CASE WHEN part THEN p_confirmed WHEN comp THEN true END AS identity_confirmed,
       CASE WHEN part THEN p_origin WHEN comp THEN 'teacher_confirmed' END AS identity_origin,
       CASE WHEN part THEN 'review_skipped' WHEN comp AND r.origin = 'teacher' THEN 'teacher_reviewed' WHEN comp THEN r.origin END AS status, CASE WHEN part THEN p_issues END AS review_issues
FROM (SELECT s.*, k.key_id, r.created_at, coalesce(p.key_id = k.key_id AND (r.review_id IS NULL OR p.created_at > r.created_at), false) AS part,
             coalesce(r.key_id = k.key_id, false) AS comp, p.partial_id, p.detection_id AS p_detection, p.student_number AS p_number, p.unknown_ordinal,
             p.identity_confirmed = 1 AS p_confirmed, p.identity_origin AS p_origin, p.review_issues AS p_issues
      FROM o_students s JOIN o_confirmed_key k ON k.exam_id = s.exam_id LEFT JOIN o_review r ON r.source_id = s.source_id LEFT JOIN o_partial p ON p.source_id = s.source_id) s
JOIN o_confirmed_key k ON k.exam_id = s.exam_id LEFT JOIN o_review r ON r.source_id = s.source_id""",
    o_logged="SELECT review_id AS record_id, question, answer FROM v_review_answers UNION ALL SELECT partial_id, question, answer FROM v_partial_answers",
    o_snapshot_answers="""
SELECT c.*, l.question, l.answer, CASE WHEN c.record_type = 'partial_review' AND l.answer = 'unresolved' THEN 'review_skipped'
         WHEN c.status = 'teacher_reviewed' OR o.answer IS NOT NULL THEN 'teacher_confirmed' ELSE 'machine_decision' END AS origin
FROM o_record c JOIN o_logged l ON l.record_id = c.record_id
LEFT JOIN o_override o ON o.source_id = c.source_id AND o.question = l.question AND o.key_id = c.key_id AND o.detection_id IS NOT DISTINCT FROM c.detection_id""",
    o_snapshot_broken="""
WITH h AS (SELECT room_id, number, count(*) AS holders FROM o_record WHERE number IS NOT NULL GROUP BY ALL)
SELECT room_id, source_id, 'unreviewed_or_stale' AS rule FROM o_record WHERE record_type IS NULL
UNION ALL SELECT c.room_id, c.source_id, 'identity_changed' FROM o_record c JOIN o_identity i ON i.source_id = c.source_id
  WHERE c.record_type = 'complete_review' AND i.created_at > c.r_at AND i.student_number <> c.number
UNION ALL SELECT c.room_id, c.source_id, 'out_of_range' FROM o_record c JOIN o_maximum m ON m.room_id = c.room_id WHERE c.number > m.maximum
UNION ALL SELECT c.room_id, c.source_id, 'attendance_conflict' FROM o_record c JOIN o_attendance a ON a.room_id = c.room_id AND a.student_number = c.number
  WHERE c.record_type = 'complete_review' AND a.status <> 'pending'
UNION ALL SELECT c.room_id, c.source_id, 'duplicate_number' FROM o_record c JOIN h ON h.room_id = c.room_id AND h.number = c.number WHERE h.holders > 1
UNION ALL SELECT room_id, source_id, 'malformed_partial' FROM o_record WHERE record_type = 'partial_review' AND number IS NULL AND unknown_ordinal IS NULL""",
    o_snapshot_indicators="""
SELECT a.source_id, i.position, CAST(sum(CASE WHEN a.answer IN (k.choice1, k.choice2) THEN 1 ELSE 0 END) AS BIGINT) AS n
FROM o_snapshot_answers a JOIN o_key_set k ON k.exam_id = a.exam_id AND k.question = a.question
JOIN v_indicators i ON i.exam_id = a.exam_id AND a.question BETWEEN i.from_question AND i.to_question AND i.exam_id NOT IN (SELECT exam_id FROM o_bad_indicators) GROUP BY ALL""",
    o_snapshot="""
SELECT c.exam_id, c.room_id, c.source_id, c.original_name, c.number, c.unknown_ordinal, c.identity_confirmed, c.identity_origin, c.record_type, c.record_id, c.status,
       t.score, t.max, x.indicators, c.room_id IN (SELECT room_id FROM o_snapshot_broken) AS blocked, c.key_id, c.detection_id, c.review_issues, w.answers
FROM o_record c LEFT JOIN (
  SELECT a.source_id, CAST(sum(p) AS BIGINT) AS score, count(*) AS max
  FROM (SELECT a.*, CASE WHEN a.answer IN (k.choice1, k.choice2) THEN 1 ELSE 0 END AS p FROM o_snapshot_answers a JOIN o_key_set k ON k.exam_id = a.exam_id AND k.question = a.question) a
  GROUP BY a.source_id) t ON t.source_id = c.source_id
LEFT JOIN (SELECT source_id, string_agg(position || ':' || n, ',' ORDER BY position) AS indicators FROM o_snapshot_indicators GROUP BY source_id) x ON x.source_id = c.source_id
LEFT JOIN (SELECT source_id, string_agg(question || ':' || answer || ':' || origin, ',' ORDER BY question) AS answers FROM o_snapshot_answers GROUP BY source_id) w ON w.source_id = c.source_id WHERE c.record_type IS NOT NULL""",
)


def state(v):
    return R.review_state(v.sources, v.detections, v.reviews, v.identities)


def confirmed(v):
    return G.confirmed_key(v.keys, v.sources)


def maximum(v):
    return G.number_maximum(v.rooms, v.exams)


def state_table(v):
    return v.cut("state", lambda: state(v))


def confirmed_table(v):
    """Written once: a row an exam, whose size Spark then knows."""
    return v.cut("confirmed", lambda: confirmed(v))


def answers(v):
    return R.effective_answers(state_table(v), confirmed_table(v), v.exams, v.observations, v.overrides, v.review_answers)


def records(v):
    return v.cut("records", lambda: R.choose_record(v.reviews, v.partials, confirmed_table(v), v.sources))


def snapshot_broken(v):
    return R.check_snapshot(records(v), maximum(v), G.attendance_state(v.attendance), v.identities)


def snapshot_answers(v):
    return R.snapshot_answers(records(v), v.review_answers, v.partial_answers, v.overrides)


def usable_indicators(v):
    from gradeloom.operators.checks import check_indicators

    return v.indicators.join(check_indicators(v.indicators, v.exams).select("exam_id").distinct(), "exam_id", "left_anti")


def snapshot(v):
    key = G.key_answers(v.keys, confirmed_table(v))
    return R.snapshot(records(v), snapshot_answers(v), key, usable_indicators(v), snapshot_broken(v))


STATE = ["source_id", "exam_id", "room_id", "detection_id", "failure", "review_id", "review_key", "number"]


@query("review_state", "W2", f"SELECT {', '.join(STATE)} FROM o_state")
def review_state(v):
    return state(v).select(*STATE)


@query("machine_answers", "P22", """
SELECT t.source_id, CAST(q.question AS INT) AS question, CASE WHEN t.pipeline_version = 'v10' AND t.has_registration = 1 AND b.auto_resolved
         THEN CASE b.state WHEN 'single_mark' THEN b.choice ELSE 'blank' END END AS answer
FROM o_detection t JOIN v_sources s ON s.source_id = t.source_id JOIN v_exams e ON e.exam_id = s.exam_id, unnest(range(1, e.question_count + 1)) q(question) LEFT JOIN o_observed b ON b.source_id = t.source_id AND b.question = q.question""")
def machine_answers(v):
    from gradeloom.operators.common import expand_range

    counts = v.sources.select("source_id", "exam_id").join(v.exams.select("exam_id", "question_count"), "exam_id")
    grid = expand_range(latest(v.detections, "source_id").join(counts.drop("exam_id"), "source_id"), F.lit(1), F.col("question_count"), "question")
    rows = grid.join(R.newest_observations(v.observations), ["source_id", "question"], "left")
    usable = R.is_current(F.col("pipeline_version")) & (F.col("has_registration") == 1)
    return rows.select("source_id", "question", R.machine_answer(F.col("state"), F.col("choice"), F.col("auto_resolved"), usable).alias("answer"))


@query("apply_overrides", "J3", "SELECT source_id, question, answer, overridden FROM o_answers")
def apply_overrides(v):
    return answers(v).select("source_id", "question", "answer", "overridden")


@query("is_current", "P23", """
SELECT detection_id, pipeline_version = 'v10' AS mark_current, identity_version = 'id-v2' AS number_current,
       NOT (pipeline_version = 'v10') OR alignment_needs_review = 1 AS refresh FROM v_detections""")
def is_current(v):
    mark = R.is_current(F.col("pipeline_version"))
    return v.detections.select("detection_id", mark.alias("mark_current"), (F.col("identity_version") == R.IDENTITY_VERSION).alias("number_current"),
                               (~mark | (F.col("alignment_needs_review") == 1)).alias("refresh"))


@query("needs_processing", "J14", """
SELECT s.source_id, s.exam_id, s.purpose, CASE WHEN d.detection_id IS NULL OR d.pipeline_version <> 'v10' THEN 'full' ELSE 'identity' END AS work
FROM o_active s LEFT JOIN o_detection d ON d.source_id = s.source_id
WHERE (s.purpose = 'key') <> (s.exam_id IN (SELECT exam_id FROM o_confirmed_key))
  AND (d.detection_id IS NULL OR d.pipeline_version <> 'v10' OR (s.purpose = 'student' AND d.failure IS NULL AND d.identity_version <> 'id-v2'))""")
def needs_processing(v):
    return R.needs_processing(v.sources, v.detections, confirmed(v))


@query("choose_record", "W5", "SELECT source_id, room_id, record_type, record_id, number, unknown_ordinal, status FROM o_record")
def choose_record(v):
    return records(v).select("source_id", "room_id", "record_type", "record_id", "number", "unknown_ordinal", "status")


@query("check_snapshot", "V5", "SELECT * FROM o_snapshot_broken")
def check_snapshot(v):
    return snapshot_broken(v)


@query("snapshot", "C2 A1 A2", "SELECT * FROM o_snapshot")
def snapshot_query(v):
    listed = F.transform(F.array_sort(F.map_entries("indicators")), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string")))
    told = F.transform("answers", lambda x: F.concat_ws(":", x["question"].cast("string"), x["answer"], x["origin"]))
    return snapshot(v).withColumn("indicators", F.array_join(listed, ",")).withColumn("answers", F.array_join(told, ","))


@query("order_results", "O1", "SELECT room_id, source_id, number, unknown_ordinal, score, row_number() OVER (PARTITION BY room_id ORDER BY number NULLS LAST, unknown_ordinal NULLS LAST, source_id) AS place FROM o_snapshot")
def order_results(v):
    return placed(G.order_results(snapshot(v).select("room_id", "source_id", "number", "unknown_ordinal", "score")), "room_id")


@query("answer_provenance", "C3", """
SELECT source_id, count(*) FILTER (WHERE origin = 'teacher_confirmed') AS teacher_confirmed, count(*) FILTER (WHERE origin = 'machine_decision') AS machine_decision,
       count(*) FILTER (WHERE origin = 'review_skipped') AS review_skipped FROM o_snapshot_answers GROUP BY source_id""")
def answer_provenance(v):
    return R.answer_provenance(snapshot_answers(v))


@query("append_attendance", "U2 S16", """
SELECT s.exam_id, room_id, CAST(number AS BIGINT) AS number, CASE WHEN number IS NULL THEN 'unknown #' || unknown_ordinal END AS number_label, i.i0, i.i1, i.i2, score, max, status, replace(s.review_issues, ';', '; ') AS review_issues, original_name FROM o_snapshot s
LEFT JOIN (SELECT source_id, max(n) FILTER (WHERE position = 0) AS i0, max(n) FILTER (WHERE position = 1) AS i1, max(n) FILTER (WHERE position = 2) AS i2 FROM o_snapshot_indicators GROUP BY source_id) i ON i.source_id = s.source_id
UNION ALL SELECT r.exam_id, a.room_id, student_number, NULL, NULL, NULL, NULL, NULL, e.question_count, status, NULL, NULL FROM o_attendance a JOIN v_rooms r ON r.room_id = a.room_id JOIN v_exams e ON e.exam_id = r.exam_id
WHERE status IN ('absent', 'excused')""")
def append_attendance(v):
    from gradeloom.sources.publish import score_sheet, wide_scores

    positions = sorted(row.position for row in v.indicators.select("position").distinct().collect())
    return wide_scores(score_sheet(snapshot(v), G.attendance_state(v.attendance), v.rooms, v.exams), positions)


@query("purge_preview", "J18", """
WITH gone AS (SELECT exam_id FROM v_exams WHERE archived = 1), src AS (SELECT source_id FROM v_sources WHERE exam_id IN (SELECT exam_id FROM gone))
SELECT 'sources' AS name, count(*) AS kept FROM v_sources WHERE exam_id NOT IN (SELECT exam_id FROM gone)
UNION ALL SELECT 'reviews', count(*) FROM v_reviews WHERE source_id NOT IN (SELECT source_id FROM src) AND key_id NOT IN (SELECT key_id FROM v_keys WHERE exam_id IN (SELECT exam_id FROM gone))
UNION ALL SELECT 'partials', count(*) FROM v_partials WHERE source_id NOT IN (SELECT source_id FROM src) AND key_id NOT IN (SELECT key_id FROM v_keys WHERE exam_id IN (SELECT exam_id FROM gone))
UNION ALL SELECT 'overrides', count(*) FROM v_overrides WHERE source_id NOT IN (SELECT source_id FROM src) AND key_id NOT IN (SELECT key_id FROM v_keys WHERE exam_id IN (SELECT exam_id FROM gone))
UNION ALL SELECT 'identities', count(*) FROM v_identities WHERE source_id NOT IN (SELECT source_id FROM src)
UNION ALL SELECT 'detections', count(*) FROM v_detections WHERE source_id NOT IN (SELECT source_id FROM src)
UNION ALL SELECT 'attendance', count(*) FROM v_attendance WHERE room_id NOT IN (SELECT room_id FROM v_rooms WHERE exam_id IN (SELECT exam_id FROM gone))
UNION ALL SELECT 'export_runs', count(*) FROM v_export_runs WHERE exam_id NOT IN (SELECT exam_id FROM gone)
UNION ALL SELECT 'import_log', count(*) FROM v_import_log WHERE exam_id NOT IN (SELECT exam_id FROM gone)""")
def purge_preview(v):
    from gradeloom.operators.changes import purge_exam

    names = ("sources", "reviews", "partials", "overrides", "identities", "detections", "attendance", "export_runs", "import_log", "keys", "rooms")
    kept = purge_exam({name: getattr(v, name) for name in names}, v.exams.where("archived = 1"))
    parts = [kept[n].groupBy().agg(F.count(F.lit(1)).alias("kept")).select(F.lit(n).alias("name"), "kept") for n in names[:9]]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("purge_exam", "J18", """
SELECT 'sources' AS name, exam_id, count(*) AS n FROM v_sources WHERE exam_id NOT IN (SELECT exam_id FROM v_exams WHERE archived = 1) GROUP BY exam_id
UNION ALL SELECT 'detections', s.exam_id, count(*) FROM v_detections d JOIN v_sources s ON s.source_id = d.source_id WHERE s.exam_id NOT IN (SELECT exam_id FROM v_exams WHERE archived = 1) GROUP BY s.exam_id
UNION ALL SELECT 'reviews', s.exam_id, count(*) FROM v_reviews r JOIN v_sources s ON s.source_id = r.source_id WHERE s.exam_id NOT IN (SELECT exam_id FROM v_exams WHERE archived = 1) GROUP BY s.exam_id
UNION ALL SELECT 'partials', s.exam_id, count(*) FROM v_partials r JOIN v_sources s ON s.source_id = r.source_id WHERE s.exam_id NOT IN (SELECT exam_id FROM v_exams WHERE archived = 1) GROUP BY s.exam_id
UNION ALL SELECT 'keys', exam_id, count(*) FROM v_keys WHERE exam_id NOT IN (SELECT exam_id FROM v_exams WHERE archived = 1) GROUP BY exam_id
UNION ALL SELECT 'export_runs', exam_id, count(*) FROM v_export_runs WHERE exam_id NOT IN (SELECT exam_id FROM v_exams WHERE archived = 1) GROUP BY exam_id""")
def purge_exam_query(v):
    """Archived exams removed from tables written by exam; what is left, read back."""
    from functools import reduce
    from uuid import uuid4

    from gradeloom.session import checkpoint_dir
    from gradeloom.sources import partitions

    root = f"{checkpoint_dir(v.spark)}/exams-{uuid4().hex}"
    own = v.sources.select("source_id", "exam_id")
    tables = {"sources": v.sources, "keys": v.keys, "export_runs": v.export_runs} | {n: getattr(v, n).join(own, "source_id") for n in ("detections", "reviews", "partials")}
    for name, rows in tables.items():
        partitions.write_partitions(rows, f"{root}/{name}")
    partitions.apply_purge(v.spark, {name: f"{root}/{name}" for name in tables}, v.exams.where("archived = 1"))
    left = [partitions.read_partitions(v.spark, f"{root}/{n}", df.schema).groupBy("exam_id").count().select(F.lit(n).alias("name"), "exam_id", F.col("count").alias("n")) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), left)
