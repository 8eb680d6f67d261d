"""Grading, rosters, attendance and exam level counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.operators import checks, grading as G
from gradeloom.operators.common import count_when, latest
from gradeloom.plans.registry import SHARED, placed, query

SHARED.update(
    o_active="SELECT * FROM v_sources WHERE archived = 0",
    o_students="SELECT * FROM v_sources WHERE archived = 0 AND purpose = 'student'",
    o_current_key="""
SELECT exam_id, key_id, source_id AS key_source_id, origin AS key_origin FROM (
  SELECT k.*, row_number() OVER (PARTITION BY k.exam_id ORDER BY k.seq DESC) AS rn
  FROM v_keys k WHERE k.question = 1 AND EXISTS (SELECT 1 FROM o_active s WHERE s.source_id = k.source_id AND s.purpose = 'key')) WHERE rn = 1""",
    o_confirmed_key="""
SELECT * FROM o_current_key k WHERE key_origin <> 'machine'
  AND key_source_id = (SELECT max(source_id) FROM o_active s WHERE s.exam_id = k.exam_id AND s.purpose = 'key')""",
    o_key_set="""
SELECT k.exam_id, k.key_id, k.question, k.choice1, coalesce(k.choice2, k.choice1) AS choice2
FROM v_keys k JOIN o_current_key c ON k.exam_id = c.exam_id AND k.key_id = c.key_id""",
    o_latest_answers="""
SELECT source_id, question, CASE WHEN state = 'single_mark' THEN choice ELSE state END AS answer FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, question ORDER BY observed_at DESC, o1 DESC, o2 DESC, o3 DESC) AS rn FROM v_observations) WHERE rn = 1""",
    o_graded="""
SELECT s.exam_id, s.room_id, a.source_id, a.question, a.answer, CASE WHEN a.answer IN (k.choice1, k.choice2) THEN 1 ELSE 0 END AS points
FROM o_latest_answers a JOIN o_students s ON a.source_id = s.source_id JOIN o_key_set k ON k.exam_id = s.exam_id AND k.question = a.question""",
    o_bad_indicators="""
SELECT a.exam_id FROM v_indicators a JOIN v_indicators b ON a.exam_id = b.exam_id AND a.position < b.position
  AND a.from_question <= b.to_question AND b.from_question <= a.to_question""",
    o_maximum="""
SELECT r.exam_id, r.room_id, coalesce(r.expected_max, CASE WHEN r.room_id = f.room_id THEN e.legacy_max END) AS maximum,
       CASE WHEN r.expected_max IS NOT NULL THEN 'room' WHEN r.room_id = f.room_id AND e.legacy_max IS NOT NULL THEN 'legacy_exam' ELSE 'unknown' END AS max_source
FROM v_rooms r JOIN v_exams e ON r.exam_id = e.exam_id
JOIN (SELECT DISTINCT ON (exam_id) exam_id, room_id FROM v_rooms ORDER BY exam_id, sort_order, room_id) f ON f.exam_id = r.exam_id""",
    o_sheet_numbers="""
SELECT s.source_id, s.exam_id, s.room_id, r.student_number AS number FROM o_students s JOIN (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM v_reviews) r ON r.source_id = s.source_id AND r.rn = 1""",
    o_attendance="""
SELECT a.room_id, a.student_number, max_by(a.status, a.seq) FILTER (WHERE a.status <> 'skipped') AS status,
       max_by(a.status, a.seq) = 'skipped' AS skipped FROM v_attendance a GROUP BY a.room_id, a.student_number""",
)


def students(v):
    return G.active_sources(v.sources, "student")


def graded(v):
    sheets = students(v).select("source_id", "exam_id", "room_id")
    answers = G.latest_answers(v.observations).join(sheets, "source_id")
    return G.grade(answers, G.key_answers(v.keys, G.current_key(v.keys, v.sources)))


def sheet_numbers(v):
    numbers = latest(v.reviews, "source_id").select("source_id", F.col("student_number").alias("number"))
    return students(v).select("source_id", "exam_id", "room_id").join(numbers, "source_id")


@query("room_ranking", "W1 J2 J1 P7 A1 O1", """
SELECT room_id, source_id, score, answered, CAST(rank() OVER (PARTITION BY room_id ORDER BY score DESC, answered) AS INT) AS place
FROM (SELECT room_id, source_id, CAST(sum(points) AS BIGINT) AS score, count(*) AS answered FROM o_graded GROUP BY room_id, source_id)""")
def room_ranking(v):
    """Places by counting the (few) distinct results per room, so no room is sorted in one task."""
    totals = G.total_score(graded(v), ["room_id", "source_id"])
    results = totals.groupBy("room_id", "score", "answered").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy("room_id").orderBy(F.col("score").desc(), "answered").rowsBetween(Window.unboundedPreceding, -1)
    places = results.select("room_id", "score", "answered", (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) + 1).cast("int").alias("place"))
    return totals.join(places, ["room_id", "score", "answered"])


@query("latest", "W1", "SELECT * FROM o_latest_answers")
def latest_answers(v):
    return G.latest_answers(v.observations)


@query("latest_detection", "W1", """
SELECT source_id, detection_id, pipeline_version, failure FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM v_detections) WHERE rn = 1""")
def latest_detection(v):
    return latest(v.detections, "source_id").select("source_id", "detection_id", "pipeline_version", "failure")


@query("current_key", "J2", "SELECT * FROM o_current_key")
def current_key(v):
    return G.current_key(v.keys, v.sources)


@query("confirmed_key", "J2", "SELECT * FROM o_confirmed_key")
def confirmed_key(v):
    return G.confirmed_key(v.keys, v.sources)


@query("grade", "J1", """
WITH g AS MATERIALIZED (SELECT exam_id, source_id, question, answer, points FROM o_graded) SELECT * FROM g ORDER BY source_id, question""")
def grade(v):
    return graded(v).select("exam_id", "source_id", "question", "answer", "points")


@query("total_score", "A1", "SELECT exam_id, room_id, source_id, CAST(sum(points) AS BIGINT) AS score, count(*) AS answered FROM o_graded GROUP BY ALL")
def total_score(v):
    return G.total_score(graded(v), ["exam_id", "room_id", "source_id"])


@query("indicator_map", "J4", """
SELECT i.exam_id, a.source_id, a.question, i.position, i.identifier FROM v_indicators i JOIN o_students s ON s.exam_id = i.exam_id
JOIN o_latest_answers a ON a.source_id = s.source_id AND a.question BETWEEN i.from_question AND i.to_question""")
def indicator_map(v):
    answers = G.latest_answers(v.observations).join(students(v).select("source_id", "exam_id"), "source_id")
    return answers.join(G.question_indicators(v.indicators), ["exam_id", "question"]).select("exam_id", "source_id", "question", "position", "identifier")


SHARED["o_indicator_scores"] = """
SELECT g.exam_id, g.source_id, i.position, i.identifier, CAST(sum(g.points) AS BIGINT) AS points
FROM o_graded g JOIN v_indicators i ON i.exam_id = g.exam_id AND g.question BETWEEN i.from_question AND i.to_question
WHERE g.exam_id NOT IN (SELECT exam_id FROM o_bad_indicators) GROUP BY ALL"""


def _indicator_scores(v):
    return G.indicator_scores(graded(v), v.indicators, checks.check_indicators(v.indicators, v.exams), ["exam_id", "source_id"])


@query("indicator_scores", "A2 J4", "SELECT * FROM o_indicator_scores")
def indicator_scores(v):
    return _indicator_scores(v)


@query("indicator_scores_wide", "A2", """
SELECT exam_id, source_id, CAST(sum(points) FILTER (WHERE position = 0) AS BIGINT) AS i0, CAST(sum(points) FILTER (WHERE position = 1) AS BIGINT) AS i1,
       CAST(sum(points) FILTER (WHERE position = 2) AS BIGINT) AS i2 FROM o_indicator_scores GROUP BY ALL""")
def indicator_scores_wide(v):
    positions = sorted(row.position for row in v.indicators.select("position").distinct().collect())
    wide = G.pivot_indicators(_indicator_scores(v), ["exam_id", "source_id"], positions)
    return wide.withColumnsRenamed({str(p): f"i{p}" for p in positions})


@query("number_maximum", "J11", "SELECT * FROM o_maximum")
def number_maximum(v):
    return G.number_maximum(v.rooms, v.exams)


@query("first_room", "W3", "SELECT exam_id, room_id FROM v_rooms WHERE sort_order = 0")
def first_room(v):
    return G.first_room(v.rooms).select("exam_id", "room_id")


@query("next_sort_order", "W7", """
SELECT exam_id, row_id, CAST(2 + row_number() OVER (PARTITION BY exam_id ORDER BY row_id) AS BIGINT) AS sort_order FROM v_labels_text""")
def next_sort_order(v):
    from gradeloom.operators.changes import next_sort_order as assign

    return assign(v.rooms, v.labels_text, "row_id").select("exam_id", "row_id", "sort_order")


@query("duplicate_numbers", "A20", "SELECT room_id, number, count(*) AS sheets FROM o_sheet_numbers GROUP BY ALL HAVING count(*) > 1")
def duplicate_numbers(v):
    return G.duplicate_numbers(sheet_numbers(v))


@query("attendance_state", "C10 W1", "SELECT * FROM o_attendance")
def attendance_state(v):
    return G.attendance_state(v.attendance)


@query("attendance_conflict", "J6", """
SELECT n.room_id, n.number, n.source_id, a.status FROM o_sheet_numbers n JOIN o_attendance a ON a.room_id = n.room_id AND a.student_number = n.number
WHERE a.status IN ('absent', 'excused')""")
def attendance_conflict(v):
    return G.attendance_conflict(sheet_numbers(v), G.attendance_state(v.attendance)).select("room_id", "number", "source_id", "status")


@query("roster_gaps", "J7", """
WITH span AS (SELECT room_id, min(number) AS low, max(number) AS high FROM o_sheet_numbers GROUP BY room_id)
SELECT room_id, number, kind FROM (
  SELECT room_id, unnest(range(low, high + 1)) AS number, 'internal' AS kind FROM span
  UNION ALL SELECT s.room_id, unnest(range(1, m.maximum + 1)), 'expected' FROM span s JOIN o_maximum m ON m.room_id = s.room_id) g
WHERE NOT EXISTS (SELECT 1 FROM o_sheet_numbers n WHERE n.room_id = g.room_id AND n.number = g.number)""")
def roster_gaps(v):
    return G.roster_gaps(G.number_maximum(v.rooms, v.exams), sheet_numbers(v)).select("room_id", "number", "kind")


@query("expected_minus_observed", "U5", """
SELECT room_id, unnest(range(1, maximum + 1)) AS number FROM o_maximum EXCEPT SELECT room_id, number FROM o_sheet_numbers""")
def expected_minus_observed(v):
    return G.expected_minus_observed(G.number_maximum(v.rooms, v.exams), sheet_numbers(v))


@query("exam_summary", "A3", """
SELECT e.exam_id, (SELECT count(*) FROM o_active s WHERE s.exam_id = e.exam_id) AS sources,
       (SELECT count(*) FROM v_reviews r JOIN o_active s ON s.source_id = r.source_id WHERE s.exam_id = e.exam_id) AS reviews,
       (SELECT count(DISTINCT r.source_id) FROM v_reviews r JOIN o_active s ON s.source_id = r.source_id WHERE s.exam_id = e.exam_id) AS reviewed_sheets,
       (SELECT count(*) FROM v_export_runs x WHERE x.exam_id = e.exam_id) AS exports FROM v_exams e""")
def exam_summary(v):
    active = G.active_sources(v.sources).select("source_id", "exam_id")
    per_sheet = v.reviews.groupBy("source_id").agg(F.count(F.lit(1)).alias("revisions"))
    counted = active.join(per_sheet, "source_id", "left").groupBy("exam_id").agg(
        F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("revisions"), F.lit(0)).alias("reviews"), F.count("revisions").alias("reviewed_sheets"))
    exports = v.export_runs.groupBy("exam_id").agg(F.count(F.lit(1)).alias("exports"))
    return v.exams.select("exam_id").join(counted, "exam_id", "left").join(exports, "exam_id", "left").na.fill(0)


@query("exam_list", "A24 O3", """
SELECT e.exam_id, e.name, e.subject, (SELECT count(*) FROM v_rooms r WHERE r.exam_id = e.exam_id) AS rooms,
       (SELECT count(*) FROM v_sources s WHERE s.exam_id = e.exam_id) AS images, row_number() OVER (PARTITION BY subject ORDER BY created_seq DESC, exam_id) AS place FROM v_exams e WHERE archived = 0""")
def exam_list(v):
    rooms = v.rooms.groupBy("exam_id").agg(F.count(F.lit(1)).alias("rooms"))
    images = v.sources.groupBy("exam_id").agg(F.count(F.lit(1)).alias("images"))
    listed = v.exams.where("archived = 0").join(rooms, "exam_id", "left").join(images, "exam_id", "left")
    ordered = listed.select("exam_id", "name", "subject", "rooms", "images", "created_seq").orderBy(F.col("created_seq").desc(), "exam_id")
    return placed(ordered, "subject").drop("created_seq")


@query("order_sheets", "O3", "SELECT source_id, room_id, number, row_number() OVER (PARTITION BY room_id ORDER BY number DESC NULLS LAST, source_id) AS place FROM o_sheet_numbers")
def order_sheets(v):
    return placed(sheet_numbers(v).select("source_id", "room_id", "number").orderBy(F.col("number").desc(), "source_id"), "room_id")


@query("score_flags", "P33", """
SELECT source_id, CAST(sum(CASE WHEN answer IN (choice1, choice2) THEN 1 ELSE 0 END) AS BIGINT) AS score,
       concat_ws(',', CASE WHEN bool_or(coalesce(answer, 'blank') = 'blank') THEN 'blank_answer' END, CASE WHEN bool_or(answer = 'multiple') THEN 'multiple_mark' END) AS flags
FROM (SELECT s.source_id, k.choice1, k.choice2, a.answer FROM o_students s JOIN o_key_set k ON k.exam_id = s.exam_id
      LEFT JOIN o_latest_answers a ON a.source_id = s.source_id AND a.question = k.question) GROUP BY source_id""")
def score_flags(v):
    from gradeloom.operators.evaluate import score_flags as run

    return run(students(v).select("source_id", "exam_id"), G.latest_answers(v.observations), G.key_answers(v.keys, G.current_key(v.keys, v.sources)))


@query("active_questions", "P34", """
SELECT o.source_id, o.question, o.o1, o.o2, o.o3 FROM v_observations o JOIN v_sources s ON s.source_id = o.source_id JOIN v_exams e ON e.exam_id = s.exam_id
WHERE o.question <= e.question_count - s.exam_id % 3""")
def active_questions(v):
    declared = v.sources.join(v.exams, "exam_id").select("source_id", (F.col("question_count") - F.col("exam_id") % 3).alias("declared"))
    return v.observations.join(declared, "source_id").where(F.col("question") <= F.col("declared")).select("source_id", "question", "o1", "o2", "o3")
