"""Open issues and what follows from them."""

from pyspark.sql import functions as F

from gradeloom.operators import grading as G
from gradeloom.operators import review as R
from gradeloom.operators.common import latest
from gradeloom.plans.q_state import answers, confirmed_table, maximum, state_table
from gradeloom.plans.registry import SHARED, placed, query

SHARED.update(
    o_open_failures="""
SELECT * FROM v_import_log f WHERE outcome = 'failed' AND NOT EXISTS (SELECT 1 FROM v_import_log d WHERE d.outcome = 'imported' AND d.exam_id = f.exam_id
  AND d.path = f.path AND d.purpose = f.purpose AND d.room_id IS NOT DISTINCT FROM f.room_id AND d.seq > f.seq)""",
    o_sheets="""
SELECT t.*, k.key_id, m.maximum, h.holders FROM o_state t JOIN o_confirmed_key k ON k.exam_id = t.exam_id JOIN o_maximum m ON m.room_id = t.room_id
LEFT JOIN (SELECT room_id, number, count(*) AS holders FROM o_state WHERE number IS NOT NULL GROUP BY ALL) h ON h.room_id = t.room_id AND h.number = t.number""",
    o_issues="""
WITH ok AS (SELECT * FROM o_sheets WHERE detection_id IS NOT NULL AND failure IS NULL)
SELECT 'image' AS kind, exam_id, room_id, source_id, number, NULL::INT AS question, NULL AS status, NULL AS candidate, NULL AS prefill, key_id, detection_id, NULL::BIGINT AS failure_seq
FROM o_sheets WHERE detection_id IS NULL OR failure IS NOT NULL
UNION ALL SELECT 'number', exam_id, room_id, source_id, number, NULL, CASE WHEN number IS NULL THEN 'uncertain' WHEN holders > 1 THEN 'duplicate' ELSE 'out_of_range' END,
       CAST(candidate AS VARCHAR), CAST(candidate AS VARCHAR), key_id, detection_id, NULL FROM ok WHERE number IS NULL OR holders > 1 OR number > maximum
UNION ALL SELECT 'attendance', o.exam_id, o.room_id, source_id, number, NULL, NULL, 'pending', NULL, key_id, detection_id, NULL
FROM ok o JOIN o_attendance a ON a.room_id = o.room_id AND a.student_number = o.number AND a.status IN ('absent', 'excused')
UNION ALL SELECT 'stale', exam_id, room_id, source_id, number, NULL, NULL, NULL, NULL, key_id, detection_id, NULL FROM ok WHERE review_key <> key_id
UNION ALL SELECT 'answer', exam_id, room_id, source_id, number, question, coalesce(state, 'uncertain'), CASE WHEN state = 'single_mark' THEN choice END,
       CASE WHEN state = 'single_mark' THEN CASE WHEN auto_resolved THEN choice END WHEN state IN ('multiple', 'boundary_cross', 'blank') THEN state END, key_id, detection_id, NULL
FROM o_answers WHERE detection_id IS NOT NULL AND failure IS NULL AND (review_key IS NULL OR review_key = key_id) AND answer IS NULL
UNION ALL SELECT 'attendance', g.exam_id, g.room_id, NULL, g.number, NULL, 'missing', 'pending', NULL, NULL, NULL, NULL
FROM (SELECT exam_id, room_id, unnest(range(1, maximum + 1)) AS number FROM o_maximum) g JOIN o_confirmed_key k ON k.exam_id = g.exam_id
WHERE NOT EXISTS (SELECT 1 FROM o_state t WHERE t.room_id = g.room_id AND t.number = g.number)
  AND NOT EXISTS (SELECT 1 FROM o_attendance a WHERE a.room_id = g.room_id AND a.student_number = g.number AND (a.skipped OR coalesce(a.status, 'pending') <> 'pending'))
UNION ALL SELECT 'import', f.exam_id, f.room_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, f.seq FROM o_open_failures f JOIN o_confirmed_key k ON k.exam_id = f.exam_id""",
    o_prefilled="""
SELECT *, CASE WHEN prefill IS NOT NULL THEN prefill WHEN kind = 'answer' AND status = 'single_mark' AND candidate IS NOT NULL THEN candidate
               WHEN kind = 'answer' AND status IN ('blank', 'multiple', 'boundary_cross') THEN status END AS value FROM o_issues""",
)


def issues(v):
    return R.issues(state_table(v), answers(v), confirmed_table(v), maximum(v), G.attendance_state(v.attendance), R.open_failures(v.import_log))


@query("import_failures", "S8", "SELECT seq, exam_id, path, purpose, room_id, error FROM o_open_failures")
def import_failures(v):
    return R.open_failures(v.import_log).select("seq", "exam_id", "path", "purpose", "room_id", "error")


@query("issues", "C1 U1", "SELECT * FROM o_issues")
def issues_query(v):
    return issues(v)


@query("order_issues", "O2", "SELECT room_id, kind, source_id, number, question, row_number() OVER (PARTITION BY room_id ORDER BY coalesce(number, 1000000000), coalesce(question, 0), source_id NULLS FIRST, kind, failure_seq) AS place FROM o_issues")
def order_issues(v):
    # written first: a sort of all rows looks at its input twice, to sample it and to sort it
    rows = v.cut("issues", lambda: issues(v).select("room_id", "kind", "source_id", "number", "question", "failure_seq"))
    return placed(R.order_issues(rows), "room_id").drop("failure_seq")


@query("prefill", "P24", "SELECT kind, room_id, source_id, number, question, failure_seq, value FROM o_prefilled")
def prefill(v):
    value = R.prefilled_value(F.col("kind"), F.col("status"), F.col("prefill"), F.col("candidate"))
    return issues(v).select("kind", "room_id", "source_id", "number", "question", "failure_seq", value.alias("value"))


@query("issue_key", "P36", """
SELECT kind, count(*) AS issues, count(DISTINCT (source_id, kind, question, number, key_id, detection_id, failure_seq)) AS keys FROM o_issues GROUP BY kind""")
def issue_key(v):
    rows = issues(v)
    keyed = rows.withColumn("issue_key", F.unhex(R.issue_key(rows)))
    return keyed.groupBy("kind").agg(F.count(F.lit(1)).alias("issues"), F.count_distinct("issue_key").alias("keys"))


SHARED["o_status"] = """
SELECT t.source_id, t.exam_id, t.room_id, CASE WHEN r.key_id = t.key_id AND NOT issue THEN 'ready' WHEN r.review_id IS NOT NULL THEN 'review_again'
         WHEN t.detection_id IS NOT NULL AND t.failure IS NULL AND t.decided AND NOT issue THEN 'prefilled' ELSE 'must_review' END AS status,
       t.failure IS NOT NULL AS unreadable, coalesce(h.same > 1, false) AS duplicate
FROM (SELECT s.*, k.key_id, coalesce(a.decided, false) AS decided, s.source_id IN (SELECT source_id FROM o_issues WHERE source_id IS NOT NULL) AS issue
      FROM o_state s LEFT JOIN o_current_key k ON k.exam_id = s.exam_id
      LEFT JOIN (SELECT s.source_id, count(*) FILTER (WHERE b.auto_resolved AND b.question BETWEEN 1 AND e.question_count) = any_value(e.question_count) AS decided
                 FROM o_state s JOIN v_exams e ON e.exam_id = s.exam_id JOIN o_observed b ON b.source_id = s.source_id GROUP BY s.source_id) a ON a.source_id = s.source_id) t
LEFT JOIN o_review r ON r.source_id = t.source_id
LEFT JOIN (SELECT s.room_id, r.student_number, count(*) AS same FROM o_students s JOIN o_review r ON r.source_id = s.source_id GROUP BY ALL) h ON h.room_id = t.room_id AND h.student_number = r.student_number"""


def _status(v):
    return R.sheet_status(state_table(v), R.newest_observations(v.observations), v.exams, G.current_key(v.keys, v.sources), issues(v), latest(v.reviews, "source_id"))


@query("sheet_status", "A4", "SELECT * FROM o_status")
def sheet_status(v):
    return _status(v)


@query("status_counts", "A4", """
SELECT room_id, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'prefilled') AS prefilled,
       count(*) FILTER (WHERE status IN ('review_again', 'must_review')) AS must_review, count(*) FILTER (WHERE unreadable) AS unreadable FROM o_status GROUP BY room_id""")
def status_counts(v):
    from gradeloom.operators.common import count_when

    status = F.col("status")
    return _status(v).groupBy("room_id").agg(
        count_when(status == "ready").alias("ready"), count_when(status == "prefilled").alias("prefilled"),
        count_when(status.isin("review_again", "must_review")).alias("must_review"), count_when(F.col("unreadable")).alias("unreadable"))


@query("progress", "A5", """
SELECT t.room_id, count(*) AS sheets, count(detection_id) AS processed, CAST(round_even(count(detection_id) * 100e0 / count(*), 0) AS INT) AS percent,
       coalesce(max(p.n), 0) AS pending FROM o_state t LEFT JOIN (SELECT room_id, count(DISTINCT source_id) AS n FROM o_issues WHERE source_id IS NOT NULL GROUP BY room_id) p ON p.room_id = t.room_id
GROUP BY t.room_id""")
def progress(v):
    return R.progress(state_table(v), issues(v))


@query("skip_summary", "A6", """
WITH a AS (SELECT source_id, count(*) FILTER (WHERE NOT ((coalesce(review_key = key_id, false) AND coalesce(review_origin = 'teacher', false)) OR overridden)
             AND (answer IS NULL OR coalesce(state IN ('uncertain', 'multiple'), false))) AS unclear, bool_and(coalesce(review_key = key_id, false)) AS on_key FROM o_answers GROUP BY source_id)
SELECT room_id, count(*) FILTER (WHERE unk) AS unconfirmed_identities, CAST(sum(unclear) AS BIGINT) AS unclear_answers,
       count(*) FILTER (WHERE unk OR failure IS NOT NULL OR unclear > 0 OR NOT on_key) AS unresolved_sheets
FROM (SELECT s.*, a.unclear, a.on_key, number IS NULL OR coalesce(holders > 1, false) OR coalesce(number > maximum, false) AS unk FROM o_sheets s JOIN a ON a.source_id = s.source_id) GROUP BY room_id""")
def skip_summary(v):
    return R.skip_summary(state_table(v), answers(v), maximum(v))


@query("skip_summary_drafts", "A6", """
WITH ed AS (SELECT event_id AS source_id, CASE WHEN event_id % 5 = 0 THEN 'x1' ELSE CAST(user_id % 40 AS VARCHAR) END AS value FROM events WHERE event_id % 3 = 1),
ae AS (SELECT DISTINCT event_id AS source_id, CAST(user_id % 7 + 1 AS INT) AS question FROM events WHERE event_id % 3 = 2),
st AS (SELECT t.source_id, t.room_id, t.failure, CASE WHEN ed.source_id IS NULL THEN t.number WHEN value NOT IN ('x1', '0') THEN CAST(value AS BIGINT) END AS number FROM o_state t LEFT JOIN ed ON ed.source_id = t.source_id),
h AS (SELECT room_id, number, count(*) AS holders FROM st WHERE number IS NOT NULL GROUP BY ALL),
a AS (SELECT o.source_id, count(*) FILTER (WHERE ae.source_id IS NULL AND NOT ((coalesce(review_key = key_id, false) AND coalesce(review_origin = 'teacher', false)) OR overridden)
        AND (answer IS NULL OR coalesce(state IN ('uncertain', 'multiple'), false))) AS unclear, bool_and(coalesce(review_key = key_id, false)) AS on_key
      FROM o_answers o LEFT JOIN ae ON ae.source_id = o.source_id AND ae.question = o.question GROUP BY o.source_id)
SELECT room_id, count(*) FILTER (WHERE unk) AS unconfirmed_identities, CAST(sum(unclear) AS BIGINT) AS unclear_answers, count(*) FILTER (WHERE unk OR failure IS NOT NULL OR unclear > 0 OR NOT on_key) AS unresolved_sheets
FROM (SELECT st.*, a.unclear, a.on_key, st.number IS NULL OR coalesce(holders > 1, false) OR coalesce(st.number > m.maximum, false) AS unk
      FROM st JOIN a ON a.source_id = st.source_id LEFT JOIN h ON h.room_id = st.room_id AND h.number = st.number LEFT JOIN o_maximum m ON m.room_id = st.room_id) GROUP BY room_id""")
def skip_summary_drafts(v):
    """Number drafts on a third of the sheets that events name, answer drafts on another third."""
    event = F.col("event_id")
    value = F.when(event % 5 == 0, "x1").otherwise((F.col("user_id") % 40).cast("string"))
    numbers = v.events.where("event_id % 3 = 1").select(event.alias("source_id"), value.alias("value"))
    edits = v.events.where("event_id % 3 = 2").select(event.alias("source_id"), (F.col("user_id") % 7 + 1).cast("int").alias("question"))
    return R.skip_summary(state_table(v), answers(v), maximum(v), edits, numbers)


@query("union_issues", "U1", "SELECT kind, coalesce(status, '-') AS status, count(*) AS n FROM o_issues GROUP BY ALL")
def union_issues(v):
    return issues(v).groupBy("kind", F.coalesce("status", F.lit("-")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
