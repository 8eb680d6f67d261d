"""Assessment views over the given tables.

Each statement is plain SQL understood by Spark and DuckDB alike, so that a
query and its oracle start from the same rows. Integer arithmetic, explicit
DOUBLE, no array or JSON syntax. One logical clock (``seq``) per log.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.common import spread
from gradeloom.session import cut

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_REVS = "(SELECT 0 AS rev UNION ALL SELECT 1) r"
_QUESTIONS = (
    "(SELECT 1 AS q UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 "
    "UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) s"
)
_THREE = "(SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2) t"
_FOUR = "(SELECT 0 AS b UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) f"

VIEWS: dict[str, str] = {
    # ---- dimensions -------------------------------------------------------
    "v_exams": """
SELECT n_nationkey AS exam_id, n_name AS name, r_name AS subject, 7 AS question_count,
       CASE WHEN n_nationkey % 5 = 0 THEN 45 END AS legacy_max,
       CASE WHEN n_nationkey % 11 = 10 THEN 1 ELSE 0 END AS archived,
       CASE WHEN n_nationkey % 4 = 0 THEN 'default-1' ELSE 'form-' || CAST(n_nationkey % 6 AS STRING) END AS template_id,
       CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 3 END AS template_version,
       n_nationkey AS created_seq
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_rooms": f"""
SELECT n_nationkey * 10 + p AS room_id, n_nationkey AS exam_id, p AS sort_order,
       CASE WHEN p = 0 AND n_nationkey % 2 = 1 THEN NULL WHEN p = 0 THEN 55 WHEN p = 1 THEN 50 END AS expected_max
FROM nation CROSS JOIN {_THREE}""",
    "v_indicators": f"""
SELECT n_nationkey AS exam_id, p AS position,
       CASE p WHEN 0 THEN 'ind-a' WHEN 1 THEN 'ind-b' ELSE 'ind-c' END AS identifier,
       CASE p WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END AS from_question,
       CASE p WHEN 0 THEN CASE WHEN n_nationkey % 4 = 3 THEN 3 ELSE 2 END WHEN 1 THEN 5 ELSE 7 END AS to_question
FROM nation CROSS JOIN {_THREE}""",
    # ---- facts ------------------------------------------------------------
    "v_sources": """
SELECT o_orderkey AS source_id, c_nationkey AS exam_id,
       CASE WHEN o_orderkey % 50 = 0 THEN 'key' ELSE 'student' END AS purpose,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE c_nationkey * 10 + o_custkey % 3 END AS room_id,
       'scan-' || CAST(o_orderkey % 5000 AS STRING) || '.jpg' AS original_name,
       o_orderdate AS created_at,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS archived
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_observations": """
SELECT l_orderkey AS source_id, l_linenumber AS question, l_shipdate AS observed_at,
       l_partkey AS o1, l_suppkey AS o2, l_extendedprice AS o3,
       CASE WHEN l_returnflag = 'A' THEN 'v9' ELSE 'v10' END AS pipeline_version,
       CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS block_ok,
       substr('ABCDE', CAST(l_partkey % 5 AS INT) + 1, 1) AS choice,
       CASE WHEN l_quantity <= 3 THEN 'blank' WHEN l_quantity <= 5 THEN 'multiple' WHEN l_quantity <= 7 THEN 'uncertain'
            WHEN l_quantity <= 8 THEN 'boundary_cross' ELSE 'single_mark' END AS state,
       CASE WHEN l_quantity <= 3 THEN 0e0 ELSE CAST((l_partkey * 7 + l_suppkey * 3) % 1000 AS DOUBLE) / 4000e0 END AS d1,
       CASE WHEN l_quantity <= 3 THEN 0e0 ELSE CAST((l_partkey * 11 + l_suppkey) % 100 AS DOUBLE) / 4000e0 END AS d2,
       CASE WHEN l_quantity <= 3 THEN 0e0 ELSE CAST((l_partkey * 13 + l_suppkey * 5) % 30 AS DOUBLE) / 4000e0 END AS d3,
       CASE WHEN l_quantity <= 3 THEN 0e0 ELSE CAST((l_partkey * 17) % 500 AS DOUBLE) / 4000e0 END AS d4,
       0e0 AS d5,
       CASE WHEN l_quantity <= 3 THEN 0e0 ELSE CAST((l_partkey * 19 + l_suppkey) % 1000 AS DOUBLE) / 3000e0 END AS c1,
       CASE WHEN l_quantity <= 3 THEN 0e0 ELSE CAST((l_partkey * 23) % 100 AS DOUBLE) / 3000e0 END AS c2,
       0e0 AS c3,
       CASE WHEN l_quantity <= 3 THEN 0e0 ELSE CAST((l_partkey * 29) % 500 AS DOUBLE) / 3000e0 END AS c4,
       0e0 AS c5
FROM lineitem""",
    "v_detections": f"""
SELECT o_orderkey AS source_id, CAST(o_orderkey * 10 + rev AS BIGINT) AS detection_id,
       CAST(o_orderkey * 10 + rev AS BIGINT) AS seq, o_orderdate AS created_at,
       CASE WHEN (o_orderkey + rev) % 9 = 0 THEN 'v9' ELSE 'v10' END AS pipeline_version,
       CASE WHEN (o_orderkey + rev) % 7 = 0 THEN 'id-v1' ELSE 'id-v2' END AS identity_version,
       CASE WHEN o_orderkey % 37 = 5 THEN 'decode failed'
            WHEN o_orderkey % 41 = 7 THEN 'answer ROI overlaps question-number strip' END AS failure,
       CASE WHEN o_orderkey % 43 = 3 THEN 'Question-Number Strip crossed' END AS geometry_error,
       CASE WHEN o_orderkey % 29 = 3 THEN 0 ELSE 1 END AS has_registration,
       CASE WHEN o_orderkey % 31 = 4 THEN 1 ELSE 0 END AS alignment_needs_review,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2500 + 1 END AS candidate,
       CAST((o_orderkey * 7 + rev) % 101 AS DOUBLE) AS confidence,
       CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST((o_orderkey * 3 + rev) % 60 AS DOUBLE) END AS confidence_margin,
       CASE WHEN o_orderkey % 5 = 2 THEN 1 ELSE 0 END AS requires_review,
       CASE WHEN o_orderkey % 17 = 1 THEN 1 ELSE 0 END AS selective_auto_accept
FROM orders CROSS JOIN {_REVS}
WHERE (rev = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 53 <> 11""",
    "v_keys": f"""
SELECT exam_id, source_id, CAST(source_id * 10 + rev AS BIGINT) AS key_id, CAST(source_id * 10 + rev AS BIGINT) AS seq,
       q AS question, CASE WHEN rev = 0 THEN 'machine' ELSE 'teacher' END AS origin,
       substr('ABCDE', CAST((exam_id * 3 + q * 7 + rev) % 5 AS INT) + 1, 1) AS choice1,
       CASE WHEN q % 4 = 0 THEN substr('ABCDE', CAST((exam_id * 3 + q * 7 + rev + 1) % 5 AS INT) + 1, 1) END AS choice2
FROM v_sources CROSS JOIN {_REVS} CROSS JOIN {_QUESTIONS}
WHERE purpose = 'key' AND (rev = 0 OR source_id % 7 <> 0)""",
    "v_last_keys": """
SELECT c_nationkey AS exam_id, max(CAST(o_orderkey * 10 + CASE WHEN o_orderkey % 7 <> 0 THEN 1 ELSE 0 END AS BIGINT)) AS last_key
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 50 = 0 AND NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') GROUP BY c_nationkey""",
    "v_reviews": f"""
SELECT CAST(o_orderkey * 10 + rev AS BIGINT) AS review_id, CAST(o_orderkey * 10 + rev AS BIGINT) AS seq,
       o_orderkey AS source_id,
       CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 60 + 1 ELSE o_orderkey % 2500 + 1 END AS student_number,
       CASE WHEN o_orderpriority = '1-URGENT' THEN last_key - 10 ELSE last_key END AS key_id,
       CASE WHEN o_orderpriority = '2-HIGH' THEN 'teacher' ELSE 'machine_with_teacher_identity' END AS origin,
       CAST(o_orderkey * 10 + CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS detection_id,
       o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN v_last_keys ON exam_id = c_nationkey CROSS JOIN {_REVS}
WHERE o_orderstatus = 'F' AND o_orderkey % 50 <> 0 AND (rev = 0 OR o_orderkey % 5 = 0)""",
    "v_review_answers": f"""
SELECT review_id, source_id, q AS question,
       CASE (review_id + q) % 23 WHEN 0 THEN 'blank' WHEN 1 THEN 'multiple' WHEN 2 THEN 'boundary_cross'
            ELSE substr('ABCDE', CAST((review_id * 3 + q * 2) % 5 AS INT) + 1, 1) END AS answer
FROM v_reviews CROSS JOIN {_QUESTIONS}""",
    "v_partials": """
SELECT CAST(o_orderkey * 10 + 5 AS BIGINT) AS partial_id, CAST(o_orderkey * 10 + 5 AS BIGINT) AS seq, o_orderkey AS source_id,
       CASE WHEN o_orderkey % 24 = 1 THEN last_key - 10 ELSE last_key END AS key_id,
       CASE WHEN o_orderkey % 16 = 1 THEN 1 ELSE 0 END AS identity_confirmed,
       CASE WHEN o_orderkey % 16 = 1 THEN o_orderkey % 2500 + 1 END AS student_number,
       CASE WHEN o_orderkey % 16 <> 1 AND o_orderkey % 56 <> 9 THEN CAST(o_orderkey AS BIGINT) + 1 END AS unknown_ordinal,
       CASE WHEN o_orderkey % 16 = 1 THEN 'teacher_confirmed' ELSE 'unknown' END AS identity_origin,
       CAST(o_orderkey * 10 AS BIGINT) AS detection_id,
       CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 2 DAY ELSE o_orderdate + INTERVAL 2 DAY END AS created_at,
       CASE WHEN o_orderkey % 16 = 1 THEN 'review_skipped' ELSE 'review_skipped;Q' || CAST(o_orderkey % 7 + 1 AS STRING) || ' unresolved;identity_unknown' END AS review_issues
FROM orders JOIN customer ON o_custkey = c_custkey JOIN v_last_keys ON exam_id = c_nationkey
WHERE o_orderkey % 8 = 1 AND o_orderkey % 50 <> 0
UNION ALL
SELECT CAST(o_orderkey * 10 + 6 AS BIGINT), CAST(o_orderkey * 10 + 6 AS BIGINT), o_orderkey, last_key,
       CASE WHEN o_orderkey % 48 = 25 THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 48 = 25 THEN NULL ELSE o_orderkey % 2500 + 1 END,
       CASE WHEN o_orderkey % 48 = 25 THEN CAST(o_orderkey AS BIGINT) + 2 END,
       CASE WHEN o_orderkey % 48 = 25 THEN 'unknown' ELSE 'teacher_confirmed' END,
       CAST(o_orderkey * 10 AS BIGINT), o_orderdate + INTERVAL 3 DAY, 'review_skipped'
FROM orders JOIN customer ON o_custkey = c_custkey JOIN v_last_keys ON exam_id = c_nationkey
WHERE o_orderkey % 24 = 1 AND o_orderkey % 50 <> 0""",
    "v_partial_answers": f"""
SELECT partial_id, source_id, q AS question,
       CASE WHEN (partial_id + q) % 4 = 0 THEN 'unresolved'
            ELSE substr('ABCDE', CAST((partial_id + q * 2) % 5 AS INT) + 1, 1) END AS answer
FROM v_partials CROSS JOIN {_QUESTIONS}""",
    "v_identities": """
SELECT event_id AS seq, event_id AS source_id,
       CASE WHEN event_id % 3 = 0 THEN user_id % 60 + 1 ELSE event_id % 2500 + 1 END AS student_number,
       CASE WHEN event_id % 4 = 0 THEN 'teacher_bulk' ELSE 'teacher' END AS origin,
       CASE WHEN event_id % 2 = 0 THEN ts ELSE ts - INTERVAL 40 YEAR END AS created_at
FROM events WHERE event_type = 'signup'""",
    "v_overrides": """
SELECT event_id AS seq, event_id AS source_id, CAST(user_id % 7 + 1 AS INT) AS question,
       CASE WHEN event_id % 13 = 0 THEN last_key - 10 ELSE last_key END AS key_id,
       CASE WHEN event_id % 53 = 11 THEN NULL
            ELSE CAST(event_id * 10 + CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) END AS detection_id,
       CASE WHEN event_id % 11 = 0 THEN 'blank' ELSE substr('ABCDE', CAST(event_id % 5 AS INT) + 1, 1) END AS answer
FROM events JOIN orders ON event_id = o_orderkey JOIN customer ON o_custkey = c_custkey
     JOIN v_last_keys ON exam_id = c_nationkey
WHERE event_type = 'click' OR event_type = 'view'""",
    "v_attendance": """
SELECT event_id AS seq, (user_id % 25) * 10 + event_id % 3 AS room_id, event_id % 60 + 1 AS student_number,
       CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'absent' WHEN 2 THEN 'excused' ELSE 'skipped' END AS status
FROM events WHERE event_type = 'purchase'""",
    "v_import_log": """
SELECT event_id AS seq, user_id % 25 AS exam_id, 'p' || CAST(user_id % 400 AS STRING) AS path,
       CASE WHEN user_id % 10 = 0 THEN 'key' ELSE 'student' END AS purpose,
       CASE WHEN user_id % 10 = 0 THEN NULL ELSE (user_id % 25) * 10 + user_id % 3 END AS room_id,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'imported' END AS outcome,
       CASE WHEN event_type = 'error' THEN 'error ' || CAST(event_id % 5 AS STRING) END AS error
FROM events WHERE event_type = 'error' OR event_type = 'view'""",
    "v_uploads": """
SELECT event_id AS seq, user_id AS session_id, ts, CAST(floor(value * 100000e0) AS BIGINT) AS bytes FROM events""",
    "v_annotation_events": """
SELECT event_id AS seq, user_id AS annotation_id, 'annotator-' || CAST(event_id % 4 AS STRING) AS annotator_id,
       CASE event_type WHEN 'click' THEN 'accept_label' WHEN 'view' THEN 'correct_bbox' WHEN 'error' THEN 'mark_bad_bbox'
                       WHEN 'signup' THEN 'exclude' ELSE 'reset' END AS action, event_id % 11 AS digit
FROM events""",
    "v_candidates": """
SELECT o_orderkey AS source_id, 1 AS pos, o_orderkey % 2500 + 1 AS candidate, CAST(o_orderkey % 101 AS DOUBLE) AS score FROM orders
UNION ALL
SELECT o_orderkey, 2, (o_orderkey + 7) % 2500 + 1, CAST(o_orderkey % 89 AS DOUBLE) FROM orders WHERE o_orderkey % 4 = 0""",
    "v_recognizer_runs": """
SELECT l_orderkey AS source_id, 'variant-' || CAST(l_linenumber AS STRING) AS variant,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_suppkey % 12 + 1 END AS candidate,
       CASE WHEN l_partkey % 8 = 1 THEN NULL ELSE l_quantity END AS raw_score
FROM lineitem""",
    "v_digit_runs": """
SELECT l_orderkey AS source_id, l_linenumber AS pos, l_partkey % 10 AS digit,
       CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE l_quantity END AS raw_score
FROM lineitem""",
    "v_digit_positions": """
SELECT l_orderkey AS source_id, l_linenumber AS pos,
       CASE WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN NULL ELSE max(l_partkey % 10) END AS digit,
       CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN 1 WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN (l_orderkey) % 10 END AS shape
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_reads": """
SELECT o_orderkey AS source_id,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 90 + 10 AS STRING) END AS processed,
       CASE WHEN o_orderkey % 12 = 1 THEN NULL ELSE CAST((o_orderkey * 7) % 1000 AS DOUBLE) / 1000e0 END AS processed_conf,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 90 + 10 AS STRING)
            WHEN o_orderkey % 3 = 1 THEN '1' || CAST(o_custkey % 90 + 10 AS STRING) ELSE CAST(o_custkey % 90 + 10 AS STRING) || '1' END AS gray,
       CASE WHEN o_orderkey % 13 = 1 THEN NULL ELSE CAST((o_orderkey * 11) % 1000 AS DOUBLE) / 1000e0 END AS gray_conf,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 90 + 10 AS STRING) END AS focus,
       CAST((o_orderkey * 13) % 1000 AS DOUBLE) / 1000e0 AS focus_conf, CAST((o_orderkey * 17) % 1000 AS DOUBLE) / 1000e0 AS focus_margin,
       CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS suppressed,
       CASE WHEN o_orderkey % 19 = 2 THEN 1 ELSE 0 END AS merged, CASE WHEN o_orderkey % 23 = 4 THEN 0 ELSE 1 END AS complete,
       CASE WHEN o_orderkey % 4 = 0 THEN 'default-1' ELSE 'form-' || CAST(o_orderkey % 6 AS STRING) END AS template_id
FROM orders""",
    "v_truth": """
SELECT l_orderkey AS source_id, l_linenumber AS question,
       CASE WHEN (l_orderkey + l_linenumber) % 13 = 0 THEN 'uncertain' WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN 'blank'
            WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN 'multiple'
            ELSE substr('ABCDE', CAST((l_orderkey * 3 + l_linenumber) % 5 AS INT) + 1, 1) END AS truth
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_sheet_evidence": """
SELECT o_orderkey AS source_id,
       CASE WHEN o_orderkey % 37 = 5 THEN 1 ELSE 0 END AS failed,
       CAST(o_orderkey % 2500 + 1 AS STRING) AS expected_number,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST((o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END) % 2500 + 1 AS STRING) END AS candidate,
       CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderkey % 2500 + 1 AS STRING) END AS suggestion,
       CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS requires_review,
       CASE WHEN o_orderkey % 12 = 1 THEN NULL ELSE CAST(o_orderkey * 7 % 9000 AS DOUBLE) / 1000e0 END AS grid_residual_px,
       CAST((o_orderkey * 11) % 1000 AS DOUBLE) / 970e0 AS alignment_confidence,
       CASE WHEN o_orderkey % 15 = 2 THEN NULL ELSE CAST(600 + (o_orderkey * 13) % 400 AS DOUBLE) / 1000e0 END AS table_coverage,
       CASE WHEN o_orderkey % 14 = 3 THEN NULL ELSE CAST(500 + (o_orderkey * 17) % 500 AS DOUBLE) / 1000e0 END AS boundary_confidence,
       CAST((o_orderkey * 19) % 8000 AS DOUBLE) / 1000e0 AS grid_line_contrast,
       CAST(400 + (o_orderkey * 23) % 600 AS DOUBLE) / 1000e0 AS grid_line_coverage,
       CASE WHEN o_orderkey % 9 = 4 THEN 1 ELSE 0 END AS review_flag,
       CASE WHEN o_orderkey % 10 = 6 THEN 1 ELSE 0 END AS normalization_flag,
       CASE WHEN o_orderkey % 13 = 1 THEN 0 ELSE 1 END AS has_corners,
       (o_orderkey * 29) % 200 AS inliers, CAST((o_orderkey * 31) % 1000 AS DOUBLE) / 1000e0 AS inlier_ratio,
       CASE o_orderkey % 3 WHEN 0 THEN 'grid-quad' WHEN 1 THEN 'features' ELSE 'paper-quad' END AS selected_candidate,
       CASE WHEN o_orderkey % 16 = 3 THEN 'id-v1' ELSE 'id-v2' END AS pipeline_version,
       CAST(o_orderkey % 700 AS DOUBLE) / 1000e0 AS seconds,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'vol-a' WHEN '2-HIGH' THEN 'vol-b' ELSE 'vol-c' END AS corpus_id
FROM orders""",
    "v_quality": """
SELECT d.doc_id, l.quality AS truth, CASE WHEN d.n_chars >= 500 THEN 1 ELSE 0 END AS pred, d.lang AS corpus_id
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_files": """
SELECT doc_id AS file_id, CAST(doc_id % 25 AS INT) AS exam_id, CASE WHEN doc_id % 50 = 0 THEN 'key' ELSE 'student' END AS purpose,
       CASE WHEN doc_id % 50 = 0 THEN NULL ELSE CAST((doc_id % 25) * 10 + doc_id % 3 AS INT) END AS room_id,
       CASE doc_id % 40 WHEN 7 THEN '.DS_Store' WHEN 9 THEN 'Thumbs.db' ELSE 'f' || CAST(doc_id AS STRING) || '.png' END AS file_name,
       text AS content FROM documents""",
    "v_raw_numbers": """
SELECT o_orderkey AS row_id,
       CASE o_orderkey % 9 WHEN 0 THEN ' ' || CAST(o_custkey AS STRING) || ' '
            WHEN 1 THEN translate(CAST(o_custkey AS STRING), '0123456789', '๐๑๒๓๔๕๖๗๘๙')
            WHEN 2 THEN '000' WHEN 3 THEN 'no ' || CAST(o_custkey AS STRING) WHEN 4 THEN '9' || CAST(o_custkey + 1000000 AS STRING)
            WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '00' || CAST(o_custkey % 1000 AS STRING)
            ELSE CAST(o_custkey AS STRING) END AS raw,
       translate(CAST(o_orderkey AS STRING), '0125878', 'OlZSB/B') || CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '' END AS ocr
FROM orders""",
    "v_labels_text": """
SELECT c_custkey AS row_id, c_nationkey AS exam_id,
       '  ' || c_mktsegment || '   ' || translate(CAST(c_custkey AS STRING), '0123456789', '０１２３４５６７８９') || ' ' AS label,
       CAST(c_custkey AS STRING) AS ascii_number, c_mktsegment AS segment
FROM customer""",
    # ---- templates --------------------------------------------------------
    "v_templates": """
SELECT 'form-' || CAST(p_partkey % 40 AS STRING) AS template_id, p_partkey AS row_id,
       CAST(floor(p_partkey / 40e0) AS BIGINT) + 1 AS version, p_name AS name,
       CASE WHEN p_partkey % 40 = 3 THEN 'builtin' ELSE 'custom' END AS kind,
       CASE WHEN p_size % 9 = 0 THEN 1 ELSE 0 END AS deleted,
       CASE WHEN p_size % 5 = 0 THEN 'draft' ELSE 'auto_detected' END AS geometry_state,
       p_partkey AS created_seq
FROM part""",
    "v_blocks": f"""
SELECT p_partkey AS template_row, b AS block_index,
       b * 5 + 1 AS question_start, b * 5 + 5 AS question_end, 5 AS row_count, 4 AS choice_count,
       b * 200 + 40 + p_size % 3 AS x0, CASE WHEN p_size % 17 = 0 THEN 6 ELSE 30 + p_size % 4 END AS dx,
       100 + p_size AS y0, CASE WHEN p_size % 19 = 0 THEN 0 ELSE 28 + p_size % 5 END AS dy,
       CASE WHEN p_size % 23 = 0 THEN 1 ELSE 0 END AS bad_range,
       CAST(p_partkey % 3 - 1 AS INT) AS shift_x, CAST(p_partkey % 5 - 2 AS INT) AS shift_y
FROM part CROSS JOIN {_FOUR}""",
    "v_lines": """
SELECT l_orderkey AS image_id, CAST(l_partkey % 400 AS INT) AS value, l_partkey AS row_id FROM lineitem""",
    "v_corners": """
SELECT o_orderkey AS image_id, 1000 AS width, 1400 AS height,
       CAST(o_orderkey % 90 AS DOUBLE) AS x1, CAST(o_orderkey % 70 AS DOUBLE) AS y1,
       CAST(999 - o_orderkey % 110 AS DOUBLE) AS x2, CAST(o_orderkey % 50 AS DOUBLE) AS y2,
       CAST(CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 90 + 5 ELSE 999 - o_orderkey % 130 END AS DOUBLE) AS x3,
       CAST(CASE WHEN o_orderkey % 23 = 0 THEN 1500 WHEN o_orderkey % 17 = 0 THEN o_orderkey % 70 + 5 ELSE 1399 - o_orderkey % 300 END AS DOUBLE) AS y3,
       CAST(o_orderkey % 60 AS DOUBLE) AS x4,
       CAST(CASE WHEN o_orderkey % 19 = 0 THEN o_orderkey % 50 + 90 ELSE 1399 - o_orderkey % 200 END AS DOUBLE) AS y4
FROM orders""",
    "v_exam_forms": """
SELECT p_partkey AS row_id, CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END AS name,
       CASE WHEN p_partkey % 17 = 0 THEN repeat('x', 201) ELSE p_type END AS subject,
       CAST(p_size * 2 - 10 AS INT) AS question_count,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_partkey % 10100 AS INT) END AS expected_max,
       CAST(p_partkey % 7 AS INT) AS template_version
FROM part""",
    "v_draft_exams": """
SELECT CAST(floor(c_custkey / 4e0) AS BIGINT) AS exam_id, CAST(20 AS INT) AS question_count FROM customer WHERE c_custkey % 4 = 0""",
    "v_draft_indicators": """
SELECT CAST(floor(c_custkey / 4e0) AS BIGINT) AS exam_id, c_custkey % 4 AS position,
       CASE WHEN c_custkey % 97 = 0 THEN '  ' WHEN c_custkey % 89 = 0 THEN repeat('y', 121)
            WHEN c_custkey % 29 < 3 THEN CASE WHEN c_custkey % 2 = 0 THEN 'same' ELSE ' SAME ' END ELSE 'ind-' || CAST(c_custkey % 4 AS STRING) END AS identifier,
       CAST(c_custkey % 4 * 5 + 1 AS INT) AS from_question,
       CAST(CASE WHEN c_custkey % 23 = 0 THEN 21 WHEN c_custkey % 19 = 0 THEN c_custkey % 4 * 5 WHEN c_custkey % 17 = 0 THEN c_custkey % 4 * 5 + 7
            ELSE c_custkey % 4 * 5 + 5 END AS INT) AS to_question
FROM customer""",
    "v_export_runs": """
SELECT event_id AS seq, user_id % 25 AS exam_id, (user_id % 25) * 10 + user_id % 3 AS room_id,
       'run-' || CAST(event_id AS STRING) AS run_id, CASE WHEN event_id % 6 = 0 THEN 'failed' ELSE 'published' END AS status
FROM events WHERE event_type = 'purchase'""",
    "v_annotations": """
SELECT o_orderkey AS row_id, o_orderkey - CASE WHEN o_orderkey % 101 = 1 THEN 1 ELSE 0 END AS annotation_id,
       CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE o_custkey END AS crop_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'excluded' WHEN 2 THEN CASE WHEN o_orderkey % 97 = 2 THEN 'rejected' ELSE 'accepted' END ELSE 'accepted' END AS label_status,
       CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 35 = 0 THEN '4' END WHEN o_orderkey % 5 = 1 THEN NULL
            WHEN o_orderkey % 71 = 0 THEN '12' ELSE CAST(o_orderkey % 10 AS STRING) END AS label,
       CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE 0 END AS bad_bbox,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS INT) END AS ax1,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 30 + o_orderkey % 41 AS INT) END AS ax2,
       CAST(o_orderkey % 20 AS INT) AS px1, CAST(o_orderkey % 20 + 12 AS INT) AS px2,
       CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE 'annotator-' || CAST(o_custkey % 7 AS STRING) END AS annotator_id,
       CAST(48 + o_orderkey % 32 AS INT) AS crop_width, CAST(24 + o_orderkey % 24 AS INT) AS crop_height
FROM orders""",
    "v_corpus": """
SELECT d.doc_id AS record_id, d.source AS corpus_id, d.text AS content, CASE WHEN d.doc_id % 37 = 0 THEN 'train' ELSE 'held_out' END AS split,
       CASE WHEN d.doc_id % 29 = 0 THEN 'x1' ELSE CAST(d.doc_id % 90 + 1 AS STRING) END AS label,
       CASE WHEN d.doc_id % 31 = 0 THEN 'machine' ELSE 'teacher_confirmed' END AS identity_origin,
       CASE WHEN d.doc_id % 43 = 0 THEN 0 ELSE 1 END AS identity_confirmed
FROM documents d""",
}

_NAME = re.compile(r"\bv_[a-z_]+\b")


def needed(sql: str, definitions: dict[str, str]) -> list[str]:
    """Names of ``definitions`` that ``sql`` uses, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[vo]_[a-z0-9_]+\b", text)):
            if name in definitions and name not in ordered:
                visit(definitions[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    return ordered


class Views:
    """Lazy DataFrames of the views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._frames: dict[str, DataFrame] = {}
        self._cuts: dict[str, DataFrame] = {}

    def fresh(self) -> Views:
        """Same frames, no materialised intermediates: one per query call."""
        other = Views(self.spark, self.folder)
        other._frames = self._frames
        return other

    def dealt(self, table: str, *keys: str) -> Views:
        """Views that read ``table`` dealt by ``keys``: what they group or join by those keys is not shuffled again."""
        other = Views(self.spark, self.folder)
        other._frames[table] = spread(self.table(table), *keys)
        return other

    def cut(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Materialise an intermediate once for all branches of a query."""
        if name not in self._cuts:
            self._cuts[name] = cut(build(), name)
        return self._cuts[name]

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view("v_" + name) if "v_" + name in VIEWS else self.table(name)

    def view(self, name: str) -> DataFrame:
        if name not in self._frames:
            text = VIEWS[name]
            inputs = {
                used: (self.view(used) if used in VIEWS else self.table(used))
                for used in set(re.findall(r"\b\w+\b", text)) & (set(VIEWS) | set(TABLES))
            }
            for used in inputs:
                text = re.sub(rf"\b(FROM|JOIN)\s+{used}\b", rf"\1 {{{used}}} {used}"
                              if not re.search(rf"\b(FROM|JOIN)\s+{used}\s+[a-z]\b", text)
                              else rf"\1 {{{used}}}", text)
            self._frames[name] = self.spark.sql(text, **inputs)
        return self._frames[name]


_OPEN: dict[tuple[str, str], Views] = {}


def open_views(spark: SparkSession, folder: str) -> Views:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Views(spark, folder)
    return _OPEN[key]
