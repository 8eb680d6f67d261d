"""Constraint checks over whole tables."""

from pyspark.sql import functions as F

from gradeloom.operators import checks as K
from gradeloom.operators.common import latest
from gradeloom.plans.q_state import snapshot_answers, records
from gradeloom.plans.registry import SHARED, query

SHARED.update(
    o_bad_drafts="""
WITH r AS (SELECT i.*, e.question_count, regexp_replace(identifier, '^\\s+|\\s+$', '', 'g') AS label FROM v_draft_indicators i JOIN v_draft_exams e ON e.exam_id = i.exam_id)
SELECT exam_id, position, 'blank_identifier' AS rule FROM r WHERE label = ''
UNION ALL SELECT exam_id, position, 'long_identifier' FROM r WHERE length(label) > 120
UNION ALL SELECT exam_id, position, 'duplicate_identifier' FROM r WHERE label <> '' AND EXISTS (SELECT 1 FROM r o WHERE o.exam_id = r.exam_id AND lower(o.label) = lower(r.label) AND o.position < r.position)
UNION ALL SELECT exam_id, position, 'bad_range' FROM r WHERE NOT (from_question >= 1 AND from_question <= to_question AND to_question <= question_count)
UNION ALL SELECT exam_id, position, 'overlap' FROM r WHERE EXISTS (SELECT 1 FROM r o WHERE o.exam_id = r.exam_id AND o.position <> r.position AND o.to_question >= r.from_question
   AND (o.from_question, o.to_question, o.position) < (r.from_question, r.to_question, r.position))""",
    o_new_indicators="SELECT * FROM v_draft_indicators WHERE exam_id NOT IN (SELECT exam_id FROM o_bad_drafts)",
)


@query("check_exams", "V1", """
SELECT row_id, 'bad_name' AS rule FROM v_exam_forms WHERE length(trim(name)) NOT BETWEEN 1 AND 200
UNION ALL SELECT row_id, 'bad_subject' FROM v_exam_forms WHERE length(trim(subject)) NOT BETWEEN 1 AND 200
UNION ALL SELECT row_id, 'bad_question_count' FROM v_exam_forms WHERE question_count NOT BETWEEN 1 AND 60
UNION ALL SELECT row_id, 'bad_maximum' FROM v_exam_forms WHERE expected_max NOT BETWEEN 1 AND 9999
UNION ALL SELECT row_id, 'bad_template_version' FROM v_exam_forms WHERE template_version < 1""")
def check_exams(v):
    return K.check_exams(v.exam_forms, ["row_id"], ["name", "subject"])


@query("check_rooms", "V1", """
WITH r AS (SELECT row_id, exam_id, segment || ' ' || CAST(row_id % 40 AS VARCHAR) AS label, row_id % 10100 AS m FROM v_labels_text)
SELECT row_id, 'duplicate_label' AS rule FROM r WHERE (SELECT count(*) FROM r o WHERE o.exam_id = r.exam_id AND lower(o.label) = lower(r.label)) > 1
UNION ALL SELECT row_id, 'bad_maximum' FROM r WHERE m NOT BETWEEN 1 AND 9999""")
def check_rooms(v):
    number = F.translate((F.col("row_id") % 40).cast("string"), "0123456789", "０１２３４５６７８９")
    cased = F.when(F.col("row_id") % 2 == 0, F.lower("segment")).otherwise(F.col("segment"))
    rooms = v.labels_text.select("row_id", "exam_id", F.concat(F.lit(" "), cased, F.lit("   "), number).alias("label"), (F.col("row_id") % 10100).alias("expected_max"))
    return K.check_rooms(rooms, ["row_id"])


@query("check_indicators", "V2", "SELECT * FROM o_bad_drafts")
def check_indicators(v):
    return K.check_indicators(v.draft_indicators, v.draft_exams)


@query("check_keys", "V3", """
SELECT DISTINCT key_id, 'answer_without_choice' AS rule FROM v_keys WHERE key_id % 11 = 0
UNION ALL SELECT key_id, 'wrong_answer_count' FROM v_keys WHERE key_id % 17 = 0 AND question = 1
UNION ALL SELECT k.key_id, 'not_an_active_key_image' FROM v_keys k LEFT JOIN o_active s ON s.source_id = k.source_id WHERE k.question = 1 AND s.source_id IS NULL""")
def check_keys(v):
    second = F.when(F.col("key_id") % 11 == 0, F.lit("X")).otherwise(F.col("choice2"))
    rows = v.keys.where(~((F.col("key_id") % 17 == 0) & (F.col("question") == 7))).select(
        "exam_id", "source_id", "key_id", "question", F.filter(F.array("choice1", second), lambda x: x.isNotNull()).alias("accepted"))
    return K.check_keys(rows, v.exams, v.sources)


@query("check_reviews", "V4", """
WITH r AS (SELECT r.*, s.exam_id, k.key_id AS now_key, d.detection_id AS now_det FROM v_reviews r LEFT JOIN o_students s ON s.source_id = r.source_id
           LEFT JOIN o_current_key k ON k.exam_id = s.exam_id LEFT JOIN o_detection d ON d.source_id = r.source_id)
SELECT review_id, 'not_an_active_sheet' AS rule FROM r WHERE exam_id IS NULL
UNION ALL SELECT review_id, 'key_changed' FROM r WHERE exam_id IS NOT NULL AND key_id IS DISTINCT FROM now_key
UNION ALL SELECT review_id, 'wrong_answer_count' FROM r WHERE exam_id IS NOT NULL AND review_id % 19 = 0
UNION ALL SELECT review_id, 'unresolved_answer' FROM r WHERE review_id % 29 = 0
UNION ALL SELECT review_id, 'detection_changed' FROM r WHERE detection_id IS DISTINCT FROM now_det""")
def check_reviews(v):
    answers = v.review_answers.where(~((F.col("review_id") % 19 == 0) & (F.col("question") == 7))).withColumn(
        "answer", F.when((F.col("review_id") % 29 == 0) & (F.col("question") == 3), "unresolved").otherwise(F.col("answer")))
    return K.check_reviews(v.reviews, answers, v.sources, v.keys, latest(v.detections, "source_id"), v.exams)


@query("check_annotations", "V8 P30", """
WITH r AS (SELECT *, coalesce(ax1, px1) AS x1, CASE WHEN ax1 IS NULL THEN px2 ELSE ax2 END AS x2 FROM v_annotations)
SELECT row_id, 'duplicate_id' AS rule FROM r WHERE (SELECT count(*) FROM r o WHERE o.annotation_id = r.annotation_id) > 1
UNION ALL SELECT row_id, 'missing_crop' FROM r WHERE crop_id IS NULL OR crop_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT row_id, 'bad_status' FROM r WHERE label_status = 'rejected'
UNION ALL SELECT row_id, 'label_outside_0_9' FROM r WHERE label_status = 'accepted' AND (label IS NULL OR NOT regexp_matches(label, '^[0-9]$'))
UNION ALL SELECT row_id, 'unresolved_bad_bbox' FROM r WHERE label_status = 'accepted' AND bad_bbox = 1
UNION ALL SELECT row_id, 'bad_accepted_bbox' FROM r WHERE label_status = 'accepted' AND NOT (x2 > x1)
UNION ALL SELECT row_id, 'missing_provenance' FROM r WHERE label_status = 'accepted' AND annotator_id IS NULL
UNION ALL SELECT row_id, 'label_without_acceptance' FROM r WHERE label_status <> 'accepted' AND label IS NOT NULL""")
def check_annotations(v):
    return K.check_annotations(annotations(v), v.customer.select(F.col("c_custkey").alias("crop_id")))


def annotations(v):
    box = lambda a, b: F.when(F.col(a).isNotNull(), F.array(F.col(a), F.lit(0), F.col(b), F.lit(20)))
    return v.annotations.withColumn("bad_bbox", F.col("bad_bbox") == 1).withColumn("bbox", K.active_bbox(box("ax1", "ax2"), box("px1", "px2")))


@query("bbox_rules", "P30", """
SELECT row_id, coalesce(ax1, px1) AS x1, CASE WHEN ax1 IS NULL THEN px2 ELSE ax2 END AS x2, CASE WHEN ax1 IS NULL THEN px2 > px1 ELSE ax2 > ax1 END AS valid,
       CASE WHEN ax1 IS NULL THEN px2 ELSE ax2 END <= crop_width AND 20 <= crop_height - 10 AS inside FROM v_annotations""")
def bbox_rules(v):
    return annotations(v).select(
        "row_id", F.element_at("bbox", 1).alias("x1"), F.element_at("bbox", 3).alias("x2"), K.valid_bbox(F.col("bbox")).alias("valid"),
        K.inside_bbox(F.col("bbox"), F.col("crop_width"), F.col("crop_height") - 10).alias("inside"))


@query("check_holdout", "V9", """
SELECT record_id, 'not_held_out' AS rule FROM v_corpus WHERE split <> 'held_out'
UNION ALL SELECT record_id, 'duplicate_content' FROM v_corpus WHERE content IN (SELECT content FROM v_corpus GROUP BY content HAVING count(*) > 1)
UNION ALL SELECT record_id, 'bad_label' FROM v_corpus WHERE NOT regexp_matches(label, '^[0-9]+$')
UNION ALL SELECT record_id, 'unknown_corpus' FROM v_corpus WHERE corpus_id NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING avg(quality) >= 0.5)""")
def check_holdout(v):
    """Known corpora are those of which at least half of the labelled documents are good."""
    rated = v.documents.join(v.labels, "doc_id").groupBy(F.col("source").alias("corpus_id"))
    corpora = rated.agg(F.avg("quality").alias("_share")).where("_share >= 0.5").select("corpus_id")
    return K.check_corpus(v.corpus.withColumn("content_hash", F.sha2("content", 256)), corpora)


@query("check_training", "V10", """
WITH m AS (SELECT c_custkey AS id FROM customer), r AS (SELECT o_custkey AS id, o_orderkey - CASE WHEN o_orderkey % 101 = 1 THEN 1 ELSE 0 END AS rid, o_orderkey, label FROM orders JOIN v_annotations ON row_id = o_orderkey)
SELECT id AS manifest_id, NULL AS record_id, 'wrong_kind' AS rule FROM m WHERE id % 13 = 0
UNION ALL SELECT id, NULL, 'training_not_allowed' FROM m WHERE id % 11 = 0 OR id % 7 = 0
UNION ALL SELECT id, NULL, 'generalization_claim' FROM m WHERE id % 5 = 0
UNION ALL SELECT id, rid, 'duplicate_id' FROM r WHERE (SELECT count(*) FROM r o WHERE o.rid = r.rid AND o.id = r.id) > 1
UNION ALL SELECT id, rid, 'label_outside_0_9' FROM r WHERE label IS NULL OR NOT regexp_matches(label, '^[0-9]$')""")
def check_training(v):
    key = F.col("c_custkey")
    manifests = v.customer.select(
        key.alias("manifest_id"), F.when(key % 13 == 0, "worklist").otherwise("student_number_digit_training_ready_manifest").alias("kind"),
        (key % 11 != 0).alias("training_ready"), (key % 7 != 0).alias("training_allowed"), (key % 5 == 0).alias("generalization_claim_allowed"))
    rows = v.orders.join(v.annotations, F.col("o_orderkey") == F.col("row_id")).select(F.col("o_custkey").alias("manifest_id"), F.col("annotation_id").alias("record_id"), "label")
    return K.check_training(manifests, rows)


@query("check_truth_export", "V12", """
WITH c AS (SELECT *, 2 - CASE WHEN source_id % 31 = 0 THEN 1 ELSE 0 END AS schema_version, 30 - CASE WHEN source_id % 17 = 0 THEN 5 ELSE 0 END AS n FROM o_record WHERE record_type IS NOT NULL)
SELECT source_id, 'schema_version' AS rule FROM c WHERE schema_version <> 2
UNION ALL SELECT source_id, 'too_few_questions' FROM c WHERE n < 30
UNION ALL SELECT source_id, 'not_teacher_reviewed' FROM c WHERE status <> 'teacher_reviewed'
UNION ALL SELECT source_id, 'not_teacher_confirmed' FROM c WHERE NOT coalesce((SELECT bool_and(origin = 'teacher_confirmed') FROM o_snapshot_answers a WHERE a.source_id = c.source_id), false)
UNION ALL SELECT source_id, 'duplicate_name' FROM c WHERE (SELECT count(*) FROM c o WHERE o.exam_id = c.exam_id AND o.original_name = c.original_name) > 1""")
def check_truth_export(v):
    sheets = records(v).where("record_type IS NOT NULL").withColumns({
        "schema_version": 2 - F.when(F.col("source_id") % 31 == 0, 1).otherwise(0), "question_count": 30 - F.when(F.col("source_id") % 17 == 0, 5).otherwise(0)})
    return K.check_truth_export(sheets, snapshot_answers(v), 30)


@query("set_equal", "U4", """
WITH a AS (SELECT source_id FROM o_students), b AS (SELECT DISTINCT source_id FROM v_reviews)
SELECT source_id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT source_id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_equal(v):
    return K.set_equal(v.sources.where("archived = 0 AND purpose = 'student'").select("source_id"), v.reviews.select("source_id"))
