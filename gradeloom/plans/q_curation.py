"""Curation of labels over whole tables."""

from pyspark.sql import functions as F

from gradeloom.operators import curation as C
from gradeloom.plans.q_checks import annotations
from gradeloom.plans.q_identity import training
from gradeloom.plans.registry import SHARED, query


@query("annotation_counts", "A14", """
SELECT label_status, count(*) AS total, count(*) FILTER (WHERE label_status = 'accepted') AS labeled, count(*) FILTER (WHERE label_status = 'excluded') AS excluded,
       count(*) FILTER (WHERE label_status = 'needs_review') AS remaining, count(*) FILTER (WHERE bad_bbox = 1) AS bad_bbox FROM v_annotations GROUP BY label_status""")
def annotation_counts(v):
    return C.annotation_counts(annotations(v), ["label_status"])


@query("next_review", "W13", """
WITH w AS (SELECT row_id FROM v_annotations WHERE label_status = 'needs_review')
SELECT c_custkey AS worker, coalesce((SELECT min(row_id) FROM w WHERE row_id >= c_custkey * 11), (SELECT min(row_id) FROM w)) AS position FROM customer""")
def next_review(v):
    starts = v.customer.select(F.col("c_custkey").alias("worker"), (F.col("c_custkey") * 11).alias("start"))
    return C.next_review(v.annotations, "row_id", starts)


@query("replay_annotations", "W14", """
WITH e AS (SELECT *, action IN ('correct_bbox', 'mark_bad_bbox', 'reset') AS isbox FROM v_annotation_events),
b AS (SELECT *, last_value(CASE WHEN isbox THEN action END IGNORE NULLS) OVER (PARTITION BY annotation_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS box FROM e),
f AS (SELECT *, action <> 'accept_label' OR (coalesce(box, '') <> 'mark_bad_bbox' AND digit BETWEEN 0 AND 9) AS ok FROM b)
SELECT annotation_id, CASE max_by(action, seq) FILTER (WHERE ok) WHEN 'accept_label' THEN 'accepted' WHEN 'exclude' THEN 'excluded' ELSE 'needs_review' END AS label_status,
  CASE WHEN max_by(action, seq) FILTER (WHERE ok) = 'accept_label' THEN max_by(digit, seq) FILTER (WHERE ok) END AS label,
  coalesce(max_by(action, seq) FILTER (WHERE isbox) = 'mark_bad_bbox', false) AS bad_bbox,
  CASE WHEN max_by(action, seq) FILTER (WHERE isbox) = 'mark_bad_bbox' THEN 'bad_bbox' WHEN bool_or(action = 'correct_bbox') THEN 'corrected' ELSE 'proposal' END AS bbox_status,
  count(*) FILTER (WHERE NOT ok) AS refused FROM f GROUP BY annotation_id""")
def replay_annotations(v):
    return C.replay_annotations(v.annotation_events)


def samples(v):
    sequence = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    return v.orders.select(
        F.col("o_orderkey").alias("sample_id"), sequence.alias("sequence"), (40 + F.col("o_orderkey") % 31).cast("int").alias("width"), F.lit(30).alias("height"),
        ((F.col("o_orderkey") % 1000).cast("double") / 1000.0).alias("ink_fraction"))


@query("propose_digit_boxes", "P31 C21", """
SELECT CAST(o AS VARCHAR) || '-digit-' || d AS annotation_id, o AS sample_id, d AS digit_position, CASE WHEN h THEN 'single_digit_without_leading_zero' ELSE 'two_digit_sequence' END AS layout_variant,
  CASE WHEN NOT h THEN substr(s, d + 1, 1) END AS label_proposed, 'needs_review' AS label_status, CASE d WHEN 0 THEN 0 ELSE w // 2 END AS x1, CASE d WHEN 0 THEN w // 2 ELSE w END AS x2,
  concat_ws(',', 'fixed_midline_requires_visual_qc', CASE WHEN h THEN 'leading_zero_not_visible_in_seed_cell' END, CASE WHEN NOT (ink BETWEEN 5 AND 450) THEN 'ink_occupancy_anomaly' END) AS qc_reasons
FROM (SELECT o_orderkey AS o, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS s, o_orderkey % 100 BETWEEN 6 AND 9 AS h, CAST(40 + o_orderkey % 31 AS INT) AS w, o_orderkey % 1000 AS ink, CAST(unnest([0, 1]) AS INT) AS d FROM orders)""")
def propose_digit_boxes(v):
    return C.propose_digit_boxes(samples(v))


@query("stratified_split", "W12", """
WITH h AS (SELECT vec_id AS ref_id, label, sha256('1729:' || CAST(vec_id AS VARCHAR)) AS h FROM embeddings),
n AS (SELECT label, greatest(1, CAST(round_even(count(*) * 0.2e0, 0) AS BIGINT)) AS take FROM h GROUP BY label)
SELECT h.ref_id, h.label, CASE WHEN row_number() OVER (PARTITION BY h.label ORDER BY h.h, h.ref_id) <= n.take THEN 'validation' ELSE 'train' END AS split FROM h JOIN n ON n.label = h.label""")
def stratified_split(v):
    return C.stratified_split(v.embeddings.select(F.col("vec_id").alias("ref_id"), "label"), "ref_id")


@query("golden_labels", "C18 J17", """
SELECT o.source_id, o.question, o.state AS machine_state, a.answer AS teacher_decision, NULL AS visual_label, CASE WHEN d.source_id IS NOT NULL THEN 'disputed' ELSE 'unadjudicated' END AS label_status, d.source_id IS NULL AS usable_for_recognition
FROM o_observed o LEFT JOIN o_snapshot_answers a ON a.source_id = o.source_id AND a.question = o.question
LEFT JOIN (SELECT DISTINCT source_id, question FROM v_overrides) d ON d.source_id = o.source_id AND d.question = o.question""")
def golden_labels(v):
    from gradeloom.operators.review import newest_observations
    from gradeloom.plans.q_state import snapshot_answers

    return C.golden_labels(newest_observations(v.observations), snapshot_answers(v).select("source_id", "question", "answer"), v.overrides)


@query("identity_corpus", "C19 V9 S9", """
SELECT record_id, corpus_id, label, 'held_out' AS split, CASE WHEN identity_origin <> 'teacher_confirmed' OR identity_confirmed <> 1 THEN 'not_teacher_confirmed' WHEN NOT regexp_matches(label, '^[0-9]+$') THEN 'bad_label'
  WHEN record_id % 53 = 0 THEN 'hash_mismatch' WHEN record_id <> (SELECT min(record_id) FROM v_corpus d WHERE d.content = c.content) THEN 'duplicate_content' END AS rejected FROM v_corpus c""")
def identity_corpus(v):
    claimed = F.when(F.col("record_id") % 53 == 0, F.sha2(F.lit("moved"), 256)).otherwise(F.sha2("content", 256))
    return C.identity_corpus(v.corpus.withColumn("sha256", claimed).drop("content"), v.corpus.select("record_id", "content"))


@query("training_ready", "C20 V8", """
SELECT row_id, label, 'seed_only' AS split, CASE WHEN crop_id IS NULL OR crop_id NOT IN (SELECT c_custkey FROM customer) THEN 'missing_crop' WHEN row_id % 41 = 0 THEN 'crop_hash_changed'
  WHEN NOT (x2 > x1) THEN 'bad_bbox' WHEN x2 > crop_width OR 20 > crop_height THEN 'bbox_outside_crop' END AS rejected
FROM (SELECT *, coalesce(ax1, px1) AS x1, CASE WHEN ax1 IS NULL THEN px2 ELSE ax2 END AS x2 FROM v_annotations) WHERE label_status = 'accepted'""")
def training_ready(v):
    digest = lambda c: F.sha2(c.cast("string"), 256)
    rows = annotations(v).withColumn("crop_sha256", F.when(F.col("row_id") % 41 == 0, "changed").otherwise(digest(F.col("crop_id"))))
    return C.training_ready(rows, v.customer.select(F.col("c_custkey").alias("crop_id"), digest(F.col("c_custkey")).alias("sha256")))
