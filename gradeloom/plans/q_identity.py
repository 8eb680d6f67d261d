"""Student-number decisions over every sheet."""

from pyspark.sql import functions as F

from gradeloom.operators import identity as I
from gradeloom.operators.common import merged, spread
from gradeloom.plans.registry import SHARED, query, widen

SHARED.update(
    o_votes="""
SELECT source_id, candidate, votes, round(best + least(2, votes - 1) * 5, 2) AS score,
       row_number() OVER (PARTITION BY source_id ORDER BY best + least(2, votes - 1) * 5 DESC, votes DESC, candidate) AS place
FROM (SELECT source_id, CAST(candidate AS VARCHAR) AS candidate, count(DISTINCT variant) AS votes, greatest(coalesce(max(raw_score), 0), 0) AS best
      FROM v_recognizer_runs WHERE candidate IS NOT NULL GROUP BY ALL)""",
    o_best_digit="SELECT source_id, pos, digit, max(raw_score) AS score FROM v_digit_runs WHERE raw_score IS NOT NULL GROUP BY ALL",
    o_positions="""
SELECT p.source_id, p.pos, p.digit, p.shape, b.score AS ps, alt.digit AS ad, alt.score AS ascore, row_number() OVER (PARTITION BY p.source_id ORDER BY p.pos) AS i
FROM v_digit_positions p JOIN (SELECT source_id FROM v_digit_positions GROUP BY source_id HAVING count(*) BETWEEN 2 AND 6) n ON n.source_id = p.source_id
LEFT JOIN o_best_digit b ON b.source_id = p.source_id AND b.pos = p.pos AND b.digit = p.digit
LEFT JOIN (SELECT p.source_id, p.pos, b.digit, b.score, row_number() OVER (PARTITION BY p.source_id, p.pos ORDER BY b.score DESC, b.digit) AS rn
           FROM v_digit_positions p JOIN o_best_digit b ON b.source_id = p.source_id AND b.pos = p.pos AND b.digit <> p.digit) alt ON alt.source_id = p.source_id AND alt.pos = p.pos AND alt.rn = 1""",
    o_supported="SELECT source_id FROM o_positions GROUP BY source_id HAVING bool_and(digit IS NOT NULL AND ps IS NOT NULL)",
    o_stitched="""
SELECT * FROM (SELECT source_id, string_agg(digit, '' ORDER BY pos) AS candidate, min(ps) AS score FROM o_positions WHERE source_id IN (SELECT source_id FROM o_supported) GROUP BY source_id)
WHERE regexp_matches(candidate, '[1-9]')""",
    o_alternatives="""
SELECT source_id, candidate, max(score) AS score FROM (
  SELECT a.source_id, a.i, string_agg(CASE WHEN b.i = a.i THEN b.ad ELSE b.digit END, '' ORDER BY b.pos) AS candidate, min(CASE WHEN b.i = a.i THEN b.ascore ELSE b.ps END) AS score
  FROM o_positions a JOIN o_positions b ON b.source_id = a.source_id WHERE a.ad IS NOT NULL AND a.source_id IN (SELECT source_id FROM o_supported) GROUP BY ALL)
WHERE regexp_matches(candidate, '[1-9]') GROUP BY ALL""",
    o_shapes="""
SELECT * FROM (SELECT source_id, string_agg(CASE WHEN ch THEN shape ELSE digit END, '' ORDER BY pos) AS candidate, string_agg(CASE WHEN ch THEN i END, ',' ORDER BY pos) AS changed
  FROM (SELECT *, coalesce(shape <> digit, false) OR (digit IS NULL AND shape IS NOT NULL) AS ch FROM o_positions) GROUP BY source_id
  HAVING bool_or(ch) AND bool_and(CASE WHEN digit IS NOT NULL THEN ps IS NOT NULL ELSE shape IS NOT NULL END)) WHERE regexp_matches(candidate, '[1-9]')""",
)


def votes_input(v):
    return v.recognizer_runs.withColumn("candidate", F.col("candidate").cast("string"))


def scored(v):
    return I.position_scores(v.digit_positions, v.digit_runs)


@query("candidate_votes", "A17", "SELECT * FROM o_votes")
def candidate_votes(v):
    return widen(I.candidate_votes(votes_input(v)), "place")


def text_candidates(v):
    return v.candidates.withColumn("candidate", F.col("candidate").cast("string"))


@query("topk_candidates", "W16", """
SELECT source_id, candidate, score, place, margin FROM (
  SELECT source_id, candidate, score, row_number() OVER w AS place, round(score - lead(score) OVER w, 8) AS margin FROM o_votes WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, candidate)) WHERE place <= 3""")
def topk_candidates(v):
    return widen(I.topk_candidates(I.candidate_votes(votes_input(v)).select("source_id", "candidate", "score"), 3), "place")


@query("constrain_candidates", "C17 J11", """
WITH r AS (SELECT c.source_id, CAST(c.candidate AS VARCHAR) AS candidate, c.score, m.maximum FROM v_candidates c JOIN o_students s ON s.source_id = c.source_id JOIN o_maximum m ON m.room_id = s.room_id),
k AS (SELECT *, row_number() OVER w AS rn, round(score - lead(score) OVER w, 8) AS margin FROM r WHERE maximum IS NULL OR CAST(candidate AS BIGINT) <= maximum WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, candidate))
SELECT r.source_id, count(DISTINCT r.candidate) AS raw_candidates, max(r.maximum) AS constraint_max, max(k.candidate) AS candidate, max(k.score) AS confidence, max(k.margin) AS margin
FROM r LEFT JOIN k ON k.source_id = r.source_id AND k.rn = 1 GROUP BY r.source_id""")
def constrain_candidates(v):
    from gradeloom.plans.q_grading import students
    from gradeloom.plans.q_state import maximum

    return I.constrain_candidates(text_candidates(v), students(v).join(maximum(v), "room_id"))


@query("stitch_segments", "A18", "SELECT * FROM o_stitched")
def stitch_segments(v):
    return I.stitch_segments(scored(v))


@query("segment_alternatives", "J19", "SELECT * FROM o_alternatives")
def segment_alternatives(v):
    return I.segment_alternatives(scored(v))


@query("combine_digits", "J19", """
WITH RECURSIVE d AS (SELECT source_id, digit, score, dense_rank() OVER (PARTITION BY source_id ORDER BY pos) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, pos ORDER BY score DESC, digit) AS rn FROM o_best_digit) WHERE rn <= 3),
z AS (SELECT source_id, max(i) AS n FROM d GROUP BY source_id),
n AS (SELECT * FROM z WHERE n <= 6),
c(source_id, i, candidate, score) AS (SELECT source_id, 1, CAST(digit AS VARCHAR), CAST(score AS DOUBLE) FROM d WHERE i = 1 AND source_id IN (SELECT source_id FROM n)
  UNION ALL SELECT c.source_id, c.i + 1, c.candidate || d.digit, least(c.score, d.score) FROM c JOIN d ON d.source_id = c.source_id AND d.i = c.i + 1),
u AS (SELECT c.source_id, c.candidate, max(c.score) AS score FROM c JOIN n ON n.source_id = c.source_id AND n.n = c.i GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER w AS place, round(score - coalesce(lead(score) OVER w, 0), 8) AS margin, greatest(count(*) OVER (PARTITION BY source_id) - 12, 0) AS left_out, CAST(NULL AS VARCHAR) AS reason
               FROM u WINDOW w AS (PARTITION BY source_id ORDER BY score DESC, candidate)) WHERE place <= 12
UNION ALL SELECT source_id, NULL, NULL, NULL, NULL, NULL, 'too_many_digits' FROM z WHERE n > 6""")
def combine_digits(v):
    best = v.digit_runs.where("raw_score IS NOT NULL").groupBy("source_id", "pos", "digit").agg(F.max("raw_score").alias("score"))
    return widen(I.combine_digits(best), "place", "left_out")


@query("refused_segments", "A18 J19", """
SELECT source_id, count(*) AS positions, CASE WHEN count(*) < 2 THEN 'too_few_digits' ELSE 'too_many_digits' END AS reason FROM v_digit_positions GROUP BY source_id HAVING count(*) NOT BETWEEN 2 AND 6""")
def refused_segments(v):
    return I.refused_segments(scored(v))


@query("shape_suggestions", "C16", "SELECT source_id, candidate, changed FROM o_shapes")
def shape_suggestions(v):
    return I.shape_suggestions(scored(v)).select("source_id", "candidate", F.concat_ws(",", F.col("changed_positions").cast("array<string>")).alias("changed"))


SHARED["o_variant"] = """
SELECT source_id, CASE WHEN shorter THEN focus ELSE chosen END AS candidate,
  CASE WHEN shorter THEN 'handwriting-tight' WHEN pick THEN 'processed-tight' ELSE 'gray-tight' END AS variant,
  CASE WHEN shorter THEN 'handwriting_focus_removed_form_artifact' ELSE base END AS reason, shorter AS shortened
FROM (SELECT *, coalesce(chosen IN ('1' || focus, focus || '1'), false) AND length(chosen) = length(focus) + 1 AND (coalesce(focus = processed AND processed_conf >= 0.55, false)
        OR (suppressed = 1 AND focus_conf >= 0.85 AND focus_margin >= 0.40)) AS shorter
  FROM (SELECT *, CASE WHEN pick THEN processed ELSE gray END AS chosen FROM (SELECT *, base IN ('processed_confidence_dominates', 'gray_disagreement_evidence_weak') AS pick
    FROM (SELECT *, CASE WHEN processed = gray THEN 'views_agree' WHEN processed_conf >= 0.9 AND processed_conf - gray_conf >= 0.1 THEN 'processed_confidence_dominates'
            WHEN gray_conf >= 0.25 OR processed IS NULL THEN 'gray_disagreement_evidence_passed' ELSE 'gray_disagreement_evidence_weak' END AS base FROM v_reads))))"""


@query("select_variant", "C14", "SELECT source_id, candidate, variant, reason, coalesce(shortened, false) AS shortened FROM o_variant")
def select_variant(v):
    return I.select_variant(v.reads)


@query("auto_accept_gate", "C15", """
SELECT source_id, coalesce(complete = 1 AND merged = 0 AND template_id IN ('default-1', 'form-1', 'form-2') AND processed IS NOT NULL AND gray IS NOT NULL AND processed = gray
       AND processed_conf >= 0.9 AND focus_margin >= 0.45, false) AS accepted FROM v_reads""")
def auto_accept_gate(v):
    same = F.col("processed") == F.col("gray")
    return v.reads.select("source_id", I.auto_accept(
        F.lit(True), F.lit(0.9), F.lit(0.45), F.col("processed"), F.col("gray"), F.col("processed_conf"), F.col("focus_margin"), F.col("complete") == 1,
        ~same, same, F.col("merged") == 1, F.col("template_id").isin("default-1", "form-1", "form-2")).alias("accepted"))


SHARED.update(
    o_model="""
SELECT r.source_id, CASE WHEN r.source_id % 7 = 0 THEN NULL WHEN r.source_id % 3 = 0 THEN s.candidate ELSE r.processed END AS model, CAST(r.source_id % 40 AS DOUBLE) AS mscore,
       n.n AS boxes, r.complete = 1 AS complete, r.merged = 1 AS merged, r.source_id % 2 = 0 AS narrow, s.candidate AS measured, s.score AS measured_score
FROM v_reads r JOIN (SELECT source_id, count(*) AS n FROM v_digit_positions GROUP BY source_id) n ON n.source_id = r.source_id LEFT JOIN o_stitched s ON s.source_id = r.source_id""",
    o_model_numbers="""
SELECT source_id, model AS candidate, mscore AS score FROM o_model WHERE model IS NOT NULL
UNION ALL SELECT source_id, measured, mscore / 2 FROM o_model WHERE model IS NOT NULL AND measured IS NOT NULL AND source_id % 2 = 0""",
    o_decide="""
WITH m AS (SELECT o.*, coalesce(measured <> model AND measured_score > mscore AND EXISTS (SELECT 1 FROM o_model_numbers x WHERE x.source_id = o.source_id AND x.candidate = o.measured), false) AS prefer FROM o_model o),
runs AS (SELECT source_id, variant, CAST(candidate AS VARCHAR) AS candidate, raw_score FROM v_recognizer_runs WHERE candidate IS NOT NULL),
al AS (SELECT source_id, variant, candidate, raw_score FROM runs UNION ALL SELECT source_id, 'segmented', CASE WHEN prefer OR model IS NULL THEN measured ELSE model END, CASE WHEN prefer OR model IS NULL THEN measured_score ELSE mscore END FROM m
  UNION ALL SELECT source_id, 'segmented-alternative', candidate, score FROM o_model_numbers UNION ALL SELECT source_id, 'segmented-alternative', candidate, score FROM o_alternatives),
vo AS (SELECT source_id, candidate, count(DISTINCT variant) AS votes, round(greatest(coalesce(max(raw_score), 0), 0) + least(2, count(DISTINCT variant) - 1) * 5, 2) AS score FROM al WHERE candidate IS NOT NULL GROUP BY ALL),
fu AS (SELECT vo.*, m.boxes >= 2 AND length(candidate) = m.boxes AS isfull FROM vo JOIN m ON m.source_id = vo.source_id),
ke AS (SELECT *, bool_or(isfull) OVER (PARTITION BY source_id) AS anyfull FROM fu),
k2 AS (SELECT * FROM ke WHERE isfull OR NOT anyfull),
b AS (SELECT m.*, s.candidate AS sc, s.changed, coalesce(complete AND length(s.candidate) = boxes AND s.candidate <> model
        AND list_bool_and(list_transform(string_split(s.changed, ','), lambda x: substr(s.candidate, CAST(x AS INT), 1) = '1')), false) AS promoted FROM m LEFT JOIN o_shapes s ON s.source_id = m.source_id),
rk AS (SELECT k2.*, row_number() OVER (PARTITION BY k2.source_id ORDER BY k2.score DESC, k2.votes DESC, k2.candidate) AS place FROM k2 JOIN b ON b.source_id = k2.source_id WHERE NOT b.promoted OR k2.candidate <> b.sc),
t AS (SELECT b.*, r1.candidate AS c1, r1.score AS s1, r2.score AS s2, sh.score AS shs, coalesce(narrow AND boxes = 2 AND regexp_matches(r1.candidate, '^4.$'), false) AS amb FROM b LEFT JOIN rk r1 ON r1.source_id = b.source_id AND r1.place = 1
      LEFT JOIN rk r2 ON r2.source_id = b.source_id AND r2.place = 2 LEFT JOIN k2 sh ON sh.source_id = b.source_id AND sh.candidate = b.sc),
u AS (SELECT *, CASE WHEN promoted THEN sc WHEN complete AND NOT amb THEN c1 END AS candidate, CASE WHEN promoted THEN s1 ELSE s2 END AS second FROM t),
w AS (SELECT *, round(CASE WHEN candidate IS NULL THEN NULL WHEN promoted THEN coalesce(shs, 0) ELSE s1 END, 2) AS confidence FROM u),
x AS (SELECT *, round(CASE WHEN candidate IS NULL THEN 0 WHEN second IS NOT NULL THEN confidence - second ELSE 100 END, 2) AS margin FROM w),
ind AS (SELECT r.source_id, r.candidate FROM runs r JOIN m ON m.source_id = r.source_id WHERE length(r.candidate) = m.boxes UNION ALL SELECT source_id, measured FROM m WHERE measured IS NOT NULL),
ev AS (SELECT i.source_id, bool_or(coalesce(i.candidate <> x.candidate, false)) AS differs, bool_or(coalesce(i.candidate = x.candidate, false)) AS confirms FROM ind i JOIN x ON x.source_id = i.source_id GROUP BY i.source_id),
y AS (SELECT x.*, candidate IS NOT NULL AND coalesce(differs, false) AS disagreement, coalesce(model = candidate, false) AND coalesce(confirms, false) AS agreement FROM x LEFT JOIN ev ON ev.source_id = x.source_id),
z AS (SELECT *, complete AND NOT merged AND NOT disagreement AND agreement AND coalesce(confidence >= 20, false) AND margin >= 5 AS auto_accept FROM y)
SELECT source_id, candidate, confidence, margin, CASE WHEN prefer THEN 'measured_digit_consensus' WHEN model IS NOT NULL THEN 'digit_model' ELSE 'measured_ocr' END AS primary_source, promoted, disagreement, agreement, auto_accept,
  CASE WHEN auto_accept THEN 'accepted' WHEN second IS NOT NULL AND margin < 20 THEN 'conflicting_candidates' WHEN model IS NOT NULL THEN 'model_candidate' ELSE 'uncalibrated' END AS review_reason FROM z""",
)


@query("decide_identity", "C25 A17 A18 J19 C15 C16", "SELECT * FROM o_decide")
def decide_identity(v):
    dealt = v.dealt("lineitem", "l_orderkey")
    sid, known = F.col("source_id"), F.col("model_candidate").isNotNull()
    model = F.when(sid % 7 == 0, None).when(sid % 3 == 0, F.col("measured")).otherwise(F.col("processed"))
    reads = spread(v.reads.select("source_id", "processed", "complete", "merged"), "source_id")
    number = lambda candidate, score: F.struct(candidate.alias("candidate"), score.alias("score"))
    sheets = reads.join(merged(I.sheet_numbers(scored(dealt))), "source_id").withColumn("model_candidate", model).withColumn("model_score", (sid % 40).cast("double"))
    numbers = F.array_compact(F.array(
        F.when(known, number(F.col("model_candidate"), F.col("model_score"))),
        F.when(known & F.col("measured").isNotNull() & (sid % 2 == 0), number(F.col("measured"), F.col("model_score") / 2))))
    sheets = sheets.withColumns({
        "complete": F.col("complete") == 1, "merged": F.col("merged") == 1, "narrow_lead": sid % 2 == 0, "calibrated": F.lit(True), "numbers": numbers})
    return I.decide_identity(sheets, votes_input(dealt), 20.0, 5.0)


def validation(v):
    return v.embeddings.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("truth"))


def training(v):
    return v.embeddings.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("vector"), "label")


SHARED.update(
    o_knn="""
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 5 = 0), r AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 5 <> 0),
d AS (SELECT q.vec_id AS query_id, r.label, list_distance(q.e, r.e) AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, r.e), r.vec_id) AS rn FROM q, r),
t AS (SELECT query_id, label, count(*) AS votes, min(dist) AS near FROM d WHERE rn <= 5 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, near, label) AS place FROM t)
SELECT a.query_id, a.label, round(20e0 * a.votes, 4) AS score, CASE WHEN b.votes IS NULL THEN 100e0 ELSE round(20e0 * (a.votes - b.votes), 4) END AS margin
FROM k a LEFT JOIN k b ON b.query_id = a.query_id AND b.place = 2 WHERE a.place = 1""",
    o_centroids="SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL",
    o_train_centroids="SELECT label, pos, avg(x) AS mean FROM (SELECT label, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY ALL",
    o_nearest="""
SELECT query_id, arg_min(label, dist) AS label, round(100e0 / (1e0 + min(dist)), 4) AS score FROM (
  SELECT q.query_id, c.label, sqrt(sum((q.x - c.mean) * (q.x - c.mean))) AS dist FROM (SELECT vec_id AS query_id, unnest(range(1, 65)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 5 = 0) q
  JOIN o_train_centroids c ON c.pos = q.pos GROUP BY ALL) GROUP BY query_id""",
)


#: Bucket length of the approximate mode: the vectors have length 1.
BUCKET = 1.0


@query("knn", "J16", "SELECT * FROM o_knn")
def knn(v):
    return I.knn_vote(I.knn(validation(v), training(v)))


@query("centroids", "A16", "SELECT label, pos - 1 AS pos, round(mean, 6) AS mean FROM o_centroids")
def centroids(v):
    return I.centroids(v.embeddings.select(F.col("embedding").alias("vector"), "label")).select("label", F.posexplode("centroid")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("col", 6).alias("mean"))


@query("nearest_centroid", "A16", "SELECT * FROM o_nearest")
def nearest_centroid(v):
    return I.nearest_centroid(validation(v).select("query_id", "vector"), I.centroids(training(v)))


@query("knn_hashed", "J16", "SELECT 5 * count(*) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 5 = 0")
def knn_hashed(v):
    """The approximate mode against the exact one: at least nine of ten neighbours are found."""
    found = I.knn_hashed(validation(v).select("query_id", "vector"), training(v), bucket=BUCKET)
    measured = I.recall(found, I.knn(validation(v).select("query_id", "vector"), training(v)))
    return measured.select("neighbours", (F.col("recall") >= 0.9).alias("enough"))
