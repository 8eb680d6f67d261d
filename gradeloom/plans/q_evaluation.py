"""Evaluation reports over every truth cell and sheet."""

from pyspark.sql import functions as F

from gradeloom.operators import evaluate as E
from gradeloom.operators import identity as I
from gradeloom.operators.review import newest_observations
from gradeloom.plans.q_identity import training, validation
from gradeloom.plans.q_marks import measured
from gradeloom.plans.registry import SHARED, query

SHARED.update(
    o_predicted="SELECT source_id, question, state, CASE WHEN state = 'single_mark' THEN choice END AS choice, auto_resolved FROM o_observed",
    o_compared="""
SELECT source_id, question, es AS expected_state, CASE WHEN es = 'single' THEN truth END AS expected_choice, CASE WHEN NOT failed THEN ps END AS predicted_state, CASE WHEN NOT failed AND ps = 'single' THEN choice END AS predicted_choice, outcome,
  CASE WHEN failed OR es = 'uncertain' THEN NULL ELSE outcome IN ('blank_state_match', 'multiple_state_match_choice_subset_unavailable', 'exact_choice_match') END AS state_match,
  es <> 'uncertain' AND NOT failed AND outcome NOT IN ('blank_state_match', 'multiple_state_match_choice_subset_unavailable', 'exact_choice_match') AND coalesce(auto_resolved, false) AS unsafe, failed
FROM (SELECT *, CASE WHEN failed THEN 'not_run_registration_failed' WHEN es = 'uncertain' THEN CASE WHEN ps = 'uncertain' THEN 'safe_uncertain_on_unresolved_truth' ELSE 'unsafe_decision_on_unresolved_truth' END
    WHEN ps = 'uncertain' THEN 'machine_uncertain' WHEN ps = 'blank' THEN CASE WHEN es = 'blank' THEN 'blank_state_match' ELSE 'false_blank' END
    WHEN ps = 'multiple' THEN CASE WHEN es = 'multiple' THEN 'multiple_state_match_choice_subset_unavailable' ELSE 'false_multiple' END
    WHEN es = 'multiple' THEN 'multiple_state_missed' WHEN es = 'single' AND ps = 'single' THEN CASE WHEN choice = truth THEN 'exact_choice_match' ELSE 'wrong_choice' END
    WHEN ps = 'boundary_cross' THEN 'boundary_cross' ELSE 'wrong_state' END AS outcome
  FROM (SELECT t.source_id, t.question, t.truth, CASE WHEN length(t.truth) = 1 THEN 'single' ELSE t.truth END AS es, CASE p.state WHEN 'single_mark' THEN 'single' ELSE coalesce(p.state, 'uncertain') END AS ps,
          p.choice, p.auto_resolved, t.source_id % 37 = 5 AS failed FROM v_truth t LEFT JOIN o_predicted p ON p.source_id = t.source_id AND p.question = t.question AND (t.source_id + t.question) % 11 <> 0))""",
)


def predictions(v):
    """Newest observations; one row in eleven is missing on purpose."""
    rows = newest_observations(v.observations).where((F.col("source_id") + F.col("question")) % 11 != 0)
    return rows.select("source_id", "question", "state", F.when(F.col("state") == "single_mark", F.array("choice")).alias("selected"), "auto_resolved")


def compared(v):
    return E.truth_join(v.truth, predictions(v), v.sheet_evidence.where("failed = 1").select("source_id"))


@query("truth_join", "J13 P25", "SELECT * FROM o_compared")
def truth_join(v):
    return compared(v)


@query("truth_and_prediction_state", "P25", """
SELECT source_id, question, CASE WHEN length(truth) = 1 THEN 'single' ELSE truth END AS truth_state, CASE WHEN length(truth) = 1 THEN truth END AS truth_choice FROM v_truth""")
def truth_states(v):
    t = E.truth_state(F.concat(F.lit(" "), F.lower("truth")))
    return v.truth.select("source_id", "question", t["state"].alias("truth_state"), t["choice"].alias("truth_choice"))


@query("truth_lists", "P25", """
SELECT source_id, question, CASE WHEN truth = 'blank' THEN 'blank' WHEN truth = 'multiple' THEN 'multiple' WHEN length(truth) = 1 THEN 'single' ELSE 'uncertain' END AS truth_state, CASE WHEN length(truth) = 1 THEN truth END AS truth_choice FROM v_truth""")
def truth_lists(v):
    """Every truth given as a list of choices: none, one or several."""
    t = F.col("truth")
    listed = F.when(t == "blank", F.array().cast("array<string>")).when(t == "multiple", F.array(F.lit("a "), F.lit("B"))).otherwise(F.array(t, F.concat(F.lit(" "), F.lower(t))))
    state = E.truth_state(E.truth_text(listed))
    return v.truth.select("source_id", "question", state["state"].alias("truth_state"), state["choice"].alias("truth_choice"))


@query("outcome_counts", "A7", """
SELECT source_id, outcome, count(*) AS n FROM o_compared GROUP BY ALL UNION ALL SELECT NULL, outcome, count(*) FROM o_compared GROUP BY outcome""")
def outcome_counts(v):
    return E.outcome_counts(compared(v))


@query("accuracy_report", "A8", """
SELECT *, round(CAST(state_matches AS DOUBLE) / comparable_cells, 6) AS match_rate_registered, round(CAST(state_matches AS DOUBLE) / resolved_cells, 6) AS match_rate_end_to_end,
  round(CAST(exact_single AS DOUBLE) / single_cells, 6) AS exact_rate_end_to_end, round(CAST(exact_single AS DOUBLE) / single_registered, 6) AS exact_rate_registered
FROM (SELECT count(*) FILTER (WHERE expected_state <> 'uncertain') AS resolved_cells, count(*) FILTER (WHERE state_match) AS state_matches, count(state_match) AS comparable_cells,
        count(*) FILTER (WHERE outcome = 'exact_choice_match') AS exact_single, count(*) FILTER (WHERE expected_state = 'single') AS single_cells,
        count(*) FILTER (WHERE expected_state = 'single' AND NOT failed) AS single_registered, count(*) FILTER (WHERE expected_state = 'multiple') AS multiple_cells,
        count(*) FILTER (WHERE failed) AS failed_cells, count(*) FILTER (WHERE unsafe) AS unsafe FROM o_compared),
     (SELECT count(*) AS sheets, CAST(sum(failed) AS BIGINT) AS sheets_failed, count(*) FILTER (WHERE candidate = expected_number) AS number_exact,
        count(*) FILTER (WHERE coalesce(candidate = expected_number, false) OR coalesce(suggestion = expected_number, false)) AS number_available,
        CAST(sum(requires_review) AS BIGINT) AS number_review, max(grid_residual_px) AS worst_residual, min(alignment_confidence) AS lowest_confidence FROM v_sheet_evidence)""")
def accuracy_report(v):
    return E.accuracy_report(compared(v), v.sheet_evidence)


@query("visual_accuracy_report", "A9", """
SELECT *, round(CAST(exact_match AS DOUBLE) / resolved, 6) AS exact_accuracy FROM (
SELECT CASE WHEN question <= 5 THEN 'active' ELSE 'out_of_key' END AS scope, count(*) FILTER (WHERE k = 'exact_match') AS exact_match, count(*) FILTER (WHERE k = 'wrong') AS wrong,
  count(*) FILTER (WHERE k = 'false_multi') AS false_multi, count(*) FILTER (WHERE k = 'false_blank') AS false_blank, count(*) FILTER (WHERE k = 'machine_uncertain') AS machine_uncertain,
  count(*) FILTER (WHERE k = 'machine_uncertain_on_ambiguous') AS machine_uncertain_on_ambiguous, count(*) FILTER (WHERE k = 'unsafe_decision_on_ambiguous') AS unsafe_decision_on_ambiguous,
  count(*) AS cells, count(*) FILTER (WHERE k NOT LIKE '%ambiguous') AS resolved
FROM (SELECT question, CASE WHEN truth = 'uncertain' THEN CASE WHEN act = 'uncertain' THEN 'machine_uncertain_on_ambiguous' ELSE 'unsafe_decision_on_ambiguous' END
        WHEN (length(truth) = 1 AND act = 'single_mark' AND choice = truth) OR (length(truth) > 1 AND act = truth) THEN 'exact_match' WHEN act = 'uncertain' THEN 'machine_uncertain'
        WHEN act = 'multiple' AND truth <> 'multiple' THEN 'false_multi' WHEN act = 'blank' AND truth <> 'blank' THEN 'false_blank' ELSE 'wrong' END AS k
      FROM (SELECT t.*, coalesce(p.state, 'uncertain') AS act, p.choice FROM v_truth t LEFT JOIN o_predicted p ON p.source_id = t.source_id AND p.question = t.question AND (t.source_id + t.question) % 11 <> 0)) GROUP BY 1)""")
def visual_accuracy_report(v):
    return E.visual_accuracy_report(v.truth, predictions(v), 5)


def records(v):
    return v.sheet_evidence.withColumn("truth", F.col("expected_number"))


@query("recognizer_summary", "A10", """
WITH r AS (SELECT *, coalesce(candidate = expected_number, false) AS ex FROM v_sheet_evidence),
s AS (SELECT corpus_id, count(*) AS records, count(*) FILTER (WHERE ex) AS exact, count(*) FILTER (WHERE candidate IS NOT NULL AND NOT ex) AS wrong,
  count(*) FILTER (WHERE ex OR coalesce(suggestion = expected_number, false)) AS visible, count(*) FILTER (WHERE requires_review = 1) AS review_required,
  count(*) FILTER (WHERE requires_review = 0) AS auto_accept, count(*) FILTER (WHERE requires_review = 0 AND NOT ex) AS wrong_auto_accept, avg(seconds) AS secs,
  count(*) FILTER (WHERE pipeline_version = 'id-v1') AS n1, count(*) FILTER (WHERE pipeline_version = 'id-v2') AS n2 FROM r GROUP BY ROLLUP(corpus_id))
SELECT corpus_id, records, exact, wrong, visible, review_required, auto_accept, wrong_auto_accept, round(CAST(exact AS DOUBLE) / records, 6) AS exact_rate, round(CAST(visible AS DOUBLE) / records, 6) AS visible_rate,
  round(CAST(auto_accept AS DOUBLE) / records, 6) AS auto_accept_coverage, round(secs, 6) AS mean_seconds, 'id-v1:' || n1 || ',id-v2:' || n2 AS versions FROM s""")
def recognizer_summary(v):
    out = E.recognizer_summary(records(v))
    listed = F.transform(F.map_entries("versions"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.withColumn("versions", F.array_join(listed, ","))


@query("visible_candidates", "U3", """
SELECT source_id, coalesce(candidate = expected_number, false) OR coalesce(suggestion = expected_number, false) OR (source_id % 5 = 0 AND candidate IS NOT NULL) AS visible FROM v_sheet_evidence""")
def visible_candidates(v):
    more = F.array("candidate", F.when((F.col("source_id") % 5 == 0) & F.col("candidate").isNotNull(), F.col("expected_number")))
    return v.sheet_evidence.select("source_id", E.visible_candidates(F.col("candidate"), more, F.array("suggestion"), F.col("expected_number")).alias("visible"))


def _bootstrap_sql() -> str:
    body = "SELECT it, n, CAST(1729 AS HUGEINT) AS s0, (it * n + k + 1) % 4294967296 AS step FROM b"
    for bit, (a, c) in enumerate(E.lcg_powers()):
        body = f"SELECT it, n, step, CASE WHEN (step >> {bit}) & 1 = 1 THEN (s{bit} * {a} + {c}) % 4294967296 ELSE s{bit} END AS s{bit + 1} FROM ({body})"
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, CASE WHEN truth = pred THEN 1 ELSE 0 END AS hit FROM v_quality),
b AS (SELECT it, n, unnest(range(0, n)) AS k FROM (SELECT unnest(range(0, 2000)) AS it, (SELECT count(*) FROM v) AS n)),
e AS (SELECT d.it, d.n, CAST(sum(v.hit) AS BIGINT) AS hits FROM ({body}) d JOIN v ON v.idx = CAST(d.s{len(E.lcg_powers())} % d.n AS BIGINT) GROUP BY d.it, d.n),
r AS (SELECT *, row_number() OVER (ORDER BY hits) AS rn FROM e)
SELECT n AS records, round(CAST(max(hits) FILTER (WHERE rn = 51) AS DOUBLE) / n, 6) AS low, round(CAST(max(hits) FILTER (WHERE rn = 1950) AS DOUBLE) / n, 6) AS high FROM r GROUP BY n"""


@query("bootstrap_ci", "A11", _bootstrap_sql())
def bootstrap_ci(v):
    return E.bootstrap_ci(v.quality, "doc_id", F.col("truth") == F.col("pred"))


@query("margin_stats", "A12", """
SELECT source_id, min(m) AS min_margin, max(m) AS max_margin, count(*) FILTER (WHERE state = 'single_mark') AS single_mark, count(*) FILTER (WHERE state = 'blank') AS blank,
  count(*) FILTER (WHERE state = 'multiple') AS multiple, count(*) FILTER (WHERE state = 'uncertain') AS uncertain, count(*) FILTER (WHERE o1 % 9 = 0) AS all_choices,
  list_sort(list(m))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_margin
FROM (SELECT source_id, o1, state, round(greatest(d1, d2, d3, d4, d5) - list_sort([d1, d2, d3, d4, d5])[4], 6) AS m FROM v_observations) GROUP BY source_id""")
def margin_stats(v):
    from gradeloom.functions.marks import top_two_margin

    everything = F.array(*[F.lit(c) for c in "ABCDE"])
    rows = measured(v).select("source_id", "state", top_two_margin(F.col("densities")).alias("margin"), F.when(F.col("o1") % 9 == 0, everything).otherwise(F.array("choice")).alias("selected"))
    return E.margin_stats(rows)


@query("run_report", "A13", """
SELECT *, round(CAST(review AS DOUBLE) / evaluated, 6) AS review_rate FROM (
SELECT s.corpus_id, count(*) AS evaluated, count(*) FILTER (WHERE failed = 0) AS accepted, count(*) FILTER (WHERE failed = 1) AS rejected,
  CAST(coalesce(sum(cells) FILTER (WHERE failed = 0), 0) AS BIGINT) AS cells, CAST(coalesce(sum(exact) FILTER (WHERE failed = 0), 0) AS BIGINT) AS exact,
  count(*) FILTER (WHERE failed = 0 AND requires_review = 1) AS review, round(sum(seconds), 4) AS sum_seconds, round(avg(seconds), 4) AS mean_seconds, round(max(seconds), 4) AS max_seconds
FROM v_sheet_evidence s LEFT JOIN (SELECT source_id, count(*) AS cells, count(*) FILTER (WHERE outcome = 'exact_choice_match') AS exact FROM o_compared GROUP BY source_id) c ON c.source_id = s.source_id GROUP BY s.corpus_id)""")
def run_report(v):
    return E.run_report(v.sheet_evidence, compared(v))


@query("registration_report", "A25", """
SELECT selected_candidate, count(*) AS sheets, count(*) FILTER (WHERE failed = 0) AS registered, count(*) FILTER (WHERE failed = 1) AS failed, max(grid_residual_px) AS worst_residual,
       min(alignment_confidence) AS worst_confidence FROM v_sheet_evidence GROUP BY selected_candidate""")
def registration_report(v):
    return E.registration_report(v.sheet_evidence)


@query("confusion_matrix", "A22", """
SELECT CASE WHEN grouping(expected_state) = 1 THEN 'total' ELSE expected_state END AS truth, count(*) FILTER (WHERE predicted_state = 'single') AS p_single, count(*) FILTER (WHERE predicted_state = 'multiple') AS p_multiple,
  count(*) FILTER (WHERE predicted_state = 'blank') AS p_blank, count(*) FILTER (WHERE predicted_state = 'uncertain') AS p_uncertain, count(*) FILTER (WHERE predicted_state = 'boundary_cross') AS p_boundary_cross, count(*) FILTER (WHERE predicted_state = 'other') AS p_other,
  count(*) FILTER (WHERE predicted_state = 'invalid_prediction') AS p_invalid_prediction, CAST(0 AS BIGINT) AS p_rest, count(*) AS total
FROM o_compared WHERE NOT failed GROUP BY ROLLUP(expected_state)""")
def confusion_matrix(v):
    return E.confusion_matrix(compared(v).where("NOT failed"), "expected_state", "predicted_state", ["single", "multiple", "blank", "uncertain", "boundary_cross", "other", "invalid_prediction"])


@query("choice_confusion", "A22", """
SELECT CASE WHEN grouping(expected_choice) = 1 THEN 'total' ELSE expected_choice END AS truth, count(*) FILTER (WHERE predicted_choice = 'A') AS p_A, count(*) FILTER (WHERE predicted_choice = 'B') AS p_B,
  count(*) FILTER (WHERE predicted_choice = 'C') AS p_C, count(*) FILTER (WHERE predicted_choice = 'D') AS p_D, count(*) FILTER (WHERE predicted_choice = 'E') AS p_E,
  count(*) FILTER (WHERE predicted_choice IS NULL) AS p_rest, count(*) AS total
FROM o_compared WHERE NOT failed AND expected_choice IS NOT NULL GROUP BY ROLLUP(expected_choice)""")
def choice_confusion(v):
    return E.confusion_matrix(compared(v).where("NOT failed AND expected_choice IS NOT NULL"), "expected_choice", "predicted_choice", list("ABCDE"))


@query("label_counts", "A15", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def label_counts(v):
    return E.label_counts(v.embeddings.select("label"))


@query("majority_baseline", "A15", """
WITH m AS (SELECT label FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label ORDER BY count(*) DESC, min(vec_id) LIMIT 1)
SELECT (SELECT label FROM m) AS label, count(*) AS records, count(*) FILTER (WHERE label = (SELECT label FROM m)) AS exact FROM embeddings WHERE vec_id % 5 = 0""")
def majority_baseline(v):
    best = E.majority_label(training(v)).select("label")
    rows = validation(v).crossJoin(F.broadcast(best))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("truth") == F.col("label"), 1)).alias("exact"))


SHARED["o_classifiers"] = """
WITH p AS (SELECT 'knn' AS kind, query_id, label FROM o_knn UNION ALL SELECT 'centroid', query_id, label FROM o_nearest
  UNION ALL SELECT 'naive_majority', vec_id, (SELECT label FROM embeddings WHERE vec_id % 5 <> 0 GROUP BY label ORDER BY count(*) DESC, min(vec_id) LIMIT 1) FROM embeddings WHERE vec_id % 5 = 0),
r AS (SELECT kind, count(*) AS records, count(*) FILTER (WHERE p.label = e.label) AS exact FROM p JOIN embeddings e ON e.vec_id = p.query_id GROUP BY kind)
SELECT kind, records, exact, round(CAST(exact AS DOUBLE) / records, 6) AS exact_rate, kind = (SELECT kind FROM r WHERE kind <> 'naive_majority' ORDER BY exact DESC, kind = 'knn' DESC LIMIT 1) AS selected FROM r"""


@query("evaluate_classifiers", "A23", "SELECT * FROM o_classifiers")
def evaluate_classifiers(v):
    queries = validation(v).select("query_id", "vector")
    tagged = lambda kind, df: df.select(F.lit(kind).alias("kind"), "query_id", "label")
    naive = queries.crossJoin(F.broadcast(E.majority_label(training(v)).select("label")))
    rows = tagged("knn", I.knn_vote(I.knn(queries, training(v)))).unionByName(
        tagged("centroid", I.nearest_centroid(queries, I.centroids(training(v))))).unionByName(tagged("naive_majority", naive))
    return E.evaluate_classifiers(rows, validation(v).select("query_id", "truth"))


@query("hash_verified_join", "J17", """
SELECT s.source_id, s.original_name, s.h AS sha256, f.h AS fixture_sha256, coalesce(s.h = f.h, false) AS verified
FROM (SELECT source_id, original_name, sha256('d' || CAST(source_id % 5000 AS VARCHAR)) AS h FROM v_sources) s
LEFT JOIN (SELECT 'scan-' || CAST(doc_id AS VARCHAR) || '.jpg' AS name, sha256(CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE 'd' END || CAST(doc_id AS VARCHAR)) AS h FROM documents) f ON f.name = s.original_name""")
def hash_verified_join(v):
    results = v.sources.select("source_id", "original_name", F.sha2(F.concat(F.lit("d"), (F.col("source_id") % 5000).cast("string")), 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 10 == 0, "x").otherwise("d")
    fixtures = v.documents.select(F.concat(F.lit("scan-"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("original_name"),
                                  F.sha2(F.concat(changed, F.col("doc_id").cast("string")), 256).alias("sha256"))
    return E.hash_verified_join(results, fixtures).select("source_id", "original_name", "sha256", "fixture_sha256", "verified")
