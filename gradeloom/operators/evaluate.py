"""Recognition and grading evaluation reports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.common import (
    CHOICES, at_rank, count_when, dense_number, rate, ranked_values, yes,
)


def score_flags(sheets: DataFrame, answers: DataFrame, key: DataFrame) -> DataFrame:
    """Score and sorted review flags per sheet; a question without an answer is blank."""
    asked = sheets.join(key.select("exam_id", "question", "accepted"), "exam_id")
    rows = asked.join(answers, ["source_id", "question"], "left")
    hit = yes(F.col("answer").isin(*CHOICES) & F.array_contains("accepted", F.col("answer")))
    return rows.groupBy("source_id").agg(
        count_when(hit).alias("score"),
        F.bool_or(F.coalesce("answer", F.lit("blank")) == "blank").alias("_blank"),
        F.bool_or(yes(F.col("answer") == "multiple")).alias("_multiple"),
    ).select("source_id", "score", F.concat_ws(",", F.when(F.col("_blank"), "blank_answer"), F.when(F.col("_multiple"), "multiple_mark")).alias("flags"))


# ---- truth against prediction ----------------------------------------------


def truth_text(values: Column) -> Column:
    """Truth given as a list of choices, as the text that ``truth_state`` reads: none is blank, several are multiple."""
    clean = F.array_distinct(F.filter(F.transform(values, lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return F.when(F.size(clean) == 0, "blank").when(F.size(clean) > 1, "multiple").otherwise(F.get(clean, 0))


# The words of truth and the names of outcomes.
def truth_state(value: Column) -> Column:
    """single / multiple / blank / uncertain / unknown, with the exact choice of a single."""
    upper, lower = F.upper(F.trim(value)), F.lower(F.trim(value))
    state = (
        F.when(value.isNull(), "blank").when(upper.isin(*CHOICES), "single").when(lower.isin("multiple", "multi"), "multiple")
        .when(lower.isin("blank", "", "none", "unanswered"), "blank").when(lower.isin("uncertain", "unknown", "review"), "uncertain").otherwise("unknown")
    )
    return F.struct(state.alias("state"), F.when(upper.isin(*CHOICES), upper).alias("choice"))


def prediction_state(classification: Column, selected: Column) -> Column:
    """Machine state with its sorted distinct choices; nothing predicted is uncertain."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(selected, lambda c: F.upper(F.trim(c))), lambda c: c != "")))
    chosen = F.coalesce(clean, F.array().cast("array<string>"))
    state = (
        F.when(classification.isNull(), "uncertain").when((classification == "single_mark") & (F.size(chosen) != 1), "invalid_prediction")
        .when(classification == "single_mark", "single").when(classification.isin("multiple", "blank", "uncertain", "boundary_cross"), classification).otherwise("other")
    )
    return F.struct(state.alias("state"), chosen.alias("choices"))


def truth_join(truth: DataFrame, predictions: DataFrame, failed: DataFrame) -> DataFrame:
    """Every truth row against its prediction; sheets that failed to register are not run.

    ``truth``: source_id, question, truth; ``predictions``: source_id, question,
    state, selected, auto_resolved; ``failed``: source_id.
    """
    rows = truth.join(predictions, ["source_id", "question"], "left").join(
        failed.select("source_id", F.lit(True).alias("_failed")).distinct(), "source_id", "left"
    )
    rows = rows.withColumn("_t", truth_state(F.col("truth"))).withColumn("_p", prediction_state(F.col("state"), F.col("selected")))
    expected, predicted = F.col("_t.state"), F.col("_p.state")
    open_truth = expected.isin("unknown", "uncertain")
    exact = (expected == "single") & (predicted == "single") & (F.col("_p.choices") == F.array("_t.choice"))
    outcome = (
        F.when(F.col("_failed"), "not_run_registration_failed")
        .when(open_truth & (predicted == "uncertain"), "safe_uncertain_on_unresolved_truth")
        .when(open_truth, "unsafe_decision_on_unresolved_truth")
        .when(predicted == "uncertain", "machine_uncertain")
        .when((predicted == "blank") & (expected == "blank"), "blank_state_match")
        .when(predicted == "blank", "false_blank")
        .when((predicted == "multiple") & (expected == "multiple"), "multiple_state_match_choice_subset_unavailable")
        .when(predicted == "multiple", "false_multiple")
        .when(expected == "multiple", "multiple_state_missed")
        .when((expected == "single") & (predicted == "single"), F.when(exact, "exact_choice_match").otherwise("wrong_choice"))
        .when(predicted == "boundary_cross", "boundary_cross")
        .otherwise("wrong_state")
    )
    rows = rows.withColumn("outcome", outcome)
    matched = F.col("outcome").isin("blank_state_match", "multiple_state_match_choice_subset_unavailable", "exact_choice_match")
    rows = rows.withColumn("state_match", F.when(F.col("_failed") | open_truth, None).otherwise(matched))
    unsafe = yes(~open_truth & (F.col("state_match") == F.lit(False)) & F.col("auto_resolved"))
    return rows.select(
        "source_id", "question", expected.alias("expected_state"), F.col("_t.choice").alias("expected_choice"),
        F.when(F.col("_failed").isNull(), predicted).alias("predicted_state"),
        F.when(F.col("_failed").isNull() & (predicted == "single"), F.get("_p.choices", 0)).alias("predicted_choice"),
        "outcome", "state_match", unsafe.alias("unsafe"), yes(F.col("_failed")).alias("failed"),
    )


def outcome_counts(compared: DataFrame) -> DataFrame:
    """Outcome histogram per sheet, and over all sheets where source_id is NULL."""
    counted = compared.groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("outcome").agg(F.sum("n").alias("n")).select(F.lit(None).cast("bigint").alias("source_id"), "outcome", "n")
    return counted.unionByName(total)


def visible_candidates(primary: Column, candidates: Column, suggestions: Column, truth: Column) -> Column:
    everything = F.array_union(F.array_compact(F.array(primary)), F.array_union(F.array_compact(candidates), F.array_compact(suggestions)))
    return yes(F.array_contains(everything, truth))


def accuracy_report(compared: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row: rates over registered cells and end to end, number hits, worst registration figures."""
    single = F.col("expected_state") == "single"
    hits = F.col("outcome") == "exact_choice_match"
    cells = compared.agg(
        count_when(~F.col("expected_state").isin("unknown", "uncertain")).alias("resolved_cells"),
        count_when(F.col("state_match")).alias("state_matches"), F.count("state_match").alias("comparable_cells"),
        count_when(hits).alias("exact_single"), count_when(single).alias("single_cells"), count_when(single & ~F.col("failed")).alias("single_registered"),
        count_when(F.col("expected_state") == "multiple").alias("multiple_cells"), count_when(F.col("failed")).alias("failed_cells"), count_when(F.col("unsafe")).alias("unsafe"),
    )
    primary = yes(F.col("candidate") == F.col("expected_number"))
    suggested = yes(F.col("suggestion") == F.col("expected_number"))
    people = sheets.agg(
        F.count(F.lit(1)).alias("sheets"), F.sum("failed").alias("sheets_failed"), count_when(primary).alias("number_exact"),
        count_when(primary | suggested).alias("number_available"), F.sum("requires_review").alias("number_review"),
        F.max("grid_residual_px").alias("worst_residual"), F.min("alignment_confidence").alias("lowest_confidence"),
    )
    # two one-row aggregates
    both = cells.crossJoin(F.broadcast(people))
    return both.select(
        "*", rate(F.col("state_matches"), F.col("comparable_cells")).alias("match_rate_registered"), rate(F.col("state_matches"), F.col("resolved_cells")).alias("match_rate_end_to_end"),
        rate(F.col("exact_single"), F.col("single_cells")).alias("exact_rate_end_to_end"), rate(F.col("exact_single"), F.col("single_registered")).alias("exact_rate_registered"),
    )


def visual_accuracy_report(truth: DataFrame, predictions: DataFrame, active_questions: int) -> DataFrame:
    """Exact, wrong, false and uncertain counts for the active key and for the grid beyond it."""
    rows = truth.join(predictions, ["source_id", "question"], "left")
    expected = F.when(F.col("truth").isin(*CHOICES), "single_mark").otherwise(F.col("truth"))
    actual = F.coalesce("state", F.lit("uncertain"))
    same = (actual == expected) & ((expected != "single_mark") | (F.col("selected") == F.array("truth")))
    kind = (
        F.when(expected == "uncertain", F.when(actual == "uncertain", "machine_uncertain_on_ambiguous").otherwise("unsafe_decision_on_ambiguous"))
        .when(same, "exact_match").when(actual == "uncertain", "machine_uncertain").when((actual == "multiple") & (expected != "multiple"), "false_multi")
        .when((actual == "blank") & (expected != "blank"), "false_blank").otherwise("wrong")
    )
    scope = F.when(F.col("question") <= active_questions, "active").otherwise("out_of_key")
    kinds = ("exact_match", "wrong", "false_multi", "false_blank", "machine_uncertain", "machine_uncertain_on_ambiguous", "unsafe_decision_on_ambiguous")
    marked = rows.select(scope.alias("scope"), yes(same).alias("_same"), kind.alias("kind"))
    report = marked.groupBy("scope").agg(*[count_when(F.col("kind") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("cells"))
    resolved = F.col("cells") - F.col("machine_uncertain_on_ambiguous") - F.col("unsafe_decision_on_ambiguous")
    return report.withColumn("resolved", resolved).withColumn("exact_accuracy", rate(F.col("exact_match"), F.col("resolved")))


def recognizer_summary(records: DataFrame) -> DataFrame:
    """Per corpus and overall (corpus NULL) in one pass over small per-version partial sums."""
    exact = yes(F.col("candidate") == F.col("truth"))
    visible = visible_candidates(F.col("candidate"), F.array("candidate"), F.array("suggestion"), F.col("truth"))
    review = F.col("requires_review") == 1
    parts = records.groupBy("corpus_id", "pipeline_version").agg(
        F.count(F.lit(1)).alias("records"), count_when(exact).alias("exact"), count_when(F.col("candidate").isNotNull() & ~exact).alias("wrong"),
        count_when(visible).alias("visible"), count_when(review).alias("review_required"), count_when(~review & ~exact).alias("wrong_auto_accept"),
        F.sum("seconds").alias("seconds"),
    )
    summed = parts.rollup("corpus_id").agg(
        F.grouping("corpus_id").alias("_all"), *[F.sum(c).alias(c) for c in ("records", "exact", "wrong", "visible", "review_required", "wrong_auto_accept", "seconds")],
    )
    versions = parts.groupingSets([["corpus_id", "pipeline_version"], ["pipeline_version"]], "corpus_id", "pipeline_version").agg(F.sum("records").alias("n"), F.grouping("corpus_id").alias("_all"))
    listed = versions.groupBy("corpus_id", "_all").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pipeline_version", "n")))).alias("versions"))
    joined = summed.alias("s").join(listed.alias("v"), F.col("s.corpus_id").eqNullSafe(F.col("v.corpus_id")) & (F.col("s._all") == F.col("v._all")))
    total = F.col("records")
    return joined.select(
        F.when(F.col("s._all") == 0, F.col("s.corpus_id")).alias("corpus_id"), "records", "exact", "wrong", "visible", "review_required",
        (total - F.col("review_required")).alias("auto_accept"), "wrong_auto_accept", rate(F.col("exact"), total).alias("exact_rate"), rate(F.col("visible"), total).alias("visible_rate"),
        rate(total - F.col("review_required"), total).alias("auto_accept_coverage"), F.round(F.col("seconds") / total, 6).alias("mean_seconds"), "versions",
    )


# ---- bootstrap ---------------------------------------------------------------

# Generator and interval of the published confidence intervals.
LCG_A, LCG_C, LCG_BITS = 1664525, 1013904223, 32
SEED, ITERATIONS = 1729, 2000


def lcg_powers() -> list[tuple[int, int]]:
    """(multiplier, increment) of 2^k generator steps."""
    a, c, out = LCG_A, LCG_C, []
    for _ in range(LCG_BITS):
        out.append((a, c))
        a, c = (a * a) % 2**LCG_BITS, (c * (a + 1)) % 2**LCG_BITS
    return out


def lcg_after(steps: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Generator states after the given step counts, by binary jump-ahead."""
    mask = np.uint64(2**LCG_BITS - 1)
    states = np.full(len(steps), seed, dtype=np.uint64)
    for bit, (a, c) in enumerate(lcg_powers()):
        used = (steps >> np.uint64(bit)) & np.uint64(1) == 1
        states = np.where(used, (states * np.uint64(a) + np.uint64(c)) & mask, states)
    return states


def lcg_run(first: int, count: int) -> np.ndarray:
    """``count`` successive generator states from step ``first`` on, by doubling."""
    mask, states = np.uint64(2**LCG_BITS - 1), lcg_after(np.array([first % 2**LCG_BITS], dtype=np.uint64))
    for a, c in lcg_powers():
        if len(states) >= count:
            break
        states = np.concatenate([states, (states * np.uint64(a) + np.uint64(c)) & mask])
    return states[:count]


# Fixed sizes: outcomes of one packed piece, pieces that one task holds, and draws made at once.
PIECE, PIECES, DRAWS = 1 << 16, 1 << 10, 1 << 20


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """The outcomes of one piece, a bit each, zeros where the table ends."""
    bits = np.zeros(PIECE, dtype=bool)
    bits[frame["draw"].to_numpy() % PIECE] = frame["hit"].to_numpy() == 1
    return pd.DataFrame({"piece": [int(frame["draw"].iloc[0]) // PIECE], "bits": [np.packbits(bits).tobytes()]})


def _draws(units: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """Hits per iteration of the draws (low to high) of some units that fall on the pieces of one part."""
    sums: dict[int, int] = {}
    if len(units):
        n, start = int(units["n"].iloc[0]), int(units["part"].iloc[0]) * PIECES
        hits = np.zeros(PIECES * PIECE if (start + PIECES) * PIECE <= n else max(0, n - start * PIECE), dtype=bool)
        for piece, bits in zip(pieces["piece"], pieces["bits"]):
            at = (piece - start) * PIECE
            hits[at : at + PIECE] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).view(bool)[: len(hits) - at]
        for low, high in zip(units["low"], units["high"]):
            drawn = (lcg_run(low + 1, high - low) % np.uint64(n)).astype(np.int64) - start * PIECE
            inside = (drawn >= 0) & (drawn < len(hits))
            found = hits[np.where(inside, drawn, 0)] & inside if len(hits) else inside
            first = low // n
            counts = np.add.reduceat(found, [max(0, i * n - low) for i in range(first, (high - 1) // n + 1)], dtype=np.int64)
            for i, count in enumerate(counts):
                sums[first + i] = sums.get(first + i, 0) + int(count)
    return pd.DataFrame({"iteration": list(sums), "n": [int(units["n"].iloc[0])] * len(sums) if len(units) else [], "hits": list(sums.values())}, dtype="int64")


def bootstrap_ci(values: DataFrame, order: str, hit: Column, block: int = DRAWS) -> DataFrame:
    """95 % percentile interval of the hit rate over 2000 resamples of the generator above.

    Every draw knows its own generator state, so draws are made in parallel
    blocks. Outcomes are packed to bits, so that the blocks meet them without a
    row per draw: a task holds up to 64 million outcomes (8 MB packed); of more,
    each block is made once for each such part and counts what falls into it.
    """
    indexed = dense_number(values.select(order, hit.cast("int").alias("hit")), [], order, "_p").select(
        (F.col("_p") - 1).cast("bigint").alias("draw"), "hit"
    )
    size = values.agg(F.count(F.lit(1)).alias("n"))
    spark = values.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = F.expr(f"draw div {PIECE}")
    pieces = indexed.groupBy(piece.alias("_piece")).applyInPandas(_packed, "piece bigint, bits binary")
    dealt = pieces.select(F.expr(f"piece div {PIECES}").alias("part"), "piece", "bits", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    # One row, and one for each part.
    parts = size.where("n > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {PIECE * PIECES}"))))
    blocks = parts.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n * {ITERATIONS} - 1) div {block}"))))
    units = blocks.select(
        "n", "part", (F.col("_b") % tasks).cast("int").alias("task"), (F.col("_b") * block).alias("low"), F.least(F.col("n") * ITERATIONS, (F.col("_b") + 1) * block).alias("high")
    )
    drawn = units.groupBy("part", "task").cogroup(dealt.groupBy("part", "task")).applyInPandas(_draws, "iteration bigint, n bigint, hits bigint")
    sums = drawn.groupBy("iteration", "n").agg(F.sum("hits").alias("_sum"))
    ranked = ranked_values(sums.withColumnRenamed("n", "_size"), ["_size"], "_sum")
    low, high = round((ITERATIONS - 1) * 0.025) + 1, round((ITERATIONS - 1) * 0.975) + 1
    return ranked.groupBy("_size").agg(
        F.max(F.when(at_rank(F.lit(low)), F.col("_sum"))).alias("_low"), F.max(F.when(at_rank(F.lit(high)), F.col("_sum"))).alias("_high")
    ).select(F.col("_size").alias("records"), rate(F.col("_low"), F.col("_size")).alias("low"), rate(F.col("_high"), F.col("_size")).alias("high"))


# ---- run reports ---------------------------------------------------------------


def margin_stats(observations: DataFrame) -> DataFrame:
    """Per sheet: smallest, upper-median and largest margin, and state counts."""
    ranked = ranked_values(observations, ["source_id"], "margin")
    middle = ranked.groupBy("source_id").agg(
        F.max(F.when(at_rank(F.floor(F.col("n") / 2) + 1), F.col("margin"))).alias("median_margin")
    )
    counts = observations.groupBy("source_id").agg(
        F.min("margin").alias("min_margin"), F.max("margin").alias("max_margin"),
        *[count_when(F.col("state") == s).alias(s) for s in ("single_mark", "blank", "multiple", "uncertain")],
        count_when(F.size("selected") == 5).alias("all_choices"),
    )
    return counts.join(middle, "source_id")


def run_report(sheets: DataFrame, compared: DataFrame) -> DataFrame:
    """One row per corpus: accepted, rejected, exact cells, review rate and timing."""
    exact = compared.groupBy("source_id").agg(F.count(F.lit(1)).alias("_cells"), count_when(F.col("outcome") == "exact_choice_match").alias("_exact"))
    joined = sheets.join(exact, "source_id", "left")
    ok = F.col("failed") == 0
    return joined.groupBy("corpus_id").agg(
        F.count(F.lit(1)).alias("evaluated"), count_when(ok).alias("accepted"), count_when(~ok).alias("rejected"),
        F.coalesce(F.sum(F.when(ok, F.col("_cells"))), F.lit(0)).alias("cells"), F.coalesce(F.sum(F.when(ok, F.col("_exact"))), F.lit(0)).alias("exact"),
        count_when(ok & (F.col("requires_review") == 1)).alias("review"), F.round(F.sum("seconds"), 4).alias("sum_seconds"),
        F.round(F.avg("seconds"), 4).alias("mean_seconds"), F.round(F.max("seconds"), 4).alias("max_seconds"),
    ).withColumn("review_rate", rate(F.col("review"), F.col("evaluated")))


def registration_report(sheets: DataFrame) -> DataFrame:
    return sheets.groupBy("selected_candidate").agg(
        F.count(F.lit(1)).alias("sheets"), count_when(F.col("failed") == 0).alias("registered"), count_when(F.col("failed") == 1).alias("failed"),
        F.max("grid_residual_px").alias("worst_residual"), F.min("alignment_confidence").alias("worst_confidence"),
    )


def confusion_matrix(df: DataFrame, truth: str, prediction: str, labels: Sequence[str]) -> DataFrame:
    """Counts per truth (rows, plus a total row) and prediction (columns; ``p_rest`` has what isn't in ``labels``; plus a total column)."""
    counted = df.groupBy(truth, prediction).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.rollup(truth).agg(
        F.grouping(truth).alias("_all"), *[F.coalesce(F.sum(F.when(F.col(prediction) == p, F.col("n"))), F.lit(0)).alias(f"p_{p}") for p in labels],
        F.coalesce(F.sum(F.when(~yes(F.col(prediction).isin(*labels)), F.col("n"))), F.lit(0)).alias("p_rest"), F.sum("n").alias("total"),
    )
    return rows.select(F.when(F.col("_all") == 1, "total").otherwise(F.col(truth)).alias("truth"), *[f"p_{p}" for p in labels], "p_rest", "total")


def label_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def majority_label(df: DataFrame) -> DataFrame:
    """Most common label; the label seen first wins a tie."""
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("ref_id").alias("_first"))
    return counts.orderBy(F.col("n").desc(), "_first").limit(1).select("label", "n")


def evaluate_classifiers(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Exact rate per kind against the validation labels and the chosen kind (knn wins a tie)."""
    rows = predictions.join(truth, "query_id")
    report = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("records"), count_when(F.col("label") == F.col("truth")).alias("exact"))
    rated = report.withColumn("exact_rate", rate(F.col("exact"), F.col("records")))
    best = rated.where(F.col("kind").isin("knn", "centroid")).agg(
        F.max(F.struct("exact_rate", (F.col("kind") == "knn").alias("k"), "kind"))["kind"].alias("_best")
    )
    return rated.crossJoin(F.broadcast(best)).select("kind", "records", "exact", "exact_rate", (F.col("kind") == F.col("_best")).alias("selected"))


def hash_verified_join(results: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Results with the hash of the fixture of the same name; both hashes are kept."""
    files = fixtures.groupBy("original_name").agg(F.min("sha256").alias("fixture_sha256"))
    return results.join(files, "original_name", "left").withColumn("verified", F.col("sha256").eqNullSafe(F.col("fixture_sha256")))

