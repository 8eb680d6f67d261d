"""Constraint checks. Each returns a violations table; ``enforce`` raises on any row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import accepted_choices, casefold, nfkc, strip
from gradeloom.operators.common import RESOLVED, count_per, enforce, reasons, violations, yes
from gradeloom.operators.grading import active_sources, current_key

__all__ = ["enforce", "check_exams", "check_rooms", "check_indicators", "check_keys", "check_reviews", "check_corpus", "check_annotations", "check_training", "check_truth_export"]


def _bad_text(value: Column, limit: int) -> Column:
    return ~yes((F.length(strip(value)) >= 1) & (F.length(strip(value)) <= limit))


def _bad_maximum(value: Column) -> Column:
    return value.isNotNull() & ~value.between(1, 9999)


def check_exams(df: DataFrame, keys: list[str], text: list[str]) -> DataFrame:
    rules = {f"bad_{name}": _bad_text(F.col(name), 200) for name in text}
    rules["bad_question_count"] = ~yes(F.col("question_count").between(1, 60))
    rules["bad_maximum"] = _bad_maximum(F.col("expected_max"))
    rules["bad_template_version"] = ~yes(F.col("template_version") >= 1)
    return violations(df, keys, rules)


def check_rooms(df: DataFrame, keys: list[str]) -> DataFrame:
    """Label present, at most 200 characters, unique in its exam after folding; maximum 1 to 9999."""
    label = strip(F.regexp_replace(nfkc("label"), r"(?U)\s+", " "))
    folded = df.withColumn("_label", label).withColumn("_folded", casefold("_label"))
    repeated = count_per(folded, ["exam_id", "_folded"]).where("n > 1").select("exam_id", "_folded", F.lit(True).alias("_repeated"))
    joined = folded.join(repeated, ["exam_id", "_folded"], "left")
    return violations(
        joined, keys,
        {
            "bad_label": ~yes((F.length("_label") >= 1) & (F.length("_label") <= 200)),
            "duplicate_label": F.col("_repeated") & (F.length("_label") > 0),
            "bad_maximum": _bad_maximum(F.col("expected_max")),
        },
    )


def check_indicators(indicators: DataFrame, exams: DataFrame) -> DataFrame:
    """Identifier and range rules, and no overlap between the ranges of one exam."""
    label = strip(F.regexp_replace(nfkc("identifier"), r"(?U)\s+", " "))
    rows = indicators.join(exams.select("exam_id", "question_count"), "exam_id").withColumn("_label", label)
    rows = rows.withColumn("_folded", casefold("_label"))
    by_label = Window.partitionBy("exam_id", "_folded").orderBy("position")
    before = Window.partitionBy("exam_id").orderBy("from_question", "to_question", "position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_copy", F.row_number().over(by_label)).withColumn("_end", F.max("to_question").over(before))
    return violations(
        rows, ["exam_id", "position"],
        {
            "blank_identifier": F.length("_label") == 0,
            "long_identifier": F.length("_label") > 120,
            "duplicate_identifier": (F.col("_copy") > 1) & (F.length("_label") > 0),
            "bad_range": ~yes(
                (F.col("from_question") >= 1) & (F.col("from_question") <= F.col("to_question")) & (F.col("to_question") <= F.col("question_count"))
            ),
            "overlap": F.col("from_question") <= F.col("_end"),
        },
    )


def check_keys(answers: DataFrame, exams: DataFrame, sources: DataFrame) -> DataFrame:
    """``answers``: exam_id, source_id, key_id, question, accepted."""
    empty = F.size(accepted_choices(F.col("accepted"))) == 0
    per_key = answers.groupBy("exam_id", "source_id", "key_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(empty).alias("empty")
    )
    images = active_sources(sources, "key").select("source_id", F.col("exam_id").alias("image_exam"))
    joined = per_key.join(exams.select("exam_id", "question_count"), "exam_id", "left").join(images, "source_id", "left")
    return violations(
        joined, ["key_id"],
        {
            "answer_without_choice": F.col("empty"),
            "wrong_answer_count": ~yes(F.col("n") == F.col("question_count")),
            "not_an_active_key_image": ~yes(F.col("image_exam") == F.col("exam_id")),
        },
    )


def check_reviews(reviews: DataFrame, answers: DataFrame, sources: DataFrame, keys: DataFrame, detections_now: DataFrame, exams: DataFrame) -> DataFrame:
    given = answers.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(yes(F.col("answer").isin(*RESOLVED))).alias("resolved")
    )
    sheets = active_sources(sources, "student").select("source_id", "exam_id")
    joined = (
        reviews.select("review_id", "source_id", "key_id", "student_number", F.col("detection_id").alias("seen"))
        .join(sheets, "source_id", "left")
        .join(current_key(keys, sources).select("exam_id", F.col("key_id").alias("now_key")), "exam_id", "left")
        .join(exams.select("exam_id", "question_count"), "exam_id", "left")
        .join(detections_now.select("source_id", "detection_id"), "source_id", "left")
        .join(given, "review_id", "left")
    )
    return violations(
        joined, ["review_id"],
        {
            "not_an_active_sheet": F.col("exam_id").isNull(),
            "key_changed": F.col("exam_id").isNotNull() & ~yes(F.col("key_id") == F.col("now_key")),
            "wrong_answer_count": F.col("exam_id").isNotNull() & ~yes(F.col("n") == F.col("question_count")),
            "unresolved_answer": ~yes(F.col("resolved")),
            "detection_changed": ~F.col("seen").eqNullSafe(F.col("detection_id")),
            "bad_number": ~yes(F.col("student_number").between(1, 999999)),
        },
    )


def check_corpus(df: DataFrame, corpora: DataFrame) -> DataFrame:
    """Held-out corpus: one record per content and id, digits only, known corpus."""
    copies = count_per(df, ["content_hash"], "_copies").where("_copies > 1")
    ids = count_per(df, ["record_id"], "_ids").where("_ids > 1")
    joined = (
        df.join(copies, "content_hash", "left").join(ids, "record_id", "left")
        .join(corpora.select("corpus_id", F.lit(True).alias("_known")), "corpus_id", "left")
    )
    return violations(
        joined, ["record_id"],
        {
            "duplicate_id": F.col("_ids").isNotNull(),
            "not_held_out": ~yes(F.col("split") == "held_out"),
            "duplicate_content": F.col("_copies").isNotNull() | F.col("content_hash").isNull(),
            "bad_label": ~yes(F.col("label").rlike("^[0-9]+$")),
            "unknown_corpus": F.col("_known").isNull(),
        },
    )


def valid_bbox(box: Column) -> Column:
    return yes(
        (F.size(box) == 4) & (F.element_at(box, 1) >= 0) & (F.element_at(box, 2) >= 0)
        & (F.element_at(box, 3) > F.element_at(box, 1)) & (F.element_at(box, 4) > F.element_at(box, 2))
    )


def active_bbox(annotated: Column, proposed: Column) -> Column:
    return F.coalesce(annotated, proposed)


def inside_bbox(box: Column, width: Column, height: Column) -> Column:
    return yes((F.element_at(box, 3) <= width) & (F.element_at(box, 4) <= height))


DIGITS = [str(digit) for digit in range(10)]


def check_annotations(df: DataFrame, crops: DataFrame, training_ready: bool = False) -> DataFrame:
    ids = count_per(df, ["annotation_id"], "_ids").where("_ids > 1")
    known = crops.select("crop_id", F.lit(True).alias("_crop")).distinct()
    joined = df.join(ids, "annotation_id", "left").join(known, "crop_id", "left")
    status, accepted = F.col("label_status"), F.col("label_status") == "accepted"
    rules = {
        "duplicate_id": F.col("_ids").isNotNull(),
        "missing_crop": F.col("_crop").isNull(),
        "bad_status": ~yes(status.isin("needs_review", "accepted", "excluded")),
        "label_outside_0_9": accepted & ~yes(F.col("label").isin(*DIGITS)),
        "unresolved_bad_bbox": (accepted | (F.lit(training_ready) & (status == "needs_review"))) & F.col("bad_bbox"),
        "bad_accepted_bbox": accepted & ~valid_bbox(F.col("bbox")),
        "missing_provenance": accepted & F.col("annotator_id").isNull(),
        "label_without_acceptance": ~yes(accepted) & F.col("label").isNotNull(),
        "not_training_ready": F.lit(training_ready) & ~yes(accepted),
    }
    return violations(joined, ["row_id"], rules)


def check_training(manifests: DataFrame, records: DataFrame) -> DataFrame:
    """Manifest guards and record rules; a manifest-level break carries a NULL record id."""
    guards = violations(
        manifests, ["manifest_id"],
        {
            "wrong_kind": ~yes(F.col("kind") == "student_number_digit_training_ready_manifest"),
            "training_not_allowed": ~yes(F.col("training_ready") & F.col("training_allowed")),
            "generalization_claim": ~yes(~F.col("generalization_claim_allowed")),
        },
    ).select("manifest_id", F.lit(None).cast("bigint").alias("record_id"), "rule")
    ids = count_per(records, ["manifest_id", "record_id"], "_ids").where("_ids > 1")
    rows = violations(
        records.join(ids, ["manifest_id", "record_id"], "left"), ["manifest_id", "record_id"],
        {"duplicate_id": F.col("_ids").isNotNull(), "label_outside_0_9": ~yes(F.col("label").isin(*DIGITS))},
    )
    return guards.unionByName(rows)


def check_truth_export(sheets: DataFrame, provenance: DataFrame, minimum: int) -> DataFrame:
    """Teacher-confirmed export: schema 2, enough questions, every answer confirmed, unique names."""
    origins = provenance.groupBy("source_id").agg(F.bool_and(yes(F.col("origin") == "teacher_confirmed")).alias("_all_teacher"))
    names = count_per(sheets, ["exam_id", "original_name"], "_names").where("_names > 1")
    joined = sheets.join(origins, "source_id", "left").join(names, ["exam_id", "original_name"], "left")
    return violations(
        joined, ["source_id"],
        {
            "schema_version": ~yes(F.col("schema_version") == 2),
            "too_few_questions": ~yes(F.col("question_count") >= minimum),
            "not_teacher_reviewed": ~yes(F.col("status") == "teacher_reviewed"),
            "not_teacher_confirmed": ~yes(F.col("_all_teacher")),
            "duplicate_name": F.col("_names").isNotNull(),
        },
    )


def set_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only; two equal sets give no row."""
    return (
        left.distinct().exceptAll(right.distinct()).withColumn("side", F.lit("left"))
        .unionByName(right.distinct().exceptAll(left.distinct()).withColumn("side", F.lit("right")))
    )
