"""Keys, scores, indicators, rosters and attendance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.scalars import score_answer
from gradeloom.operators.common import CHOICES, count_per, expand_range, latest, top


def active_sources(sources: DataFrame, purpose: str | None = None) -> DataFrame:
    rows = sources.where(F.col("archived") == 0)
    return rows if purpose is None else rows.where(F.col("purpose") == purpose)


def current_key(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """Newest key revision per exam whose image is still active."""
    heads = keys.where(F.col("question") == 1).select("exam_id", "source_id", "key_id", "seq", "origin")
    live = heads.join(active_sources(sources, "key").select("source_id"), "source_id", "left_semi")
    return latest(live, "exam_id").select(
        "exam_id", "key_id", F.col("source_id").alias("key_source_id"), F.col("origin").alias("key_origin")
    )


def confirmed_key(keys: DataFrame, sources: DataFrame) -> DataFrame:
    """The current key when a teacher confirmed it and no newer key image waits."""
    newest = active_sources(sources, "key").groupBy("exam_id").agg(F.max("source_id").alias("newest_source"))
    return (
        current_key(keys, sources)
        .join(newest, "exam_id")
        .where((F.col("key_origin") != "machine") & (F.col("newest_source") == F.col("key_source_id")))
        .drop("newest_source")
    )


def key_answers(keys: DataFrame, chosen: DataFrame) -> DataFrame:
    """Accepted sets of the chosen keys: at most 60 small rows per exam."""
    return keys.join(chosen.select("exam_id", "key_id"), ["exam_id", "key_id"]).select(
        "exam_id", "key_id", "question",
        F.filter(F.array("choice1", "choice2"), lambda item: item.isNotNull()).alias("accepted"),
    )


def latest_answers(observations: DataFrame) -> DataFrame:
    """Newest observation per (sheet, question), read as an answer."""
    newest = latest(
        observations.select("source_id", "question", "observed_at", "o1", "o2", "o3", "state", "choice"),
        ["source_id", "question"], ["observed_at", "o1", "o2", "o3"],
    )
    answer = F.when(F.col("state") == "single_mark", F.col("choice")).otherwise(F.col("state"))
    return newest.select("source_id", "question", answer.alias("answer"))


def grade(answers: DataFrame, key: DataFrame) -> DataFrame:
    """Points per answer. ``answers`` needs exam_id and question next to the answer.

    The key side holds 60 rows per exam at most; Spark decides on broadcasting
    it from its measured size, and AQE splits the exam that holds most sheets
    when it must shuffle.
    """
    scored = answers.join(key, ["exam_id", "question"])
    return scored.withColumn("points", score_answer(F.col("answer"), F.col("accepted"))).drop("accepted")


def total_score(graded: DataFrame, keys: list[str]) -> DataFrame:
    return graded.groupBy(*keys).agg(F.sum("points").alias("score"), F.count(F.lit(1)).alias("answered"))


def question_indicators(indicators: DataFrame) -> DataFrame:
    """Range rows as one row per question, so that mapping a question is an equi join."""
    return expand_range(indicators, "from_question", "to_question", "question").select(
        "exam_id", "question", "position", "identifier"
    )


def indicator_scores(graded: DataFrame, indicators: DataFrame, broken_exams: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of points per indicator; exams with a broken configuration give nothing."""
    usable = indicators.join(broken_exams.select("exam_id").distinct(), "exam_id", "left_anti")
    mapped = graded.join(question_indicators(usable), ["exam_id", "question"])
    return mapped.groupBy(*keys, "position", "identifier").agg(F.sum("points").alias("points"))


def pivot_indicators(scores: DataFrame, keys: list[str], positions: list[int]) -> DataFrame:
    """One column per indicator position; the position list is given, so no extra job runs."""
    return scores.groupBy(*keys).pivot("position", positions).agg(F.sum("points"))


def first_room(rooms: DataFrame) -> DataFrame:
    return top(rooms, ["exam_id"], [F.col("sort_order"), F.col("room_id")])


def number_maximum(rooms: DataFrame, exams: DataFrame) -> DataFrame:
    """Room maximum, else the exam's legacy maximum for its first room, else unknown."""
    opening = first_room(rooms).select("room_id", F.lit(True).alias("is_first"))
    joined = rooms.join(exams.select("exam_id", "legacy_max"), "exam_id").join(opening, "room_id", "left")
    legacy = F.when(F.col("is_first"), F.col("legacy_max"))
    return joined.select(
        "exam_id", "room_id",
        F.coalesce("expected_max", legacy).alias("maximum"),
        F.when(F.col("expected_max").isNotNull(), "room").when(legacy.isNotNull(), "legacy_exam").otherwise("unknown").alias("max_source"),
    )


def duplicate_numbers(sheets: DataFrame) -> DataFrame:
    """Numbers held by more than one sheet of a room."""
    held = sheets.where(F.col("number").isNotNull())
    return count_per(held, ["room_id", "number"], "sheets").where(F.col("sheets") > 1)


def attendance_state(log: DataFrame) -> DataFrame:
    """Last status per (room, number), plus whether the number is skipped now.

    A skip keeps the status before it; any later status clears the skip.
    """
    rows = log.groupBy("room_id", "student_number").agg(
        F.max("seq").alias("last_seq"),
        F.max(F.when(F.col("status") != "skipped", F.struct("seq", "status"))).alias("kept"),
    )
    return rows.select(
        "room_id", "student_number", F.col("kept.status").alias("status"),
        (F.col("kept").isNull() | (F.col("kept.seq") < F.col("last_seq"))).alias("skipped"),
    )


def attendance_conflict(sheets: DataFrame, attendance: DataFrame) -> DataFrame:
    """Sheets whose number is marked absent or excused."""
    away = attendance.where(F.col("status").isin("absent", "excused")).select(
        "room_id", F.col("student_number").alias("number"), "status"
    )
    return sheets.join(away, ["room_id", "number"])


def roster_gaps(rooms: DataFrame, sheets: DataFrame) -> DataFrame:
    """Numbers without a sheet: inside the observed span, and up to the room maximum.

    ``rooms`` carries ``maximum``. The ranges are generated per room, never
    crossed with the sheets.
    """
    seen = sheets.where(F.col("number").isNotNull()).select("room_id", F.col("number").cast("bigint").alias("number")).distinct()
    span = seen.groupBy("room_id").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    inside = expand_range(span, "low", "high", "number").select("room_id", "number", F.lit("internal").alias("kind"))
    bounded = span.join(rooms.where(F.col("maximum").isNotNull()), "room_id")
    expected = expand_range(bounded, F.lit(1).cast("bigint"), F.col("maximum").cast("bigint"), "number").select(
        "room_id", "number", F.lit("expected").alias("kind")
    )
    return inside.unionByName(expected).join(seen, ["room_id", "number"], "left_anti")


def expected_minus_observed(rooms: DataFrame, sheets: DataFrame) -> DataFrame:
    expected = expand_range(
        rooms.where(F.col("maximum").isNotNull()), F.lit(1).cast("bigint"), F.col("maximum").cast("bigint"), "number"
    ).select("room_id", "number")
    return expected.subtract(sheets.select("room_id", F.col("number").cast("bigint").alias("number")))


def order_results(results: DataFrame) -> DataFrame:
    """Known numbers ascending, then unknown sheets by their ordinal."""
    return results.orderBy(
        "room_id", F.coalesce("number", F.lit(10**9)), F.when(F.col("number").isNull(), F.coalesce("unknown_ordinal", F.lit(10**9))).otherwise(0), "source_id"
    )
