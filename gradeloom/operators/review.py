"""Review state, effective answers, open issues and grading snapshots for all rooms at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.scalars import normalize_number
from gradeloom.operators import grading as G
from gradeloom.operators.common import CHOICES, RESOLVED, count_per, count_when, expand_range, latest, yes

# Current versions of the reading contract.
PIPELINE_VERSION = "v10"
IDENTITY_VERSION = "id-v2"


def is_current(pipeline: Column) -> Column:
    return yes(pipeline == PIPELINE_VERSION)


def review_state(sources: DataFrame, detections: DataFrame, reviews: DataFrame, identities: DataFrame) -> DataFrame:
    """Active sheets with their newest detection, matching review and effective number.

    A review counts only while it refers to the newest detection; a confirmed
    number outlives a re-read.
    """
    sheets = G.active_sources(sources, "student").select("source_id", "exam_id", "room_id")
    seen = latest(detections, "source_id").select(
        "source_id", "detection_id", "pipeline_version", "identity_version", "failure", "has_registration",
        "alignment_needs_review", "candidate", "confidence", "confidence_margin", "requires_review", "selective_auto_accept",
    )
    review = latest(reviews, "source_id").select(
        "source_id", "review_id", F.col("key_id").alias("review_key"), F.col("student_number").alias("review_number"),
        F.col("origin").alias("review_origin"), F.col("detection_id").alias("_review_detection"), F.col("created_at").alias("_review_at"),
    )
    identity = latest(identities, "source_id").select(
        "source_id", F.col("student_number").alias("_identity"), F.col("created_at").alias("_identity_at"),
        F.col("origin").alias("identity_origin"),
    )
    joined = sheets.join(seen, "source_id", "left").join(review, "source_id", "left").join(identity, "source_id", "left")
    kept = F.col("review_id").isNotNull() & F.col("_review_detection").eqNullSafe(F.col("detection_id"))
    from_review = kept & (F.col("_identity").isNull() | (F.col("_review_at") > F.col("_identity_at")))
    return (
        joined.withColumn("number", F.when(from_review, F.col("review_number")).otherwise(F.col("_identity")))
        .withColumns({name: F.when(kept, F.col(name)) for name in ("review_id", "review_key", "review_number", "review_origin")})
        .drop("_review_detection", "_review_at", "_identity", "_identity_at")
    )


def machine_answer(observation_state: Column, choice: Column, resolved: Column, usable: Column) -> Column:
    """Only a clear single mark or a normal blank of a current, registered read counts."""
    value = F.when(observation_state == "single_mark", choice).when(observation_state == "blank", F.lit("blank"))
    return F.when(yes(usable & resolved), value)


def newest_observations(observations: DataFrame) -> DataFrame:
    newest = latest(
        observations.select("source_id", "question", "observed_at", "o1", "o2", "o3", "state", "choice", "block_ok"),
        ["source_id", "question"], ["observed_at", "o1", "o2", "o3"],
    )
    resolved = F.col("state").isin("single_mark", "blank") & (F.col("block_ok") == 1)
    return newest.select("source_id", "question", "state", "choice", resolved.alias("auto_resolved"))


def newest_overrides(overrides: DataFrame) -> DataFrame:
    """Last override per (sheet, key, detection, question); an unknown detection is its own value."""
    rows = overrides.select("source_id", "question", "key_id", "detection_id", "seq", F.col("answer").alias("override"))
    return latest(rows, ["source_id", "question", "key_id", "detection_id"]).drop("seq")


def apply_overrides(answers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace answers by the override for the same key and (null-safe) detection."""
    o = newest_overrides(overrides).alias("o")
    a = answers.alias("a")
    match = (
        (F.col("a.source_id") == F.col("o.source_id")) & (F.col("a.question") == F.col("o.question"))
        & (F.col("a.key_id") == F.col("o.key_id")) & F.col("a.detection_id").eqNullSafe(F.col("o.detection_id"))
    )
    return a.join(o, match, "left").select("a.*", F.col("o.override"))


def effective_answers(
    state: DataFrame, key: DataFrame, exams: DataFrame, observations: DataFrame, overrides: DataFrame, review_answers: DataFrame
) -> DataFrame:
    """One row per (sheet, question 1..n): reviewed answer, else override, else machine answer, else NULL.

    What is known of a sheet's questions (at most 60, narrow rows) comes to the
    sheet as one list, and the sheet is spelled out last: sheets are shuffled
    once, by ``source_id``, answers not at all, and groups of a sheet's answers
    need no further shuffle.
    """
    sheets = state.join(key.select("exam_id", "key_id"), "exam_id").join(exams.where("question_count >= 1").select("exam_id", "question_count"), "exam_id")
    current_review = yes(F.col("review_key") == F.col("key_id"))
    told = lambda df, kind, value, **seen: df.select(
        "source_id", "question", F.lit(kind).alias("kind"), F.col(value).alias("value"),
        *[seen.get(name, F.lit(None)).cast(of).alias(name) for name, of in (("state", "string"), ("resolved", "boolean"))],
    )
    place = sheets.select("source_id", F.col("key_id").alias("_key"), F.col("detection_id").alias("_detection"))
    valid = newest_overrides(overrides).join(place, "source_id").where((F.col("key_id") == F.col("_key")) & F.col("detection_id").eqNullSafe(F.col("_detection")))
    reviewed = review_answers.select("review_id", "question", "answer").join(sheets.where(current_review).select("review_id", "source_id"), "review_id")
    facts = (
        told(newest_observations(observations), "seen", "choice", state=F.col("state"), resolved=F.col("auto_resolved"))
        .unionByName(told(valid, "override", "override")).unionByName(told(reviewed, "reviewed", "answer"))
    )
    listed = facts.repartition("source_id").groupBy("source_id").agg(F.collect_list(F.struct("question", "kind", "value", "state", "resolved")).alias("_facts"))
    of = lambda question, kind: F.get(F.filter("_facts", lambda x: (x["question"] == question) & (x["kind"] == kind)), 0)
    answers = F.transform(
        F.sequence(F.lit(1), F.col("question_count")),
        lambda q: F.struct(q.alias("question"), of(q, "seen").alias("_seen"), of(q, "override")["value"].alias("_override"), of(q, "reviewed")["value"].alias("_reviewed")),
    )
    rows = sheets.join(listed, "source_id", "left").select(*sheets.columns, F.inline(answers))
    rows = rows.withColumns({"state": F.col("_seen.state"), "choice": F.col("_seen.value"), "auto_resolved": F.col("_seen.resolved"), "overridden": F.col("_override").isNotNull()})
    usable = is_current(F.col("pipeline_version")) & (F.col("has_registration") == 1)
    machine = machine_answer(F.col("state"), F.col("choice"), F.col("auto_resolved"), usable)
    return rows.withColumn("answer", F.when(current_review, F.col("_reviewed")).otherwise(F.coalesce("_override", machine))).drop("_seen", "_override", "_reviewed")


def answer_prefill(state: Column, choice: Column, resolved: Column) -> Column:
    return (
        F.when((state == "single_mark") & resolved, choice)
        .when(state.isin("multiple", "boundary_cross", "blank"), state)
    )


def prefilled_value(kind: Column, status: Column, prefill: Column, candidate: Column) -> Column:
    """A measured value or a known status; never an invented one."""
    answer = kind == "answer"
    return F.coalesce(
        F.nullif(prefill, F.lit("")),
        F.when(answer & (status == "single_mark"), F.nullif(candidate, F.lit(""))),
        F.when(answer & status.isin("blank", "multiple", "boundary_cross"), status),
    )


ISSUE_COLUMNS = (
    "kind", "exam_id", "room_id", "source_id", "number", "question", "status", "candidate", "prefill", "key_id", "detection_id", "failure_seq",
)


def _issue(df: DataFrame, kind: str | Column, **columns: Column) -> DataFrame:
    """Brings a branch to the common issue columns; a missing one is NULL."""
    types = {"kind": "string", "status": "string", "candidate": "string", "prefill": "string", "question": "int"}
    out = []
    for name in ISSUE_COLUMNS:
        value = (F.lit(kind) if isinstance(kind, str) else kind) if name == "kind" else columns.get(name, F.col(name) if name in df.columns and name not in ("candidate", "status", "question") else F.lit(None))
        out.append(value.cast(types.get(name, "bigint")).alias(name))
    return df.select(*out)


def open_failures(log: DataFrame) -> DataFrame:
    """Failures with no later success for the same file; the room is compared null-safe."""
    done = log.where(F.col("outcome") == "imported").groupBy("exam_id", "path", "purpose", "room_id").agg(F.max("seq").alias("done_seq"))
    f, d = log.where(F.col("outcome") == "failed").alias("f"), done.alias("d")
    same = (
        (F.col("f.exam_id") == F.col("d.exam_id")) & (F.col("f.path") == F.col("d.path")) & (F.col("f.purpose") == F.col("d.purpose"))
        & F.col("f.room_id").eqNullSafe(F.col("d.room_id")) & (F.col("d.done_seq") > F.col("f.seq"))
    )
    return f.join(d, same, "left_anti")


def with_room_facts(state: DataFrame, maximum: DataFrame) -> DataFrame:
    """Adds how many sheets of the room hold the number, and the room's maximum."""
    held = count_per(state.where(F.col("number").isNotNull()), ["room_id", "number"], "holders")
    return state.join(held, ["room_id", "number"], "left").join(maximum.select("room_id", "maximum"), "room_id", "left")


def missing_numbers(rooms: DataFrame, state: DataFrame, attendance: DataFrame) -> DataFrame:
    """Expected numbers with no sheet, no skip and no decided attendance (explicit maxima only)."""
    expected = expand_range(rooms.where(F.col("maximum").isNotNull()), F.lit(1).cast("bigint"), F.col("maximum").cast("bigint"), "number")
    decided = attendance.where(F.col("skipped") | (F.coalesce("status", F.lit("pending")) != "pending"))
    taken = state.where(F.col("number").isNotNull()).select("room_id", F.col("number").cast("bigint").alias("number"))
    return expected.join(taken, ["room_id", "number"], "left_anti").join(
        decided.select("room_id", F.col("student_number").cast("bigint").alias("number")), ["room_id", "number"], "left_anti"
    )


def issues(state: DataFrame, answers: DataFrame, key: DataFrame, rooms: DataFrame, attendance: DataFrame, failures: DataFrame) -> DataFrame:
    """Open review issues of every exam with a confirmed key.

    ``state`` comes from ``review_state``, ``answers`` from
    ``effective_answers`` over the confirmed key, ``rooms`` from
    ``number_maximum``.
    """
    away = attendance.where(F.col("status").isin("absent", "excused")).select(
        "room_id", F.col("student_number").alias("number"), F.lit(True).alias("_away")
    )
    sheets = with_room_facts(state.join(key.select("exam_id", "key_id"), "exam_id"), rooms).join(away, ["room_id", "number"], "left")
    unreadable = F.col("detection_id").isNull() | F.col("failure").isNotNull()
    stale = yes(F.col("review_key") != F.col("key_id"))
    number_status = (
        F.when(F.col("number").isNull(), "uncertain").when(F.col("holders") > 1, "duplicate").when(F.col("number") > F.col("maximum"), "out_of_range")
    )
    candidate = F.col("candidate").cast("string")
    none = F.lit(None).cast("string")
    # All sheet-level kinds come from one pass: an unreadable sheet is one issue, a readable one up to three.
    entry = lambda kind, status, value, fill: F.struct(
        F.lit(kind).alias("kind"), status.alias("status"), value.alias("candidate"), fill.alias("prefill")
    )
    found = F.when(unreadable, F.array(entry("image", none, none, none))).otherwise(
        F.array_compact(
            F.array(
                F.when(number_status.isNotNull(), entry("number", number_status, candidate, candidate)),
                F.when(F.col("_away"), entry("attendance", none, F.lit("pending"), none)),
                F.when(stale, entry("stale", none, none, none)),
            )
        )
    )
    per_sheet = sheets.select("exam_id", "room_id", "source_id", "number", "key_id", "detection_id", F.inline(found))
    open_answers = answers.where(~unreadable & ~stale & F.col("answer").isNull())
    single = F.when(F.col("state") == "single_mark", F.col("choice"))
    confirmed_rooms = rooms.join(key.select("exam_id"), "exam_id", "left_semi")
    return (
        _issue(per_sheet, F.col("kind"), status=F.col("status"), candidate=F.col("candidate"))
        .unionByName(
            _issue(
                open_answers, "answer", question=F.col("question"), status=F.coalesce("state", F.lit("uncertain")), candidate=single,
                prefill=answer_prefill(F.col("state"), F.col("choice"), F.col("auto_resolved")),
            )
        )
        .unionByName(_issue(missing_numbers(confirmed_rooms, state, attendance), "attendance", status=F.lit("missing"), candidate=F.lit("pending")))
        .unionByName(_issue(failures.join(key.select("exam_id"), "exam_id", "left_semi"), "import", failure_seq=F.col("seq")))
    )


def order_issues(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.coalesce("number", F.lit(10**9)), F.coalesce("question", F.lit(0)), "source_id", "kind", *(["failure_seq"] if "failure_seq" in rows.columns else []))


def issue_key(rows: DataFrame) -> Column:
    """Stable sha256 key of an issue; NULL fields count as values."""
    fields = ["source_id", "kind", "question", "number", "key_id", "detection_id", "failure_seq"]
    return F.sha2(F.to_json(F.struct(*[F.col(name) for name in fields]), {"ignoreNullFields": "false"}), 256)


def choose_record(reviews: DataFrame, partials: DataFrame, key: DataFrame, sources: DataFrame) -> DataFrame:
    """Per active sheet: the newest partial when it is on the current key and newer than the review, else the review."""
    sheets = G.active_sources(sources, "student").select("source_id", "exam_id", "room_id", "original_name").join(
        key.select("exam_id", "key_id"), "exam_id"
    )
    r = latest(reviews, "source_id").select(
        "source_id", "review_id", F.col("key_id").alias("r_key"), F.col("student_number").alias("r_number"), F.col("origin").alias("r_origin"),
        F.col("detection_id").alias("r_detection"), F.col("created_at").alias("r_at"),
    )
    p = latest(partials, "source_id").select(
        "source_id", "partial_id", F.col("key_id").alias("p_key"), F.col("student_number").alias("p_number"), "unknown_ordinal",
        "identity_confirmed", F.col("identity_origin").alias("p_identity"), F.col("detection_id").alias("p_detection"), F.col("created_at").alias("p_at"),
        *([F.col("review_issues").alias("p_issues")] if "review_issues" in partials.columns else [F.lit(None).cast("string").alias("p_issues")]),
    )
    joined = sheets.join(r, "source_id", "left").join(p, "source_id", "left")
    partial = yes((F.col("p_key") == F.col("key_id")) & (F.col("review_id").isNull() | (F.col("p_at") > F.col("r_at"))))
    complete = yes(F.col("r_key") == F.col("key_id"))
    pick = lambda a, b: F.when(partial, F.col(a)).otherwise(F.when(complete, F.col(b)))
    return joined.select(
        "source_id", "exam_id", "room_id", "original_name", "key_id", "r_at",
        F.when(partial, "partial_review").when(complete, "complete_review").alias("record_type"),
        pick("partial_id", "review_id").alias("record_id"),
        pick("p_detection", "r_detection").alias("detection_id"),
        F.when(partial, F.when(F.col("identity_confirmed") == 1, F.col("p_number"))).otherwise(F.when(complete, F.col("r_number"))).alias("number"),
        F.when(partial & (F.col("identity_confirmed") == 0), F.col("unknown_ordinal")).alias("unknown_ordinal"),
        F.when(partial, F.col("identity_confirmed") == 1).otherwise(F.when(complete, F.lit(True))).alias("identity_confirmed"),
        F.when(partial, F.col("p_identity")).otherwise(F.when(complete, "teacher_confirmed")).alias("identity_origin"),
        F.when(partial, "review_skipped").when(complete & (F.col("r_origin") == "teacher"), "teacher_reviewed").when(complete, F.col("r_origin")).alias("status"),
        F.when(partial, F.col("p_issues")).alias("review_issues"),
    )


def check_snapshot(records: DataFrame, maximum: DataFrame, attendance: DataFrame, identities: DataFrame) -> DataFrame:
    """What keeps a room from being published: one row per (room, sheet, rule)."""
    numbered = with_room_facts(records, maximum)
    away = attendance.where(F.col("status").isNotNull() & (F.col("status") != "pending")).select(
        "room_id", F.col("student_number").alias("number"), F.lit(True).alias("_away")
    )
    edit = latest(identities, "source_id").select("source_id", F.col("student_number").alias("_edit"), F.col("created_at").alias("_edit_at"))
    joined = numbered.join(away, ["room_id", "number"], "left").join(edit, "source_id", "left")
    complete = F.col("record_type") == "complete_review"
    from gradeloom.operators.common import violations

    return violations(
        joined, ["room_id", "source_id"],
        {
            "unreviewed_or_stale": F.col("record_type").isNull(),
            "identity_changed": complete & (F.col("_edit_at") > F.col("r_at")) & (F.col("_edit") != F.col("number")),
            "out_of_range": F.col("number") > F.col("maximum"),
            "attendance_conflict": complete & F.col("_away"),
            "duplicate_number": F.col("holders") > 1,
            "malformed_partial": (F.col("record_type") == "partial_review") & F.col("number").isNull() & F.col("unknown_ordinal").isNull(),
        },
    )


def snapshot_answers(records: DataFrame, review_answers: DataFrame, partial_answers: DataFrame, overrides: DataFrame) -> DataFrame:
    """Answers of the chosen records with their provenance."""
    logged = review_answers.select(F.col("review_id").alias("record_id"), "question", "answer").unionByName(
        partial_answers.select(F.col("partial_id").alias("record_id"), "question", "answer")
    )
    chosen = records.where(F.col("record_type").isNotNull()).select(
        "source_id", "exam_id", "room_id", "key_id", "record_id", "record_type", "detection_id", "status"
    )
    rows = apply_overrides(chosen.join(logged, "record_id"), overrides)
    origin = (
        F.when((F.col("record_type") == "partial_review") & (F.col("answer") == "unresolved"), "review_skipped")
        .when((F.col("status") == "teacher_reviewed") | F.col("override").isNotNull(), "teacher_confirmed")
        .otherwise("machine_decision")
    )
    return rows.withColumn("origin", origin).drop("override")


def answer_provenance(rows: DataFrame) -> DataFrame:
    """Per sheet: how many answers came from where (at most 60 per sheet)."""
    kinds = ("teacher_confirmed", "machine_decision", "review_skipped")
    return rows.groupBy("source_id").agg(*[count_when(F.col("origin") == kind).alias(kind) for kind in kinds])


def snapshot(records: DataFrame, answers: DataFrame, key: DataFrame, indicators: DataFrame, broken: DataFrame) -> DataFrame:
    """Scores and evidence of every sheet of every room.

    ``indicators`` maps each indicator position to its points, any number of
    positions: points are summed per (sheet, position) on the map side, and the
    few positions of a sheet become its map. ``answers`` lists question, answer
    and where it came from (at most 60 of a sheet); ``key_id``,
    ``detection_id`` and ``review_issues`` name what the score rests on.
    """
    scored = G.grade(answers, key.drop("key_id"))
    mapped = scored.join(G.question_indicators(indicators), ["exam_id", "question"])
    per_position = mapped.groupBy("source_id", "position").agg(F.sum("points").cast("bigint").alias("points"))
    maps = per_position.groupBy("source_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("position", "points")))).alias("indicators"))
    totals = scored.groupBy("source_id").agg(F.sum("points").alias("score"), F.count(F.lit(1)).alias("max"))
    told = answers.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("question", "answer", "origin"))).alias("answers"))
    blocked = broken.select("room_id").distinct().withColumn("blocked", F.lit(True))
    return (
        records.where(F.col("record_type").isNotNull()).join(totals, "source_id", "left").join(maps, "source_id", "left").join(told, "source_id", "left").join(blocked, "room_id", "left")
        .withColumn("blocked", F.coalesce("blocked", F.lit(False)))
        .select("exam_id", "room_id", "source_id", "original_name", "number", "unknown_ordinal", "identity_confirmed", "identity_origin", "record_type", "record_id", "status", "score", "max", "indicators", "blocked", "key_id", "detection_id", "review_issues", "answers")
    )


def sheet_status(state: DataFrame, newest: DataFrame, exams: DataFrame, key: DataFrame, open_issues: DataFrame, newest_review: DataFrame) -> DataFrame:
    """ready / must review again / prefilled / must review / unreadable per active sheet.

    Read against the current key of the exam, a machine key too. A sheet needs
    a decision unless its newest observations resolve every question of the exam.
    """
    counted = (
        newest.where("auto_resolved").join(state.select("source_id", "exam_id"), "source_id").join(exams.select("exam_id", "question_count"), "exam_id")
        .where(F.col("question").between(1, F.col("question_count"))).groupBy("source_id").agg(F.count(F.lit(1)).alias("resolved"))
    )
    flagged = open_issues.where(F.col("source_id").isNotNull()).select("source_id").distinct().withColumn("has_issue", F.lit(True))
    last = newest_review.select("source_id", F.col("key_id").alias("last_key"), F.col("student_number").alias("last_number"))
    repeated = count_per(state.select("source_id", "room_id").join(last, "source_id"), ["room_id", "last_number"], "same")
    joined = (
        state.join(key.select("exam_id", "key_id"), "exam_id", "left").join(exams.select("exam_id", "question_count"), "exam_id", "left").join(counted, "source_id", "left")
        .join(flagged, "source_id", "left").join(last, "source_id", "left").join(repeated, ["room_id", "last_number"], "left")
    )
    issue = yes(F.col("has_issue"))
    needs = F.col("detection_id").isNull() | F.col("failure").isNotNull() | ~yes(F.col("resolved") == F.col("question_count")) | issue
    status = (
        F.when(yes(F.col("last_key") == F.col("key_id")) & ~issue, "ready")
        .when(F.col("last_key").isNotNull(), "review_again")
        .when(F.col("detection_id").isNotNull() & ~needs, "prefilled")
        .otherwise("must_review")
    )
    return joined.select(
        "source_id", "exam_id", "room_id", status.alias("status"), F.col("failure").isNotNull().alias("unreadable"), yes(F.col("same") > 1).alias("duplicate"),
    )


def progress(state: DataFrame, open_issues: DataFrame) -> DataFrame:
    """Processed share and distinct sheets waiting, per room."""
    waiting = open_issues.where(F.col("source_id").isNotNull()).groupBy("room_id").agg(F.count_distinct("source_id").alias("pending"))
    done = state.groupBy("room_id").agg(F.count(F.lit(1)).alias("sheets"), F.count("detection_id").alias("processed"))
    return done.join(waiting, "room_id", "left").select(
        "room_id", "sheets", "processed", F.bround(F.col("processed") * 100.0 / F.col("sheets")).cast("int").alias("percent"),
        F.coalesce("pending", F.lit(0)).alias("pending"),
    )


def needs_processing(sources: DataFrame, detections: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Work list: a full read, or a number-only refresh; students wait for a confirmed key, confirmed keys stay."""
    now = latest(detections, "source_id").select("source_id", "detection_id", "pipeline_version", "identity_version", "failure")
    rows = (
        G.active_sources(sources).select("source_id", "exam_id", "purpose").join(now, "source_id", "left")
        .join(confirmed.select("exam_id", F.lit(True).alias("confirmed")), "exam_id", "left")
    )
    stale = F.col("detection_id").isNull() | ~is_current(F.col("pipeline_version"))
    old_number = (F.col("purpose") == "student") & F.col("failure").isNull() & ~yes(F.col("identity_version") == IDENTITY_VERSION)
    allowed = F.when(F.col("purpose") == "key", ~yes(F.col("confirmed"))).otherwise(yes(F.col("confirmed")))
    work = F.when(stale, "full").when(old_number, "identity")
    return rows.where(allowed & work.isNotNull()).select("source_id", "exam_id", "purpose", work.alias("work"))


def skip_summary(
    state: DataFrame, answers: DataFrame, maximum: DataFrame, answer_edits: DataFrame | None = None, identity_edits: DataFrame | None = None
) -> DataFrame:
    """Per room: unknown identities, unclear answers and unresolved sheets.

    Draft edits count as made: ``identity_edits`` (source_id, value), where a
    value that can't be read leaves the sheet unknown, and ``answer_edits``
    (source_id, question), whose answers are no longer unclear.
    """
    if identity_edits is not None:
        drafts = identity_edits.select("source_id", normalize_number(F.col("value")).alias("_draft"), F.lit(True).alias("_edited"))
        state = state.join(drafts, "source_id", "left").withColumn("number", F.when(F.col("_edited"), F.col("_draft")).otherwise(F.col("number"))).drop("_draft", "_edited")
    if answer_edits is not None:
        made = answer_edits.groupBy("source_id").agg(F.collect_set("question").alias("_edited"))  # at most 60 questions per sheet
        answers = answers.join(made, "source_id", "left").withColumn("_made", F.array_contains("_edited", F.col("question")))
    else:
        answers = answers.withColumn("_made", F.lit(False))
    sheets = with_room_facts(state.where(F.col("exam_id").isNotNull()), maximum)
    unknown = F.col("number").isNull() | yes(F.col("holders") > 1) | yes(F.col("number") > F.col("maximum"))
    reviewed = yes(F.col("review_key") == F.col("key_id"))
    per_answer = answers.withColumn(
        "_unclear",
        ~((reviewed & yes(F.col("review_origin") == "teacher")) | F.col("overridden"))
        & (F.col("answer").isNull() | yes(F.col("state").isin("uncertain", "multiple")))
        & ~yes(F.col("_made")),
    )
    per_sheet = per_answer.groupBy("source_id").agg(count_when(F.col("_unclear")).alias("unclear"), F.bool_and(reviewed).alias("on_key"))
    joined = sheets.join(per_sheet, "source_id")
    pending = unknown | F.col("failure").isNotNull() | (F.col("unclear") > 0) | ~F.col("on_key")
    return joined.groupBy("room_id").agg(
        count_when(unknown).alias("unconfirmed_identities"), F.sum("unclear").alias("unclear_answers"), count_when(pending).alias("unresolved_sheets")
    )


def resolved(answer: Column) -> Column:
    return yes(answer.isin(*RESOLVED))


def is_letter(answer: Column) -> Column:
    return yes(answer.isin(*CHOICES))
