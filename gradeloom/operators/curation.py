"""Label curation: annotation state, work lists, held-out and training-ready sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators import checks
from gradeloom.operators.common import count_when, position_in_chunks, reasons, sliced, yes

# Two-digit samples whose leading zero is not drawn.
HIDDEN_ZERO = ("06", "07", "08", "09")
INK_RANGE = (0.005, 0.45)


def annotation_counts(records: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    status = F.col("label_status")
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count_when(status == "accepted").alias("labeled"), count_when(status == "excluded").alias("excluded"),
        count_when(status == "needs_review").alias("remaining"), count_when(F.col("bad_bbox")).alias("bad_bbox"),
    )


def next_review(records: DataFrame, position: str, start: DataFrame) -> DataFrame:
    """Next record to review at or after each start position, wrapping round. ``start``: worker, start.

    Waiting positions and starts are cut into slices by position. A start looks
    for the next waiting position inside its slice; if there is none, the least
    one of all later slices is it (a suffix minimum over one row per slice), and
    after the last slice the first of all. Equal starts are split by worker.
    """
    waiting = records.where(F.col("label_status") == "needs_review").select(F.col(position).cast("bigint").alias("_at")).distinct()
    marks = waiting.select("_at", F.lit(1).alias("_waits"), F.lit(None).cast(start.schema["worker"].dataType).alias("worker")).unionByName(
        start.select(F.col("start").cast("bigint").alias("_at"), F.lit(0).alias("_waits"), "worker")
    )
    marks = sliced(marks, ["_at", "_waits", "worker"], "marks")
    hit = F.when(F.col("_waits") == 1, F.col("_at"))
    heads = marks.groupBy("_slice").agg(F.min(hit).alias("_head"))
    later = Window.orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    heads = heads.select("_slice", F.min("_head").over(later).alias("_later"), F.min("_head").over(Window.partitionBy()).alias("_first"))
    # Backwards, as a frame that grows: Spark reads the whole rest again for each row of a frame that shrinks.
    inside = Window.partitionBy("_slice").orderBy(*[F.col(c).desc() for c in ("_at", "_waits", "worker")]).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("_next", F.min(hit).over(inside)).where("_waits = 0")
    return found.join(heads, "_slice").select("worker", F.coalesce("_next", "_later", "_first").alias("position"))


def replay_annotations(events: DataFrame) -> DataFrame:
    """Current state of every record after its event log, and how many accepts were refused.

    An accept is refused while the newest bbox event before it marks the box as
    bad, or when its digit is not 0 to 9. ``reset`` clears the mark as well.
    An event maps the mark (box bad or not) to a new one; over a slice of the
    clock these maps compose to one: the slice's last bbox event, or no change.
    Composed again from slice to slice they give the mark that each slice is
    entered with, and every slice is judged by itself. The log of one record may
    fill any number of slices.
    """
    mark = F.when(F.col("action").isin("correct_bbox", "mark_bad_bbox", "reset"), F.col("action") == "mark_bad_bbox")
    log = sliced(events.select("annotation_id", "seq", "action", "digit"), ["annotation_id", "seq"], "events").withColumn("_mark", mark)
    maps = log.groupBy("annotation_id", "_slice").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("seq"))).alias("_leaves"))
    earlier = Window.partitionBy("annotation_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    entered = maps.select("annotation_id", "_slice", F.last("_leaves", ignorenulls=True).over(earlier).alias("_enters"))
    inside = Window.partitionBy("annotation_id", "_slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    judged = log.withColumn("_within", F.last("_mark", ignorenulls=True).over(inside)).join(entered, ["annotation_id", "_slice"])
    accept = F.col("action") == "accept_label"
    refused = accept & (F.coalesce("_within", "_enters", F.lit(False)) | ~yes(F.col("digit").between(0, 9)))
    state = judged.withColumn("_refused", refused).groupBy("annotation_id").agg(
        F.max(F.when(~F.col("_refused"), F.struct("seq", "action", "digit"))).alias("_last"),
        F.max(F.when(F.col("_mark").isNotNull(), F.struct("seq", "_mark"))).alias("_box"),
        F.bool_or(F.col("action") == "correct_bbox").alias("_annotated"), count_when(F.col("_refused")).alias("refused"),
    )
    action, bad = F.col("_last.action"), yes(F.col("_box._mark"))
    return state.select(
        "annotation_id",
        F.when(action == "accept_label", "accepted").when(action == "exclude", "excluded").otherwise("needs_review").alias("label_status"),
        F.when(action == "accept_label", F.col("_last.digit")).alias("label"), bad.alias("bad_bbox"),
        F.when(bad, "bad_bbox").when(F.col("_annotated"), "corrected").otherwise("proposal").alias("bbox_status"), "refused",
    )


def propose_digit_boxes(samples: DataFrame) -> DataFrame:
    """Left and right half of every two-digit sample, all waiting for review.

    ``samples``: sample_id, sequence (two digits), width, height, ink_fraction.
    """
    middle = F.floor(F.col("width") / 2).cast("int")
    boxes = F.array(
        F.array(F.lit(0), F.lit(0), middle, F.col("height")), F.array(middle, F.lit(0), F.col("width"), F.col("height")),
    )
    rows = samples.select("*", F.posexplode(boxes).alias("digit_position", "bbox"))
    hidden = F.col("sequence").isin(*HIDDEN_ZERO)
    why = reasons(
        {
            "fixed_midline_requires_visual_qc": F.lit(True), "leading_zero_not_visible_in_seed_cell": hidden,
            "ink_occupancy_anomaly": ~yes(F.col("ink_fraction").between(*INK_RANGE)),
        }
    )
    return rows.select(
        F.concat(F.col("sample_id").cast("string"), F.lit("-digit-"), F.col("digit_position").cast("string")).alias("annotation_id"), "sample_id",
        "digit_position", F.when(hidden, "single_digit_without_leading_zero").otherwise("two_digit_sequence").alias("layout_variant"),
        F.when(~hidden, F.substring(F.col("sequence"), F.col("digit_position") + 1, F.lit(1))).alias("label_proposed"), F.lit("needs_review").alias("label_status"),
        F.element_at("bbox", 1).alias("x1"), F.element_at("bbox", 3).alias("x2"), F.array_join(why, ",").alias("qc_reasons"),
    )


def stratified_split(records: DataFrame, key: str, seed: int = 1729, fraction: float = 0.2) -> DataFrame:
    """Per label, the ``max(1, round(n * fraction))`` records with the smallest seeded hash go to validation.

    Positions are counted in 65536 hash ranges per label, so a label of any
    size is never sorted in one task.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    hashed = records.withColumn("_hash", digest)
    sizes = hashed.groupBy("label").agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(fraction), 0).cast("bigint")).alias("_take"))
    chunk = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("bigint")
    placed = position_in_chunks(hashed, ["label"], chunk, [F.col("_hash"), F.col(key)], "_place")
    return placed.join(sizes, "label").withColumn("split", F.when(F.col("_place") <= F.col("_take"), "validation").otherwise("train")).drop("_hash", "_take", "_place")


def golden_labels(observations: DataFrame, confirmed: DataFrame, disputed: DataFrame) -> DataFrame:
    """Machine reading, teacher decision and visual label side by side; disputed cells are marked out."""
    marks = disputed.select("source_id", "question", F.lit(True).alias("_disputed")).distinct()
    rows = observations.join(confirmed, ["source_id", "question"], "left").join(marks, ["source_id", "question"], "left")
    return rows.select(
        "source_id", "question", F.col("state").alias("machine_state"), F.col("answer").alias("teacher_decision"), F.lit(None).cast("string").alias("visual_label"),
        F.when(F.col("_disputed"), "disputed").otherwise("unadjudicated").alias("label_status"), F.col("_disputed").isNull().alias("usable_for_recognition"),
    )


def identity_corpus(records: DataFrame, files: DataFrame) -> DataFrame:
    """Held-out records: teacher-confirmed, digits only, hash verified, one per content.

    ``records``: record_id, corpus_id, label, identity_origin, identity_confirmed, sha256;
    ``files``: record_id, content. The first record id of a content is kept,
    the others are reported.
    """
    actual = files.select("record_id", F.sha2("content", 256).alias("actual"))
    joined = records.join(actual, "record_id", "left")
    firsts = joined.groupBy("actual").agg(F.min("record_id").alias("_first"))
    rows = joined.join(firsts, "actual", "left")
    reason = (
        F.when((F.col("identity_origin") != "teacher_confirmed") | (F.col("identity_confirmed") != 1), "not_teacher_confirmed")
        .when(~yes(F.col("label").rlike("^[0-9]+$")), "bad_label").when(~yes(F.col("actual") == F.col("sha256")), "hash_mismatch")
        .when(F.col("_first") != F.col("record_id"), "duplicate_content")
    )
    return rows.select("record_id", "corpus_id", "label", F.lit("held_out").alias("split"), reason.alias("rejected"))


def training_ready(records: DataFrame, crops: DataFrame) -> DataFrame:
    """Accepted annotations whose crop is unchanged and whose box lies inside it; each other accepted one says why not.

    ``crops``: crop_id, sha256, crop_width, crop_height.
    """
    accepted = records.where(F.col("label_status") == "accepted")
    rows = accepted.join(crops.select("crop_id", F.col("sha256").alias("_actual")), "crop_id", "left")
    reason = (
        F.when(F.col("_actual").isNull(), "missing_crop").when(~yes(F.col("_actual") == F.col("crop_sha256")), "crop_hash_changed")
        .when(~checks.valid_bbox(F.col("bbox")), "bad_bbox").when(~checks.inside_bbox(F.col("bbox"), F.col("crop_width"), F.col("crop_height")), "bbox_outside_crop")
    )
    return rows.select("row_id", "label", F.lit("seed_only").alias("split"), reason.alias("rejected"))
