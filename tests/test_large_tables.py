"""Steps that must not rest on a size estimate, a whole partition per row, or a table per task."""

import contextlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from __spark_entry__ import queries
from gradeloom.operators import changes, curation, evaluate, geometry, identity, review


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def layout(spark, templates=6):
    """Two blocks of two questions and three choices per template."""
    blocks = spark.range(templates).select(F.col("id").alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("block_index"))
    start = F.col("block_index") * 2 + 1
    return blocks.select(
        "t", "block_index", start.alias("question_start"), (start + 1).alias("question_end"), F.lit(3).alias("choice_count"), F.lit(2).alias("row_count"),
        geometry.boundaries(F.col("block_index") * 200, F.lit(30), F.lit(3)).alias("cols"), geometry.boundaries(F.lit(10), F.lit(40), F.lit(2)).alias("rows"),
        (F.col("t") % 3).cast("int").alias("shift_x"), F.lit(1).alias("shift_y"),
    )


def test_question_block_collects_no_side(spark):
    asked = spark.range(24).select((F.col("id") % 6).alias("t"), (F.col("id") % 5).cast("int").alias("question"))
    found = geometry.question_block(asked, layout(spark), ["t"])
    assert "Broadcast" not in plan(found)
    assert rows(found.select("t", "question", "block_index")) == sorted([(i % 6, i % 5, (i % 5 - 1) // 2) for i in range(24) if i % 5], key=repr)


def test_check_geometry_collects_no_side_and_spells_out_after_the_offsets_are_met(spark):
    blocks = layout(spark)
    cells = geometry.shifted_cells(blocks, blocks, ["t"])
    found = geometry.check_geometry(blocks, cells, geometry.number_strips(blocks, ["t"]), ["t"])
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(cells)
    assert rows(cells) == rows(geometry.shift_rects(geometry.cell_rects(blocks, ["t"]), blocks, ["t"]))
    moved = [(t, q, c) for t in range(6) for q in range(1, 5) for c in "ABC"]
    assert rows(found) == sorted([(t, q, c, "leaves_block") for t, q, c in moved if 30 * "ABC".index(c) + 4 + t % 3 + 22 > 90], key=repr)


def test_drift_shuffles_blocks_and_no_cells(spark):
    # in every second template block 0 also covers the first question of block 1, and template 5 has a block twice
    reach = F.col("question_end") + F.when((F.col("t") % 2 == 1) & (F.col("block_index") == 0), 1).otherwise(0)
    blocks = layout(spark, 8).withColumn("question_end", reach)
    blocks = blocks.unionByName(blocks.where("t = 5 AND block_index = 1"))
    offsets = blocks.select("t", "block_index", F.when(F.col("t").isin(3, 4), 200).otherwise(F.col("shift_x")).alias("shift_x"), "shift_y").where("t <> 7")
    found = geometry.offset_drift(blocks, offsets, ["t"], ["ix"])
    columns = ["t", "question", "choice", "ix"]
    want = geometry.geometry_drift(geometry.shifted_cells(blocks, offsets, ["t"]).select(*columns), geometry.cell_rects(blocks, ["t"]))
    assert rows(found) == rows(want) and found.columns == columns
    # question 3 of template 3: block 0 moved by 200 lies where block 1 was, block 1 moved lies nowhere
    assert [row for row in rows(found) if row[0] == 3 and row[1] == 3] == [(3, 3, c, 404 + 30 * i) for i, c in enumerate("ABC")]
    assert {row[0] for row in rows(found)} == {1, 2, 3, 4, 5}
    query = plan(queries()["geometry_drift"](spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in query.split("Generate explode", 1)[0]
    assert "Exchange" not in query[query.index("HashAggregate"):].split("Generate explode", 1)[0]


def test_template_diff_and_check_template_collect_no_side(spark):
    blocks = layout(spark)
    moved = blocks.withColumn("cols", F.transform("cols", lambda x: x + F.col("shift_x")))
    found = geometry.template_diff(blocks, moved.withColumn("rows", F.slice("rows", 1, 2)), ["t"])
    assert "Broadcast" not in plan(found)
    assert rows(found.select("t", "max_error")) == [(t, t % 3) for t in range(6)]
    templates = spark.range(6).select(F.col("id").alias("t"), F.lit(280).alias("width"), F.lit(300).alias("height"), F.lit(5).alias("question_count"), F.lit(3).alias("choice_count"))
    broken = geometry.check_template(blocks, templates, ["t"])
    assert "Broadcast" not in plan(broken)
    assert rows(broken) == sorted([(t, 1, "out_of_bounds") for t in range(6)] + [(t, None, "coverage") for t in range(6)], key=repr)


def test_next_review_reads_no_rest_of_a_slice_again(spark):
    records = spark.range(40).select("id", F.when(F.col("id") % 7 == 3, "needs_review").otherwise("accepted").alias("label_status"))
    starts = spark.range(50).select(F.col("id").alias("worker"), F.col("id").alias("start"))
    found = curation.next_review(records, "id", starts)
    assert "currentrow$(), unboundedfollowing$()" not in plan(found)
    assert rows(found) == sorted([(i, next((p for p in range(3, 40, 7) if p >= i), 3)) for i in range(50)], key=repr)


def test_bootstrap_makes_no_row_per_draw(spark):
    n = evaluate.PIECE + 9
    values = np.arange(n) % 7 < 3
    assert list(evaluate.lcg_run(5, 300)) == list(evaluate.lcg_after(np.arange(5, 305, dtype=np.uint64)))
    totals = sorted(int(values[(evaluate.lcg_run(i * n + 1, n) % np.uint64(n)).astype(np.int64)].sum()) for i in range(evaluate.ITERATIONS))
    found = evaluate.bootstrap_ci(spark.range(n).select("id", (F.col("id") % 7 < 3).alias("hit")), "id", F.col("hit"))
    assert "FlatMapCoGroupsIn" in plan(found)
    assert tuple(found.first()) == (n, round(totals[50] / n, 6), round(totals[1949] / n, 6))


def test_nearest_sums_differences_for_leaders_only_with_equal_results():
    rng = np.random.default_rng(5)
    for refs in (rng.normal(size=(700, 16)), np.round(rng.normal(size=(700, 16))), np.repeat(rng.normal(size=(7, 16)), 100, axis=0), rng.normal(size=(3, 16))):
        asked = np.concatenate([refs[:40], rng.normal(size=(40, 16))])
        refs[1, 2], refs[2, 3] = np.nan, np.inf
        row, at, distance = identity._leaders(asked, refs, 5)
        every = [np.sqrt(((refs - vector) ** 2).sum(axis=1)) for vector in asked]
        want = [np.argsort(found, kind="stable")[:5] for found in every]
        got = [(int(i), int(j)) for i, j, d in zip(row, at, distance) if not np.isnan(d)]
        assert got == [(i, int(j)) for i, best in enumerate(want) for j in best if not np.isnan(every[i][j])]
        assert all(d == every[i][j] for i, j, d in zip(row, at, distance) if not np.isnan(d))


def test_answers_are_spelled_out_after_the_last_shuffle(spark):
    state = spark.createDataFrame([
        (1, 7, 70, 11, "v10", 1, None, None), (2, 7, 70, None, None, None, None, None), (3, 7, 71, 31, "v10", 1, 300, 5), (4, 7, 71, 41, "v10", 1, 400, 4), (5, 9, 90, 51, "v10", 1, None, None),
    ], "source_id bigint, exam_id int, room_id int, detection_id bigint, pipeline_version string, has_registration int, review_id bigint, review_key bigint")
    key, exams = spark.createDataFrame([(7, 5)], "exam_id int, key_id bigint"), spark.createDataFrame([(7, 2), (9, 2)], "exam_id int, question_count int")
    seen = [(1, 1, 0, "multiple", "A"), (1, 1, 1, "single_mark", "B"), (1, 2, 0, "blank", "C"), (1, 3, 0, "blank", "C"), (3, 1, 0, "single_mark", "D"), (4, 2, 0, "single_mark", "E")]
    observations = spark.createDataFrame([(s, q, at, 0, 0, 0, mark, choice, 1) for s, q, at, mark, choice in seen], "source_id bigint, question int, observed_at int, o1 int, o2 int, o3 int, state string, choice string, block_ok int")
    overrides = spark.createDataFrame(
        [(1, 2, 5, 11, 1, "A"), (1, 2, 5, 11, 2, "C"), (1, 1, 4, 11, 3, "E"), (1, 1, 5, 12, 4, "E"), (2, 1, 5, None, 5, "D"), (3, 1, 5, 31, 6, "E")],
        "source_id bigint, question int, key_id bigint, detection_id bigint, seq int, answer string",
    )
    reviewed = spark.createDataFrame([(300, 1, "A"), (300, 2, "blank"), (400, 1, "A")], "review_id bigint, question int, answer string")
    found = review.effective_answers(state, key, exams, observations, overrides, reviewed)
    got = rows(found.select("source_id", "question", "state", "answer", "overridden"))
    assert got == sorted([
        (1, 1, "single_mark", "B", False), (1, 2, "blank", "C", True), (2, 1, None, "D", True), (2, 2, None, None, False),
        (3, 1, "single_mark", "A", True), (3, 2, None, "blank", False), (4, 1, None, None, False), (4, 2, "single_mark", "E", False),
    ], key=repr)
    # joins of a few rows are broadcast, which shuffles no side; of many they are not
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        above, _ = plan(found.groupBy("source_id", "room_id", "detection_id").agg(F.collect_list("answer"))).split("Generate inline", 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in above


def test_bulk_dismiss_joins_only_rows_that_can_be_dismissed(spark):
    kind = "kind string, room_id int, source_id bigint, question int, number int, failure_seq bigint"
    selected = spark.createDataFrame([("import", 1, None, None, None, 8), ("import", 1, None, None, None, 9), ("image", 1, 3, None, None, None), ("image", 1, 4, None, None, None), ("answer", 1, 3, 2, None, None), (None, 1, 3, None, None, None)], kind)
    failures = spark.createDataFrame([(8,)], "seq bigint")
    sheets = spark.createDataFrame([(3, 0, "student"), (4, 1, "student")], "source_id bigint, archived int, purpose string")
    found = changes.bulk_dismiss(selected, failures, sheets)
    assert rows(found.select("kind", "source_id", "failure_seq", "result")) == sorted([
        ("import", None, 8, "failure_resolved"), ("import", None, 9, "already_changed"), ("image", 3, None, "sheet_archived"),
        ("image", 4, None, "already_changed"), ("answer", 3, None, "not_dismissable"), (None, 3, None, "not_dismissable"),
    ], key=repr)
    assert " = import)" in plan(found) and " = image)" in plan(found)


def test_uniform_edit_meets_keys_as_bytes(spark):
    kind = "kind string, source_id bigint, question int, number int, key_id bigint, detection_id bigint, failure_seq bigint"
    issues = spark.createDataFrame([("image", 1, None, None, 5, 6, None), ("answer", 2, 3, None, 5, 6, None), ("image", 3, None, None, 5, 6, None)], kind)
    keyed = issues.select("source_id", review.issue_key(issues).alias("issue_key"))
    keys = {row.source_id: row.issue_key for row in keyed.collect()}
    selection = spark.createDataFrame([(keys[1],), (keys[1],), (keys[2],), (keys[3].upper(),), ("no key",)], "issue_key string")
    found = changes.uniform_edit(issues, selection, "dismiss")
    assert rows(found.select("source_id", "issue_key", "error")) == [(1, keys[1], None), (2, keys[2], "not_dismissable")]
    assert "unhex" in plan(found)


def test_identity_shuffles_each_input_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(queries()["decide_identity"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # reads, positions, digit runs and recogniser runs; no votes or sheets are written and shuffled again
    assert found.count("Exchange") == found.count("REPARTITION_BY_NUM") == 4


def test_sheet_numbers_are_those_of_the_single_steps(spark):
    rng = np.random.default_rng(3)
    positions = [(s, pos, None if rng.random() < 0.1 else int(rng.integers(0, 3)), int(rng.integers(0, 3)) if rng.random() < 0.3 else None) for s in range(80) for pos in range(1 + s % 8)]
    runs = [(s, pos, int(rng.integers(0, 3)), float(rng.integers(0, 9)) if rng.random() < 0.95 else None) for s in range(80) for pos in range(9) for _ in range(4)]
    positions = spark.createDataFrame(positions, "source_id bigint, pos int, digit bigint, shape bigint")
    scored = identity.position_scores(positions, spark.createDataFrame(runs, "source_id bigint, pos int, digit bigint, raw_score double"))
    assert scored.count() == positions.count()
    found = identity.sheet_numbers(scored).cache()
    assert rows(found.select("source_id", "boxes")) == sorted([(s, 1 + s % 8) for s in range(80)], key=repr)
    assert rows(found.where("measured IS NOT NULL").select("source_id", "measured", "measured_score")) == rows(identity.stitch_segments(scored)) != []
    others = found.select("source_id", F.inline("alternatives")).groupBy("source_id", "candidate").agg(F.max("score"))
    assert rows(others) == rows(identity.segment_alternatives(scored)) != []
    shapes = found.where("shape_candidate IS NOT NULL").select("source_id", "shape_candidate", "changed_positions")
    assert rows(shapes) == rows(identity.shape_suggestions(scored)) != []


def test_order_issues_samples_written_rows(spark):
    found = plan(queries()["order_issues"](spark, "/root/testdata/sf0.001"))
    # the range exchange reads its input twice: there must be no join or group below it
    below = found.split("Exchange rangepartitioning", 1)[1]
    assert "Join" not in below and "Generate" not in below and "Scan parquet" in below


def test_queries_that_visit_every_cell_are_routed_in_small_batches():
    rng = np.random.default_rng(8)
    pivots, index = rng.random((300, 64)), np.arange(300)
    asked = pd.DataFrame({"query_id": np.arange(3000), "vector": list(rng.random((3000, 64)))})
    route = identity._router(pivots, index, np.full(300, 100.0), [(i, 0.1) for i in range(300)], 5)
    frames = list(route(iter([asked, asked.iloc[:0]])))
    assert max(len(frame) for frame in frames) * 64 <= identity.BATCH_NUMBERS < 3000 * 300 * 64
    found = pd.concat(frames)
    assert len(found) == 900_000 and not found.duplicated(["query_id", "cell"]).any()


def test_leaders_are_those_of_a_full_sort():
    rng = np.random.default_rng(5)
    refs = np.r_[rng.random((700, 8)), np.repeat(rng.random((3, 8)), 50, axis=0)]
    asked = np.r_[rng.random((40, 8)), refs[-2:]]
    row, at, distance = identity._leaders(asked, refs, 5)
    every = np.sqrt(((asked[:, None] - refs) ** 2).sum(axis=2))
    assert at.reshape(-1, 5).tolist() == np.argsort(every, axis=1, kind="stable")[:, :5].tolist()
    assert row.tolist() == np.repeat(np.arange(42), 5).tolist() and np.allclose(distance, np.sort(every, axis=1)[:, :5].ravel())
