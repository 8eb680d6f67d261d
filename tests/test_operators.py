"""Hand-checked rows and brute-force comparisons."""

import datetime
import hashlib
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import marks, scalars
from gradeloom.operators import changes, checks, curation, evaluate, geometry, identity, quota, review
from gradeloom.operators.common import dense_number, exact_median, latest, running_sum
from gradeloom.sources import exports, files, publish
from gradeloom.streaming import jobs


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def png(width, height, value=255):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = b"".join(b"\x00" + bytes([value]) * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


# ---- marks ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "densities, cores, state, selected",
    [
        ([0.2, 0.0, 0.0, 0.0], [0.2, 0, 0, 0], "single_mark", ["A"]),
        ([0.2, 0.3, 0.0, 0.0], [0.2, 0.3, 0, 0], "multiple", ["A", "B"]),
        ([0.0, 0.0, 0.0, 0.0], [0.0, 0, 0, 0], "blank", []),
        ([0.2, 0.07, 0.0, 0.0], [0.2, 0.02, 0, 0], "uncertain", ["A"]),
        ([0.3, 0.05, 0.0, 0.0], [0.3, 0.02, 0, 0], "single_mark", ["A"]),
        ([0.02, 0.0, 0.0, 0.0], [0.0, 0, 0, 0], "uncertain", []),
    ],
)
def test_classify_ink(spark, densities, cores, state, selected):
    df = spark.createDataFrame([(densities, [float(c) for c in cores])], "d array<double>, c array<double>")
    out = df.select(marks.classify_ink(F.col("d"), F.col("c")).alias("x")).first().x
    assert (out.state, out.selected) == (state, selected)


def test_component_majority_needs_a_large_single_stroke(spark):
    df = spark.createDataFrame(
        [([70, 50, 0, 0, 0], 120, 0), ([110, 10, 0, 0, 0], 120, 0), ([70, 50, 0, 0, 0], 120, 90), ([60, 30, 0, 0, 0], 90, 0)], "m array<int>, a int, o int"
    )
    decision = F.struct(F.array().cast("array<string>").alias("selected"), F.lit("uncertain").alias("state"), F.lit("x").alias("reason"))
    cores = F.array(*[F.lit(0.01)] * 5)
    got = [row.s for row in df.select(marks.component_majority(decision, cores, F.col("m"), F.col("a"), F.col("o"))["state"].alias("s")).collect()]
    assert got == ["boundary_cross", "single_mark", "uncertain", "uncertain"]


# ---- text ----------------------------------------------------------------------


def test_labels_and_names(spark):
    df = spark.createDataFrame([("  Ａ１   ข้อ ",), ("   ",), ("x" * 121,)], "t string")
    assert [r[0] for r in df.select(scalars.normalize_label(F.col("t"), 120)).collect()] == ["A1 ข้อ", None, None]
    folder = spark.range(1).select(scalars.safe_folder([F.lit("ก" * 100), F.lit("a/b")], F.lit(30)).alias("n")).first().n
    assert folder == "ก" * 60 + "_30q" and len(folder[:-4].encode()) == 180
    names = spark.createDataFrame([("../../etc/pass\x00wd",), ("..",), ("photo.JPG",)], "t string")
    got = [r[0] for r in names.select(scalars.safe_upload_name(F.col("t"), F.lit(".png"), F.lit("id"))).collect()]
    assert got == ["pass_wd.png", "upload-id.png", "photo.JPG"]


# ---- scalable building blocks -------------------------------------------------------


def test_running_helpers_match_brute_force_on_a_hot_key(spark):
    rng = random.Random(5)
    data = [(0 if i % 3 else rng.randrange(4), i * 3, rng.randrange(50)) for i in range(2000)]
    df = spark.createDataFrame(data, "k bigint, seq bigint, value bigint")
    sums, want = {}, []
    for k, seq, value in data:
        sums[k] = sums.get(k, 0) + value
        want.append((k, seq, value, sums[k]))
    assert rows(running_sum(df, ["k"], "seq", "value", "total", width=64)) == sorted(want)
    assert rows(dense_number(df, [], "seq", "n", width=100).select("seq", "n")) == [(i * 3, i + 1) for i in range(2000)]
    medians = {k: float(np.median([v for kk, _, v in data if kk == k])) for k in {d[0] for d in data}}
    assert rows(exact_median(df, ["k"], "value", "m")) == sorted(medians.items())


def test_latest_does_not_depend_on_row_order(spark):
    data = [(i % 7, i, f"v{i}") for i in range(200)]
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    schema = "k int, seq int, v string"
    assert rows(latest(spark.createDataFrame(data, schema), "k")) == rows(latest(spark.createDataFrame(shuffled, schema), "k"))
    plan = latest(spark.createDataFrame(data, schema), "k")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_overlap_join_matches_brute_force(spark):
    rng = random.Random(2)
    boxes = [(i % 2, i, rng.randrange(600), rng.randrange(600), rng.randrange(1, 300), rng.randrange(1, 300)) for i in range(60)]
    df = spark.createDataFrame(boxes, "t int, id int, x int, y int, w int, h int")
    got = rows(geometry.overlap_join(df, df, ["t"], 64).select("t", "id_l", "id_r"))
    want = sorted(
        (a[0], a[1], b[1]) for a in boxes for b in boxes
        if a[0] == b[0] and max(a[2], b[2]) < min(a[2] + a[4], b[2] + b[4]) and max(a[3], b[3]) < min(a[3] + a[5], b[3] + b[5])
    )
    assert got == want


def test_dedupe_near_keeps_the_strongest(spark):
    def quad(d):
        return [float(d), 0.0, 100.0 + d, 0.0, 100.0 + d, 100.0, float(d), 100.0]

    data = [(1, 1, 0.9, "a", *quad(0)), (1, 2, 0.8, "b", *quad(3)), (1, 3, 0.7, "c", *quad(40)), (2, 4, 0.5, "a", *quad(0)), (1, 5, 0.95, "d", *quad(6))]
    schema = "image_id bigint, candidate_id bigint, proposal_score double, method string, " + ", ".join(f"x{i} double, y{i} double" for i in (1, 2, 3, 4))
    assert rows(geometry.dedupe_near(spark.createDataFrame(data, schema), 4.0)) == [(1, 1, 0.9, "a"), (1, 3, 0.7, "c"), (1, 5, 0.95, "b,d"), (2, 4, 0.5, "a")]


def test_knn_over_many_blocks_equals_one_block(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(120, 6)).astype("float32")
    ref = spark.createDataFrame([(i, int(i % 3), vectors[i].tolist()) for i in range(90)], "ref_id bigint, label int, vector array<float>")
    query = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(90, 120)], "query_id bigint, vector array<float>")
    small = rows(identity.knn(query, ref, 5, cell_rows=16, query_rows=7).select("query_id", "ref_id", "place"))
    want = []
    for i in range(90, 120):
        distance = np.sqrt(((vectors[:90].astype(float) - vectors[i].astype(float)) ** 2).sum(axis=1))
        want += [(i, int(r), p + 1) for p, r in enumerate(np.argsort(distance, kind="stable")[:5])]
    assert small == sorted(want)


def test_bootstrap_matches_the_sequential_generator(spark):
    values = [True] * 5 + [False] * 17
    state, estimates = 1729, []
    for _ in range(2000):
        total = 0
        for _ in values:
            state = (1664525 * state + 1013904223) % 2**32
            total += values[state % len(values)]
        estimates.append(total / len(values))
    estimates.sort()
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, hit boolean")
    got = evaluate.bootstrap_ci(df, "id", F.col("hit"), block=8).first()
    assert (got.low, got.high) == (round(estimates[50], 6), round(estimates[1949], 6)) == (0.090909, 0.409091)


def test_next_review_wraps(spark):
    records = spark.createDataFrame([(1, "accepted"), (4, "needs_review"), (9, "needs_review")], "p bigint, label_status string")
    starts = spark.createDataFrame([(1, 0), (2, 4), (3, 5), (4, 10)], "worker bigint, start bigint")
    assert rows(curation.next_review(records, "p", starts)) == [(1, 4), (2, 4), (3, 9), (4, 4)]


def test_replay_refuses_accept_on_a_bad_box(spark):
    log = ["mark_bad_bbox", "accept_label", "correct_bbox", "accept_label", "mark_bad_bbox", "reset", "accept_label"]
    data = [(i, 1, "me", a, i) for i, a in enumerate(log)]
    got = curation.replay_annotations(spark.createDataFrame(data, "seq bigint, annotation_id bigint, annotator_id string, action string, digit bigint")).first()
    assert (got.label_status, got.label, got.bad_bbox, got.bbox_status, got.refused) == ("accepted", 6, False, "corrected", 1)


# ---- decisions -------------------------------------------------------------------


def test_elimination_needs_exactly_one_candidate(spark):
    ambiguous = spark.createDataFrame([(1, 10, 5), (1, 10, 6), (1, 11, 5), (1, 11, 7), (1, 11, 8)], "room_id int, source_id int, candidate int")
    anchored = spark.createDataFrame([(1, 5)], "room_id int, candidate int")
    assert rows(changes.eliminate_candidates(ambiguous, anchored)) == [(1, 10, 6)]


def test_gates_fail_closed_on_unknown_values(spark):
    df = spark.createDataFrame([(None, 0.9)], "c double, m double")
    ok = identity.auto_accept(
        F.lit(True), F.lit(0.9), F.lit(0.4), F.lit("1"), F.lit("1"), F.col("c"), F.col("m"), F.lit(True), F.lit(False), F.lit(True), F.lit(None).cast("boolean"), F.lit(True)
    )
    assert df.select(ok).first()[0] is False


def test_enforce_raises(spark):
    broken = checks.check_exams(
        spark.createDataFrame([(1, " ", 99, 0, 1)], "row_id int, name string, question_count int, expected_max int, template_version int"), ["row_id"], ["name"]
    )
    assert {r.rule for r in broken.collect()} == {"bad_name", "bad_question_count", "bad_maximum"}
    with pytest.raises(checks.enforce.__globals__["ConstraintError"]):
        checks.enforce(broken)


def test_quota_exact_counts_accepted_uploads_only(spark):
    start = datetime.datetime(2024, 1, 1)
    sizes = [60, 50, 30, 10, 5, 5]
    data = [(1, i, start + datetime.timedelta(seconds=i), s) for i, s in enumerate(sizes)] + [(1, 9, start + datetime.timedelta(seconds=99), 1)]
    df = spark.createDataFrame(data, "session_id bigint, seq bigint, ts timestamp, bytes bigint")
    got = [r.decision for r in quota.quota_exact(df, quota.Limits(file_bytes=55, session_bytes=90, files=4, seconds=50)).orderBy("seq").collect()]
    assert got == ["file_too_large", "accepted", "accepted", "accepted", "session_full", "session_full", "session_expired"]


def test_stream_quota_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    data = [(rng.randrange(5), i, start + datetime.timedelta(seconds=i), rng.randrange(1, 60)) for i in range(300)]
    limits = quota.Limits(file_bytes=55, session_bytes=900, files=30, seconds=200)
    df = spark.createDataFrame(data, "session_id bigint, seq bigint, ts timestamp, bytes bigint")
    batch = rows(quota.quota_exact(df, limits))
    source = df.withColumnRenamed("ts", "at")
    last = spark.createDataFrame([(-1, 999, start + datetime.timedelta(days=1), 1)], source.schema)  # moves the watermark past all others
    source.unionAll(last).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")).withWatermark("at", "10 minutes")
    with jobs.state_store(spark):
        jobs.run_available(jobs.stream_quota(stream, limits), str(tmp_path / "out"), str(tmp_path / "check"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("session_id", "seq", "bytes", "decision")) == batch


# ---- files -------------------------------------------------------------------------


def test_scan_inventory_and_ingest(spark, tmp_path):
    folder = tmp_path / "scans"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.png").write_bytes(png(7, 5))
    (folder / "sub" / "stored").write_bytes(png(7, 5))
    (folder / "note.txt").write_text("hello")
    (folder / "Thumbs.db").write_bytes(b"x")
    (folder / "broken.jpg").write_bytes(b"\xff\xd8\xffzz")
    found = {r.file_name: r.type for r in files.scan_files(spark, str(folder)).collect()}
    assert found == {"a.png": "png", "stored": "png", "broken.jpg": "jpeg"}
    listed = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.status) for r in files.inventory(spark, str(folder)).collect()}
    assert listed["a.png"] == (7, 5, "ok") and listed["broken.jpg"][2] == "error"
    raster = files.scan_rasters(spark, str(folder)).where("path like '%a.png'").first()
    assert (raster.width, raster.height, raster.channels) == (7, 5, 1)
    batch = spark.createDataFrame([(1, "student", 1, 10, "h"), (1, "student", 1, 11, "h"), (1, "key", None, 12, "k")], "exam_id int, purpose string, room_id int, file_id int, sha256 string")
    empty = spark.createDataFrame([], "exam_id int, sha256 string, source_id int, purpose string, room_id int, archived int")
    first = files.ingest_sources(batch, empty)
    assert rows(first.select("file_id", "decision")) == [(10, "accepted"), (11, "duplicate"), (12, "accepted")]
    stored = first.where("decision = 'accepted'").select("exam_id", "sha256", F.col("file_id").alias("source_id"), "purpose", "room_id", F.lit(0).alias("archived"))
    assert {r.decision for r in files.ingest_sources(batch, stored).collect()} == {"existing"}
    archived = stored.withColumn("archived", F.lit(1))
    assert {r.decision for r in files.ingest_sources(batch, archived).collect()} == {"reactivated"}


def test_publish_commits_only_an_unchanged_snapshot(spark, tmp_path):
    root = str(tmp_path / "pub")
    df = spark.createDataFrame([(1, 2), (3, 4)], "a int, b int")
    publish.publish(lambda: df, spark, root, "r1")
    assert rows(publish.published(spark, root).select("a", "b")) == [(1, 2), (3, 4)]
    moving = iter([df, df.limit(1)])
    with pytest.raises(publish.SnapshotChanged):
        publish.publish(lambda: next(moving), spark, root, "r2")
    assert [r.run_id for r in publish.committed_runs(spark, root).collect()] == ["r1"]
    with pytest.raises(ValueError):
        publish.publish(lambda: df, spark, root, "r1")
    manifest = publish.artifact_manifest(spark, root + "/runs/run_id=r1").where("path like '%.parquet'").first()
    with open(manifest.path.replace("file:", ""), "rb") as stream:
        assert hashlib.sha256(stream.read()).hexdigest() == manifest.sha256


def test_write_scores_and_snapshot(spark, tmp_path):
    sheet = spark.createDataFrame([(1, 7, "=x.jpg"), (1, 3, "b.jpg"), (2, 1, "c.jpg")], "room_id int, number bigint, original_name string")
    publish.write_scores(sheet, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    publish.write_snapshot(sheet, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("schema_version = 2").count() == 3


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(1, i, f"s{i}") for i in range(500)], "room_id int, source_id int, status string")
    base = publish.fingerprint(df, ["room_id"], width=16).first().fingerprint
    assert publish.fingerprint(df.orderBy(F.rand(1)).repartition(7), ["room_id"], width=16).first().fingerprint == base
    assert publish.fingerprint(df.withColumn("status", F.when(F.col("source_id") == 7, "x").otherwise(F.col("status"))), ["room_id"], width=16).first().fingerprint != base


def test_export_readers(spark, tmp_path):
    doc = {
        "schema_version": 2, "run_id": "r", "exam": {"id": "e", "question_count": 2}, "room": {"id": "m"}, "key": {"id": "k"},
        "results": [{"source": {"id": "s", "original_name": "a.jpg", "sha256": "h"}, "student_number": "7", "identity_confirmed": True, "answers": ["A", "B"],
                     "answer_provenance": [{"question": 1, "origin": "teacher_confirmed"}], "detection": {"answers": [{"classification": "blank", "selected": []}] * 3}}],
    }
    (tmp_path / "results.json").write_text(json.dumps(doc))
    results, observations = exports.read_export_results(spark, str(tmp_path / "results.json"))
    assert results.first().student_number == "7"
    assert rows(observations.select("question", "answer", "origin"))[0] == (1, "A", "teacher_confirmed") and observations.count() == 2
    (tmp_path / "keys.json").write_text(json.dumps({"key_01": {"1": "A", "2": "D"}}))
    assert rows(exports.read_answer_keys(spark, str(tmp_path / "keys.json"))) == [("key_01", 1, "A"), ("key_01", 2, "D")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "old.json").write_text(json.dumps({"id": "old", "width": 100, "height": 90, "groups": [[0, 10, 20], [30, 40, 50]], "rows": [5, 15, 25, 35]}))
    templates, blocks = exports.read_template(spark, str(tmp_path / "t"))
    assert templates.first().question_count == 6
    assert rows(blocks.select("block_index", "question_start", "question_end", "choice_count")) == [(0, 1, 3, 2), (1, 4, 6, 2)]


def test_streaming_latest_is_idempotent_and_compacts(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "source_id int, seq int, v string")
    target = str(tmp_path / "log")
    write = jobs.latest_writer(target, "source_id")
    write(log, 0)
    write(log, 0)
    write(log.where("seq = 3").withColumn("seq", F.lit(9)), 1)
    assert rows(jobs.latest_table(spark, target, "source_id").select("source_id", "seq")) == [(1, 2), (2, 9)]
    jobs.compact(spark, target, str(tmp_path / "small"), "source_id")
    assert rows(spark.read.parquet(str(tmp_path / "small")).select("source_id", "seq")) == [(1, 2), (2, 9)]


def test_file_stream_keeps_bad_files_as_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.png").write_bytes(png(3, 3))
    (folder / "b.png").write_bytes(png(3, 3))
    (folder / "c.png").write_bytes(b"junk")
    stream = jobs.file_stream(spark, str(folder)).select(F.lit(1).alias("exam_id"), "sha256", "type", F.col("modificationTime").alias("at"))
    jobs.run_available(jobs.stream_ingest(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(str(r.type) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["None", "png"]


def test_prefill_never_invents_a_value(spark):
    df = spark.createDataFrame([("answer", "uncertain", None, None), ("answer", "single_mark", None, "B"), ("number", "uncertain", "12", "12")], "kind string, status string, prefill string, candidate string")
    got = [r[0] for r in df.select(review.prefilled_value(*[F.col(c) for c in df.columns])).collect()]
    assert got == [None, "B", "12"]


def test_running_helpers_take_sparse_and_negative_clocks(spark):
    rng = random.Random(3)
    clock = sorted({rng.randrange(-(1 << 62), 1 << 62) for _ in range(300)} | set(range(-40, 40)))
    df = spark.createDataFrame([(c, c % 7) for c in rng.sample(clock, len(clock))], "seq long, value long")
    total, want = 0, []
    for c in clock:
        total += c % 7
        want.append((c, c % 7, total))
    assert rows(running_sum(df, [], "seq", "value", "total", width=16)) == want


def test_intermediates_need_a_shared_folder_and_can_be_forgotten(spark):
    import os

    from gradeloom.session import checkpoint_dir, cut, forget

    class Unset:
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Unset)
    assert cut(spark.range(10)).count() == 10 and os.path.isdir(checkpoint_dir(spark))
    forget(spark)
    assert not os.path.exists(checkpoint_dir(spark))


def test_unknown_sheets_take_the_next_free_name(spark):
    given = [(1, 10, None, 3), (1, 11, None, 3), (1, 12, None, 4), (1, 13, None, None), (1, 14, None, 1), (2, 15, None, 3), (1, 16, 7, None), (1, 17, 7, None)]
    df = spark.createDataFrame(given, "room_id int, source_id long, number int, unknown_ordinal long")
    names = {r.source_id: r.file_name for r in publish.unique_filenames(df).collect()}
    assert names == {10: "unknown-03.jpg", 11: "unknown-04.jpg", 12: "unknown-05.jpg", 13: "unknown-01.jpg", 14: "unknown-02.jpg", 15: "unknown-03.jpg", 16: "no-07.jpg", 17: "no-07_02.jpg"}


def test_confusion_counts_what_is_not_listed(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "z"), ("b", None), ("b", "a")], "t string, p string")
    got = {r.truth: (r.p_a, r.p_b, r.p_rest, r.total) for r in evaluate.confusion_matrix(df, "t", "p", ["a", "b"]).collect()}
    assert got == {"a": (1, 0, 1, 2), "b": (1, 0, 1, 2), "total": (2, 0, 2, 4)}


def test_lone_candidates_and_long_numbers_are_told(spark):
    df = spark.createDataFrame([(1, p, 3, 5.0) for p in range(3)] + [(2, p, 3, 5.0) for p in range(7)], "source_id long, pos int, digit int, score double")
    got = {r.source_id: (r.candidate, r.margin, r.left_out, r.reason) for r in identity.combine_digits(df).collect()}
    assert got == {1: ("333", 5.0, 0, None), 2: (None, None, None, "too_many_digits")}


def test_connected_strokes_decide_after_contrast_on_refined_sheets_only(spark):
    df = spark.createDataFrame(
        [(1, True), (2, False)], "row_id int, refined boolean"
    ).selectExpr(
        "row_id", "refined", "false AS custom", "false AS green", "array(0.05D, 0.04D, 0D) AS densities", "array(0.05D, 0.04D, 0D) AS cores", "array(0.8D, 0.2D, 0D) AS shares",
        "array(160, 40, 0) AS mass", "200 AS area", "10 AS other_area", "cast(array() AS array<int>) AS crosses", "cast(array() AS array<int>) AS diagonals",
        "named_struct('selected', cast(array() AS array<string>), 'state', 'uncertain', 'reason', 'faint-or-competing-ink') AS decision",
    )
    got = {r.row_id: (r.decision.state, list(r.decision.selected)) for r in marks.refine_classification(df, strokes=True).collect()}
    assert got == {1: ("single_mark", ["A"]), 2: ("uncertain", [])}
