"""Operators whose keys may be large: one key split over many slices against a plain scan, streams over several micro-batches, writes that conflict or fail."""

import datetime
import random
import struct
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import curation, geometry, identity, quota
from gradeloom.sources import commits, files, partitions, publish
from gradeloom.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


@pytest.fixture
def split(spark):
    """Shuffle partitions stay as they are, so that small tables are cut into eight slices."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# ---- quotas ----------------------------------------------------------------------


def scan(uploads, limits):
    """Decisions of (session, seq, ts, bytes) rows, one after the other."""
    state, out = {}, []
    for session, seq, ts, size in sorted(uploads, key=lambda r: (r[0], r[2], r[1])):
        at = int((ts - START).total_seconds() * 1_000_000)
        start, count, used = state.get(session, (at, 0, 0))
        decision = quota.decide(start, count, used, at, size, limits)
        if decision == "accepted":
            count, used = count + 1, used + size
        state[session] = start, count, used
        out.append((session, seq, size, decision))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_quota_of_a_hot_session_equals_the_scan(spark, split, seed):
    rng = random.Random(seed)
    limits = quota.Limits(file_bytes=80, session_bytes=[900, 3000, 400][seed], files=[500, 40, 12][seed], seconds=700)
    session = lambda: 1 if rng.random() < 0.7 else rng.randrange(2, 5)
    uploads = [(session(), i, START + datetime.timedelta(seconds=rng.randrange(900)), rng.choice([0, 1, 3, 20, 60, 100])) for i in range(600)]
    df = spark.createDataFrame(uploads, "session_id bigint, seq bigint, ts timestamp, bytes bigint").repartition(5)
    assert rows(quota.quota_exact(df, limits)) == scan(uploads, limits)


def test_quota_of_nothing_and_of_one_session_that_accepts_nothing(spark):
    kind = "session_id bigint, seq bigint, ts timestamp, bytes bigint"
    assert quota.quota_exact(spark.createDataFrame([], kind)).count() == 0
    assert rows(quota.quota_exact(spark.createDataFrame([(1, 1, START, 9)], kind), quota.Limits(file_bytes=5))) == [(1, 1, 9, "file_too_large")]


def test_stream_quota_over_micro_batches_with_late_rows_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    limits = quota.Limits(file_bytes=55, session_bytes=900, files=30, seconds=200)
    uploads = [(rng.randrange(4), i, START + datetime.timedelta(seconds=i), rng.randrange(1, 60)) for i in range(500)]
    uploads += [(7, 900, START, 10), (7, 901, START + datetime.timedelta(seconds=450), 10)]  # comes back after it has expired
    kind = "session_id bigint, seq bigint, at timestamp, bytes bigint"
    for batch in range(5):  # every fourth row comes a batch later than its time
        own = [r for r in uploads if min(max((r[2] - START).seconds // 100 + (r[1] % 4 == 0), 0), 4) == batch]
        rng.shuffle(own)
        own += [(99, 10_000, START + datetime.timedelta(days=3), 1)] if batch == 4 else []
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("at", "300 seconds")
    with jobs.state_store(spark):
        query = jobs.run_available(jobs.stream_quota(stream, limits), f"{tmp_path}/out", f"{tmp_path}/check")
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 5
    got = rows(spark.read.parquet(f"{tmp_path}/out").where("session_id <> 99").select("session_id", "seq", "bytes", "decision"))
    assert got == scan(uploads, limits) and (7, 901, 10, "session_expired") in got
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_observed_progress_becomes_rows(spark, tmp_path):
    kind = "room_id int, done boolean"
    for part in ([(1, True), (1, False)], [(2, True)], [(1, None), (2, True), (2, False)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with jobs.progress_rows(spark) as listener:
        query = jobs.run_batches(jobs.stream_progress(jobs.observed_progress(stream)), lambda df, batch: jobs.write_batch(df, f"{tmp_path}/out", batch), f"{tmp_path}/check", "update")
        listener.wait(query)
    got = rows(listener.rows(spark).where("batch_total > 0").drop("run_id"))
    assert got == [(0, 2, 1, 2, 1, 1), (1, 1, 1, 3, 2, 1), (2, 3, 1, 6, 3, 3)]
    assert listener.rows(spark).count() == 0


# ---- one key in many slices --------------------------------------------------------


def quads(rng, n, images, spread):
    out = []
    for i in range(n):
        x, y = rng.uniform(0, spread), rng.uniform(0, spread)
        noise = lambda: rng.uniform(-2, 2)
        corners = [c + noise() for c in (x, y, x + 100, y, x + 100, y + 100, x, y + 100)]
        out.append((rng.randrange(images), i, rng.randrange(9) / 9.0, rng.choice("abc"), *corners))
    return out


def kept_by_scan(proposals, tolerance):
    out = []
    for image in {p[0] for p in proposals}:
        kept = []
        for p in sorted((p for p in proposals if p[0] == image), key=lambda p: (-p[2], p[1])):
            shape = np.asarray(p[4:]).reshape(4, 2)
            near = [k for k in kept if np.linalg.norm(k[0] - shape, axis=1).mean() <= tolerance]
            if near:
                near[0][2].add(p[3])
            else:
                kept.append((shape, p, {p[3]}))
        out += [(image, p[1], p[2], ",".join(sorted(methods))) for _, p, methods in kept]
    return sorted(out, key=repr)


PROPOSALS = "image_id bigint, candidate_id bigint, proposal_score double, method string, " + ", ".join(f"x{i} double, y{i} double" for i in (1, 2, 3, 4))


@pytest.mark.parametrize("seed,n,images,spread", [(1, 120, 1, 40), (2, 150, 3, 15), (3, 60, 1, 3)])
def test_dedupe_near_equals_the_scan(spark, split, seed, n, images, spread):
    proposals = quads(random.Random(seed), n, images, spread)
    got = rows(geometry.dedupe_near(spark.createDataFrame(proposals, PROPOSALS).repartition(4), 4.0))
    assert got == kept_by_scan(proposals, 4.0)


def test_dedupe_near_of_a_chain(spark):
    chain = [(1, i, 1.0 - i / 100, "m", *([3.0 * i] * 8)) for i in range(10)]  # each is near the next only
    assert rows(geometry.dedupe_near(spark.createDataFrame(chain, PROPOSALS), 4.5)) == kept_by_scan(chain, 4.5)
    assert geometry.dedupe_near(spark.createDataFrame([], PROPOSALS), 4.5).count() == 0


def test_replay_of_one_record_in_many_slices(spark, split):
    rng = random.Random(5)
    log = [(i, 1 if i % 7 else 2, "me", rng.choice(["accept_label", "mark_bad_bbox", "correct_bbox", "reset", "exclude", "accept_label", "accept_label"]), rng.randrange(-1, 12)) for i in range(900)]
    want = []
    for record in (1, 2):
        bad, status, label, box, annotated, refused = False, "needs_review", None, None, False, 0
        for _, _, _, action, digit in (e for e in log if e[1] == record):
            if action == "accept_label":
                if bad or not 0 <= digit <= 9:
                    refused += 1
                    continue
                status, label = "accepted", digit
                continue
            status, label = ("excluded" if action == "exclude" else "needs_review"), None
            if action != "exclude":
                bad, annotated = action == "mark_bad_bbox", annotated or action == "correct_bbox"
        want.append((record, status, label, bad, "bad_bbox" if bad else "corrected" if annotated else "proposal", refused))
    df = spark.createDataFrame(log, "seq bigint, annotation_id bigint, annotator_id string, action string, digit bigint").repartition(3)
    assert rows(curation.replay_annotations(df)) == want


def test_next_review_among_sparse_positions(spark, split):
    rng = random.Random(6)
    positions = sorted(rng.randrange(-(1 << 62), 1 << 62) for _ in range(300))
    waiting = [p for p in positions if rng.random() < 0.3]
    records = spark.createDataFrame([(p, "needs_review" if p in set(waiting) else "accepted") for p in positions], "p bigint, label_status string")
    starts = [(i, rng.choice([rng.choice(positions), rng.randrange(-(1 << 62), 1 << 62), positions[0]])) for i in range(200)] + [(900, (1 << 62) + 5)]
    got = dict(rows(curation.next_review(records, "p", spark.createDataFrame(starts, "worker bigint, start bigint"))))
    assert got == {w: next((p for p in waiting if p >= s), waiting[0]) for w, s in starts}


def test_clusters_and_runs_of_one_image_in_many_slices(spark, split):
    rng = random.Random(7)
    values = sorted({rng.randrange(40_000) for _ in range(1500)})
    counted = [(1, v) for v in values for _ in range(rng.randrange(1, 3))] + [(2, 5), (2, 500)]
    islands, current = [], []
    for v in values:
        if current and v - current[-1] > 20:
            islands.append(current)
            current = []
        current.append(v)
    islands.append(current)
    times = {v: sum(c == (1, v) for c in counted) for v in values}
    mean = lambda own: round(sum(v * times[v] for v in own) / sum(times[v] for v in own))
    df = spark.createDataFrame(counted, "image_id int, value int").repartition(4)
    found = geometry.cluster_gaps(df, ["image_id"], 20)
    assert rows(found.where("image_id = 1").select("line", "members")) == sorted(((mean(o), sum(times[v] for v in o)) for o in islands), key=repr)
    lines, at = [], 0
    for i in range(400):
        at += 30 if i % 97 else 90
        lines.append((1, at))
    got = geometry.longest_regular_run(spark.createDataFrame(lines, "image_id int, line int").repartition(4), ["image_id"]).first()
    own = [v for _, v in lines]
    gaps = [b - a for a, b in zip(own, own[1:])]
    runs, first = [], 0
    for i, gap in enumerate([*gaps, 1000]):
        if not 15 <= gap <= 51:
            runs.append((i - first, own[first], own[i]))
            first = i + 1
    best = max(runs, key=lambda r: (r[0], -r[1]))
    assert (got.spacing, got.intervals, got.first_line, got.last_line) == (30.0, *best)


def test_hashed_neighbours_reach_nine_in_ten(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 3
    vectors = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * 0.4).astype("float32")
    ref = spark.createDataFrame([(i, int(i % 3), vectors[i].tolist()) for i in range(500)] + [(999, 1, None)], "ref_id bigint, label int, vector array<float>")
    query = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(500, 600)], "query_id bigint, vector array<float>")
    exact = identity.knn(query, ref, 5)
    found = identity.knn_hashed(query, ref, 5, bucket=3.0, cell_rows=64, query_rows=32)
    assert identity.recall(found, exact).first().recall >= 0.9
    assert identity.recall(exact, exact).first().recall == 1.0


def test_nearest_centroid_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    centres, asked = rng.normal(size=(40, 8)), rng.normal(size=(60, 8))
    c = spark.createDataFrame([(i, centres[i].tolist()) for i in range(40)], "label int, centroid array<double>")
    q = spark.createDataFrame([(i, asked[i].tolist()) for i in range(60)], "query_id bigint, vector array<double>")
    gaps = np.linalg.norm(asked[:, None] - centres, axis=2)
    want = [(i, int(gaps[i].argmin()), round(100 / (1 + gaps[i].min()), 4)) for i in range(60)]
    assert rows(identity.nearest_centroid(q, c)) == sorted(want, key=repr)


# ---- writes ----------------------------------------------------------------------


def stamps(folder):
    return {p.relative_to(folder).as_posix(): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_replacing_partitions_leaves_the_others_alone(spark, tmp_path):
    path = tmp_path / "indicators"
    kind = "exam_id int, position int, identifier string"
    first = spark.createDataFrame([(e, p, f"{e}{p}") for e in (1, 2, 3) for p in range(3)], kind)
    partitions.write_partitions(first, str(path))
    before = stamps(path)
    incoming = spark.createDataFrame([(1, 0, "new"), (2, 0, "broken"), (4, 0, "fresh")], kind)
    broken = spark.createDataFrame([(2, "overlap")], "exam_id int, rule string")
    for _ in range(2):  # a rerun changes nothing
        partitions.apply_indicators(str(path), incoming, broken)
        got = rows(partitions.read_partitions(spark, str(path), first.schema))
        assert got == [(1, 0, "new"), *[(e, p, f"{e}{p}") for e in (2, 3) for p in range(3)], (4, 0, "fresh")]
    after = stamps(path)
    assert {k: v for k, v in before.items() if "exam_id=1/" not in k}.items() <= after.items()


def test_a_failed_write_leaves_the_old_partition(spark, tmp_path):
    path = tmp_path / "indicators"
    first = spark.createDataFrame([(1, "a"), (2, "b")], "exam_id int, identifier string")
    partitions.write_partitions(first, str(path))
    before = stamps(path)
    failing = spark.createDataFrame([(1, "x"), (2, "y")], "exam_id int, identifier string").withColumn("identifier", F.when(F.col("exam_id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("identifier")))
    with pytest.raises(Exception, match="no"):
        partitions.replace_partitions(failing, str(path))
    assert stamps(path) == before and rows(partitions.read_partitions(spark, str(path), first.schema)) == [(1, "a"), (2, "b")]


def test_purge_removes_an_exam_from_every_table_and_can_be_repeated(spark, tmp_path):
    kinds = {"sources": "exam_id int, source_id int", "partials": "exam_id int, source_id int, key_id int", "keys": "exam_id int, key_id int"}
    for name, kind in kinds.items():
        n = kind.count(",")
        partitions.write_partitions(spark.createDataFrame([(e, *range(e, e + n)) for e in (1, 2, 3)], kind), f"{tmp_path}/{name}")
    before = {name: stamps(tmp_path / name) for name in kinds}
    gone = spark.createDataFrame([(2,), (9,)], "exam_id int")
    paths = {name: f"{tmp_path}/{name}" for name in kinds}
    assert partitions.apply_purge(spark, paths, gone) == {"partials": 1, "keys": 1, "sources": 1}
    assert partitions.apply_purge(spark, paths, gone) == {"partials": 0, "keys": 0, "sources": 0}
    for name, kind in kinds.items():
        left = partitions.read_partitions(spark, paths[name], kind)
        assert sorted(r.exam_id for r in left.collect()) == [1, 3]
        assert stamps(tmp_path / name) == {k: v for k, v in before[name].items() if "exam_id=2/" not in k}


def test_of_two_publishers_of_one_run_one_wins(spark, tmp_path):
    root = str(tmp_path)
    one, two = (spark.createDataFrame([(i, name)], "a int, who string") for i, name in ((1, "one"), (2, "two")))
    calls = []

    def build():
        """The first publisher's second look: the other one publishes the same run in between."""
        calls.append(1)
        if len(calls) == 2:
            publish.publish(lambda: two, spark, root, "r")
        return one

    with pytest.raises(commits.CommitConflict):
        publish.publish(build, spark, root, "r")
    publish.publish(lambda: one, spark, root, "s")
    assert rows(publish.published(spark, root).select("run_id", "who")) == [("r", "two"), ("s", "one")]
    assert rows(publish.committed_runs(spark, root).select("version", "run_id")) == [(0, "r"), (1, "s")]


def test_a_taken_number_sends_the_commit_to_the_next(spark, tmp_path, monkeypatch):
    folder, real, stale = str(tmp_path / "log"), commits.last_version, iter([0])
    assert commits.commit(spark, folder, {"run": "a"}, "run string", "run") == 0
    assert commits.commit(spark, folder, {"run": "b"}, "run string", "run") == 1
    monkeypatch.setattr(commits, "last_version", lambda *a: next(stale, None) if (found := real(*a)) is None else next(stale, found))
    assert commits.commit(spark, folder, {"run": "c"}, "run string", "run") == 2  # saw an old log first
    assert rows(commits.commits(spark, folder, "run string")) == [(0, "a"), (1, "b"), (2, "c")]
    with pytest.raises(commits.CommitConflict):
        commits.commit(spark, folder, {"run": "b"}, "run string", "run")


# ---- image sizes from bytes --------------------------------------------------------


def jpeg(width, height, before=(), marker=0xC0, end=b"\xff\xd9"):
    frame = struct.pack(">BBHBHHB", 0xFF, marker, 11, 8, height, width, 1) + b"\x01\x11\x00"
    scan = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00data"
    return b"\xff\xd8" + b"".join(before) + frame + scan + end


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def test_jpeg_sizes_from_marker_segments(spark, tmp_path):
    thumbnail = segment(0xE1, b"Exif\x00\x00" + jpeg(16, 9))  # its frame header isn't the picture's
    cases = {
        "plain.jpg": (jpeg(640, 480), (640, 480, "ok")),
        "thumbnail.jpg": (jpeg(4000, 3000, [segment(0xE0, b"JFIF\x00"), thumbnail, segment(0xDB, b"\x00" * 65), segment(0xC4, b"\x00" * 30)]), (4000, 3000, "ok")),
        "progressive.jpg": (jpeg(33, 44, [b"\xff\xff\xff", segment(0xFE, b"note")][1:], marker=0xC2), (33, 44, "ok")),
        "filled.jpg": (jpeg(5, 6, [b"\xff\xff"]), (5, 6, "ok")),
        "many.jpg": (jpeg(70, 80, [segment(0xE2, b"x")] * 500), (70, 80, "ok")),
        "cut.jpg": (jpeg(640, 480)[:-6], (640, 480, "error")),
        "headless.jpg": (b"\xff\xd8" + segment(0xE0, b"JFIF\x00") + b"\xff\xda\x00\x02\xff\xd9", (None, None, "error")),
        "short.jpg": (b"\xff\xd8\xff", (None, None, "error")),
    }
    for name, (content, _) in cases.items():
        (tmp_path / name).write_bytes(content)
    listed = files.inventory(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.status) for r in listed.collect()} == {name: want for name, (_, want) in cases.items()}
    assert listed._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1


class Store:
    """A state store of one key that counts the calls."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def getValueState(self, name, schema):
        return Store.Value(self, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1

    deleteTimer = registerTimer

    class Value:
        def __init__(self, store, name):
            self.store, self.name = store, name

        def get(self):
            self.store.calls += 1
            return self.store.kept.get(self.name, () if self.name == "waiting" else None)

        def put(self, value):
            self.store.calls += 1
            self.store.kept[self.name] = value

        update = put

        def appendValue(self, value):
            self.put([*self.store.kept.get(self.name, ()), value])

        def clear(self):
            self.put(())


def test_a_bucket_of_sessions_makes_a_few_trips_to_the_state_store():
    rng = random.Random(6)
    limits = quota.Limits(file_bytes=55, session_bytes=300, files=9, seconds=200)
    uploads = [(rng.randint(1, 400), seq, rng.randint(0, 1_000_000_000), rng.randint(1, 60)) for seq in range(8000)]
    store, got = Store(), []
    own = jobs.Admission(limits)
    own.init(store)
    for first in range(0, 1000, 100):  # every third upload comes one batch late
        came = [x for x in uploads if first <= x[2] / 1e6 + (100 if x[1] % 3 == 0 else 0) < first + 100 or (first == 900 and x[2] / 1e6 >= 900 and x[1] % 3 == 0)]
        mark = SimpleNamespace(getCurrentWatermarkInMs=lambda at=first: (at - 100) * 1000 if at < 900 else 10**7)
        frame = pd.DataFrame(came, columns=["session_id", "seq", "at", "bytes"]).assign(at=lambda x: pd.to_datetime(x["at"], unit="us"))
        got += [own.handleInputRows((3,), iter([frame]), mark), own.handleExpiredTimer((3,), mark, None)]
        got[-2:] = [pd.concat([pd.DataFrame(), *frames]) for frames in got[-2:]]
    done = pd.concat(got)
    want = []
    for session in {x[0] for x in uploads}:
        files, used, own = 0, 0, sorted((x for x in uploads if x[0] == session), key=lambda x: (x[2], x[1]))
        for _, seq, at, size in own:
            decision = quota.decide(own[0][2], files, used, at, size, limits)
            files, used = files + (decision == "accepted"), used + size * (decision == "accepted")
            want.append((session, seq, size, decision))
    assert len({x[3] for x in want}) == 5
    assert sorted(zip(done["session_id"], done["seq"], done["bytes"], done["decision"], strict=True)) == sorted(want)
    assert store.calls < 200  # 400 sessions, ten batches
