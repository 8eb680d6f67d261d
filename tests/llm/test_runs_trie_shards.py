"""Periodic runs, prefix trie and sharding against brute force on small tables."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import periodic, sharding, trie
from gradeloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# -- periodic runs


def slow_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repeated(rng, n, kinds):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 4:
            a = rng.randrange(n)
            p = rng.randrange(1, (n - a) // 2 + 2)
            for i in range(a, rng.randrange(a, n + 1)):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        words = repeated(rng, rng.randrange(rng.choice([15, 60, 250])), rng.choice([1, 2, 3, 5, 60]))
        least = rng.choice([5, 12, 30])
        assert list(map(tuple, periodic.runs(np.asarray(words, np.int64), least).tolist())) == slow_runs(words, least)


def test_products_and_transforms_are_exact():
    edge = [0, 1, 2, (1 << 32) - 1, 1 << 32, 1 << 63, periodic.PRIME - 1]
    for a, b in itertools.product(edge, edge):
        assert int(periodic.times(np.asarray([a], np.uint64), np.asarray([b], np.uint64))[0]) == a * b % periodic.PRIME
    rows = np.random.default_rng(1).integers(0, periodic.PRIME, (3, 64), np.uint64)
    back = periodic.times(periodic.restored(periodic.transformed(rows)), np.uint64(pow(64, -1, periodic.PRIME)))
    assert (back == rows).all()


def test_zeros_in_digits_where_sums_could_pass_the_modulus():
    words = np.asarray([1 << 40, 5, 7, 1 << 40, 5, 7, (1 << 40) + 1, 5, 7, *[(1 << 41)] * 20], np.int64)
    assert len(periodic._digits(words, 1 << 41, 2)) > 1
    at, distance = periodic.zeros(words, 1 << 41, np.asarray([0, 2, 4]), 2, 1, 6)
    assert list(zip(at.tolist(), distance.tolist(), strict=True)) == [(0, 3), (2, 3)]


def test_long_runs_of_one_word_take_little_time():
    words = np.zeros(60_000, np.int64)
    assert periodic.runs(words).tolist() == [[0, 60_000, 1]]


def test_periodic_runs_of_texts(spark):
    song = "la " * 15
    texts = [None, "", " \t\n ", "one two", song, "x " + "a b c d e f g " * 2 + "y", "a b " * 6 + "\x85 " + "a b " * 6, song, "w " * 11]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"runs": F.lit(1), "periodic": F.lit(2), "n_words": F.lit(3)})
    got = {r.doc_id: r for r in periodic.periodic_runs(docs.repartition(3)).collect()}
    assert len(got) == len(texts) and got[0].runs == 1 and got[0].n_words == 3
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        expected = slow_runs(words)
        dropped = {k for s, n, q in expected for k in range(s + q, s + n)}
        assert [tuple(r) for r in got[i].periodic.runs] == expected
        assert got[i].periodic.collapsed == b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()
        assert got[i].periodic.n_words == len(words)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_the_rebuilt_text_repeats(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i * 7 % 90))) for i in range(60)] + [(60, None)]
    got = spark.createDataFrame(rows, DOCS).select("doc_id", periodic.repeating(F.col("text"), F.col("doc_id") * 31).alias("t")).collect()
    for r, (i, text) in zip(got, rows, strict=True):
        words, g = (text or "").split(), i * 31
        if words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        assert r.t == " ".join(words)


# -- prefix trie


def slow_trie(members):
    """members: conv_id to its list of turns (role, text)."""
    nodes = defaultdict(list)
    for conv, turns in members.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(conv)
    rows = set()
    for path, convs in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = [p for p in below if not any(len(o) == len(p) + 1 and o[: len(p)] == p for o in nodes)]
        kids = sum(len(p) == len(path) + 1 for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in convs if len(members[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        rows.add((min(convs), len(path), parent, len(convs), kids, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def told(df):
    got = [tuple(r) for r in df.select(*trie._RESULT).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture
def split(spark):
    """Eight partitions stay eight, so that nodes go across seams."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_brute_force_across_partitions(spark, split, seed):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["", "a", "b", "é€😀", "a|b"]))
    stems = [[turn() for _ in range(rng.randrange(5))] for _ in range(4)]
    members = {}
    for conv in range(90):
        base = stems[0] if seed % 2 and conv < 45 else rng.choice(stems)  # half of all conversations alike
        members[conv] = base[: rng.randrange(len(base) + 1)] + [turn() for _ in range(0 if conv < 45 else rng.randrange(4))]
    rows = [(c, t, role, text) for c, turns in members.items() for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    given = trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    without = spark.createDataFrame([(c,) for c, turns in members.items() if not turns], "conv_id long").select("conv_id", F.lit(b"").alias("key"), F.array().cast("array<long>").alias("chars"))
    assert told(trie.prefix_trie(given.unionByName(without))) == slow_trie(members)


def test_trie_of_one_sequence_many_times(spark, split):
    members = {c: [("user", "hi"), ("assistant", "yes")] for c in range(200)} | {200: [("user", "hi"), ("assistant", "yes"), ("user", "more")]}
    rows = [(c, t, role, text) for c, turns in members.items() for t, (role, text) in enumerate(turns)]
    got = told(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert got == slow_trie(members) and len(got) == 4


def test_trie_of_nulls_and_nothing(spark):
    kind = "conv_id long, turn long, role string, text string, n_convs string"
    rows = [(None, 0, "user", "x", "z"), (1, None, None, None, "z"), (1, 0, "user", "x", "z"), (2, 5, "", "", "z"), (2, 9, "user", "x", "z"), (2, 9, "user", "x", "z")]
    got = told(trie.prefix_trie(trie.sequences(spark.createDataFrame(rows, kind))))
    assert got == slow_trie({1: [("", ""), ("user", "x")], 2: [("", ""), ("user", "x"), ("user", "x")]})
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame([], kind))).count() == 0


def test_rebuilt_conversations(spark):
    rng = random.Random(3)
    own = {c: [("user", f"{c}-{t}") for t in range(rng.randrange(1, 9))] for c in [*range(0, 20), 100, 117, 250, 251, 333]}
    rows = [(c, t, role, text) for c, turns in own.items() for t, (role, text) in enumerate(turns)]
    got = trie.rebuilt(trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    digest = lambda turn: hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[: trie.WIDTH]
    assert len(got) == len(own)
    for r in got:
        h = zlib.crc32(str(r.conv_id).encode()) % 6
        turns = own.get(r.conv_id - r.conv_id % 100, [])[:h] + own[r.conv_id][h:]
        assert bytes(r.key) == b"".join(map(digest, turns)) and r.chars == [len(t[1]) for t in turns]


def test_minima_search_both_ways():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 6, 70)
    table = trie.Minima(values)
    for row in range(70):
        for least in range(7):
            right, left = row, row
            while right + 1 < 70 and values[right + 1] >= least:
                right += 1
            while left > 0 and values[left] >= least:
                left -= 1
            assert table.right(np.asarray([row]), np.asarray([least]))[0] == right
            assert table.left(np.asarray([row]), np.asarray([least]))[0] == left


# -- sharding


@pytest.mark.parametrize("good,bad,drawn", [(5, 7, 6), (30, 20, 10), (1, 1, 1), (3, 0, 2), (100, 1000, 300)])
def test_large_draws_are_hypergeometric(good, bad, drawn):
    rng, tries = np.random.default_rng(5), 20_000
    got = Counter(sharding.large_hypergeometric(rng, good, bad, drawn) for _ in range(tries))
    for k in range(max(0, drawn - bad), min(good, drawn) + 1):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(got[k] / tries - p) < 5 * (p * (1 - p) / tries) ** 0.5 + 5 / tries


def test_matrix_rows_and_columns_are_exact():
    counts = np.asarray([5, 0, 700, 1, 12, 60])
    sizes, owner = sharding.block_sizes(int(counts.sum()), 7, 30)
    matrix = np.asarray([sharding.matrix_row(counts, sizes, k, 9) for k in range(len(counts))])
    assert (matrix.sum(0) == sizes).all() and (matrix.sum(1) == counts).all()
    per_shard = np.bincount(owner, sizes)
    assert sizes.max() <= 30 and per_shard.max() - per_shard.min() <= 1


def test_draws_beyond_the_librarys_limit():
    sizes = np.asarray([10**9, 3 * 10**9, 10**8])
    got = sharding.drawn_apart(np.random.default_rng(1), sizes, 10**9)
    assert got.sum() == 10**9 and (got <= sizes).all() and abs(got[0] / 10**9 - 1 / 4.1) < 1e-3


@pytest.mark.parametrize("n,shards,block", [(0, 4, 8), (3, 7, 8), (500, 7, 16), (1000, 4, 1 << 18)])
def test_shards_are_exact_and_gapless(spark, n, shards, block):
    rows = spark.createDataFrame([(None if i % 50 == 7 else i % 97, None if i % 9 == 0 else f"t{i % 5}") for i in range(n)], DOCS)
    rows = rows.withColumns({"part": F.lit(1), "block": F.lit("b"), "slot": F.lit(-5), "a b": F.lit(2.5)}).repartition(5)
    done = sharding.shuffled(rows, shards, seed=4, block_rows=block)
    assert done.columns == ["shard", "slot", "doc_id", "text", "part", "block", "a b"]
    got = done.collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == n
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in rows.collect())


def test_every_place_is_equally_likely():
    counts, tries, seen = np.asarray([5, 1, 4, 2]), 1200, Counter()
    parts = np.repeat(np.arange(4), counts)
    places = np.concatenate([np.arange(c) for c in counts])
    sizes, owner = sharding.block_sizes(12, 3, 2)
    for seed in range(tries):
        batch = pa.RecordBatch.from_arrays([pa.array(parts), pa.array(places), pa.array(range(12))], ["part", "place", "c0"])
        sent = pa.Table.from_batches(sharding._sender(np.arange(4), counts, sizes, seed)(iter([batch])))
        sent = sent.sort_by([("block", "ascending"), ("part", "ascending"), ("place", "ascending")])
        for placed in sharding._settler(sizes, owner, seed + 1)(iter(sent.to_batches(max_chunksize=5))):
            seen.update(zip(*(placed.column(c).to_pylist() for c in ("c0", "shard", "slot")), strict=True))
    chi = sum((seen[i, s, k] - tries / 12) ** 2 / (tries / 12) for i in range(12) for s in range(3) for k in range(4))
    assert chi < 121 + 5 * (2 * 121) ** 0.5  # 11 * 11 degrees of freedom, five standard deviations


def test_written_shards_read_back_in_order(spark, tmp_path):
    sharding.write_shards(spark.range(100), f"{tmp_path}/shards", 8, block_rows=5)
    got = spark.read.parquet(f"{tmp_path}/shards")
    assert got.count() == 100 and got.select("shard").distinct().count() == 8


def test_sharding_query_keeps_every_document(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op13_sharding"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None)
    assert {Counter(r.shard for r in got)[s] for s in range(40)} == {5}
