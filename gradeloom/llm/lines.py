"""Line dedup through a sharded minimal perfect hash.

Distinct line keys are counted by 128-bit hash, dealt to shards of bounded size
by that hash, and each shard becomes one row: the bit levels of a minimal
perfect hash and, at the place it gives to each key, a compact fingerprint and
the number of documents. Documents' line hashes go to the shard that holds them
and probe its arrays; no line rows are joined. What comes back per text is the
short list of hashes to drop.

Very common lines would all probe one shard. Those in more documents than one
in ``HEAVY_PARTS`` of all line occurrences are at most ``HEAVY_PARTS`` lines
whatever the input, so they are sent to all tasks and answered on the spot.

A line's key is the line without white space at its ends, A-Z lower-cased.
Defined results: a null or empty text is one empty line, which has no key and
stays; repeated rows are documents of their own and count each; a text of
which all lines go becomes empty. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import SPACES, lowered, stored

MIN_DOCUMENTS = 10
#: Keys of one shard on average, and bits of a level for each key that reaches it.
SHARD_KEYS = 1 << 15
SPARSE = 2.0
HEAVY_PARTS = 4096
_ODD = 0x9E3779B97F4A7C15
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def line_keys(text: Column) -> Column:
    """Distinct keys of a text's lines."""
    return F.array_distinct(F.transform(F.split(lowered(F.coalesce(text, F.lit(""))), "\n"), lambda x: F.btrim(x, F.lit(SPACES))))


def hashed_lines(texts: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` and the 128-bit hash (h1, h2) of each distinct non-empty key of column text."""
    lines = texts.select(*columns, F.explode(line_keys(F.col("text"))).alias("_line")).where("_line <> ''")
    names = [c for c in lines.columns if c != "_line"]
    return lines.select(*names, F.xxhash64("_line").alias("h1"), F.xxhash64(F.concat(F.lit("\x01"), "_line")).alias("h2"))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key in a level, from both halves of its hash."""
    x = h1 ^ (h2 * np.uint64((2 * level + 1) * _ODD % (1 << 64)))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key is at the first level where it was alone at its place; its number is the rank of that bit."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels, sizes = [], []
        while len(h1):
            size = max(64, int(SPARSE * len(h1)))
            at = _places(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            sizes.append(size)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(np.concatenate(levels) if levels else np.zeros(0, bool), sizes)

    def numbers(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """0 .. n-1 for the keys it was built of, each once; for others any number, or -1."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + _places(h1[left], h2[left], level, size)
            found = self.bits[at]
            out[left[found]] = self.rank[at[found]]
            left = left[~found]
            if not len(left):
                break
        return out


def _fingerprints(h2: np.ndarray) -> np.ndarray:
    return (h2 >> np.uint64(48)).astype("<u2")


_INDEX = "shard long, sizes array<long>, bits binary, fingerprints binary, counts binary"


def _shard(key, rows):
    h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    counts = rows.column("n").to_numpy()
    order = np.lexsort((h2, h1))
    h1, h2, counts = h1[order], h2[order], counts[order]
    mph = PerfectHash.build(h1, h2)
    at = mph.numbers(h1, h2)
    fingerprints, numbers = np.empty(len(h1), "<u2"), np.empty(len(h1), "<u4" if counts.max() < 1 << 32 else "<u8")
    fingerprints[at], numbers[at] = _fingerprints(h2), counts
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int64()), "sizes": pa.array([mph.sizes], pa.list_(pa.int64())), "bits": [np.packbits(mph.bits).tobytes()],
        "fingerprints": [fingerprints.tobytes()], "counts": [numbers.tobytes()],
    })


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row per shard from distinct (h1, h2, n)."""
    dealt = counts.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2", "n")
    return dealt.groupBy("shard").applyInArrow(_shard, _INDEX)


class Shard:
    """The arrays of one index row, ready to be probed."""

    def __init__(self, sizes, bits: bytes, fingerprints: bytes, counts: bytes):
        total = int(sum(sizes))
        self.hash = PerfectHash(np.unpackbits(np.frombuffer(bits, np.uint8), count=total).astype(bool), list(sizes))
        self.fingerprints = np.frombuffer(fingerprints, "<u2")
        self.counts = np.frombuffer(counts, f"<u{len(counts) // max(1, len(self.fingerprints))}")

    def documents(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 where the fingerprint differs."""
        at = self.hash.numbers(h1, h2)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == _fingerprints(h2[known])
        out = np.zeros(len(h1), np.int64)
        out[known] = self.counts[at[known]]
        return out


def _prober(least: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard: its arrays first, then the hashes that probe them, streamed."""
        number, shard = None, None
        for batch in batches:
            kinds, shards = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            h1, h2 = (pc.fill_null(batch.column(c), 0).to_numpy().view(np.uint64) for c in ("h1", "h2"))  # null in index rows
            hit = kinds == 2
            edges = np.r_[0, np.flatnonzero((np.diff(shards) != 0) | (kinds[1:] == 0)) + 1, len(kinds)]
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if low < high and kinds[low] == 0:
                    number = shards[low]
                    row = {c: batch.column(c)[low].as_py() for c in ("sizes", "bits", "fingerprints", "counts")}
                    shard = Shard(**row)
                own = np.arange(low, high)[kinds[low:high] == 1]
                if len(own):
                    if shards[low] != number:
                        raise ValueError(f"no index rows of shard {shards[low]}")
                    hit[own] = shard.documents(h1[own], h2[own]) >= least
            chosen = pa.array(np.flatnonzero(hit))
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(chosen), batch.column("h1").take(chosen)], ["text_key", "h1"])

    return probe


def frequent_lines(docs: DataFrame, *, text: str = "text", min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(text_key, drop): for texts with lines in at least ``min_documents`` documents, the first hash half of those lines."""
    texts = docs.select(F.col(text).alias("text"))
    counts = stored(hashed_lines(texts).groupBy("h1", "h2").agg(F.count("*").alias("n")), "line-counts")
    total = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines")).first()
    shards = max(1, -(-total.keys // shard_keys))
    index = stored(build_index(counts, shards), "line-index")
    heavy = counts.where(F.col("n") > max(min_documents - 1, total.lines // HEAVY_PARTS)).select(F.col("h1").alias("x1"), F.col("h2").alias("x2"))
    probes = hashed_lines(texts, _text_key(F.col("text")).alias("text_key"))
    if min_documents <= total.lines:
        probes = probes.join(F.broadcast(heavy), (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left").withColumn("_heavy", F.col("x1").isNotNull())
    else:
        probes = probes.withColumn("_heavy", F.lit(False))
    probes = probes.select(
        F.when(F.col("_heavy"), F.pmod(F.xxhash64("text_key"), F.lit(shards))).otherwise(F.pmod("h1", F.lit(shards))).alias("shard"),
        F.when(F.col("_heavy"), 2).otherwise(1).alias("kind"), "text_key", "h1", "h2",
    )
    both = probes.unionByName(index.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sent = both.repartition("shard").sortWithinPartitions("shard", "kind")
    hits = sent.mapInArrow(_prober(min_documents), "text_key binary, h1 long")
    return hits.groupBy("text_key").agg(F.collect_set("h1").alias("drop"))


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _key_hash(line: str) -> int:
    value = xxhash.xxh64_intdigest(line.strip(SPACES).translate(_LOWER).encode("utf-8", "surrogatepass"), 42)
    return value - (1 << 64) if value >> 63 else value


def _cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, drops in batches:
        rows = []
        for text, drop in zip(texts, drops, strict=True):
            text = text or ""
            if drop is None:
                rows.append((text.count("\n") + 1, 0, text))
                continue
            gone = set(drop.tolist())
            lines = text.split("\n")
            kept = [line for line in lines if not line.strip(SPACES) or _key_hash(line) not in gone]
            rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, *, text: str = "text", min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS, name: str = "lines") -> DataFrame:
    """``docs`` with a struct ``name`` (in place of a column so named): n_lines, n_dropped and the kept text.

    The text crosses the network once, by its own hash. The other side is a
    short list for each text that loses lines; it is a table of its own, so
    that Spark may split the partition of a text with many copies.
    """
    drops = stored(frequent_lines(docs, text=text, min_documents=min_documents, shard_keys=shard_keys), "dropped-lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _text_key(F.col(text)).alias("_key"))
    joined = rows.join(drops.hint("shuffle_hash"), F.col("_key") == F.col("text_key"), "left")
    cleaned = F.pandas_udf(_cleaned, "n_lines long, n_dropped long, kept string")
    done = joined.select("_row", cleaned(F.col("_row")[text], F.col("drop")).alias("_done"))
    return done.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != name], F.col("_done").alias(name))
