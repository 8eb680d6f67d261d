"""Exact substring dedup with a logarithmic family of sparse suffix arrays.

*Sampled suffixes.* Every string of ``LENGTH`` bytes picks one of its places by
content alone: the start of its k-gram with the least hash. Equal strings pick
equal places, so only suffixes at picked places (about one in 185 bytes) can
begin a long match, and those are indexed: by the hash of the k-gram they start
with, then by the digest of the segment, that is all bytes of the strings that
picked the place.

*Family.* Texts come in batches. A batch's suffixes are sorted into an array
(one row for equal suffixes, with their number), merge-scanned against every
level for equal heads, and become a level; two levels of equal rank merge into
one of the next rank, so n batches leave about log2(n) levels and each suffix is
rewritten as often. Levels are tables in the shared folder.

*Matches.* A place whose segment occurs twice repeats wholly. A place whose
head occurs elsewhere with other segments repeats in part: those segments alone
are cut from the texts and brought together by head, where a suffix array by
prefix doubling gives every place its rank among strings of ``LENGTH`` bytes, and
equal ranks repeat. A head with more segments than ``HOT_SEGMENTS`` isn't brought
to one task: its strings are counted by digest across tasks instead.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose
nothing; repeated rows are texts of their own, so each is elsewhere for the
other; matches never cross rows. Bytes are those of UTF-8; what is kept may
split a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import stored

LENGTH = 400
HEAD = 32
BATCHES = 4
HOT_SEGMENTS = 20_000
#: Bytes of a text that are sampled in one step, and bytes of segments that are ranked at once (heads are never parted).
STEP = 1 << 23
RANKED = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Sampler:
    """Picked places of texts: (head hash, segment digest, first and last start of the strings that picked it)."""

    def __init__(self, length: int = LENGTH, head: int = HEAD, step: int = STEP):
        self.length, self.head, self.step = length, min(head, length), step
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, size: int) -> None:
        if len(self.up) < size:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                own = np.full(size, base, np.uint64)
                own[0] = 1
                setattr(self, name, np.multiply.accumulate(own))

    def places(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for first in range(0, max(0, len(raw) - self.length + 1), self.step):
            own = self._step(np.frombuffer(raw, np.uint8)[first : first + self.step + self.length - 1])
            yield own[0], own[1], own[2] + first, own[3] + first

    def _step(self, data: np.ndarray):
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * self.up[:n], out=sums[1:])
        heads = _mixed((sums[self.head :] - sums[: n - self.head + 1]) * self.down[: n - self.head + 1])
        keys = (heads & ~_PLACE) | np.arange(len(heads), dtype=np.uint64)
        width, least = self.length - self.head + 1, keys
        have = 1
        while have < width:  # minimum over windows, doubled until it covers the width
            more = min(have, width - have)
            least = np.minimum(least[: len(least) - more], least[more:])
            have += more
        picked = (least & _PLACE).astype(np.int64)
        low = np.r_[0, np.flatnonzero(np.diff(picked)) + 1]
        high = np.r_[low[1:], len(picked)] - 1
        at, end = picked[low], high + self.length
        digest = _mixed((sums[end] - sums[low]) * self.down[low] ^ _mixed(((at - low) << 32 | (end - low)).astype(np.uint64)))
        return heads[at].view(np.int64), digest.view(np.int64), low, high


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


_PLACES = "text_key binary, batch int, head long, segment long, low long, high long, n long"


def _placer(length: int, head: int, batches: int):
    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length, head)
        for frame in frames:
            copies: dict[bytes, list] = {}
            for key, text in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                copies.setdefault(key, [0, text])[0] += 1
            found, sizes, keys = [], [], list(copies)
            for _, text in copies.values():
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass") if text.is_valid else b""
                steps = list(sampler.places(raw))
                found += steps
                sizes.append(sum(len(s[0]) for s in steps))
            columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(4)]
            owner = np.repeat(np.arange(len(keys)), sizes)
            batch = np.asarray([key[0] % batches for key in keys], np.int32)
            times = np.asarray([c[0] for c in copies.values()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()).take(pa.array(owner)), pa.array(batch[owner]), *map(pa.array, columns), pa.array(times[owner])],
                ["text_key", "batch", "head", "segment", "low", "high", "n"],
            )

    return place


class Family:
    """Levels of sorted suffix rows (head, segment, n); a level of rank r holds 2**r batches."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    @staticmethod
    def _array(rows: DataFrame, name: str) -> DataFrame:
        """Suffixes in order within hash ranges of their heads, equal ones as one row."""
        return stored(rows.groupBy("head", "segment").agg(F.sum("n").alias("n")).repartition("head").sortWithinPartitions("head", "segment"), name)

    def add(self, batch: DataFrame) -> None:
        """Scan a batch of (head, segment, n) against itself and all levels, then take it in."""
        array, rank = self._array(batch, "suffixes"), 0
        self.found.append(array.groupBy("head").agg(F.sum("n").alias("n")).where("n > 1").select("head"))
        for _, level in self.levels:
            self.found.append(array.select("head").join(level.select("head"), "head", "left_semi").distinct())
        while self.levels and self.levels[-1][0] == rank:
            array, rank = self._array(array.unionAll(self.levels.pop()[1]), "suffixes"), rank + 1
        self.levels.append((rank, array))

    def repeated(self) -> DataFrame:
        """(head, segment, n, segments, single): suffixes whose head was found twice, how many segments it has, and how many of them occur once."""
        heads = reduce(DataFrame.unionAll, self.found).distinct()
        rows = reduce(DataFrame.unionAll, [level for _, level in self.levels]).groupBy("head", "segment").agg(F.sum("n").alias("n"))
        rows = stored(rows.join(heads, "head", "left_semi"), "repeated")
        sizes = rows.groupBy("head").agg(F.count("*").alias("segments"), F.count_if(F.col("n") == 1).alias("single"))
        return rows.join(sizes, "head")


_BITS = _U(21)


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Rank of each key, equal keys alike. Keys of fewer than 2**21 places and 43 bits are sorted in one word with their place."""
    if len(keys) > 1 << 21:
        return np.unique(keys, return_inverse=True)[1].astype(np.uint64)
    packed = (keys << _BITS) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    at, keys = (packed & _U((1 << 21) - 1)).astype(np.int64), packed >> _BITS
    rank = np.zeros(len(keys), np.uint64)
    rank[at[1:]] = np.cumsum(keys[1:] != keys[:-1])
    return rank


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the string of ``length`` bytes at each place, by prefix doubling; strings that run over the end have no meaning."""
    have, keys = min(5, length), np.zeros(len(data), np.uint64)
    for k in range(have):
        keys[: len(data) - k] = (keys[: len(data) - k] << _U(8)) | data[k:]
        keys[len(data) - k :] <<= _U(8)
    rank = _ranked(keys)
    width = _BITS if len(data) <= 1 << 21 else _U(32)
    while have < length:
        more = min(have, length - have)
        rank = _ranked((rank << width) | np.r_[rank[more:], np.zeros(min(more, len(rank)), np.uint64)])
        have += more
    return rank


def repeated_runs(segments: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(segment, start, end): maximal runs of bytes covered by strings that start at two places of the segments."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.asarray([len(s) for s in segments])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    stops = np.cumsum(counts)
    at = np.arange(stops[-1]) + np.repeat(starts - (stops - counts), counts)
    rank = ranks(data, length)[at].astype(np.int64)
    hit = at[np.bincount(rank)[rank] > 1]
    if not len(hit):
        return []
    owner = np.searchsorted(starts, hit, "right") - 1
    first = np.r_[True, (np.diff(hit) > 1) | (np.diff(owner) > 0)]
    last = np.r_[first[1:], True]
    own = owner[first]
    return list(zip(own.tolist(), (hit[first] - starts[own]).tolist(), (hit[last] - starts[own] + length).tolist(), strict=True))


def _cutter(length: int):
    def cut(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of texts at the wanted places; the first of a text's copies in a run of rows gives them."""
        previous = None
        for frame in frames:
            heads, keys, lows, hots, parts = [], [], [], [], []
            for i, (key, wanted) in enumerate(zip(frame.column("text_key").to_pylist(), frame.column("wanted"), strict=True)):
                if key == previous or not wanted.is_valid:
                    continue
                previous = key
                raw = frame.column("text")[i].as_py().encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    heads.append(w["head"])
                    keys.append(key)
                    lows.append(w["low"])
                    hots.append(w["hot"])
                    parts.append(raw[w["low"] : w["high"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(keys, pa.binary()), pa.array(lows, pa.int64()), pa.array(hots, pa.bool_()), pa.array(parts, pa.binary())], ["head", "text_key", "low", "hot", "bytes"])

    return cut


_RUNS = "text_key binary, start long, stop long"


def _ranker(length: int, ranked: int):
    def rank(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by head; whole heads are ranked together until their bytes fill a step. Copies of a place count once."""
        places: dict[tuple[bytes, int], bytes] = {}
        size, head = 0, None

        def solve():
            runs = repeated_runs(list(places.values()), length) if len(places) > 1 else []
            own = list(places)
            return pa.RecordBatch.from_arrays(
                [pa.array([own[k][0] for k, _, _ in runs], pa.binary()), pa.array([own[k][1] + s for k, s, _ in runs], pa.int64()), pa.array([own[k][1] + e for k, _, e in runs], pa.int64())],
                ["text_key", "start", "stop"],
            )

        for frame in frames:
            for own, key, low, part in zip(*(frame.column(c).to_pylist() for c in ("head", "text_key", "low", "bytes")), strict=True):
                if own != head and size > ranked:
                    yield solve()
                    places, size = {}, 0
                head = own
                if (key, low) not in places:
                    places[key, low] = part
                    size += len(part)
        yield solve()

    return rank


def _digester(length: int):
    def digest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digest of every string of hot segments."""
        for frame in frames:
            for key, low, part in zip(*(frame.column(c).to_pylist() for c in ("text_key", "low", "bytes")), strict=True):
                n = len(part) - length + 1
                hashes = [hashlib.blake2b(part[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(np.arange(low, low + n)), pa.array(hashes, pa.binary())], ["text_key", "start", "digest"])

    return digest


def _remover():
    def remove(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            counts, spans, kept = [], [], []
            for text, runs in zip(frame.column("text").to_pylist(), frame.column("runs").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for run in sorted((r["start"], r["stop"]) for r in runs or ()):
                    if merged and run[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], run[1])
                    else:
                        merged.append(list(run))
                edges = [0, *(x for run in merged for x in run), len(raw)]
                kept.append(b"".join(raw[low:high] for low, high in zip(edges[::2], edges[1::2], strict=True)))
                counts.append(len(raw))
                spans.append([x for run in merged for x in run])
            removed = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
            )

    return remove


def dedup_substrings(
    docs: DataFrame, *, text: str = "text", length: int = LENGTH, head: int = HEAD, batches: int = BATCHES, hot_segments: int = HOT_SEGMENTS, ranked: int = RANKED
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (start, end of removed runs, in turn), kept (bytes)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col(text).alias("text"), _text_key(F.col(text)).alias("text_key"))
    places = stored(texts.select("text_key", "text").mapInArrow(_placer(length, head, batches), _PLACES), "places")
    family = Family()
    for batch in range(batches):
        family.add(places.where(F.col("batch") == batch).select("head", "segment", "n"))
    repeated = family.repeated().withColumnsRenamed({"head": "_head", "segment": "_segment", "n": "_n"})
    same = (F.col("head") == F.col("_head")) & (F.col("segment") == F.col("_segment"))
    hits = stored(places.join(repeated, same).select("text_key", "head", "segment", "low", "high", "_n", "segments", "single"), "hits")
    whole = hits.where("_n > 1").select("text_key", F.col("low").alias("start"), (F.col("high") + length).alias("stop"))
    # Segments that occur once, and one of each that occurs more often beside them.
    partly = hits.where("_n > 1 AND single > 0").groupBy("head", "segment").agg(F.min(F.struct("text_key", "low", "high")).alias("p"), F.max("segments").alias("segments")).select("p.text_key", "head", "p.low", "p.high", "segments")
    partly = hits.where("_n = 1 AND segments > 1").select("text_key", "head", "low", "high", "segments").unionAll(partly)
    wanted = partly.groupBy("text_key").agg(F.collect_set(F.struct("head", "low", "high", (F.col("segments") > hot_segments).alias("hot"))).alias("wanted"))
    key = F.col("text_key") == F.col("_key")
    # Both joins need the same exchange of the texts, so both carry the same columns.
    asked = texts.join(wanted.withColumnRenamed("text_key", "_key").hint("shuffle_hash"), key, "left").select("doc_id", "text", "text_key", "wanted")
    cut = asked.mapInArrow(_cutter(length), "head long, text_key binary, low long, hot boolean, bytes binary")
    hot = hits.where((F.col("_n") == 1) & (F.col("segments") > hot_segments)).limit(1).count() > 0
    heads = stored(cut, "segments") if hot else cut
    local = heads.where("NOT hot").repartition("head").sortWithinPartitions("head").mapInArrow(_ranker(length, ranked), _RUNS)
    found = whole.unionAll(local)
    if hot:
        strings = stored(heads.where("hot").dropDuplicates(["text_key", "low"]).mapInArrow(_digester(length), "text_key binary, start long, digest binary"), "hot-strings")
        twice = strings.groupBy("digest").count().where("count > 1").select("digest")
        found = found.unionAll(strings.join(twice, "digest", "left_semi").select("text_key", "start", (F.col("start") + length).alias("stop")))
    runs = found.groupBy("text_key").agg(F.collect_set(F.struct("start", "stop")).alias("runs")).withColumnRenamed("text_key", "_key")
    final = texts.join(runs.hint("shuffle_hash"), key, "left").select("doc_id", "text", "text_key", "runs")
    return final.mapInArrow(_remover(), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")
