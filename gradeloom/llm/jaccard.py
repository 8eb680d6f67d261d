"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document is the set of its word n-grams; documents with equal sets are one
class. The global order is that of the n-grams' 64-bit hashes, and it is cut
into fragments, so that every set is cut into the same number of pieces.

*Which pairs.* Two sets with a Jaccard of at least t differ in at most
D = (a + b)(1 - t)/(1 + t) elements, and each lies in one fragment. The order is
cut into an eighth more fragments than D, and four, and a set gives a digest of
each fragment that isn't empty. Of m digests m - D at least are those of any set
it links with, which tells most sets apart at once: one with fewer digests that
others have too links with none, however many sets share a passage with it. A
set with m of at most D gives digests of its empty fragments as well, and all
but D are equal where both sets of a pair are like that. The number of fragments depends on the size class
alone; each set is cut for its own class and the one below, the only ones that
hold sets small enough to link with it. Digests are shuffled once. Of those that
several classes have, one of them in its own cut, cuts below their bound are
left out, again until few digests go; linked sets still share their bound, so
they share one of each other's rarest, and the bound less one of the most
frequent (a passage's) are left out too. Cuts that keep a digest are a star
around the first.

*Which links.* Cuts that share digests form clusters (connected components
of a star per digest, so linear in rows). The two cuts of a set are apart, as
every pair meets in the cut of its smaller class: sets that share little would
else form chains over all sizes, longer the more sets there are. Each cluster's sets are sent once; a
cluster larger than one block is split, and pairs of blocks are compared. In a
block every fragment of the order is one inverted list, which gives the partial
overlaps of the pairs that meet in it; the sum over fragments decides. Pairs
whose lengths can't link are out from the start, and after each fragment those
that can't reach their overlap with what both have left. Pairs themselves are
never rows: a block gives what its links connect as stars, at most one row per
document.

Defined results: a null or empty text, or one without words, is the empty set
and links with nothing, its copies included; with fewer words than n, the words
are one n-gram; repeated rows are documents of equal sets; a null id takes the
component's smallest id, which is null only if all are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import components, done_with, free_shuffles, stored

#: Hashes of one block of a cluster, on average.
BLOCK_HASHES = 400_000
#: What a set counts in a block besides its hashes.
SET_COST = 200
#: Fragments that overlaps are counted in.
FRAGMENTS = 16
#: Places that a class with several documents is sent to.
SALT = 16
#: The number of a class from that of a cut.
CLASS = "cut & ~1L"
#: Rounds that leave out digests end when one leaves this share.
GOING = 0.9
_STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Words of more bytes are hashed one by one.
_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], eight bytes at a time with a mixing step between."""
    size = ends - starts
    out = mixed(size.astype(np.uint64) + _U(_BASE))
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    for at in range(0, _WORD, 8):
        own = np.flatnonzero((size > at) & (size <= _WORD))
        if not len(own):
            break
        left = np.minimum(size[own] - at, 8).astype(np.uint64)
        part = eight[starts[own] + at] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
        out[own] = mixed(mixed(out[own] ^ part) + _U(_BASE))
    for own in np.flatnonzero(size > _WORD).tolist():
        out[own] = int.from_bytes(hashlib.blake2b(data[starts[own] : ends[own]].tobytes(), digest_size=8).digest(), "little")
    return out


class Hasher:
    """Sorted distinct n-gram hashes of texts, all words of a step at once."""

    def __init__(self, n: int):
        self.n = n

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        first, size = 0, 0
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for k, own in enumerate(raw):
            size += len(own)
            if size > _STEP or k == len(raw) - 1:
                yield from self._step(raw[first : k + 1])
                first, size = k + 1, 0

    def _step(self, raw: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join(raw).lower() + b" ", np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, space].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        words = word_hashes(data, starts, ends)
        limits = np.cumsum([len(r) + 1 for r in raw])
        counts = np.diff(np.r_[0, np.searchsorted(starts, limits)])
        grams = words.copy()
        for k in range(1, self.n):
            if len(words) > k:
                grams[:-k] = mixed(grams[:-k] + words[k:] * _U(2 * k + 1))
        at = 0
        for count in counts.tolist():
            if count >= self.n:
                yield np.unique(grams[at : at + count - self.n + 1])
            elif count:
                short = np.asarray([count], np.uint64)
                for k in range(at, at + count):
                    short = mixed(short + words[k : k + 1])
                yield short
            else:
                yield np.zeros(0, np.uint64)
            at += count


def size_classes(percent: int) -> list[int]:
    """Least size of each class: sets that can link lie in one class or in neighbours."""
    limits = [1]
    while limits[-1] < 1 << 40:
        limits.append(limits[-1] * 100 // percent + 1)
    return limits


def differences(limits: list[int], percent: int) -> list[int]:
    """By class: how many elements linked sets can differ in at most, the smaller one of that class."""
    return [((top - 1) + (top - 1) * 100 // percent) * (100 - percent) // (100 + percent) for top in limits[1:]]


def fragments_of(differ: int) -> int:
    return differ + differ // 8 + 4


def digests(hashes: np.ndarray, differ: int) -> tuple[np.ndarray, int]:
    """Digests of the fragments of one set that have elements, of empty ones too if there are no more than ``differ``; and how many a linked set shares at least."""
    parts = fragments_of(differ)
    own = (((hashes >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
    starts = np.r_[0, np.flatnonzero(np.diff(own)) + 1]
    numbers, sums = own[starts], np.add.reduceat(mixed(hashes + _U(1)), starts)
    least = max(len(numbers) - differ, 1)
    if len(numbers) <= differ:
        empty = np.setdiff1d(np.arange(parts), numbers)
        numbers, sums = np.r_[numbers, empty], np.r_[sums, np.zeros(len(empty), np.uint64)]
    return mixed(mixed(sums) ^ mixed(numbers.astype(np.uint64) + _U((parts << 32) + 1))), least


def _key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _number(key: bytes) -> int:
    """Number of a class; the lowest bit is free for the cut, 0 for the class's own size and 1 for the one below."""
    return int.from_bytes(key[:8], "little", signed=True) & ~1


class Cutter:
    """What a set gives in each of its cuts."""

    def __init__(self, percent: int):
        self.limits = np.asarray(size_classes(percent))
        self.differ = differences(self.limits.tolist(), percent)

    def cuts(self, hashes: np.ndarray) -> list[tuple[np.ndarray, int]]:
        if not len(hashes):
            return []
        own = int(np.searchsorted(self.limits, len(hashes), "right")) - 1
        return [digests(hashes, self.differ[c]) for c in (own, own - 1) if c >= 0]


def _classed(n: int, percent: int):
    """Rows (doc_id, text, mark) to the class of each: the digest of its set, its number, the set's size, and how many digests its cuts must share at least."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cutter = Hasher(n), Cutter(percent)
        for batch in batches:
            sets = [(_key(h), len(h), [least for _, least in cutter.cuts(h)]) for h in hasher.sets(batch.column(1).to_pylist())]
            columns = [pa.array([k for k, _, _ in sets], pa.binary()), pa.array([_number(k) for k, _, _ in sets], pa.int64()), pa.array([size for _, size, _ in sets], pa.int64()), pa.array([x for _, _, x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "mark", "set_key", "id", "n", "least"])

    return give


def _signer(n: int, percent: int):
    """Rows (text) to (cut, sign), the digests of each set; copies in one task sign once."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, cutter, seen = Hasher(n), Cutter(percent), set()
        for batch in batches:
            cuts, signs = [], []
            for hashes in hasher.sets(batch.column(0).to_pylist()):
                number = _number(_key(hashes))
                if number not in seen:
                    seen.add(number)
                    for below, (found, _) in enumerate(cutter.cuts(hashes)):
                        cuts.append(number + below)
                        signs.append(found)
            flat = np.concatenate(signs).view(np.int64) if signs else np.zeros(0, np.int64)
            every = np.repeat(np.asarray(cuts, np.int64), [len(x) for x in signs])
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(flat)], ["cut", "sign"])

    return sign


def _setter(n: int):
    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n)
        for batch in batches:
            sets = [h.tobytes() for h in hasher.sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("set_key"), pa.array(sets, pa.binary())], ["cluster", "set_key", "hashes"])

    return give


def linked_pairs(sets: list[np.ndarray], left: range, right: range, percent: int, fragments: int = FRAGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of ``left`` and ``right`` that link: partial overlaps by fragment, summed per pair."""
    a, b = (np.asarray([len(sets[i]) for i in side], np.int64) for side in (left, right))
    need = -(-percent * (a[:, None] + b) // (100 + percent))  # the overlap from which 100 * overlap >= percent * union
    alive = np.minimum(a[:, None], b) >= need
    total = np.zeros((len(a), len(b)), np.int64)
    cuts = [int(k * (1 << 64) // fragments) for k in range(fragments)]
    flat, owner = _order(sets, left)
    other, holder = (flat, owner) if left == right else _order(sets, right)
    at, to = (np.r_[np.searchsorted(x, np.asarray(cuts, np.uint64)), len(x)] for x in (flat, other))
    rest_a, rest_b = a.copy(), b.copy()
    for f in range(fragments):
        if not alive.any():
            break
        own, those = slice(at[f], at[f + 1]), slice(to[f], to[f + 1])
        rest_a -= np.bincount(owner[own], minlength=len(a))
        rest_b -= np.bincount(holder[those], minlength=len(b))
        rows = np.flatnonzero(alive.any(axis=1)[owner[own]]) + at[f]
        low = to[f] + np.searchsorted(other[those], flat[rows])
        count = to[f] + np.searchsorted(other[those], flat[rows], "right") - low
        stops = np.cumsum(count)
        for first, last in _pieces(stops):
            sizes = count[first:last]
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low[first:last] - (ends - sizes), sizes)
            total += np.bincount(np.repeat(owner[rows[first:last]], sizes) * len(b) + holder[place], minlength=total.size).reshape(total.shape)
        alive &= total + np.minimum(rest_a[:, None], rest_b) >= need
    i, j = np.nonzero(alive)
    return i + left.start, j + right.start


def _order(sets: list[np.ndarray], side: range) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of some sets in the global order, and whose they are."""
    flat = np.concatenate([sets[i] for i in side]) if len(side) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(side)), [len(sets[i]) for i in side])
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order]


def _pieces(stops: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of a running count that hold about ``most`` each, at least one entry."""
    first = 0
    while first < len(stops):
        last = max(int(np.searchsorted(stops, (stops[first - 1] if first else 0) + most, "right")), first + 1)
        yield first, last
        first = last


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        self.up[max(i, j)] = min(i, j)


def links_of(sets: list[np.ndarray], left: range, right: range, percent: int) -> list[tuple[int, int]]:
    """What the links between two ranges of sets connect (one range twice: within it), as stars around the first set of each part."""
    forest = Forest(len(sets))
    for i, j in zip(*(x.tolist() for x in linked_pairs(sets, left, right, percent)), strict=True):
        forest.join(i, j)
    return [(i, top) for i in range(len(sets)) if (top := forest.top(i)) != i]


def _linker(percent: int):
    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows by (cluster, i, j), blocks of a cluster; one such group is held at a time."""

        def solve(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates("set_key").sort_values(["block", "set_key"], ignore_index=True)
            sets = [np.frombuffer(h, "<u8") for h in rows.hashes]
            cut = int((rows.block == rows.i).sum())
            whole = range(len(sets))
            pair = (whole, whole) if rows.i.iat[0] == rows.j.iat[0] else (range(cut), range(cut, len(sets)))
            edges = links_of(sets, *pair, percent)
            keys = rows.set_key.tolist()
            return pd.DataFrame({"a": [keys[i] for i, _ in edges], "b": [keys[j] for _, j in edges]})

        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            new = (frame[["cluster", "i", "j"]] != frame[["cluster", "i", "j"]].shift()).any(axis=1).to_numpy().nonzero()[0]
            for low, high in zip(new[:-1], new[1:], strict=True):
                if high - low > 1:
                    yield solve(frame.iloc[low:high])
            held = frame.iloc[new[-1] :] if len(new) else None
        if held is not None and len(held) > 1:
            yield solve(held)

    return link


def _shared(given: DataFrame, n: int, percent: int) -> DataFrame:
    """(cut, sign) of the digests that several classes have, stored. All digests are shuffled once, with their cut 16 bytes each."""
    signs = given.select("text").mapInArrow(_signer(n, percent), "cut long, sign long")
    of = Window.partitionBy("sign")
    return stored(signs.withColumns({"low": F.min("cut").over(of), "high": F.max("cut").over(of)}).where("(low & ~1L) < (high & ~1L)").select("cut", "sign").distinct(), "shared")


def _live(shared: DataFrame, least: DataFrame) -> DataFrame:
    """Digests that can be those of a link: several classes have them, one in its own cut, and each cut shares as many as a link takes. Stored."""
    live, before = shared, None
    while True:
        own = Window.partitionBy("sign")
        known = live.withColumns({"low": F.min("cut").over(own), "high": F.max("cut").over(own), "own": F.min(F.col("cut").bitwiseAND(1)).over(own)})
        known = known.where("(low & ~1L) < (high & ~1L) AND own = 0").select("cut", "sign")
        enough = known.groupBy("cut").count().join(least, "cut").where("count >= least").select("cut")
        old, live = live, stored(known.join(enough, "cut", "left_semi"), "live")
        if old is not shared:
            done_with(old)
        rows = live.count()
        if before is not None and rows >= GOING * before:
            return live
        before = rows


def _stars(shared: DataFrame, signed: DataFrame) -> DataFrame:
    """Cuts (a) with the first cut (b) of each digest, stored. What can't be of a link is left out, and of a cut's digests the most frequent, fewer than a link takes."""
    least = signed.select("id", F.posexplode("least").alias("below", "least")).groupBy((F.col("id") + F.col("below")).alias("cut")).agg(F.max("least").alias("least"))
    live = _live(shared, least)
    of = Window.partitionBy("cut")
    rated = live.withColumn("sharers", F.count("*").over(Window.partitionBy("sign")))
    rated = rated.withColumns({"have": F.count("*").over(of), "place": F.row_number().over(of.orderBy("sharers", "sign"))})
    kept = rated.join(least, "cut").where("place <= have - least + 1").select("cut", "sign")
    stars = stored(kept.select(F.col("cut").alias("a"), F.min("cut").over(Window.partitionBy("sign")).alias("b")), "stars")
    done_with(live)
    return stars


def similar_sets(docs: DataFrame, *, n: int = 3, percent: int = 90, text: str = "text", block_hashes: int = BLOCK_HASHES) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, set_key, n; links: a, b between set keys, enough to connect what is linked)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    signed = stored(given.mapInArrow(_classed(n, percent), f"doc_id {kind}, mark long, set_key binary, id long, n long, least array<long>"), "signed")
    shared = _shared(given, n, percent)
    free_shuffles(docs.sparkSession)
    stars = _stars(shared, signed)
    clusters = components(stars, "clusters")
    done_with(shared, stars)
    classes = signed.where("n > 0").groupBy("set_key", "id").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.max("n").alias("n"))
    placed = stored(classes.join(clusters, F.col("id") == F.col("node").bitwiseAND(~1)).select("first.doc_id", "first.mark", "set_key", "n", F.col("component").alias("cluster")), "clustered")
    done_with(clusters)
    free_shuffles(docs.sparkSession)
    # A set weighs its hashes and what a row of the overlaps costs, so that a block of small sets isn't too many.
    sizes = placed.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") + SET_COST) / block_hashes).alias("blocks"))
    # The set of a class is read again from one of its documents. The plan is the same at every size: texts meet their ids by shuffle.
    wanted = placed.select(F.col("doc_id").alias("own"), F.col("mark").alias("own_mark"), "set_key", "cluster").hint("shuffle_hash")
    texts = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark"))).select("text", "cluster", "set_key")
    sets = texts.mapInArrow(_setter(n), "cluster long, set_key binary, hashes binary")
    sets = sets.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    sent = sets.select("cluster", "set_key", "hashes", "block", other.alias("o")).select(
        "cluster", "set_key", "hashes", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")
    )
    links = stored(sent.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInPandas(_linker(percent), "a binary, b binary"), "links")
    done_with(placed)
    free_shuffles(docs.sparkSession)
    return signed.select("doc_id", "set_key", "n"), links


def linked_documents(docs: DataFrame, *, n: int = 3, percent: int = 90, text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Classes are placed, not rows: a class is one row with its smallest id, and
    only classes of several documents or with links are sent back to documents,
    each to ``SALT`` places, so that the copies of one text are split.
    """
    rows, links = similar_sets(docs, n=n, percent=percent, text=text, **options)
    tops = components(links, "linked")
    classes = rows.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.join(tops, F.col("set_key") == F.col("node"), "left").select("set_key", "least", "copies", F.coalesce("component", "set_key").alias("top"), F.col("node").isNotNull().alias("linked"))
    least = classes.where("linked").groupBy("top").agg(F.min("least").alias("lowest"))
    placed = classes.where("linked OR copies > 1").join(least, "top", "left").select("set_key", F.coalesce("lowest", "least").alias("component"))
    sent = placed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(SALT)).cast("int"))
    met = salted.join(sent, ["set_key", "salt"], "left")
    return met.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def first_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; rows of one id stay or go together."""
    gone = linked_documents(docs, **options).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
