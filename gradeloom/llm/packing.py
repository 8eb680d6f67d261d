"""Best-fit packing of token sequences, improved by a swap-based local search.

Documents are tokenized and cut into pieces of at most one sequence. Pieces are
dealt to groups of bounded size by a hash of their place in the written piece
table, so that no source or size class gathers in one task; each group packs
its pieces alone: best fit over pieces by falling length, then local search
among the bins that are not full. A move takes a piece to another bin, swaps
one for one, or swaps two for one; each must raise the sum of squared fills, so
the search ends, full bins leave it and the emptiest bin drains until it is gone.

Defined results: a null text is empty; an empty document is its end token
alone, one piece; repeated rows are documents of their own; a null doc_id is
kept as null. Every piece gets a place in one sequence without gaps.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import held, stored

LENGTH = 4096
END = 1
#: Pieces that one packing task group has on average.
GROUP_PIECES = 8000
#: Words whose ids a worker keeps: those of two generations of this size.
CACHED_WORDS = 400_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _letters(word: str) -> bool:
    """Whether the word stays all letters when it is normalized and lower-cased, without growing."""
    return word.isalpha() and "\u0130" not in word and unicodedata.is_normalized("NFC", word)


class Encoder:
    """Ids of whole texts; each word between ASCII white space is encoded once while it is kept.

    The tokenizer's normalization and pre-tokenization never reach across white
    space, so the ids of a text are those of its words, one after the other.
    Letters with closing ASCII punctuation are two pre-tokens, so the letters
    are kept alone. Words of letters are encoded many at a time, and their ids
    parted where a token ends a word; where that doesn't give one end for each
    word, one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in found]

    def _together(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for first in range(0, len(words), 512):
            own = words[first : first + 512]
            ids = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(own).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(own) or ends[-1] != len(ids):
                out += self._one_by_one(own)
                continue
            raw, at = ids.tobytes(), 0
            for end in (4 * ends).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        young, old = self.young, self.old
        letters, others, parts = set(), set(), []
        for w in words:
            if w in young:
                continue
            if (known := old.get(w)) is not None:
                young[w] = known
                continue
            core = w.rstrip(PUNCTUATION)
            low = core.lower()
            if core and (core.isalpha() or _letters(core.decode("utf-8", "surrogatepass"))):
                letters.add(low)
                if len(low) < len(w):
                    others.add(w[len(core) :])
                if low != w:
                    parts.append((w, low, w[len(core) :]))
            else:
                others.add(w)
        for group, encode in ((letters, self._together), (others, self._one_by_one)):
            wanted = []
            for w in group:
                if w not in young:
                    if (known := old.get(w)) is not None:
                        young[w] = known
                    else:
                        wanted.append(w)
            if wanted:
                young.update(zip(wanted, encode(wanted), strict=True))
        for w, low, tail in parts:
            young[w] = young[low] + young[tail] if tail else young[low]
        return young

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.encode("utf-8", "surrogatepass").split()
        try:
            return b"".join(map(self.young.__getitem__, words))
        except KeyError:
            if len(self.young) > CACHED_WORDS:
                self.old, self.young = self.young, {}
            return b"".join(map(self.learn(set(words)).__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    stop = np.asarray([end], "<u4").tobytes()
    kind = docs.schema["doc_id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("word ids", tokenizer), lambda: Encoder(tokenizer))  # tasks of a worker share its words
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for row, text in enumerate(texts):
                ids = encoder.ids(text or "") + stop
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append(row)
                    numbers.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling size, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        above = rooms >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            at = open_at[room].pop()
            if not open_at[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        room -= size
        if room:
            open_at[room].append(at)
            rooms |= 1 << room
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Exchange items between underfull bins as long as that raises the sum of squared fills.

    The emptiest bin gives first, then the next ones. Steps for an item of the
    giving bin are, in this order: a move into the bin that it fills best; a
    swap with a smaller item of a fuller bin; two items against one smaller
    item. Each carries size to a bin at least as full, which raises the sum, so
    the search ends; after each the emptiest bin has its turn again. It stops
    at the least number of bins that the total allows, or where no bin has a
    step with any other: a bin without one is settled until a bin changes so
    that it could take what the settled one can give.
    """
    least = -(-sum(sizes) // capacity)
    fill = [sum(sizes[i] for i in b) for b in bins]
    items = [sorted((sizes[i], i) for i in b) for b in bins]
    under = sorted((fill[k], k) for k in range(len(bins)) if fill[k] < capacity)
    alive, settled = len(bins), {}
    if alive <= least:
        return [[i for _, i in own] for own in items if own]
    index = _Index(bins, sizes, fill, capacity)
    while alive > least:
        turn = next((k for k, (_, own) in enumerate(under) if own not in settled), None)
        if turn is None:
            break
        _, own = under.pop(turn)
        gives = _gives(items[own])
        step = _step(own, items, gives, fill, under, turn, capacity, index)
        if step is None:
            insort(under, (fill[own], own))
            settled[own] = sum({1 << size for _, size, _ in gives})
            continue
        other = step[0]
        _exchange(items, fill, under, own, *step, capacity)
        if items[own]:
            insort(under, (fill[own], own))
        else:
            alive -= 1
        takes = 0  # bit s: a changed bin may take size s
        for changed in (own, other):
            settled.pop(changed, None)
            index.place(changed, items[changed], fill[changed])
            if items[changed] and fill[changed] < capacity:
                window = (1 << (capacity - fill[changed])) - 1
                for size in {0, *(size for size, _ in items[changed])}:
                    takes |= window << (size + 1)
        for k in [k for k, mask in settled.items() if mask & takes]:
            del settled[k]
    return [[i for _, i in own] for own in items if own]


class _Index:
    """All items by size, with the room of their bins."""

    def __init__(self, bins, sizes, fill, capacity):
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        self.items, self.sizes, self.capacity = order, [sizes[i] for i in order], capacity
        self.at = {i: k for k, i in enumerate(order)}
        self.room = np.zeros(len(order), np.int64)
        self.bin, self.reach = np.zeros_like(self.room), np.zeros_like(self.room)
        for k, own in enumerate(bins):
            self.place(k, [(sizes[i], i) for i in own], fill[k])

    def place(self, own, items, fill):
        at = [self.at[i] for _, i in items]
        self.bin[at] = own
        self.room[at] = self.capacity - fill
        self.reach[at] = self.room[at] + [size for size, _ in items]

    def swap(self, own, size, room):
        """The item, of a bin with at most ``room``, whose exchange for ``size`` fills its bin best, and that bin."""
        low, high = bisect_left(self.sizes, size - room), bisect_left(self.sizes, size)
        if low == high:
            return None
        reach = self.reach[low:high]
        found = np.flatnonzero((reach >= size) & (self.room[low:high] <= room) & (self.bin[low:high] != own))
        if not len(found):
            return None
        k = low + int(found[np.argmin(reach[found])])
        return int(self.bin[k]), (self.sizes[k], self.items[k])


def _gives(own):
    """(largest item, size, items) of what a bin can give in a swap, each size by its first item or pair: larger items first, alone before with another."""
    first, twice = {}, {}
    for size, item in own:
        (twice if size in first else first).setdefault(size, (size, item))
    out, seen = [], set()
    for size in sorted(first, reverse=True):
        pairs = ([first[size], first[x] if x != size else twice[x]] for x in sorted(first) if x < size or (x == size and x in twice))
        for give in ([first[size]], *pairs):
            total = sum(x for x, _ in give)
            if total not in seen or len(give) == 1:
                seen.add(total)
                out.append((first[size], total, give))
    return out


def _step(own, items, gives, fill, under, turn, capacity, index):
    """(other bin, items given, items taken) of the first step that helps; bins from place ``turn`` on are as full as the giving one."""
    for (size, item), total, give in gives:
        if len(give) == 1:
            at = bisect_left(under, (capacity - size + 1,)) - 1
            if at >= turn:
                return under[at][1], [(size, item)], []
        found = index.swap(own, total, capacity - fill[own])
        if found is not None:
            return found[0], give, [found[1]]
    return None


def _exchange(items, fill, under, low, other, give, take, capacity):
    """Move ``give`` from bin low to bin other and ``take`` back; bin low isn't listed as underfull meanwhile."""
    del under[bisect_left(under, (fill[other], other))]
    for source, target, moved in ((low, other, give), (other, low, take)):
        for entry in moved:
            del items[source][bisect_left(items[source], entry)]
            insort(items[target], entry)
            fill[source] -= entry[0]
            fill[target] += entry[0]
    if fill[other] < capacity:
        insort(under, (fill[other], other))


def pack(rows: DataFrame, *, capacity: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``rows`` (any columns, ``length`` at most ``capacity``) with sequence_id and offset.

    The piece table is written first: row numbers are then fixed, and a lost
    executor repeats packing, not tokenizing.
    """
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = [*[f for f in rows.schema.fields if f.name != "_row"]]
    names = [f.name for f in schema]

    def packed(key, own):
        own = own.sort_values("_row", ignore_index=True)
        sizes = own["length"].astype(int).tolist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        order = np.concatenate([np.asarray(b) for b in bins])
        counts = np.asarray([len(b) for b in bins])
        out = own.iloc[order][names].reset_index(drop=True)
        ends = np.cumsum(out["length"].to_numpy())
        starts = ends - out["length"].to_numpy()
        first = np.cumsum(counts) - counts
        out["sequence_id"] = (np.int64(key[0]) << 32) + np.repeat(np.arange(len(bins)), counts)
        out["offset"] = starts - np.repeat(starts[first], counts)
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return dealt.groupBy("_group").applyInPandas(packed, f"{kinds}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer: str, *, length: int = LENGTH, end: int = END, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, length=length, end=end), capacity=length, group_pieces=group_pieces)
