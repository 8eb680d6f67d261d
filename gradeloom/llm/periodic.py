"""Periodic runs of words by block convolution.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(``least``, 2q) that no neighbouring word extends keeping period q.

Words become integers, the texts of a step one array with a separator of its
own after each text. At the scale of blocks of B words, B a power of two, every
block at a multiple of B is slid over the words that follow it, at distances
2B - 1 to 4B - 2 (the first scale, B = 2, takes 1 to 6, which no scale below
could hold). The squared differences of block and window are summed for all
distances at once by one product of number theoretic transforms modulo
2^64 - 2^32 + 1; the sums stay below that modulus, so they are exact integers
and a zero is an occurrence of the whole block. A run of period q is at least
max(12, 2q) words long, hence words q apart agree over at least 2B - 1 words in
a row and cover a whole block: every run has a zero at its period's scale.
Neighbouring blocks with a zero at one distance are one seed, and as the next
block on either side has none, each seed grows by less than B words. Equal
stretches found at several distances keep the smallest, their period.

A block can only occur again where each of its pairs of neighbouring words
does, so blocks with a pair that does not return within 4B - 2 words are left
out of the transforms; in prose these are nearly all. A seed inside a run that
is known already, at a multiple of that run's period, grows to that run and is
left out too, so that a long run of a short period costs one extension.

Defined results: a null or empty text has no words, no runs and an empty
collapsed text; repeated rows are texts of their own; other columns are carried
along, and a column that has the result's name is replaced.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Texts of one step have about so many bytes together; one longer text is a step of its own.
STEP_BYTES = 1 << 22
#: Numbers that one transform or one comparison holds at once.
_HELD = 1 << 18

#: The prime 2^64 - 2^32 + 1, and a generator of its multiplicative group.
PRIME = (1 << 64) - (1 << 32) + 1
_GENERATOR = 7
_P, _LOW, _EPS = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a + b of residues: a carry out of 64 bits is worth 2^32 - 1."""
    out = a + b
    out += np.where(out < a, _EPS, np.uint64(0))
    return np.where(out >= _P, out - _P, out)


def _minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + (_P - b))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b of residues, through four products of 32-bit halves; 2^64 is 2^32 - 1 and 2^96 is -1."""
    a1, a0, b1, b0 = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    low, mid, other, high = a0 * b0, a0 * b1, a1 * b0, a1 * b1
    mid = mid + (low >> _HALF)
    other = other + (mid & _LOW)
    high = high + (mid >> _HALF) + (other >> _HALF)
    low = (other << _HALF) | (low & _LOW)
    low = np.where(low >= _P, low - _P, low)
    return _plus(_minus(low, high >> _HALF), (high & _LOW) * _EPS)


_ROOTS: dict[tuple[int, bool], np.ndarray] = {}


def _roots(size: int, inverse: bool) -> np.ndarray:
    """The first half of the powers of a root of unity of order ``size``."""
    if (size, inverse) not in _ROOTS:
        root = pow(_GENERATOR, (PRIME - 1) // size, PRIME)
        root = pow(root, -1, PRIME) if inverse else root
        powers = np.ones(1, np.uint64)
        while len(powers) < size // 2:  # doubling: the next powers are those before times one more
            powers = np.r_[powers, times(powers, np.uint64(pow(root, len(powers), PRIME)))]
        _ROOTS[size, inverse] = powers
    return _ROOTS[size, inverse]


def transformed(rows: np.ndarray) -> np.ndarray:
    """Transform of each row (a power of two long), in the order that halving leaves."""
    count, size = rows.shape
    part = size
    while part > 1:
        view = rows.reshape(count, size // part, 2, part // 2)
        left, right = view[:, :, 0], view[:, :, 1]
        rows = np.stack([_plus(left, right), times(_minus(left, right), _roots(part, False))], axis=2).reshape(count, size)
        part //= 2
    return rows


def restored(rows: np.ndarray) -> np.ndarray:
    """Rows from their transforms, times the length."""
    count, size = rows.shape
    part = 2
    while part <= size:
        view = rows.reshape(count, size // part, 2, part // 2)
        left, right = view[:, :, 0], times(view[:, :, 1], _roots(part, True))
        rows = np.stack([_plus(left, right), _minus(left, right)], axis=2).reshape(count, size)
        part *= 2
    return rows


def _digits(words: np.ndarray, top: int, block: int) -> list[np.ndarray]:
    """The words as one array of numbers, or as several digits of each where a block's squared differences could pass the modulus."""
    parts = 1
    while parts * block * (base := int(np.ceil(top ** (1 / parts))) + 1) ** 2 >= PRIME:
        parts += 1
    return [(words // base**k % base).astype(np.uint64) for k in range(parts)]


def zeros(words: np.ndarray, top: int, starts: np.ndarray, block: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``starts``, distance): where a block occurs again ``first`` to ``last`` words further on.

    ``words`` are numbers from 0 to ``top``; they end with padding that no block holds.
    """
    size = 1 << (block + last - first + block - 2).bit_length()
    wide, distances = block + last - first, np.arange(last - first + 1)
    at, distance = [], []
    digits = _digits(words, top, block)
    squares = [np.r_[np.uint64(0), np.cumsum(d * d)] for d in digits]
    scale = np.uint64(pow(size, -1, PRIME))
    step = max(_HELD // size, 1)
    for low in range(0, len(starts), step):
        own = starts[low : low + step]
        total = np.zeros((len(own), len(distances)), np.uint64)
        for d, sums in zip(digits, squares, strict=True):
            left, right = np.zeros((len(own), size), np.uint64), np.zeros((len(own), size), np.uint64)
            left[:, :block] = d[own[:, None] + np.arange(block - 1, -1, -1)]
            right[:, :wide] = d[own[:, None] + first + np.arange(wide)]
            both = restored(times(transformed(left), transformed(right)))[:, block - 1 : block - 1 + len(distances)]
            both = times(both, scale)
            follow = own[:, None] + first + distances
            squared = (sums[own + block] - sums[own])[:, None] + sums[follow + block] - sums[follow]
            total += squared - both - both  # an exact integer below the modulus
        i, k = np.nonzero(total == 0)
        at.append(i + low)
        distance.append(k + first)
    return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *distance])


def _grown(words: np.ndarray, at: np.ndarray, distance: np.ndarray, way: int) -> np.ndarray:
    """How many words in a row, from ``at`` on in direction ``way``, equal those ``distance`` further; looks at 4, 8, 16... at a time."""
    grown, open_, look = np.zeros(len(at), np.int64), np.arange(len(at)), 4
    while len(open_):
        left = []
        for part in np.array_split(open_, max(len(open_) * look // _HELD, 1)):
            place = at[part, None] + way * (grown[part, None] + np.arange(look))
            inside = (place >= 0) & (place + distance[part, None] < len(words))
            place = np.where(inside, place, 0)
            same = inside & (words[place] == words[np.where(inside, place + distance[part, None], 0)])
            count = np.where(same.all(axis=1), look, same.argmin(axis=1))
            grown[part] += count
            left.append(part[count == look])
        open_, look = np.concatenate(left), look * 2
    return grown


def _inside(known: np.ndarray, begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the known run that reaches furthest, of those that start no later, holds a stretch and has a period that divides its distance."""
    if not len(known) or not len(begin):
        return np.zeros(len(begin), bool)
    known = known[np.lexsort((-known[:, 2], known[:, 0] + known[:, 1], known[:, 0]))]
    reach = np.maximum.accumulate(known[:, 0] + known[:, 1])
    furthest = np.maximum.accumulate(np.where(known[:, 0] + known[:, 1] == reach, np.arange(len(known)), 0))
    place = np.searchsorted(known[:, 0], begin, "right") - 1
    run = known[furthest[place]]
    return (place >= 0) & (run[:, 0] <= begin) & (run[:, 0] + run[:, 1] >= end) & (q % run[:, 2] == 0)


def runs(words: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs (start, length, period) of an array of numbers from 0 on, by start and period.

    A number that occurs once is a separator: no run crosses it.
    """
    if least < 5:
        raise ValueError("runs of fewer than five words may not cover a block of two")
    n = len(words)
    found = [np.zeros((0, 3), np.int64)]
    if n < least:
        return found[0]
    top = int(words.max()) + 1
    pairs = words[:-1] * top + words[1:]
    order = np.argsort(pairs, kind="stable")
    again = np.full(n, 4 * n)  # distance to the next occurrence of a word and its neighbour
    same = pairs[order[1:]] == pairs[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    block, first = 2, 1
    far = again[: n // 2 * 2 : 2]
    padded = words
    while len(far) and 2 * first <= n:
        last = 4 * block - 2
        starts = np.flatnonzero(far <= last) * block
        if len(starts):
            need = n + last + block
            if len(padded) < need:
                padded = np.r_[words, np.full(need - n, top)]
            i, distance = zeros(padded, top, starts, block, first, last)
            at = starts[i]
            order = np.lexsort((at, distance))
            at, distance = at[order], distance[order]
            new = np.r_[True, (np.diff(distance) != 0) | (np.diff(at) != block)][: len(at)]
            low = np.flatnonzero(new)
            begin, end, q = at[low], at[np.r_[low[1:], len(at)] - 1] + block if len(at) else at, distance[low]
            fresh = ~_inside(np.concatenate(found), begin, end + q, q)
            begin, end, q = begin[fresh], end[fresh], q[fresh]
            begin = begin - _grown(words, begin - 1, q, -1)
            end = end + _grown(words, end, q, 1)
            long = end - begin + q >= np.maximum(least, 2 * q)
            found.append(np.stack([begin, end - begin + q, q], axis=1)[long])
        first = 4 * block - 1
        far = far[: len(far) // 2 * 2].reshape(-1, 2).max(axis=1)
        block *= 2
    out = np.concatenate(found)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    fresh = np.r_[True, (np.diff(out[:, 0]) != 0) | (np.diff(out[:, 1]) != 0)][: len(out)]  # the smallest period of a stretch
    out = out[fresh]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def of_texts(texts: list[str | None], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(number of words, runs, collapsed text) of each text; texts go through the convolution in steps of bounded size."""
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        held.append(raw.split())  # the white space of bytes is the contract's
        size += len(raw)
        if size >= STEP_BYTES:
            yield from _step(held, least)
            held, size = [], 0
    yield from _step(held, least)


def _step(texts: list[list[bytes]], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    sizes = [len(t) for t in texts]
    ends = np.cumsum(np.asarray(sizes, np.int64) + 1)
    flat = list(itertools.chain.from_iterable((*t, b"") for t in texts))
    numbers = {word: number for number, word in enumerate(dict.fromkeys(flat))}
    words = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    words[ends - 1] = len(numbers) + np.arange(len(ends))  # no word is empty: these places are the separators
    found = runs(words, least)
    cuts = np.searchsorted(found[:, 0], np.r_[0, ends])
    for k, own in enumerate(texts):
        part = found[cuts[k] : cuts[k + 1]] - [ends[k] - sizes[k] - 1, 0, 0]
        kept = own
        if len(part):
            open_ = np.zeros(len(own) + 1, np.int64)
            np.add.at(open_, part[:, 0] + part[:, 2], 1)
            np.add.at(open_, part[:, 0] + part[:, 1], -1)
            kept = [own[i] for i in np.flatnonzero(np.cumsum(open_[:-1]) == 0).tolist()]
        yield len(own), list(map(tuple, part.tolist())), b" ".join(kept).decode("utf-8", "surrogatepass")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, *, text: str = "text", name: str = "periodic", least: int = LEAST) -> DataFrame:
    """``docs`` with a struct ``name`` per row: n_words, runs (start, length, period; by start, then period), and collapsed.

    The collapsed text has the words that no run contains after its first
    period, joined by one space.
    """

    @F.arrow_udf("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = list(of_texts(batch.to_pylist(), least))
            fields = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), run, strict=True)) for run in r[1]] for r in rows], pa.list_(_RUN)),
                pa.array([r[2] for r in rows], pa.string()),
            ]
            yield pa.StructArray.from_arrays(fields, ["n_words", "runs", "collapsed"])

    return docs.withColumn(name, scanned(F.col(text)))


def longest(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("slow"))))


def repeating(text: Column, seed: Column) -> Column:
    """The words of a text, of which those from word g % n on repeat with period 1 + (n - g % n) // (3 + g % 8), joined by one space; g is ``seed``."""
    # A pattern's \\s is the contract's white space: space and U+0009 to U+000D.
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    start = F.pmod(seed, F.greatest(n, F.lit(1))).cast("int")
    period = (F.lit(1) + F.floor((n - start) / (F.lit(3) + seed % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    return F.concat_ws(" ", F.slice(words, F.lit(1), start), F.slice(tail, F.lit(1), n - start))
