"""SentencePiece encoding and decoding with N best segmentations.

A text is normalized as the model file says (spaces become U+2581, one in
front), and segmented over the lattice of its pieces, whose scores add up.
Forward Viterbi gives each position the best score of what lies before it; a
backward A* search from the end takes those scores as its heuristic. They are
exact, so complete segmentations leave the queue in falling order of score. The
forward pass keeps the runner-up's score too, which tells what a word's
second-best loses before any search.

The model file is a BPE model: its scores are merge ranks, which say nothing
when summed. A piece's score here is its log probability, from how often the
library itself uses the piece over all documents (``log_probabilities``). What
the library gives is returned beside the N best, with its own score.

No piece of the vocabulary crosses from a letter to U+2581 or holds a line
break, so the lattice of a text is a chain of independent word lattices (and a
word's is one of two where no piece holds its last letter and the punctuation
after it). Each distinct word is solved once while a worker keeps it, all new
words of a step together; the N best of a text combine those of its words. Only
the words whose second-best costs least can differ from their best there (N - 1
of them at most, ties by place), so the same A* search runs over these alone.
A step's words are found and numbered as arrays, and its texts' ids gathered by
number from those of all words, so no word of a text is looked at one by one.

A character that no piece covers is written as its UTF-8 bytes' pieces, each
with the score ``BYTE_SCORE``, below that of any piece.

Defined results: a null or empty text has no pieces and one segmentation, of
score 0; repeated rows give one row each; decoding an encoding gives the
normalized text back, with its spaces. Fewer than N segmentations are returned
where there are no more; of equal scores the one found first comes first.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import held, stored

BEST = 4
SPACE = "▁"
BYTE_SCORE = -1000.0
#: Scores are multiples of 1 / SCALE: sums over a text are exact.
SCALE = 1 << 20
#: Words that a worker keeps, characters of texts that are looked at together, and the longest word that is solved together with others.
CACHED_WORDS = 800_000
STEP_CHARS = 1 << 22
TOGETHER = 48
#: Slots of the trie that are looked at together for a node's children.
FITTED = 1 << 8
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLOSING = PUNCTUATION.encode()
#: (score, ids) of each segmentation.
Segmentations = list[tuple[float, tuple[int, ...]]]


def _key(text: str) -> bytes:
    """A word as it is kept: UTF-8, with plain spaces."""
    return text.replace(SPACE, " ").encode("utf-8", "surrogatepass")


def _shown(key: bytes) -> str:
    return key.decode("utf-8", "surrogatepass").replace(" ", SPACE)


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of normalized texts; for each word in turn its place among them; and how many words each text has.

    Words are runs of spaces with what follows them up to the next space or
    line break, and line breaks. A null or empty text has none.
    """
    raw = [b" " + _key(text) if text else b"" for text in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes
    space, line = data == ord(" "), data == ord("\n")
    first = line.copy()
    first[1:] |= np.where(space[1:], ~space[:-1], line[:-1])
    first[starts[sizes > 0]] = True
    low = np.flatnonzero(first)
    words = pa.Array.from_buffers(pa.large_binary(), len(low), [None, pa.py_buffer(np.r_[low, len(data)]), pa.py_buffer(data)]).dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy().astype(np.int64), np.diff(np.r_[np.searchsorted(low, starts), len(low)])


def stepped(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in steps of bounded size; one text isn't parted."""
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(text)
        size += len(text or "")
        if size >= STEP_CHARS or k == len(texts) - 1:
            yield held
            held, size = [], 0


def _spelled(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(sizes.sum()) + np.repeat(starts - (ends - sizes), sizes)]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each of the groups of ``sizes`` that lie one after another."""
    out, some = np.zeros(len(sizes), values.dtype), sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


class Kept:
    """Ids and scores of numbered words, one after another."""

    def __init__(self):
        self.flat, self.starts, self.sizes, self.scores = array("I"), array("q"), array("q"), array("d")

    def add(self, flat: np.ndarray, sizes: np.ndarray, scores: np.ndarray) -> None:
        self.starts.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.flat.frombytes(flat.astype(np.uint32).tobytes())
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.scores.frombytes(scores.tobytes())

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, how many each has, and their scores."""
        if not len(numbers):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0)
        sizes = np.frombuffer(self.sizes, np.int64)[numbers]
        return _spelled(np.frombuffer(self.flat, np.uint32), np.frombuffer(self.starts, np.int64)[numbers], sizes), sizes, np.frombuffer(self.scores)[numbers]


class Lattice:
    """Best segmentations of words over a vocabulary of scored pieces."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], byte_score: float = BYTE_SCORE):
        self.scores, self.byte_ids, self.byte_score = scores, byte_ids, byte_score
        self.pairs = {x + y for piece in scores for x, y in zip(piece, piece[1:], strict=False)}
        self.trie: dict = {}
        for piece, (number, score) in scores.items():
            node = self.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = (score, (number,))
        self.base: np.ndarray | None = None

    def edges(self, word: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """By end place: (start, score, ids) of the pieces that end there; and the best score of what lies before each place."""
        size = len(word)
        ends: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
        forward = [0.0] + [-np.inf] * size
        for start in range(size):
            node, before = self.trie, forward[start]
            if word[start] not in self.scores:
                raw = word[start].encode("utf-8", "surrogatepass")
                score = self.byte_score * len(raw)
                ends[start + 1].append((start, score, tuple(self.byte_ids[b] for b in raw)))
                forward[start + 1] = max(forward[start + 1], before + score)
            for end in range(start, size):
                node = node.get(word[end])
                if node is None:
                    break
                if (known := node.get("")) is not None:
                    ends[end + 1].append((start, *known))
                    if before + known[0] > forward[end + 1]:
                        forward[end + 1] = before + known[0]
        return ends, forward

    def tables(self) -> None:
        """The trie as a double array: a node's child by a letter is at ``base`` of the node plus the letter, if ``parent`` there is the node; and each node's piece and score."""
        letters = {letter: k for k, (letter, _) in enumerate(Counter(x for piece in self.scores for x in piece).most_common(), 1)}
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(x) for x in letters]] = list(letters.values())
        width, nodes = len(letters) + 1, [self.trie]
        for node in nodes:
            nodes += [child for x, child in node.items() if x]
        children = [[letters[x] for x in node if x] for node in nodes]
        # Nodes with many children are placed first, each where all of its children fit in the slots from ``full`` on, which moves where none do; the only children fill what is left.
        free, base, full = np.ones(4 * width, bool), np.zeros(len(nodes), np.int64), width
        free[0] = False
        sizes = np.fromiter(map(len, children), np.int64, len(children))
        for number in np.argsort(-sizes, kind="stable")[: (sizes > 1).sum()].tolist():
            codes, fits = np.sort(children[number]), ()
            while not len(fits):
                if full + FITTED + width > len(free):
                    free = np.r_[free, np.ones(len(free) + FITTED, bool)]
                slots = full + np.flatnonzero(free[full : full + FITTED])
                fits = slots[free[(slots - codes[0])[:, None] + codes].all(axis=1)]
                full += 0 if len(fits) else FITTED
            base[number] = fits[0] - codes[0]
            free[base[number] + codes] = False
        ones = np.flatnonzero(sizes == 1)
        left = width + np.flatnonzero(np.r_[free[width:], np.ones(len(ones), bool)])
        base[ones] = left[: len(ones)] - np.asarray([children[k][0] for k in ones.tolist()], np.int64)
        # Children are numbered in the order of their parents.
        above = np.repeat(np.arange(len(nodes)), sizes)
        slot = np.r_[0, base[above] + np.fromiter(itertools.chain.from_iterable(children), np.int64)]
        size = int(slot.max()) + width + 1
        self.base, self.parent, self.piece, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.full(size, -np.inf)
        self.base[slot], self.parent[slot[1:]] = base, slot[above]
        self.piece[slot], self.value[slot] = [n[""][1][0] if "" in n else -1 for n in nodes], [n[""][0] if "" in n else -np.inf for n in nodes]
        single = np.zeros(0x110000, bool)
        single[[ord(x) for x in self.scores if len(x) == 1]] = True
        self.single = single

    def best_two_of(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """``best_two`` of many words, ids packed."""
        flat, sizes, scores, losses = self.solved(words)
        raw, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        return list(zip((raw[low:high] for low, high in zip([0, *ends], ends, strict=False)), scores.tolist(), losses.tolist(), strict=True))

    def solved(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``best_two`` of many words: all ids, and each word's number of ids, score and loss. Words of like length run through the forward pass side by side."""
        if self.base is None:
            self.tables()
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        alone = (_sums(~self.single[points] + 0, sizes) > 0) | (sizes > TOGETHER) | (sizes == 0)
        order = np.flatnonzero(~alone)
        order = order[np.argsort(sizes[order], kind="stable")]
        found = [(part, *self._side_by_side(points, starts[part], sizes[part])) for part in np.array_split(order, max(len(order) // 4096, 1)) if len(part)]
        for k in np.flatnonzero(alone).tolist():
            ids, score, loss = self.best_two(words[k])
            found.append((np.asarray([k]), np.asarray(ids, np.uint32), np.asarray([len(ids)]), np.asarray([score]), np.asarray([loss])))
        if not found:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        owner, flat, counts, scores, losses = (np.concatenate([f[k] for f in found]) for k in range(5))
        back = np.argsort(owner)
        return _spelled(flat, (np.cumsum(counts) - counts)[back], counts[back]), counts[back], scores[back], losses[back]

    def _side_by_side(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        longest, rows = int(sizes[-1]), np.arange(len(sizes))
        letters = self.letter[points[np.minimum(starts[:, None] + np.arange(longest), len(points) - 1)]]
        first = np.full((len(sizes), longest + 1), -np.inf)
        second, piece, back = first.copy(), np.zeros(first.shape, np.int32), np.zeros(first.shape, np.int32)
        first[:, 0] = 0.0
        for start in range(longest):
            own = rows[sizes > start]
            node = np.zeros(len(own), np.int32)
            for end in range(start, longest):
                inside = sizes[own] > end
                own, node = own[inside], node[inside]
                slot = self.base[node] + letters[own, end]
                follows = self.parent[slot] == node
                own, node = own[follows], slot[follows]
                if not len(own):
                    break
                known = self.piece[node] >= 0
                r, at = own[known], node[known]
                score = self.value[at]
                a, b, best, next_ = first[r, start] + score, second[r, start] + score, first[r, end + 1], second[r, end + 1]
                better = a > best
                second[r, end + 1] = np.where(better, np.maximum(best, b), np.maximum(next_, a))
                first[r, end + 1] = np.where(better, a, best)
                won = r[better]
                piece[won, end + 1], back[won, end + 1] = self.piece[at[better]], start
        # Pieces from the end of each word to its start, right-aligned.
        ids, at = np.zeros((len(sizes), longest), np.uint32), sizes.copy()
        counts = np.zeros(len(sizes), np.int64)
        while (live := rows[at > 0]).size:
            ids[live, longest - 1 - counts[live]] = piece[live, at[live]]
            counts[live] += 1
            at[live] = back[live, at[live]]
        flat = ids[np.arange(longest) >= longest - counts[:, None]]
        return flat, counts, first[rows, sizes], first[rows, sizes] - second[rows, sizes]

    def best_two(self, word: str) -> tuple[tuple[int, ...], float, float]:
        """(ids of the best segmentation, its score, what the second-best loses), by a forward pass that keeps two scores for each place."""
        size = len(word)
        first, second = [-np.inf] * (size + 1), [-np.inf] * (size + 1)
        back: list[tuple[int, tuple[int, ...]]] = [(0, ())] * (size + 1)
        first[0] = 0.0
        scores, trie = self.scores, self.trie
        for start in range(size):
            a, b, node = first[start], second[start], trie
            if word[start] not in scores:
                raw = word[start].encode("utf-8", "surrogatepass")
                score, end = self.byte_score * len(raw), start + 1
                if a + score > first[end]:
                    second[end], first[end] = max(first[end], b + score), a + score
                    back[end] = (start, tuple(self.byte_ids[x] for x in raw))
                elif a + score > second[end]:
                    second[end] = a + score
            for end in range(start, size):
                node = node.get(word[end])
                if node is None:
                    break
                known = node.get("")
                if known is not None:
                    score = known[0]
                    if a + score > first[end + 1]:
                        old, more = first[end + 1], b + score
                        second[end + 1] = old if old > more else more
                        first[end + 1] = a + score
                        back[end + 1] = (start, known[1])
                    elif a + score > second[end + 1]:
                        second[end + 1] = a + score
        ids: list[tuple[int, ...]] = []
        at = size
        while at:
            at, own = back[at]
            ids.append(own)
        return tuple(x for own in reversed(ids) for x in own), first[size], first[size] - second[size]

    def best(self, word: str, n: int) -> Segmentations:
        """Up to ``n`` segmentations, highest score first.

        A path is a chain of links to the piece after it, and of equal scores
        the newest path goes on, so a word of any length takes steps in
        proportion to it. Scores are exact in binary, so equal ones are equal.
        """
        ends, forward = self.edges(word)
        order = itertools.count()
        queue = [(-forward[-1], 0, len(word), 0.0, None)]
        found: Segmentations = []
        while queue and len(found) < n:
            _, _, at, score, path = heapq.heappop(queue)
            if not at:
                ids: list[int] = []
                while path is not None:
                    piece, path = path
                    ids += piece
                found.append((score, tuple(ids)))
                continue
            for start, own, piece in ends[at]:
                heapq.heappush(queue, (-(forward[start] + own + score), -next(order), start, own + score, (piece, path)))
        return found


def combined(words: list[Segmentations], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """N best choices of one segmentation per word: (score, choice by word), by the same search over a chain."""
    forward = np.r_[0.0, np.cumsum([w[0][0] for w in words])]
    queue = [(-forward[-1], (), len(words), 0.0)]
    found = []
    while queue and len(found) < n:
        _, chosen, at, score = heapq.heappop(queue)
        if not at:
            found.append((score, chosen))
            continue
        for k, (own, _) in enumerate(words[at - 1]):
            heapq.heappush(queue, (-(forward[at - 1] + own + score), (k, *chosen), at - 1, own + score))
    return found


class Encoder:
    """Words, their segmentations and what is kept of them; ``scores`` of the pieces, or the model file's."""

    def __init__(self, path: str, n: int = BEST, scores: np.ndarray | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n
        size = self.model.get_piece_size()
        own = [i for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.names = [self.model.id_to_piece(i) for i in range(size)]
        if any(SPACE in self.names[i].lstrip(SPACE) or "\n" in self.names[i] for i in own):
            raise ValueError("a piece crosses from a letter to a space or holds a line break: words aren't independent")
        byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        given = self.model.get_score if scores is None else scores.__getitem__
        value = lambda i: round(given(i) * SCALE) / SCALE
        self.lattice = Lattice({self.names[i]: (i, float(value(i))) for i in own}, byte_ids)
        self.after_break = self.model.encode("\n")
        self.letters = np.fromiter(map(len, self.names), np.int64, size)
        self.is_byte = np.isin(np.arange(size), byte_ids)
        self.value = np.asarray([BYTE_SCORE if i in self.byte_of else float(value(i)) for i in range(size)])
        self.forget()

    def cut(self, word: bytes) -> int:
        """Where the word is parted: before its closing punctuation if no piece holds both sides, else 0."""
        if word[-1] not in _CLOSING:
            return 0
        core = word.rstrip(_CLOSING)
        return len(core) if core and _shown(core)[-1] + chr(word[len(core)]) not in self.lattice.pairs else 0

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.known: list[bytes] = []
        self.packed, self.own = Kept(), Kept()
        self.losses, self.back = array("d"), array("b")
        self.lists: dict[int, list[tuple[float, bytes]]] = {}

    def library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's own ids of words, each read with a line break behind it: all ids, and how many of each word.

        The library puts a space in front itself; a word without one is read
        after a line break.
        """
        given = [w[1:].replace(SPACE, " ") + "\n" if w[0] == SPACE else f"\n{w}\n" for w in words]
        found = self.model.encode(given, num_threads=1)
        skip, behind = len(self.after_break), len(self.after_break) - 1
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int64)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first = np.fromiter((0 if w[0] == SPACE else skip for w in words), np.int64, len(words))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = (place >= np.repeat(first, sizes)) & (place < np.repeat(sizes - behind, sizes))
        return flat[own], sizes - first - behind

    def learn(self, words: list[bytes]) -> None:
        """Solve new words, all together; the parts of a word that has two are words themselves."""
        plain, parted = [], []
        for word in words:
            if cut := self.cut(word):
                parted.append((word, word[:cut], word[cut:]))
            else:
                plain.append(word)
        plain += {part for _, *parts in parted for part in parts} - self.at.keys() - set(plain)
        every = plain + [word for word, *_ in parted]
        self.at |= zip(every, range(len(self.known), len(self.known) + len(every)), strict=True)
        self.known += every
        shown = list(map(_shown, plain))
        flat, sizes, scores, losses = self.lattice.solved(shown)
        self.packed.add(flat, sizes, scores)
        self.losses.frombytes(losses.tobytes())
        self.back.frombytes(self.read_back(plain, shown, flat, sizes).astype(np.int8).tobytes())
        flat, sizes = self.library(shown)
        self.own.add(flat, sizes, _sums(self.value[flat], sizes))
        if not parted:
            return
        halves = np.asarray([self.at[part] for _, *parts in parted for part in parts], np.int64)
        twos = np.full(len(parted), 2)
        for kept in (self.packed, self.own):
            flat, sizes, scores = kept.of(halves)
            kept.add(flat, _sums(sizes, twos), _sums(scores, twos))
        losses, back = np.frombuffer(self.losses)[halves], np.frombuffer(self.back, np.int8)[halves]
        self.losses.frombytes(np.minimum(losses[::2], losses[1::2]).tobytes())
        self.back.frombytes((back[::2] & back[1::2]).tobytes())

    def read_back(self, words: list[bytes], shown: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the ids of each word read as the word."""
        starts = np.cumsum(sizes) - sizes
        plain = _sums(self.is_byte[flat] + 0, sizes) == 0
        where = np.flatnonzero(plain)
        own = _spelled(flat, starts[where], sizes[where])
        told, lengths = [shown[k] for k in where.tolist()], _sums(self.letters[own], sizes[where])
        if "".join(map(self.names.__getitem__, own.tolist())) == "".join(told):
            plain[where] = lengths == np.fromiter(map(len, told), np.int64, len(told))
        else:
            plain[:] = False
        for k in np.flatnonzero(~plain).tolist():
            plain[k] = self.raw(flat[starts[k] : starts[k] + sizes[k]].tolist()).replace(SPACE.encode(), b" ") == words[k]
        return plain

    def split(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of all words of some texts, and how many words each text has, in steps of bounded size; new words of a step are learnt together."""
        for step in stepped(texts):
            words, places, counts = words_of(step)
            if len(self.at) > CACHED_WORDS:
                self.forget()
            if new := [word for word in words if word not in self.at]:
                self.learn(new)
            yield np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))[places], counts

    def choices(self, word: int) -> list[tuple[float, bytes]]:
        """N best segmentations of one word, by its number."""
        known = self.lists.get(word)
        if known is None:
            if len(self.lists) > CACHED_WORDS // 10:
                self.lists = {}
            found = [(score, array("I", ids).tobytes()) for score, ids in self.lattice.best(_shown(self.known[word]), self.n)]
            # Of equal scores the one that the word's best took comes first.
            ids = self.packed.of(np.asarray([word]))[0].tobytes()
            known = self.lists[word] = [(found[0][0], ids), *[x for x in found if x[1] != ids]][: self.n]
        return known

    def varied(self, at: np.ndarray, loss: np.ndarray) -> tuple[list[int], list[list[tuple[float, bytes]]], list[tuple[float, tuple[int, ...]]]]:
        """Places of the words that may differ from their best, what they can be, and the N best choices for them."""
        few = min(self.n - 1, len(at))
        limit = np.partition(loss, few - 1)[few - 1] if few else np.inf
        near = np.flatnonzero(loss <= limit)
        near = near[np.isfinite(loss[near])]
        places = np.sort(near[np.argsort(loss[near], kind="stable")[:few]])
        lists = list(map(self.choices, at[places].tolist()))
        return places.tolist(), lists, combined(lists, self.n)

    def told(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[float, bytes]], tuple[float, bytes], bool]]:
        """For each text: (score, packed ids) of the N best, the same of the library's segmentation, and whether each word's best reads as the word."""
        for at, counts in self.split(texts):
            (flat, sizes, scores), (own, own_sizes, own_scores) = self.packed.of(at), self.own.of(at)
            loss, wrong = (np.frombuffer(self.losses)[at], 1 - np.frombuffer(self.back, np.int8)[at].astype(np.int64)) if len(at) else (np.zeros(0), np.zeros(0, np.int64))
            raw, own_raw = flat.astype("<u4").tobytes(), own.astype("<u4").tobytes()
            edges, own_edges = (4 * np.r_[0, np.cumsum(s)] for s in (sizes, own_sizes))
            ends = np.cumsum(counts)
            each = zip((ends - counts).tolist(), ends.tolist(), _sums(scores, counts).tolist(), _sums(own_scores, counts).tolist(), _sums(wrong, counts).tolist(), strict=True)
            for low, high, score, own_score, faults in each:
                if low == high:
                    yield [(0.0, b"")], (0.0, b""), True
                    continue
                places, lists, found = self.varied(at[low:high], loss[low:high])
                fixed = score - sum(known[0][0] for known in lists)
                cuts = [edges[low], *(x for place in places for x in edges[low + place : low + place + 2]), edges[high]]
                between = [raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
                best = []
                for gain, chosen in found:
                    parts = [between[0]]
                    for known, k, rest in zip(lists, chosen, between[1:], strict=True):
                        parts += known[k][1], rest
                    best.append((fixed + gain, b"".join(parts)))
                yield best, (own_score, own_raw[own_edges[low] : own_edges[high]]), not faults

    def encode(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[float, bytes]], tuple[float, bytes]]]:
        """For each text: (score, packed ids) of the N best, and the same of the library's segmentation."""
        for best, library, _ in self.told(texts):
            yield best, library

    def piece_counts(self, words: dict[bytes, int]) -> np.ndarray:
        """How often the library uses each piece for words that occur so often."""
        plain: Counter = Counter()
        for word, n in words.items():
            if cut := self.cut(word):
                plain[word[:cut]] += n
                plain[word[cut:]] += n
            else:
                plain[word] += n
        flat, sizes = self.library(list(map(_shown, plain)))
        return np.bincount(flat, np.repeat(np.fromiter(plain.values(), np.int64, len(plain)), sizes), len(self.names)).astype(np.int64)

    def segmentations(self, text: str | None) -> Segmentations:
        """The N best segmentations of one text, ids in full."""
        best, _ = next(self.encode([text]))
        return [(score, tuple(np.frombuffer(ids, "<u4").tolist())) for score, ids in best]

    def raw(self, ids) -> bytes:
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.names[i].encode("utf-8", "surrogatepass") for i in ids)

    def decode(self, ids) -> str:
        """Text of ids; runs of byte pieces are UTF-8, the space in front goes."""
        text = self.raw(ids).decode("utf-8", "surrogatepass")
        return text.removeprefix(SPACE).replace(SPACE, " ")


def encoder(path: str, n: int = BEST, scores: tuple | None = None) -> Encoder:
    """One encoder for each worker process, so that tasks share its words; ``scores``: (a name, the values)."""
    return held(("pieces", path, n, scores and scores[0]), lambda: Encoder(path, n, scores and scores[1]))


def log_probabilities(docs: DataFrame, model: str, *, text: str = "text") -> np.ndarray:
    """Log of each piece's share of all pieces that the library writes over all documents, one added to each count.

    Words are counted per task and only distinct ones encoded; the counts of
    pieces, no more than the vocabulary has, are a table in the shared folder.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        total = np.zeros(len(own.names), np.int64)
        words: dict[bytes, int] = {}
        for batch in batches:
            for texts in stepped(batch.column(0).to_pylist()):
                found, places, _ = words_of(texts)
                for word, n in zip(found, np.bincount(places, minlength=len(found)).tolist(), strict=True):
                    words[word] = words.get(word, 0) + n
                if len(words) > CACHED_WORDS // 4:
                    total += own.piece_counts(words)
                    words = {}
        total += own.piece_counts(words)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["piece", "n"])

    counts = stored(docs.select(text).mapInArrow(counted, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    rows = counts.collect()
    size = encoder(model).model.get_piece_size()
    n = np.ones(size)
    n[[r.piece for r in rows]] += [r.n for r in rows]
    return np.log(n) - np.log(n.sum())


def _named(scores: np.ndarray) -> tuple[int, np.ndarray]:
    return zlib.crc32(scores.tobytes()), scores


def encoded(docs: DataFrame, model: str, *, text: str = "text", n: int = BEST, name: str = "pieces", scores: np.ndarray | None = None) -> DataFrame:
    """``docs`` with a struct ``name``: ``best``, an array of N (score, ids), highest score first, and ``library``, (score, ids) of the library's segmentation.

    ``scores`` of the pieces are the log probabilities over ``docs`` where none are given.
    """
    known = _named(log_probabilities(docs, model, text=text) if scores is None else scores)
    pair = "struct<score: double, ids: array<int>>"

    @F.pandas_udf(f"best array<{pair}>, library {pair}")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(model, n, known)
        told = lambda found: {"score": found[0], "ids": np.frombuffer(found[1], "<u4").astype(np.int32)}
        for batch in batches:
            rows = list(own.encode(batch.tolist()))
            yield pd.DataFrame({"best": [list(map(told, best)) for best, _ in rows], "library": [told(library) for _, library in rows]})

    return docs.withColumn(name, run(F.col(text)))


def decoded(rows: DataFrame, model: str, *, ids: str = "ids", name: str = "text") -> DataFrame:
    """``rows`` with the text of a column of ids."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoder(model)
        for batch in batches:
            yield batch.map(lambda value: None if value is None else own.decode(value.tolist()))

    return rows.withColumn(name, run(F.col(ids)))


def digests(docs: DataFrame, model: str, *, n: int = BEST) -> DataFrame:
    """One row per document: doc_id; score, n_pieces and crc32 of the ids for each of the N best; the same of the library's segmentation, and its place among the N best (from 1; null if it is none of them); whether decoding the best gives the text back."""
    known = _named(log_probabilities(docs, model))
    result = "scores array<double>, n_pieces array<long>, ids_crc32 array<long>, library_score double, library_pieces long, library_crc32 long, library_place int, round_trip boolean"

    @F.pandas_udf(result)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(model, n, known)
        for batch in batches:
            rows, texts = [], batch.tolist()
            for value, (best, (score, library), back) in zip(texts, own.told(texts), strict=True):
                place = next((k for k, (_, ids) in enumerate(best, 1) if ids == library), None)
                lists = [s for s, _ in best], [len(ids) // 4 for _, ids in best], [zlib.crc32(ids) for _, ids in best]
                back = back or own.decode(np.frombuffer(best[0][1], "<u4").tolist()) == (value or "").replace(SPACE, " ")
                rows.append((*lists, score, len(library) // 4, zlib.crc32(library), place, back))
            columns = ["scores", "n_pieces", "ids_crc32", "library_score", "library_pieces", "library_crc32", "library_place", "round_trip"]
            yield pd.DataFrame(rows, columns=columns).astype({"library_place": "Int32"})

    return docs.select("doc_id", run(F.col("text")).alias("_p")).select("doc_id", "_p.*")
