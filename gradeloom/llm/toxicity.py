"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its own hashed form and of its character n-grams, so an
unseen misspelling shares vectors with the words it was made from. A passage
is the average of its words' bags; a two-class softmax reads that average.
Embeddings and softmax learn together by stochastic gradient steps on a
bounded sample of labelled documents. A document is cut into passages of a
fixed number of words (all of it, the last one shorter), and its score is that
of its worst passage: an average over a very long text would hide an insult.

After training a bucket contributes one number to the logit, so scoring a
document is a sum over its words, and each task keeps those sums per word.

Defined results: a null or empty text, and one without words, scores the
model's bias alone; repeated rows score alike, one row each, and teach once; a null doc_id is never
held out; of differing labels of one document the larger counts; without any labelled document, or with one class only, every
score is the smoothed share of toxic labels (0.5 without labels).
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import held

BUCKETS = 1 << 17
DIMENSIONS = 8
PASSAGE_WORDS = 64
#: Buckets that an average is taken over at least: a shorter passage is filled up with zero vectors, lest one odd word rules it.
PADDED = 640
#: Labelled documents of each class that the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE_PER_CLASS = 1500
EPOCHS = 6
THRESHOLD = 0.3
CACHED_WORDS = 400_000
#: Passages of each class in one pass over the sample, at most.
PASSES = 6000
_WORD = re.compile(r"\w+")


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its character n-grams of 3 to 5, edges marked."""
    edged = f"<{word}>"
    size = len(edged)
    if edged.isascii():
        edged = edged.encode()
        return [zlib.crc32(edged[i : i + n]) % buckets for n in (3, 4, 5) for i in range(size - n + 1)] + [zlib.crc32(edged, 7) % buckets]
    grams = [edged[i : i + n] for n in (3, 4, 5) for i in range(size - n + 1)]
    return [zlib.crc32(gram.encode("utf-8", "surrogatepass")) % buckets for gram in grams] + [zlib.crc32(edged.encode("utf-8", "surrogatepass"), 7) % buckets]


def passages(text: str | None, size: int = PASSAGE_WORDS) -> list[list[str]]:
    words = _WORD.findall((text or "").lower())
    return [words[i : i + size] for i in range(0, len(words), size)] or [[]]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Bags:
    """All passages of the sample as flat arrays: passages hold words with counts, words hold buckets."""

    def __init__(self, texts: list[str], buckets: int):
        index, words, counts, lengths, owner = {}, [], [], [], []
        for k, text in enumerate(texts):
            for bag in map(Counter, passages(text)):
                words += [index.setdefault(w, len(index)) for w in bag]
                counts += bag.values()
                lengths.append(len(bag))
                owner.append(k)
        rows = [subwords(w, buckets) for w in index]
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.ids = np.fromiter((i for row in rows for i in row), np.int32, int(self.sizes.sum()))
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.words, self.counts = np.asarray(words, np.int64), np.asarray(counts, np.float32)
        self.lengths, self.owner = np.asarray(lengths), np.asarray(owner)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def features(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket ids, the row each adds to, and its share of that row's average."""
        at = _spread(self.starts[chosen], self.lengths[chosen])
        words, counts = self.words[at], self.counts[at]
        rows = np.repeat(np.arange(len(chosen)), self.lengths[chosen])
        n = self.sizes[words]
        total = np.maximum(np.bincount(rows, counts * n, len(chosen)), PADDED)
        return self.ids[_spread(self.offsets[words], n)], np.repeat(rows, n), np.repeat((counts / total[rows]).astype(np.float32), n)

    def logits(self, weights: np.ndarray) -> np.ndarray:
        """Of every passage, without the bias."""
        sums = np.add.reduceat(weights[self.ids], self.offsets)
        rows = np.repeat(np.arange(len(self.lengths)), self.lengths)
        top = np.bincount(rows, sums[self.words] * self.counts, len(self.lengths))
        return top / np.maximum(np.bincount(rows, self.sizes[self.words] * self.counts, len(self.lengths)), PADDED)


def train(texts: list[str], labels: list[int], *, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = 0.6, batch: int = 48, share: float | None = None) -> tuple[np.ndarray, float]:
    """(bucket weights, bias) of the logit for label 1.

    ``share``: the share of label 1 where the model is used, if the sample was
    balanced; the bias is moved accordingly.
    """
    y = np.asarray(labels)
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(buckets, np.float32), float(np.log(p / (1 - p)))
    bags = Bags(texts, buckets)
    filled = bags.lengths > 0
    if not filled.any():
        return calibrated(np.zeros(buckets, np.float32), 0.0, texts, labels, share)
    target = y[bags.owner]
    rng = np.random.default_rng(11)
    table = rng.uniform(-1 / dimensions, 1 / dimensions, (buckets, dimensions)).astype(np.float32)
    soft, bias = rng.uniform(-0.5, 0.5, (dimensions, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen, soft_seen, bias_seen = np.full(buckets, 1e-6, np.float32), 1e-6, 1e-6
    for epoch in range(epochs):
        # A passage of a toxic document need not be toxic: from the second pass on, each document teaches by its highest passages.
        order = np.argsort(bags.owner + rng.random(len(target)), kind="stable") if not epoch else np.lexsort((-bags.logits(table @ (soft[:, 1] - soft[:, 0])), bags.owner))
        first = np.r_[0, np.flatnonzero(np.diff(bags.owner[order])) + 1]
        count = np.diff(np.r_[first, len(order)])
        place = np.arange(len(order)) - np.repeat(first, count)
        most = np.where(y[bags.owner[order]] == 1, np.maximum(1, np.repeat(count, count) * (0.4**epoch)), 3)
        chosen = order[(place < most) & filled[order]]
        good, bad = chosen[target[chosen] == 0], chosen[target[chosen] == 1]
        if not len(good) or not len(bad):
            break
        good, bad = rng.permutation(good)[:PASSES], rng.permutation(bad)[:PASSES]
        few, many = sorted((good, bad), key=len)
        chosen = rng.permutation(np.r_[many, few, rng.choice(few, max(0, len(many) // 2 - len(few)))])
        step = rate * (1 - epoch / epochs)
        for own in (chosen[i : i + batch] for i in range(0, len(chosen), batch)):
            at, rows, part = bags.features(own)
            starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
            hidden = np.add.reduceat(table[at] * part[:, None], starts)
            logits = hidden @ soft + bias
            e = np.exp(logits - logits.max(1, keepdims=True))
            error = (e / e.sum(1, keepdims=True)).astype(np.float32)
            error[np.arange(len(own)), target[own]] -= 1
            back = error @ soft.T
            by = np.argsort(at, kind="stable")
            starts = np.r_[0, np.flatnonzero(np.diff(at[by])) + 1]
            grad = np.add.reduceat(back[rows[by]] * part[by, None], starts)
            touched = at[by][starts]
            seen[touched] += (grad**2).mean(1)
            table[touched] -= step * grad / np.sqrt(seen[touched])[:, None]
            grad = hidden.T @ error / len(own)
            soft_seen += float((grad**2).mean())
            bias_seen += float((error.mean(0) ** 2).mean())
            soft -= step * 0.3 * grad / np.sqrt(soft_seen)
            bias -= step * 0.1 * error.mean(0) / np.sqrt(bias_seen)
    return calibrated((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), texts, labels, share)


def calibrated(weights: np.ndarray, bias: float, texts: list[str], labels: list[int], share: float | None) -> tuple[np.ndarray, float]:
    """Scale and bias of the worst passage's logit, refitted so that scores are probabilities of the document."""
    logit = Scorer(weights, bias).logits(texts)
    y = np.asarray(labels, float)
    p = y.mean()
    target = share if share is not None else p
    importance = np.where(y == 1, target / p, (1 - target) / (1 - p))
    center, spread = logit.mean(), logit.std() + 1e-6
    x = np.stack([(logit - center) / spread, np.ones_like(logit)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        gradient = x.T @ (importance * (q - y)) + 1e-3 * a
        hessian = (x * (importance * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        a -= move / max(1.0, np.abs(move).max())
    scale = max(a[0], 1e-3) / spread
    return (weights * scale).astype(np.float32), float((bias - center) * scale + a[1])


class Scorer:
    """Scores texts; keeps the sum and number of buckets per word, for a bounded number of words."""

    def __init__(self, weights: np.ndarray, bias: float, size: int = PASSAGE_WORDS):
        self.weights, self.bias, self.size = weights.astype(float).tolist(), bias, size
        self.buckets, self.at, self.sums, self.numbers = len(weights), {}, array("d"), array("d")

    def add(self, words: set[str]) -> None:
        if len(self.at) + len(words) > CACHED_WORDS:
            self.at, self.sums, self.numbers = {}, array("d"), array("d")
        value = self.weights.__getitem__
        for word in words:
            if word not in self.at:
                own = subwords(word, self.buckets)
                self.at[word] = len(self.sums)
                self.sums.append(sum(map(value, own)))
                self.numbers.append(len(own))

    def logits(self, texts) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            words = _WORD.findall((text or "").lower())
            if not words:
                continue
            at = list(map(self.at.get, words))
            if None in at:
                self.add(set(words))
                at = list(map(self.at.__getitem__, words))
            at = np.asarray(at)
            starts = np.arange(0, len(at), self.size)
            sums = np.add.reduceat(np.frombuffer(self.sums)[at], starts)
            out[k] += (sums / np.maximum(np.add.reduceat(np.frombuffer(self.numbers)[at], starts), PADDED)).max()
        return out


def _scorer(weights: bytes, bias: float) -> Scorer:
    """One scorer per model and worker process, so that tasks share its words."""
    return held(("toxicity", hash((weights, bias))), lambda: Scorer(np.frombuffer(weights, np.float32), bias))


def _trainer(share: float, options: dict):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "text"])
        weights, bias = train(rows.text.tolist(), rows.label.astype(int).tolist(), share=share, **options)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    return fit


def fit(docs: DataFrame, labels: DataFrame, *, column: str = "toxic", per_class: int = SAMPLE_PER_CLASS, **options) -> tuple[np.ndarray, float]:
    """Model from the labelled documents that may be learnt from: labelled 0 or 1, not held out.

    The sample is drawn from ids alone, at most ``per_class`` of each class, and
    is the same for the same rows in any order; only then are its texts read,
    by ids that are few enough to be sent to all tasks. One task fits, and the
    driver gets the fixed-size model only.
    """
    known = labels.where(F.col(column).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label"))
    known = known.groupBy("id").agg(F.max("label").alias("label")).join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return np.zeros(options.get("buckets", BUCKETS), np.float32), 0.0
    share = (counts.get(1, 0) + 1) / (total + 2)
    keyed = known.select("id", "label", F.xxhash64("id").alias("order"))
    parts = [keyed.where(F.col("label") == label).orderBy("order", "id").limit(per_class) for label in (0, 1)]
    sample = F.broadcast(parts[0].unionAll(parts[1]))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(sample, "id").groupBy("order", "label", "id").agg(F.min("text").alias("text"))
    model = rows.groupBy(F.lit(0).alias("all")).applyInPandas(_trainer(share, options), "weights binary, bias double").first()
    return np.frombuffer(model.weights, np.float32), model.bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row."""
    weights, bias = model[0].tobytes(), model[1]

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(weights, bias)
        for batch in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(scorer.logits(batch.tolist()), -700, 700))))

    return docs.withColumn(name, scored(F.col(text)))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **options)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def kept_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without those that score at or above the threshold."""
    columns = docs.columns
    name = "_toxicity"
    while name in columns:
        name += "_"
    return score(docs, fit(docs, labels, **options), name=name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in columns])
