"""Quality rules on DataFrame functions alone: text statistics and cross-document line frequency.

Base rules look at one text. The method then looks across documents: lines are
trimmed and lower-cased and hashed; per host, the distinct documents that hold
a line are counted, where copies of one text count as one document; lines above
the limit go, and a document that loses more than the allowed share of its
characters is depleted and rejected.

Defined results: a null text is empty (no words, so the base rules fail it);
empty texts have zero counts; repeated rows give one row each; a null host is
a host of its own; lines without a word are neither counted nor removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import SPACES, let, lowered, stored

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Distinct documents of one host that may hold a line, and the share of its characters that a document must keep.
MAX_DOCUMENTS = 10
MIN_KEPT_PERCENT = 50
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words between white space, none for an empty text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more, the first find included.

    Windows compare by 64-bit hash within one text. Their start places are
    brought in order of (hash, place); those with an equal neighbour repeat,
    and each adds what it covers beyond the repeated window before it.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def starts(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.sort_array(F.transform(found, lambda i: F.get(s, i)["i"]))

    def covered(places: Column) -> Column:
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def of(w: Column) -> Column:
        many = let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: let(starts(s), covered))))
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(many)

    return let(words, of)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_rules(text: Column) -> Column:
    """Struct of the counts of one text and whether the base rules fail it."""
    text = F.coalesce(text, F.lit(""))
    n_words = F.size(words_of(text)).cast("long")
    return F.struct(
        n_words.alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(text).cast("long").alias("n_dup_lines"),
        repeated_words(words_of(text)).cast("long").alias("n_repeat_words"),
    )


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: the document's key, host, the line's 128-bit hash, and its characters."""
    lines = docs.select("doc_key", "host", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    line = F.btrim(F.col("line"), F.lit(SPACES))
    lines = lines.select("doc_key", "host", lowered(line).alias("line")).where("line <> ''")
    return lines.select("doc_key", "host", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.length("line").alias("chars"))


def quality(
    docs: DataFrame, *, host: str = "source", max_documents: int = MAX_DOCUMENTS, min_kept_percent: int = MIN_KEPT_PERCENT,
    min_words: int = MIN_WORDS, max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, removed_chars, line_chars, kept.

    Text never shuffles: what moves are hashes of lines, pre-aggregated by
    task, and the few characters lost per text. A text has one key whichever
    row holds it, so copies meet as one row per task.
    """
    keyed = docs.select("doc_id", F.col("text").alias("text"), F.col(host).alias("host"))
    keyed = keyed.withColumn("doc_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    lines = _lines(keyed)
    frequent = lines.select("host", "h1", "h2", "doc_key").distinct().groupBy("host", "h1", "h2").count().where(F.col("count") > max_documents).drop("count")
    frequent = stored(frequent, "frequent-lines")  # Spark reads its size from the files and sends it to all tasks only if small
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("host", "h1", "h2")]
    once = lines.alias("l").join(frequent.alias("f"), same, "left_semi")
    # Copies of a text in one host lose the same characters, counted once: a task sums a text's lines, and equal sums of copies are averaged.
    lost = once.groupBy("doc_key", "host").agg(F.sum("chars").alias("lost"))
    sizes = F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0), lambda n, x: n + F.length(F.btrim(x, F.lit(SPACES))))
    counted = keyed.select("doc_id", "host", "doc_key", base_rules(F.col("text")).alias("c"), sizes.cast("long").alias("line_chars"))
    copies = counted.groupBy("doc_key", "host").count()
    lost = lost.alias("t").join(copies.alias("n"), [F.col("t.doc_key") == F.col("n.doc_key"), F.col("t.host").eqNullSafe(F.col("n.host"))])
    lost = lost.select(F.col("t.doc_key").alias("doc_key"), F.col("t.host").alias("host"), F.expr("lost div count").alias("lost"))
    base_failed = (F.col("c.n_words") < min_words) | (100 * F.col("c.n_repeat_words") > max_repeated_percent * F.col("c.n_words"))
    joined = counted.alias("d").join(lost.alias("t"), [F.col("d.doc_key") == F.col("t.doc_key"), F.col("d.host").eqNullSafe(F.col("t.host"))], "left")
    removed = F.coalesce("lost", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "c.n_words", "c.word_chars", "c.n_symbols", "c.n_dup_lines", "c.n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & (100 * (F.col("line_chars") - removed) >= min_kept_percent * F.col("line_chars"))).alias("kept"),
        removed.alias("removed_chars"), "line_chars",
    )
