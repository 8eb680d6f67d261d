"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), calls one operator, and its decision
takes effect; all but the last return the columns of ``documents``.

Defined results: null and empty texts pass every filter that has nothing to
say about them and become a piece of one end token; repeated rows count as
documents of their own where a stage counts, and rows of one doc_id stay or go
together in the join; an empty table gives no rows; columns beyond those of
``documents`` are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import jaccard, lines, packing, secrets, toxicity
from gradeloom.llm.common import done_with, free_name, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of the documents given."""
    return toxicity.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; texts that lose none stay as they are."""
    own = free_name(docs, "lines")
    done = lines.dedup_lines(docs, name=own)
    changed = F.col(f"{own}.n_dropped") > 0
    text = F.when(changed, F.col(f"{own}.kept")).otherwise(F.col("text"))
    size = F.when(changed, F.length(f"{own}.kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[{"text": text, "n_chars": size}.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; links are those of five words and 0.8, wider than the join's own query."""
    return jaccard.first_documents(docs, n=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, in any layer they were found in; texts without secrets stay as they are."""
    before = free_name(docs, "before")
    done = secrets.redacted(docs.withColumn(before, F.col("text")))
    size = F.when(F.col("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.withColumn("n_chars", size).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_copies), ("secret scans", mask_secrets), ("best-fit packing", pack)]

#: The classifier and the tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            done_with(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
