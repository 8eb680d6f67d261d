"""Score sheets, evidence documents, fingerprints and the publish protocol."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.scalars import prevent_formula
from gradeloom.operators.common import dense_number
from gradeloom.sources.commits import CommitConflict, commit, commits


def score_sheet(results: DataFrame, attendance: DataFrame, rooms: DataFrame, exams: DataFrame) -> DataFrame:
    """Result rows, then one row per absent or excused number (missing columns are NULL).

    ``indicators`` of a result is a map from position to points; ``wide_scores`` gives one column for each.
    """
    label = F.when(F.col("number").isNull(), F.concat(F.lit("unknown #"), F.col("unknown_ordinal").cast("string")))
    rows = results.select(
        "exam_id", "room_id", F.col("number").cast("bigint").alias("number"), label.alias("number_label"), "indicators", "score",
        F.col("max").cast("bigint").alias("max"), "status", prevent_formula(F.replace(F.col("review_issues"), F.lit(";"), F.lit("; "))).alias("review_issues"), prevent_formula(F.col("original_name")).alias("original_name"),
    )
    places = rooms.select("room_id", "exam_id").join(exams.select("exam_id", F.col("question_count").cast("bigint").alias("max")), "exam_id")
    away = attendance.where(F.col("status").isin("absent", "excused")).join(places, "room_id").select(
        "exam_id", "room_id", F.col("student_number").alias("number"), "max", "status"
    )
    return rows.unionByName(away, allowMissingColumns=True)


def wide_scores(sheet: DataFrame, positions: list[int]) -> DataFrame:
    """The sheet with one column per indicator position in place of the map."""
    wide = [F.element_at("indicators", F.lit(p)).alias(f"i{p}") for p in positions]
    return sheet.select(*[c for c in sheet.columns if c != "indicators"], *wide)


def write_scores(sheet: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder per room, its files and their rows in number order, numberless rows last."""
    last = F.col("number").isNull()
    ordered = sheet.repartitionByRange("room_id", last, "number").sortWithinPartitions("room_id", last, "number")
    writer = ordered.write.mode("errorifexists").partitionBy("room_id")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def row_digest(df: DataFrame) -> Column:
    """sha256 of a row as JSON with its columns in name order; NULL fields are kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(name) for name in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame, keys: list[str], width: int = 4096) -> DataFrame:
    """Order-independent sha256 per key, folded as a hash tree.

    Row digests are sorted inside hash buckets of about ``width`` rows, and
    their digests inside the key, level by level: three levels of at most
    ``width`` each, whatever the size of the key, so none is collected whole.
    """
    hashed = df.select(*keys, row_digest(df).alias("_row"))
    sizes = hashed.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / width)).alias("_buckets"))
    bucketed = hashed.join(sizes, keys).withColumn("_bucket", F.pmod(F.conv(F.substring("_row", 1, 8), 16, 10).cast("bigint"), F.col("_buckets")))
    folded = bucketed.groupBy(*keys, "_bucket").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("_row")), ""), 256).alias("_digest"), F.count(F.lit(1)).alias("_n")
    )
    listed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_digest"))), lambda item: item["_digest"]), ""), 256)
    above = folded.withColumn("_above", F.floor(F.col("_bucket") / width))
    middle = above.groupBy(*keys, "_above").agg(listed.alias("_digest"), F.sum("_n").alias("_n"))
    middle = middle.withColumnRenamed("_above", "_bucket")
    alone = F.count(F.lit(1)) == 1
    return middle.groupBy(*keys).agg(F.when(alone, F.first("_digest")).otherwise(listed).alias("fingerprint"), F.sum("_n").alias("rows"))


def snapshot_documents(results: DataFrame) -> DataFrame:
    """One canonical JSON evidence document per sheet, keyed by room."""
    return results.select("exam_id", "room_id", "source_id", F.to_json(F.struct(*[F.col(c) for c in sorted(results.columns)]), {"ignoreNullFields": "false"}).alias("document"))


def write_snapshot(results: DataFrame, path: str) -> None:
    results.withColumn("schema_version", F.lit(2)).write.mode("errorifexists").partitionBy("room_id").json(path)


def artifact_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of every file written below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "length")


RUN_SCHEMA = "run_id string, attempt string, fingerprint string, rows bigint, status string"


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    return commits(spark, f"{root}/export_runs", RUN_SCHEMA)


class SnapshotChanged(ValueError):
    """The tables moved while the results were written; nothing was published."""


def publish(build: Callable[[], DataFrame], spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Write the snapshot of ``build`` under a folder of its own, re-check, then commit.

    ``build`` is called again after writing, and the run is committed only when
    the tables still give the fingerprint that was written. The commit goes to a
    numbered log that takes each run id once: of two publishers of one run, in
    whatever order their steps fall, one wins and the other gets an error.
    Readers go by the log, so attempts that lost or died are invisible.
    """
    if committed_runs(spark, root).where(F.col("run_id") == run_id).limit(1).count():
        raise CommitConflict(f"run_id exists: {run_id}")
    attempt = uuid4().hex
    target = f"{root}/runs/run_id={run_id}/attempt={attempt}"
    build().write.mode("errorifexists").parquet(target)
    whole = lambda df: fingerprint(df.withColumn("_all", F.lit(1)), ["_all"]).select("fingerprint", "rows")
    written = whole(spark.read.parquet(target)).collect()
    current = whole(build()).collect()
    if [tuple(row) for row in written] != [tuple(row) for row in current]:
        raise SnapshotChanged(run_id)
    digest, rows = tuple(written[0]) if written else (None, 0)
    row = {"run_id": run_id, "attempt": attempt, "fingerprint": digest, "rows": rows, "status": "published"}
    version = commit(spark, f"{root}/export_runs", row, RUN_SCHEMA, "run_id")
    return committed_runs(spark, root).where(F.col("version") == version)


def published(spark: SparkSession, root: str) -> DataFrame:
    """Rows of committed runs only."""
    runs = committed_runs(spark, root).where("status = 'published'").select("run_id", "attempt")
    return spark.read.option("basePath", f"{root}/runs").parquet(f"{root}/runs").join(runs, ["run_id", "attempt"], "left_semi").drop("attempt")


def export_runs(runs: DataFrame) -> DataFrame:
    """Export history, newest first."""
    return runs.orderBy(F.col("seq").desc(), "run_id")


def _probed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by (room, sheet): each takes its number, or the next one that is free in its room."""
    room, after = None, {}
    for frame in frames:
        places = []
        for own, asked in zip(frame["room_id"].tolist(), frame["asked"].tolist(), strict=True):
            if own != room:
                room, after = own, {}
            place, path = asked, []
            while place in after:
                path.append(place)
                place = after[place]
            after[place] = place + 1
            for passed in path:
                after[passed] = place + 1
            places.append(place)
        yield frame.assign(place=places)[["room_id", "source_id", "number", "place"]]


def unique_filenames(results: DataFrame) -> DataFrame:
    """``no-07``, ``no-07_02``, … per room and number; an unknown sheet takes its ordinal, or the next free sequence of its room, in sheet order.

    Names of unknown sheets follow from those before them, so the unknown
    sheets of a room (only those) stream through one task.
    """
    pad = lambda digits: F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    valid = F.coalesce(F.col("number").between(1, 999999), F.lit(False))
    known = dense_number(results.where(valid), ["room_id", "number"], "source_id", "_n")
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("_"), pad(F.col("_n").cast("string")))).otherwise("")
    named = F.concat(F.lit("no-"), pad(F.col("number").cast("string")), suffix, F.lit(".jpg"))
    unknown = results.where(~valid).select(
        F.col("room_id").cast("long").alias("room_id"), F.col("source_id").cast("long").alias("source_id"), F.col("number").cast("double").alias("number"),
        F.coalesce("unknown_ordinal", F.lit(1)).cast("long").alias("asked"),
    )
    placed = unknown.repartition("room_id").sortWithinPartitions("room_id", "source_id").mapInPandas(_probed, "room_id long, source_id long, number double, place long")
    kinds = {name: results.schema[name].dataType for name in ("room_id", "source_id", "number")}
    file_name = F.concat(F.lit("unknown-"), pad(F.col("place").cast("string")), F.lit(".jpg"))
    return known.select(*kinds, named.alias("file_name")).unionByName(
        placed.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds.items()], file_name.alias("file_name"))
    )
