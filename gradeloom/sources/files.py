"""File scans, content-addressed ingest and integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators.common import top, yes

# Accepted extensions, file signatures and system files to skip.
EXTENSIONS = ("jpg", "jpeg", "png")
PNG_SIGNATURE = "89504E470D0A1A0A"
JPEG_SIGNATURE = "FFD8FF"
ARTIFACTS = (".ds_store", "thumbs.db", "desktop.ini", ".spotlight-v100", ".trashes")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def sniff_type(content: Column) -> Column:
    """Type by signature: png, jpeg, or NULL."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == PNG_SIGNATURE, "png").when(head.startswith(JPEG_SIGNATURE), "jpeg")


def drop_artifacts(df: DataFrame, name: str) -> DataFrame:
    return df.where(~F.lower(F.col(name)).isin(*ARTIFACTS))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def blob_path(digest: Column) -> Column:
    """Content-addressed location; no user-controlled text in it."""
    return F.concat(F.lit("input/originals/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def scan_files(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Files below ``path`` that have an image extension or whose bytes prove one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = drop_artifacts(files.withColumn("file_name", file_name(F.col("path"))), "file_name")
    suffix = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    typed = named.withColumn("type", sniff_type(F.col("content"))).withColumn("has_extension", suffix.isin(*extensions))
    return typed.where(F.col("has_extension") | F.col("type").isNotNull())


def png_size(content: Column) -> Column:
    """Width and height from the PNG header."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(sniff_type(content) == "png", F.struct(number(17).alias("width"), number(21).alias("height")))


def scan_rasters(spark: SparkSession, path: str) -> DataFrame:
    """Decoded rasters (BGR bytes); a file that does not decode is a row with width -1. EXIF rotation is not applied."""
    return spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(path).select(
        F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"), (F.col("image.width") <= 0).alias("failed"),
    )


def _number(content: Column, at: Column | int, size: int) -> Column:
    """Big-endian number of ``size`` bytes from the 1-based place ``at``; NULL beyond the end."""
    part = F.substring(content, F.lit(at) if isinstance(at, int) else at, F.lit(size))
    return F.when(F.octet_length(part) == size, F.conv(F.hex(part), 16, 10).cast("int"))


def jpeg_size(content: Column) -> Column:
    """Width and height of a JPEG, by walking its marker segments to the frame header; NULL where there is none before the scan.

    A fold over as many steps as the file could have segments; after the frame
    header, the start of the scan or anything that is no marker it stands still.
    """
    start = F.struct(F.lit(3).alias("at"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(False).alias("ended"))

    def step(state: Column, _: Column) -> Column:
        at, mark = state["at"], _number(content, state["at"], 2)
        stay = lambda at, ended, width=None, height=None: F.struct(
            at.alias("at"), (F.lit(None).cast("int") if width is None else width).alias("width"), (F.lit(None).cast("int") if height is None else height).alias("height"), F.lit(ended).alias("ended")
        )
        # Frame headers are 0xC0 to 0xCF but for tables (C4, CC) and C8; FF01 and FFD0 to FFD7 stand alone; D9 and DA end the headers.
        frame = mark.between(0xFFC0, 0xFFCF) & ~mark.isin(0xFFC4, 0xFFC8, 0xFFCC)
        return (
            F.when(state["ended"], state)
            .when(mark.isNull() | (mark < 0xFF00) | mark.isin(0xFF00, 0xFFD8, 0xFFD9, 0xFFDA), stay(at, True))
            .when(mark == 0xFFFF, stay(at + 1, False))
            .when((mark == 0xFF01) | mark.between(0xFFD0, 0xFFD7), stay(at + 2, False))
            .when(frame, stay(at, True, _number(content, at + 7, 2), _number(content, at + 5, 2)))
            .otherwise(stay(at + 2 + F.greatest(F.coalesce(_number(content, at + 2, 2), F.lit(2)), F.lit(2)), False))
        )

    steps = F.sequence(F.lit(1), F.greatest(F.octet_length(content), F.lit(1)))
    walked = F.aggregate(steps, start, step)
    return F.when(sniff_type(content) == "jpeg", F.struct(walked["width"].alias("width"), walked["height"].alias("height")))


def complete(content: Column) -> Column:
    """Whether a PNG or JPEG has its last bytes: the IEND chunk, or the end-of-image marker."""
    tail = F.hex(F.substring(content, -12, 12))
    kind = sniff_type(content)
    return F.when(kind == "png", tail == "0000000049454E44AE426082").when(kind == "jpeg", F.substring(tail, -4, 4) == "FFD9").otherwise(False)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, hash, bytes, size, type and status of every visible file, in path order.

    Everything is told from the bytes, which are read once and not decoded: a
    file is ``ok`` when it has a size in its header and its last bytes. Damage
    in the middle of the pixel data is not seen; ``scan_rasters`` decodes. Spark
    lists no files of zero bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    visible = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).where(~file_name(F.col("path")).startswith("."))
    content = F.col("content")
    sized = visible.withColumn("_size", F.coalesce(png_size(content), jpeg_size(content)))
    good = (F.col("_size.width") > 0) & (F.col("_size.height") > 0) & complete(content)
    return sized.select(
        "path", content_hash(content).alias("sha256"), "length", F.col("_size.width").alias("width"), F.col("_size.height").alias("height"), sniff_type(content).alias("format"),
        F.when(yes(good), "ok").otherwise("error").alias("status"),
    ).orderBy("path")


def ingest_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """One decision per file: accepted, existing, reactivated, duplicate in the batch, or a conflict.

    ``files``: exam_id, purpose, room_id, file_id, sha256; ``sources``: exam_id, sha256, source_id, purpose, room_id, archived.
    Re-importing an archived image brings it back, for keys as well. The first
    file of a content is found by a pre-aggregating minimum, so a content that
    is copied very often never meets in one task.
    """
    first = files.groupBy("exam_id", "sha256").agg(F.min(F.struct("file_id", "purpose", "room_id")).alias("_first"))
    known = sources.select(
        "exam_id", "sha256", "source_id", F.col("purpose").alias("_purpose"), F.col("room_id").alias("_room"), F.col("archived").alias("_archived")
    )
    owner = first.join(known, ["exam_id", "sha256"], "left").select(
        "exam_id", "sha256", "source_id", "_archived", F.col("_first.file_id").alias("_owner"), F.col("source_id").isNotNull().alias("_known"),
        F.coalesce("_purpose", F.col("_first.purpose")).alias("_purpose"), F.when(F.col("source_id").isNotNull(), F.col("_room")).otherwise(F.col("_first.room_id")).alias("_room"),
    )
    rows = files.join(owner, ["exam_id", "sha256"])
    decision = (
        F.when(F.col("purpose") != F.col("_purpose"), "purpose_conflict")
        .when((F.col("purpose") == "student") & ~F.col("room_id").eqNullSafe(F.col("_room")), "room_conflict")
        .when(F.col("_known"), F.when(F.col("_archived") == 1, "reactivated").otherwise("existing"))
        .when(F.col("file_id") == F.col("_owner"), "accepted").otherwise("duplicate")
    )
    return rows.select("file_id", "exam_id", "sha256", "purpose", "room_id", "source_id", decision.alias("decision"))


def list_sources(sources: DataFrame, exam_id: int | None = None, room_id: int | None = None, archived: bool = False, purpose: str | None = None) -> DataFrame:
    """Active images by (created, id), or archived ones newest first; keys belong to every room."""
    rows = sources.where(F.col("archived") == (1 if archived else 0))
    if exam_id is not None:
        rows = rows.where(F.col("exam_id") == exam_id)
    if room_id is not None:
        rows = rows.where((F.col("purpose") == "key") | (F.col("room_id") == room_id))
    if purpose is not None:
        rows = rows.where(F.col("purpose") == purpose)
    return rows.orderBy(F.col("created_at").desc(), "source_id") if archived else rows.orderBy("created_at", "source_id")


def verify_integrity(sources: DataFrame, blobs: DataFrame) -> DataFrame:
    """Recorded hash against the stored bytes: ok, mismatched or missing. ``blobs``: path, content."""
    actual = blobs.select("path", content_hash(F.col("content")).alias("actual"))
    joined = sources.join(actual, "path", "left")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("mismatch")
    return joined.select("source_id", "path", status.alias("status"))


def orphan_blobs(sources: DataFrame, exams: DataFrame) -> DataFrame:
    """Contents of the given exams that no other exam uses."""
    gone = exams.select("exam_id").distinct()
    mine = sources.join(gone, "exam_id", "left_semi").select("sha256").distinct()
    others = sources.join(gone, "exam_id", "left_anti").select("sha256")
    return mine.join(others, "sha256", "left_anti")


def append_detections(detections: DataFrame, path: str) -> None:
    """Append detection rows without their raster column, one folder per exam."""
    detections.drop("aligned").write.mode("append").partitionBy("exam_id").parquet(path)
