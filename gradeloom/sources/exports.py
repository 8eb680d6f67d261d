"""Readers of exported results, answer keys and templates (nested JSON to rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS_SCHEMA = """schema_version int, run_id string, exam struct<id:string,question_count:int>, room struct<id:string>, key struct<id:string>,
results array<struct<source:struct<id:string,original_name:string,sha256:string>,review_id:string,student_number:string,identity_confirmed:boolean,identity_origin:string,
status:string,decision_origin:string,score:int,max:int,answers:array<string>,answer_provenance:array<struct<question:int,origin:string>>,
detection:struct<pipeline_version:string,answers:array<struct<question:int,classification:string,selected:array<string>,ink_density:array<double>,auto_resolved:boolean>>>>>"""

KEYS_SCHEMA = "map<string,map<string,string>>"

TEMPLATE_SCHEMA = """id string, template_id string, name string, kind string, version int, width int, height int, canonical_width int, canonical_height int, choice_count int,
question_count int, cell_inset int, reference_sha256 string, choice_map map<string,string>, student_number_roi array<int>, score_roi array<int>, groups array<array<int>>, rows array<int>,
answer_blocks array<struct<block_index:int,question_start:int,question_end:int,rows:int,choice_count:int,col_boundaries:array<int>,row_boundaries:array<int>,geometry_state:string,confidence:double>>"""


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


def read_export_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, observations) of results documents, schema version 2 only."""
    documents = _documents(spark, path, RESULTS_SCHEMA).where("schema_version = 2")
    rows = documents.select(
        "run_id", F.col("exam.id").alias("exam_id"), F.col("room.id").alias("room_id"), F.col("key.id").alias("key_id"),
        F.col("exam.question_count").alias("question_count"), F.explode("results").alias("r"),
    )
    results = rows.select(
        "run_id", "exam_id", "room_id", "key_id", "question_count", F.col("r.source.id").alias("source_id"), F.col("r.source.original_name").alias("original_name"),
        F.col("r.source.sha256").alias("sha256"), "r.review_id", "r.student_number", "r.identity_confirmed", "r.identity_origin", "r.status", "r.decision_origin", "r.score", "r.max",
    )
    answers = rows.select("run_id", "exam_id", "question_count", F.col("r.source.id").alias("source_id"), "r.answers", "r.answer_provenance", F.posexplode_outer("r.detection.answers").alias("pos", "o"))
    observations = answers.where(F.col("pos") < F.col("question_count")).select(
        "run_id", "exam_id", "source_id", (F.col("pos") + 1).alias("question"), F.col("o.classification").alias("state"), F.col("o.selected").alias("selected"),
        F.col("o.ink_density").alias("ink_density"), F.col("o.auto_resolved").alias("auto_resolved"), F.try_element_at("answers", F.col("pos") + 1).alias("answer"),
        F.try_element_at("answer_provenance", F.col("pos") + 1)["origin"].alias("origin"),
    )
    return results, observations


def read_answer_keys(spark: SparkSession, path: str) -> DataFrame:
    """``{key: {question: choice}}`` documents as rows."""
    texts = spark.read.option("wholetext", "true").text(path)
    keys = texts.select(F.explode(F.from_json("value", KEYS_SCHEMA)).alias("key_id", "answers"))
    return keys.select("key_id", F.explode("answers").alias("question", "choice")).withColumn("question", F.col("question").cast("int"))


def read_template(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(templates, blocks) of both layouts: ``groups``/``rows`` (five choices, one row grid for all groups) and ``answer_blocks``."""
    documents = _documents(spark, path, TEMPLATE_SCHEMA)
    template_id = F.coalesce("template_id", "id")
    lines = F.size("rows") - 1
    grouped = F.transform(
        "groups",
        lambda cols, i: F.struct(
            i.alias("block_index"), (i * lines + 1).alias("question_start"), ((i + 1) * lines).alias("question_end"), lines.alias("rows"),
            (F.size(cols) - 1).alias("choice_count"), cols.alias("col_boundaries"), F.col("rows").alias("row_boundaries"),
            F.lit("auto_detected").alias("geometry_state"), F.lit(None).cast("double").alias("confidence"),
        ),
    )
    unified = documents.withColumn("blocks", F.coalesce("answer_blocks", grouped))
    templates = unified.select(
        template_id.alias("template_id"), F.coalesce("version", F.lit(1)).alias("version"), F.coalesce("canonical_width", "width").alias("width"),
        F.coalesce("canonical_height", "height").alias("height"), F.coalesce("cell_inset", F.lit(4)).alias("cell_inset"), "reference_sha256", "choice_map",
        F.coalesce("question_count", F.aggregate("blocks", F.lit(0), lambda n, b: n + b["rows"])).alias("question_count"),
        F.coalesce("choice_count", F.element_at("blocks", 1)["choice_count"]).alias("choice_count"), "student_number_roi", "score_roi",
    )
    blocks = unified.select(template_id.alias("template_id"), F.coalesce("version", F.lit(1)).alias("version"), F.explode("blocks").alias("b")).select(
        "template_id", "version", "b.block_index", "b.question_start", "b.question_end", F.col("b.rows").alias("row_count"), "b.choice_count",
        F.col("b.col_boundaries").alias("cols"), F.col("b.row_boundaries").alias("rows"), "b.geometry_state", "b.confidence",
    )
    return templates, blocks
