"""Column functions over whole tables."""

from pyspark.sql import functions as F

from gradeloom.functions import scalars as S
from gradeloom.plans.registry import query

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
ASCII = "translate({0}, '๐๑๒๓๔๕๖๗๘๙', '0123456789')"


@query("normalize_number", "P1", rf"""
SELECT row_id, CASE WHEN regexp_matches(t, '^[0-9]{{1,6}}$') AND CAST(CASE WHEN regexp_matches(t, '^[0-9]{{1,6}}$') THEN t END AS INT) >= 1
            THEN CAST(CASE WHEN regexp_matches(t, '^[0-9]{{1,6}}$') THEN t END AS INT) END AS number
FROM (SELECT row_id, {ASCII.format(TRIM.format('raw'))} AS t FROM v_raw_numbers)""")
def normalize_number(v):
    return v.raw_numbers.select("row_id", S.normalize_number(F.col("raw")).alias("number"))


@query("extract_digits", "P2", rf"""
SELECT row_id, nullif(regexp_replace({ASCII.format('raw')}, '[^0-9]', '', 'g'), '') AS digits FROM v_raw_numbers""")
def extract_digits(v):
    return v.raw_numbers.select("row_id", S.extract_digits(F.col("raw")).alias("digits"))


@query("digits_only_or_null", "P3", rf"""
SELECT row_id, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN t END AS digits
FROM (SELECT row_id, {TRIM.format(ASCII.format('raw'))} AS t FROM v_raw_numbers)""")
def digits_only(v):
    return v.raw_numbers.select("row_id", S.digits_only_or_null(F.col("raw")).alias("digits"))


@query("export_number", "P4", rf"""
SELECT row_id, CASE WHEN regexp_matches(t, '^[0-9]*[1-9][0-9]*$') THEN TRY_CAST(t AS BIGINT) END AS number,
       CASE WHEN regexp_matches(t, '^[0-9]*[1-9][0-9]*$') THEN NULL ELSE coalesce(raw, '') END AS number_label
FROM (SELECT row_id, raw, {ASCII.format(TRIM.format("coalesce(raw, '')"))} AS t FROM v_raw_numbers)""")
def export_number(v):
    number = S.export_number(F.col("raw"))
    return v.raw_numbers.select(
        "row_id", number.alias("number"), F.when(number.isNull(), F.coalesce("raw", F.lit(""))).alias("number_label")
    )


@query("fold_homoglyphs", "P5", """
SELECT row_id, CASE WHEN regexp_matches(t, '^[0-9]{1,6}$') AND regexp_matches(t, '[1-9]') THEN t END AS folded
FROM (SELECT row_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
        ocr, 'l','1'), 'I','1'), '|','1'), 'O','0'), 'o','0'), 'S','5'), 's','5'), 'B','8'), 'Z','2'), 'z','2'), '/','7') AS t
      FROM v_raw_numbers)""")
def fold_homoglyphs(v):
    return v.raw_numbers.select("row_id", S.fold_homoglyphs(F.col("ocr")).alias("folded"))


def _key_sets(v):
    """Accepted sets per key question, with a bad member on some rows."""
    extra = F.when(F.col("key_id") % 11 == 0, F.lit("X")).otherwise(F.col("choice2"))
    return v.keys.select(
        "key_id", "question",
        F.filter(F.array("choice1", extra, F.when(F.col("question") == 2, F.col("choice1"))), lambda x: x.isNotNull()).alias("listed"),
    )


@query("accepted_choices", "P6", """
SELECT key_id, question, CASE WHEN key_id % 11 = 0 THEN ''
       WHEN choice2 IS NULL OR choice2 = choice1 THEN choice1
       WHEN choice1 < choice2 THEN choice1 || ',' || choice2 ELSE choice2 || ',' || choice1 END AS accepted FROM v_keys""")
def accepted_choices(v):
    return _key_sets(v).select("key_id", "question", F.array_join(S.accepted_choices(F.col("listed")), ",").alias("accepted"))


@query("score_answer", "P7", """
SELECT source_id, question, o1, o2, o3,
       CASE WHEN state = 'single_mark' AND o1 % 13 <> 0 AND choice IN ('A', 'C') THEN 1 ELSE 0 END AS point
FROM v_observations""")
def score_answer(v):
    accepted = F.when(F.col("o1") % 13 == 0, F.array(F.lit("A"), F.lit("Q"))).otherwise(F.array(F.lit("C"), F.lit("A")))
    answer = F.when(F.col("state") == "single_mark", F.col("choice")).otherwise(F.col("state"))
    return v.observations.select("source_id", "question", "o1", "o2", "o3", S.score_answer(answer, accepted).alias("point"))


@query("parse_key_text", "P8", """
SELECT key_id, question, CASE WHEN bad OR list IS NULL THEN NULL ELSE list END AS choices,
       CASE WHEN bad OR list IS NULL THEN NULL WHEN length(list) = 1 THEN list
            WHEN substr(list, 1, 1) < substr(list, 3, 1) THEN list ELSE substr(list, 3, 1) || ',' || substr(list, 1, 1) END AS formatted
FROM (SELECT key_id, question, key_id % 13 = 0 OR (choice1 = 'E' OR coalesce(choice2, '') = 'E') AS bad,
             CASE WHEN choice2 IS NULL OR choice2 = choice1 THEN choice1 ELSE choice1 || ',' || choice2 END AS list FROM v_keys)""")
def parse_key_text(v):
    second = F.coalesce(F.translate(F.col("choice2"), "ABCDE", "กขคงจ"), F.lit(""))
    text = F.concat(F.lower("choice1"), F.lit(", "), second, F.lit("/"), F.col("choice1"),
                    F.when(F.col("key_id") % 13 == 0, ",Q").otherwise(""))
    parsed = S.parse_key_text(text, 4)
    return v.keys.select("key_id", "question", F.array_join(parsed, ",").alias("choices"), S.format_key_text(parsed).alias("formatted"))


@query("choice_labels", "P9", """
SELECT source_id, question, o1, o2, o3,
       CASE WHEN o1 % 4 = 0 AND choice = 'E' THEN NULL ELSE choice END AS canonical,
       CASE choice WHEN 'A' THEN 'ก' WHEN 'B' THEN 'ข' WHEN 'C' THEN 'ค' WHEN 'D' THEN 'ง' ELSE 'E' END AS display
FROM v_observations""")
def choice_labels(v):
    labels = F.array(*[F.lit(c) for c in "ABCD"])
    display = F.array(*[F.lit(c) for c in "กขคง"])
    mapping = F.create_map(*[F.lit(c) for pair in zip("กขคงจ", "ABCDE") for c in pair])
    shown = F.when(F.col("o1") % 4 == 0, F.lower("choice")).otherwise(F.translate("choice", "ABCDE", "กขคงจ"))
    return v.observations.select(
        "source_id", "question", "o1", "o2", "o3",
        S.canonical_choice(F.concat(F.lit(" "), shown), mapping, labels).alias("canonical"),
        S.display_choice(F.lower("choice"), labels, display).alias("display"),
    )


@query("normalize_label", "P10", """
SELECT row_id, segment || ' ' || ascii_number AS label, lower(segment || ' ' || ascii_number) AS unique_key FROM v_labels_text""")
def normalize_label(v):
    label = S.normalize_label(F.col("label"), 120)
    return v.labels_text.select("row_id", label.alias("label")).withColumn("unique_key", S.casefold("label"))


@query("safe_names", "P11", """
SELECT row_id, CASE WHEN row_id % 5 = 0 THEN replace(segment, ' ', '') || '-' || ascii_number || '_9-A_7q'
                    ELSE segment || '-' || ascii_number || '_9-A_7q' END AS folder,
       ascii_number || '.png' AS upload
FROM v_labels_text""")
def safe_names(v):
    number = F.translate("ascii_number", "0123456789", "０１２３４５６７８９")
    return v.labels_text.select(
        "row_id",
        S.safe_folder([F.concat(F.lit(" ."), F.col("segment"), F.lit(":"), number), F.lit("9/A. ")], F.lit(7)).alias("folder"),
        S.safe_upload_name(F.concat(F.lit("../up/"), number), F.lit(".png"), F.col("row_id").cast("string")).alias("upload"),
    )


@query("prevent_formula", "P12", """
SELECT page_id, CASE WHEN t[1] IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS safe
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '@' ELSE '' END || url AS t FROM pages)""")
def prevent_formula(v):
    prefix = F.element_at(F.array(F.lit("="), F.lit("+"), F.lit("@"), F.lit(""), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    return v.pages.select("page_id", S.prevent_formula(F.concat(prefix, F.col("url"))).alias("safe"))


@query("template_mismatch", "P27", """
SELECT detection_id, coalesce(failure, '') LIKE '%number strip%' OR geometry_error IS NOT NULL AS mismatch FROM v_detections""")
def template_mismatch(v):
    return v.detections.select("detection_id", S.uses_number_strip(F.col("failure"), F.col("geometry_error")).alias("mismatch"))
