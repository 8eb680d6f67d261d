"""Column functions for numbers, choices, keys and labels (all JVM side but NFKC)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gradeloom.operators.common import CHOICES

# Thai digits and Thai choice letters with their canonical forms.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
ASCII_DIGITS = "0123456789"
THAI_CHOICES = "กขคงจ"
CANONICAL = "ABCDE"
# Letters that a recogniser confuses with digits.
HOMOGLYPHS = "lI|OoSsBZz/"
HOMOGLYPH_DIGITS = "11100558227"

STRIP = r"(?U)^\s+|\s+$"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, STRIP, "")


def ascii_digits(value: Column) -> Column:
    return F.translate(value, THAI_DIGITS, ASCII_DIGITS)


def normalize_number(value: Column) -> Column:
    """1 to 6 digits, at least 1, Thai digits accepted; anything else is NULL."""
    text = ascii_digits(strip(value))
    number = F.when(text.rlike("^[0-9]{1,6}$"), text).try_cast("int")
    return F.when(number >= 1, number)


def extract_digits(value: Column) -> Column:
    """Keep the digits only; NULL when none is left."""
    return F.nullif(F.regexp_replace(ascii_digits(value), "[^0-9]", ""), F.lit(""))


def digits_only_or_null(value: Column) -> Column:
    """The whole text must be digits; leading zeros stay."""
    text = strip(ascii_digits(value))
    return F.when(text.rlike("^[0-9]+$"), text)


def export_number(value: Column) -> Column:
    """Numeric form for known numbers; the text form is kept by the caller."""
    text = ascii_digits(strip(F.coalesce(value, F.lit(""))))
    number = F.when(text.rlike("^[0-9]+$"), text).try_cast("bigint")
    return F.when(number > 0, number)


def fold_homoglyphs(value: Column, allow_zero: bool = False) -> Column:
    """Read look-alike letters as digits; NULL unless 1 to 6 digits result."""
    text = F.translate(value, HOMOGLYPHS, HOMOGLYPH_DIGITS)
    valid = text.rlike("^[0-9]{1,6}$")
    if not allow_zero:
        valid = valid & text.rlike("[1-9]")
    return F.when(valid, text)


def accepted_choices(answer: Column) -> Column:
    """Distinct accepted choices; one invalid member empties the set."""
    legal = F.array(*[F.lit(choice) for choice in CHOICES])
    good = (F.size(answer) > 0) & F.forall(answer, lambda item: F.coalesce(F.array_contains(legal, item), F.lit(False)))
    return F.when(F.coalesce(good, F.lit(False)), F.array_sort(F.array_distinct(answer))).otherwise(
        F.array().cast("array<string>")
    )


def score_answer(answer: Column, accepted: Column) -> Column:
    """1 for a single student choice inside the accepted set, else 0."""
    hit = answer.isin(*CHOICES) & F.array_contains(accepted_choices(accepted), answer)
    return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)


def parse_key_text(text: Column, choice_count: Column | int = 5) -> Column:
    """``"A, ข/C"`` to canonical choices in order of first use; NULL when any is illegal."""
    count = F.lit(choice_count) if isinstance(choice_count, int) else choice_count
    parts = F.split(F.replace(F.replace(text, F.lit("/"), F.lit(",")), F.lit(" "), F.lit("")), ",")
    letters = F.array_distinct(
        F.transform(
            F.filter(parts, lambda part: part != ""),
            lambda part: F.upper(F.when(F.length(part) == 1, F.translate(part, THAI_CHOICES, CANONICAL)).otherwise(part)),
        )
    )
    legal = F.slice(F.array(*[F.lit(choice) for choice in CHOICES]), F.lit(1), count)
    valid = (F.size(letters) > 0) & F.forall(letters, lambda item: F.array_contains(legal, item))
    return F.when(valid, letters)


def format_key_text(choices: Column) -> Column:
    return F.array_join(F.array_sort(choices), ",")


def canonical_choice(label: Column, choice_map: Column, labels: Column) -> Column:
    """Template map first, then the upper-cased label; NULL when unknown."""
    name = strip(label)
    upper = F.upper(name)
    return F.coalesce(F.try_element_at(choice_map, name), F.when(F.array_contains(labels, upper), upper))


def display_choice(choice: Column, labels: Column, display: Column) -> Column:
    upper = F.upper(strip(choice))
    position = F.array_position(labels, upper).cast("int")
    return F.when(position > 0, F.try_element_at(display, F.nullif(position, F.lit(0)))).otherwise(upper)


# Spark has no NFKC; this is the only row function here that leaves the JVM.
@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda text: None if text is None else unicodedata.normalize("NFKC", text))


@F.pandas_udf(StringType())
def clip_utf8(values: pd.Series, limits: pd.Series) -> pd.Series:
    """Cut to whole characters within a byte limit."""
    return pd.Series(
        [None if text is None else text.encode()[:limit].decode(errors="ignore") for text, limit in zip(values, limits)]
    )


@F.pandas_udf(StringType())
def casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda text: None if text is None else text.casefold())


def normalize_label(value: Column, limit: int) -> Column:
    """NFKC, single spaces, trimmed; NULL when empty or longer than ``limit``."""
    text = strip(F.regexp_replace(nfkc(value), r"(?U)\s+", " "))
    return F.when((F.length(text) >= 1) & (F.length(text) <= limit), text)


def safe_folder(parts: list[Column], question_count: Column, limit: int = 180) -> Column:
    """Cross-platform folder name: joined parts, ``limit`` UTF-8 bytes, question-count suffix."""
    raw = nfkc(F.concat_ws("_", *[F.coalesce(strip(part.cast("string")), F.lit("")) for part in parts]))
    text = F.regexp_replace(raw, r'[<>:"/\\|?*\x00-\x1f]', "-")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")
    text = F.regexp_replace(clip_utf8(text, F.lit(limit)), r"[ .]+$", "")
    text = F.when(text == "", "exam").otherwise(text)
    return F.concat(text, F.lit("_"), question_count.cast("int").cast("string"), F.lit("q"))


def safe_upload_name(value: Column, suffix: Column, fallback: Column, limit: int = 160) -> Column:
    """Readable base name without path parts or control characters."""
    name = F.regexp_replace(nfkc(F.coalesce(value, F.lit(""))), r"/+$", "")
    name = F.regexp_extract(name, r"([^/]*)$", 1)
    name = F.regexp_replace(name, r"[\x00-\x1f\x7f/\\]+", "_")
    name = F.regexp_replace(name, r"^[ .]+|[ .]+$", "")
    name = F.when(name == "", F.concat(F.lit("upload-"), fallback, suffix)).otherwise(name)
    name = F.when(name.rlike(r"^.+\.[^.]+$"), name).otherwise(F.concat(name, suffix))
    return F.substring(name, 1, limit)


def prevent_formula(value: Column) -> Column:
    """Keep user text as text in spreadsheets."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def uses_number_strip(failure: Column, geometry_error: Column) -> Column:
    """Template mismatch: an answer cell crosses the printed question-number strip."""
    text = F.lower(F.concat_ws(" ", failure, geometry_error))
    # Fixed value: the Thai wording of the same message.
    return text.contains("question-number strip") | text.contains("ทับแถบเลขข้อ")
