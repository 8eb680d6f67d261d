"""Per-question mark decisions over measured ink and core densities.

All functions are native columns. A decision is a struct
``<selected array<string>, state string, reason string>``; the refinement
steps run in order, each replacing the decision only where its rule holds.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.common import CHOICES, yes

# Measurement thresholds (fractions of cell area).
SELECTED = 0.10
UNCERTAIN = 0.025
SPILL_DENSITY = 0.06
SPILL_SHARE = 0.35
CORE = 0.08
TRACE = 0.012
GREEN_ISOLATION = 0.02
GREEN_CROSS_CORE = 0.06

DECISION = "struct<selected:array<string>,state:string,reason:string>"


def _letters() -> Column:
    return F.array(*[F.lit(choice) for choice in CHOICES])


def _each(test, *arrays: Column) -> list[Column]:
    """``test`` of every cell; a row has at most as many cells as there are letters, and a missing cell fails.

    Spelled out per cell, so that it compiles into plain comparisons.
    """
    return [yes(test(*[F.get(values, i) for values in arrays])) for i in range(len(CHOICES))]


def _count(tests: list[Column]) -> Column:
    return reduce(add, [F.when(test, 1).otherwise(0) for test in tests])


def _mask(tests: list[Column]) -> Column:
    """The cells that pass as bits of one number, the first cell lowest."""
    return reduce(add, [F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)])


def _letters_of(mask: Column) -> Column:
    """Choice letters of a mask, looked up in the list of all of them."""
    every = [F.array(*[F.lit(x) for i, x in enumerate(CHOICES) if m >> i & 1]).cast("array<string>") for m in range(1 << len(CHOICES))]
    return F.element_at(F.array(*every), mask + 1)


def _mask_of(selected: Column) -> Column:
    return _mask([yes(F.array_contains(selected, letter)) for letter in CHOICES])


def _ranked(values: Column) -> Column:
    return F.sort_array(values, asc=False)


def _second(values: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(_ranked(values), F.lit(2)), F.lit(default))


def _argmax(values: Column) -> Column:
    """1-based position of the first largest value."""
    return F.array_position(values, F.array_max(values)).cast("int")


def _letter(position: Column) -> Column:
    return F.element_at(_letters(), position)


def _decision(selected: Column, state: str | Column, reason: str | Column) -> Column:
    state = F.lit(state) if isinstance(state, str) else state
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(selected.alias("selected"), state.alias("state"), reason.alias("reason")).cast(DECISION)


def _none() -> Column:
    return F.array().cast("array<string>")


def top_two_margin(values: Column) -> Column:
    return F.round(F.array_max(values) - _second(values), 6)


def median(values: Column) -> Column:
    ordered, n = F.sort_array(values), F.size(values)
    low = F.element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.element_at(ordered, F.floor((n + 2) / 2).cast("int"))
    return (low + high) / 2


def row_snr(cores: Column) -> Column:
    """Core densities relative to the row median: deltas, best two, winner."""
    middle = median(cores)
    return F.struct(
        F.transform(cores, lambda core: core - middle).alias("deltas"),
        (F.array_max(cores) - middle).alias("best"),
        F.when(F.size(cores) > 1, _second(cores) - middle).otherwise(F.lit(0.0)).alias("runner_up"),
        _argmax(cores).alias("winner"),
    )


#: Outcomes of the ink alone, as (state, reason), by number from 1.
_INK = (("uncertain", "faint-or-competing-ink"), ("blank", "no-answer-ink"), ("multiple", "core-dominance"), ("multiple", "clear-ink"), ("single_mark", "core-dominance"), ("single_mark", "clear-ink"))


def classify_ink(densities: Column, cores: Column) -> Column:
    """Dominant mark, several marks, nothing, or a mark that needs a person.

    Cells are masks of one number each, computed whatever the outcome, so that
    they are shared by all that reads them instead of being copied into branches.
    """
    peak = F.array_max(densities)
    selected = _mask(_each(lambda value: value >= SELECTED, densities))
    faint = _mask(_each(lambda value: (value >= UNCERTAIN) & (value < SELECTED), densities))
    spilled = _mask(_each(lambda value, core: (value < SPILL_DENSITY) & (value < peak * SPILL_SHARE) & (core < CORE), densities, cores))
    spilled = spilled * F.when(selected > 0, 1).otherwise(0)
    unresolved = faint.bitwiseAND(F.bitwise_not(spilled)) > 0
    marked = F.when(selected.bitwiseAND(selected - 1) > 0, 3).otherwise(5) + F.when(faint > 0, 0).otherwise(1)
    outcome = F.when(unresolved | ((selected == 0) & (peak >= TRACE)), 1).when(selected == 0, 2).otherwise(marked)
    told = lambda k: F.element_at(F.array(*[F.lit(pair[k]) for pair in _INK]), outcome)
    return _decision(_letters_of(selected), told(0), told(1))


def component_majority(decision: Column, cores: Column, mass: Column, area: Column, other_area: Column) -> Column:
    """One connected stroke over several cells: the cell with 60 % of it, else a crossing."""
    applies = (
        decision["state"].isin("uncertain", "multiple")
        & (F.array_max(cores) < CORE)
        & (area > 100)
        & (other_area < area * 0.3)
        & (_count(_each(lambda part: part > 0, mass)) > 1)
    )
    majority = F.array_max(mass) / area >= 0.6
    return (
        F.when(yes(applies & majority), _decision(F.array(_letter(_argmax(mass))), "single_mark", "connected-mark-majority"))
        .when(yes(applies), _decision(decision["selected"], "boundary_cross", "mark-straddles-two-cells"))
        .otherwise(decision)
    )


# Row facts that several rules read. They are columns of their own, so that a
# row sorts its five values once and not once per rule and cell.
ROW_FACTS = ("_sorted", "_median", "_second", "_best", "_runner_up", "_core_winner", "_peak", "_peak_core", "_winner")
# The decision while the rules run: a mask of cells, state and reason, plain columns each.
_PLAIN = ("_picked", "_state", "_reason")


def with_row_facts(df: DataFrame) -> DataFrame:
    densities, cores, n = F.col("densities"), F.col("cores"), F.size("cores")
    at = lambda place: F.element_at("_sorted", place.cast("int"))
    return (
        df.withColumns({"_sorted": F.sort_array(cores), "_peak": F.array_max(densities)})
        .withColumns({
            "_median": (at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2, "_peak_core": F.array_max("_sorted"),
            "_second": F.coalesce(F.try_element_at("_sorted", F.lit(-2)), F.lit(0.0)),
        })
        .withColumns({
            "_best": F.col("_peak_core") - F.col("_median"), "_runner_up": F.when(n > 1, F.col("_second") - F.col("_median")).otherwise(F.lit(0.0)),
            "_core_winner": F.array_position(cores, F.col("_peak_core")).cast("int"), "_winner": F.array_position(densities, F.col("_peak")).cast("int"),
        })
    )


def _ruled(df: DataFrame, *rules: tuple[Column, Column, str, str]) -> DataFrame:
    """The first of (condition, mask of cells, state, reason) that holds replaces the decision; conditions are computed once."""
    number = F.coalesce(*[F.when(yes(condition), k) for k, (condition, *_) in enumerate(rules, 1)], F.lit(0))
    numbered = df.withColumn("_rule", number)
    chosen = {"_picked": F.col("_picked"), "_state": F.col("_state"), "_reason": F.col("_reason")}
    for k, (_, picked, state, reason) in reversed(list(enumerate(rules, 1))):
        own = F.col("_rule") == k
        chosen = {name: F.when(own, value).otherwise(chosen[name]) for name, value in (("_picked", picked), ("_state", F.lit(state)), ("_reason", F.lit(reason)))}
    return numbered.withColumns(chosen).drop("_rule")


def _bit(position: Column) -> Column:
    """The mask of one cell; of none where there is no position."""
    return F.coalesce(F.element_at(F.array(*[F.lit(1 << i) for i in range(len(CHOICES))]), position), F.lit(0))


def _custom_rescue(df: DataFrame) -> DataFrame:
    best, runner_up, peak, peak_core = (F.col(c) for c in ("_best", "_runner_up", "_peak", "_peak_core"))
    open_case = F.col("custom") & F.col("_state").isin("uncertain", "multiple")
    blank = (F.col("_picked") == 0) & (peak < 0.06) & (((best < 0.035) & (peak_core < 0.05)) | ((peak < 0.035) & (peak_core < 0.03)))
    dominant = (best >= 0.05) & (runner_up < best * 0.45) & (peak_core >= 0.06)
    competing = (best >= 0.06) & (runner_up >= best * 0.70)
    loud = _mask(_each(lambda core: core - F.col("_median") >= best * 0.70, F.col("cores")))
    return _ruled(
        df, (open_case & blank, F.lit(0), "blank", "no-answer-ink"), (open_case & dominant, _bit(F.col("_core_winner")), "single_mark", "differential-core-dominance"),
        (open_case & competing, loud, "multiple", "competing-marks"),
    )


def _relative_contrast(df: DataFrame) -> DataFrame:
    peak, core = F.col("_peak"), F.element_at("cores", F.col("_winner"))
    # the winner itself isn't quiet (core >= 0.08), so exactly one cell may be loud
    loud = _count(_each(lambda value, other: (value >= peak * 0.38) | (other >= CORE), F.col("densities"), F.col("cores")))
    applies = F.col("refined") & (F.col("_state") == "uncertain") & (peak >= 0.045) & (core >= CORE) & (loud == 1)
    return _ruled(df, (applies, _bit(F.col("_winner")), "single_mark", "relative-contrast-dominance"))


def _connected_stroke(df: DataFrame) -> DataFrame:
    mass, area = F.col("mass"), F.col("area")
    applies = (
        F.col("refined") & F.col("_state").isin("uncertain", "multiple") & (F.col("_peak_core") < CORE) & (area > 100) & (F.col("other_area") < area * 0.3)
        & (_count(_each(lambda part: part > 0, mass)) > 1)
    )
    return _ruled(
        df, (applies & (F.array_max(mass) / area >= 0.6), _bit(_argmax(mass)), "single_mark", "connected-mark-majority"),
        (applies, F.col("_picked"), "boundary_cross", "mark-straddles-two-cells"),
    )


def _green_core(df: DataFrame) -> DataFrame:
    strong = (F.col("_peak_core") >= SELECTED) & (F.col("_second") < GREEN_ISOLATION)
    hollow = (F.col("_state") == "multiple") & (_count(_each(lambda core: core >= CORE, F.col("cores"))) < 2)
    return _ruled(
        df, (F.col("green") & strong, _bit(F.col("_core_winner")), "single_mark", "green-center-ink-dominance"),
        (F.col("green") & hollow, F.col("_picked"), "uncertain", "multiple-without-two-centered-marks"),
    )


def _single_cross(df: DataFrame) -> DataFrame:
    crosses, diagonals = F.col("crosses"), F.col("diagonals")
    position = F.try_element_at(crosses, F.lit(1))
    applies = (
        F.col("green") & (F.col("_state") == "uncertain") & (F.size(crosses) == 1) & (F.size(diagonals) == 1) & (position == F.try_element_at(diagonals, F.lit(1)))
        & (F.try_element_at("cores", position) >= GREEN_CROSS_CORE)
    )
    return _ruled(df, (applies, _bit(position), "single_mark", "centered-cross-geometry"))


def refine_classification(df: DataFrame, decision: str = "decision", strokes: bool = False) -> DataFrame:
    """Apply the refinement rules in order.

    Needs ``densities``, ``cores``, the flags ``custom``, ``refined``,
    ``green`` and, per sheet row, ``crosses`` / ``diagonals`` (1-based cell
    positions) next to the decision column. With ``strokes`` also ``mass``,
    ``area`` and ``other_area`` of the largest connected stroke, whose rule
    comes after relative contrast, on refined sheets only. A rule is one narrow
    projection over plain columns; the decision is put together at the end.
    """
    rows = with_row_facts(df).withColumns({"_picked": _mask_of(F.col(f"{decision}.selected")), "_state": F.col(f"{decision}.state"), "_reason": F.col(f"{decision}.reason")})
    rules = [_custom_rescue, _relative_contrast, *([_connected_stroke] if strokes else []), _green_core, _single_cross]
    for rule in rules:
        rows = rule(rows)
    return rows.withColumn(decision, _decision(_letters_of(F.col("_picked")), F.col("_state"), F.col("_reason"))).drop(*ROW_FACTS, *_PLAIN)


def auto_resolved(state: Column, block_review: Column) -> Column:
    return yes(state.isin("single_mark", "blank") & ~block_review)


def confidence_band(state: Column, page_review: Column) -> Column:
    return (
        F.when(page_review & (state != "uncertain"), "normalization-review-required")
        .when(state == "boundary_cross", "explicit-zero-boundary")
        .when(state.isin("uncertain", "multiple", "blank"), "review-required")
        .otherwise("uncalibrated-single")
    )


def gates(page_review: Column, block_review: Column, state: Column) -> Column:
    return F.struct(
        page_review.alias("page"),
        block_review.alias("block"),
        (~auto_resolved(state, block_review)).alias("answer"),
        F.lit(True).alias("identity"),
    )
