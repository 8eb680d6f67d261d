"""Quality rules over the numeric outcome of sheet registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.common import exact_median, reasons, yes

# Acceptance limits of a registered sheet.
MIN_CONFIDENCE = 0.82
MIN_ALIGNMENT = 0.62
MIN_GRID_COVERAGE = 0.70
MAX_RESIDUAL = 5.0
MIN_CONTRAST = 2.5
MIN_TABLE_COVERAGE = 0.985


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def page_gate(confidence: Column, flagged: Column, boundary: Column) -> Column:
    raw = F.coalesce(confidence, F.lit(0.0))
    review = yes(flagged) | (raw < MIN_CONFIDENCE) | (F.coalesce(boundary, F.lit(1.0)) < MIN_CONFIDENCE)
    return F.struct(F.round(clamp(raw), 4).alias("confidence"), review.alias("review"))


def alignment_confidence(coverage: Column, mean_error: Column, contrast: Column) -> Column:
    return 0.45 * coverage + 0.40 * F.exp(-mean_error / 5.0) + 0.15 * F.least(F.lit(1.0), contrast / 10.0)


def grid_fit(alignment: Column, coverage: Column, residual: Column, contrast: Column) -> Column:
    return (
        0.50 * alignment
        + 0.20 * clamp(coverage)
        + 0.20 * F.exp(-F.greatest(F.lit(0.0), residual) / 3.0)
        + 0.10 * clamp(contrast / 8.0)
    )


def candidate_scores(alignment: Column, coverage: Column, residual: Column, contrast: Column, penalty: Column, prior: Column) -> Column:
    """Blended scores of one registration proposal."""
    fit = grid_fit(alignment, coverage, residual, contrast)
    geometry = clamp(1.0 - penalty / 0.45)
    return F.struct(
        F.round(fit, 4).alias("grid_fit_score"),
        F.round(0.82 * fit + 0.18 * geometry + prior * 0.05, 4).alias("candidate_score"),
        F.round(geometry, 4).alias("geometry_confidence"),
        F.round(0.70 * alignment + 0.30 * F.round(geometry, 4), 4).alias("normalization_confidence"),
    )


def accepts(alignment: Column, coverage: Column, residual: Column, contrast: Column) -> Column:
    return yes(
        (alignment >= MIN_ALIGNMENT) & (coverage >= MIN_GRID_COVERAGE) & (residual <= MAX_RESIDUAL) & (contrast >= MIN_CONTRAST)
    )


def fallback_review(normalization: Column, physical: Column, alignment: Column, coverage: Column, residual: Column, contrast: Column, table: Column) -> Column:
    """Why a fallback registration needs a person; empty when it does not."""
    return reasons(
        {
            "normalization": ~yes(normalization >= MIN_CONFIDENCE),
            "boundary": ~yes(physical >= MIN_CONFIDENCE),
            "alignment": ~yes(alignment >= 0.78),
            "grid_coverage": ~yes(coverage >= 0.90),
            "residual": ~yes(residual <= 3.0),
            "contrast": ~yes(contrast >= MIN_CONTRAST),
            "table_coverage": ~yes(table >= MIN_TABLE_COVERAGE),
        }
    )


def valid_homography(inliers: Column, ratio: Column) -> Column:
    return yes(
        (inliers >= 20)
        & ((ratio >= 0.45) | ((inliers >= 80) & (ratio >= 0.35)) | ((inliers >= 150) & (ratio >= 0.30)))
    )


def manual_intervention(flagged: Column, review: Column, coverage: Column, has_corners: Column, boundary: Column) -> Column:
    low_coverage = coverage < MIN_TABLE_COVERAGE
    return F.struct(
        reasons(
            {
                "normalization_requires_review": flagged,
                "registration_review_required": review,
                "table_coverage_below_0.985": low_coverage,
            }
        ).alias("manual_reasons"),
        (~yes(has_corners) | ~yes(boundary >= MIN_CONFIDENCE) | yes(low_coverage)).alias("corner_adjustment"),
    )


def usable_corners(corners: Column) -> Column:
    """Four finite points, else NULL."""
    finite = F.forall(
        corners,
        lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))),
    )
    return F.when(yes((F.size(corners) == 4) & finite), corners)


def boundary_corners(physical: Column, paper: Column, candidates: Column, selected: Column, width: Column, height: Column) -> Column:
    """Page boundary: physical, paper, best-ranked usable proposal, selected, full frame.

    ``candidates`` is an array of ``struct<confidence, edge_support, proposal_score, corners>``.
    """
    usable = F.filter(candidates, lambda c: usable_corners(c["corners"]).isNotNull())
    ranks = F.transform(
        usable,
        lambda c: F.struct(
            F.coalesce(c["confidence"], F.lit(0.0)).alias("a"),
            F.coalesce(c["edge_support"], F.lit(0.0)).alias("b"),
            F.coalesce(c["proposal_score"], F.lit(0.0)).alias("c"),
        ),
    )
    best = F.try_element_at(usable, F.nullif(F.array_position(ranks, F.array_max(ranks)).cast("int"), F.lit(0)))
    right, bottom, zero = (width - 1).cast("double"), (height - 1).cast("double"), F.lit(0.0)
    frame = F.array(F.array(zero, zero), F.array(right, zero), F.array(right, bottom), F.array(zero, bottom))
    return F.coalesce(usable_corners(physical), usable_corners(paper), best["corners"], usable_corners(selected), frame)


def check_manual_corners(df: DataFrame, keys: list[str], target_width: float | None = None, target_height: float | None = None) -> DataFrame:
    """Broken rules of hand-set corners ``x1,y1 .. x4,y4`` in a ``width`` x ``height`` photo."""
    xs, ys = [F.col(f"x{i}") for i in (1, 2, 3, 4)], [F.col(f"y{i}") for i in (1, 2, 3, 4)]
    ex = [xs[(i + 1) % 4] - xs[i] for i in range(4)]
    ey = [ys[(i + 1) % 4] - ys[i] for i in range(4)]
    length = [F.sqrt(ex[i] * ex[i] + ey[i] * ey[i]) for i in range(4)]
    cross = F.array(*[ex[i] * ey[(i + 1) % 4] - ey[i] * ex[(i + 1) % 4] for i in range(4)])
    area = F.abs(sum((xs[i] * ys[(i + 1) % 4] - xs[(i + 1) % 4] * ys[i] for i in range(4)), F.lit(0.0))) / 2
    share = area / F.greatest(F.lit(1.0), (F.col("width") * F.col("height")).cast("double"))
    finite = F.forall(F.array(*xs, *ys), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    inside = F.forall(F.array(*xs), lambda v: (v >= 0) & (v <= F.col("width") - 1)) & F.forall(
        F.array(*ys), lambda v: (v >= 0) & (v <= F.col("height") - 1)
    )
    convex = F.forall(cross, lambda v: v > 1e-3) | F.forall(cross, lambda v: v < -1e-3)
    rules = {
        "not_finite": ~yes(finite),
        "outside_frame": ~yes(inside),
        "edge_too_short": F.least(*length) < F.greatest("width", "height") * 0.04,
        "not_convex": ~yes(convex),
        "implausible_area": ~yes((share >= 0.08) & (share <= 0.999)),
    }
    if target_width and target_height:
        aspect = (length[0] + length[2]) / F.greatest(F.lit(1.0), length[1] + length[3])
        wanted = max(target_width / max(1.0, target_height), 1e-4)
        rules["aspect_mismatch"] = F.abs(F.log(F.greatest(aspect, F.lit(1e-4)) / wanted)) > 0.75
    return df.select(*keys, F.explode(reasons(rules)).alias("rule"))


def alignment_metrics(lines: DataFrame, keys: list[str], expected: Column) -> DataFrame:
    """Residual, coverage, contrast and confidence from matched grid lines (``residual``, ``contrast``)."""
    measured = lines.groupBy(*keys).agg(
        F.avg("residual").alias("mean_error"),
        (F.count("residual") / F.greatest(F.lit(1), F.max(expected))).alias("coverage"),
    )
    measured = measured.join(exact_median(lines, keys, "residual", "median_error"), keys).join(
        exact_median(lines, keys, "contrast", "median_contrast"), keys
    )
    return measured.select(
        *keys,
        F.round("mean_error", 3).alias("grid_residual_px"),
        F.round("median_error", 3).alias("grid_median_residual_px"),
        F.round("coverage", 4).alias("grid_line_coverage"),
        F.round("median_contrast", 3).alias("grid_line_contrast"),
        F.round(alignment_confidence(F.col("coverage"), F.col("mean_error"), F.col("median_contrast")), 4).alias("alignment_confidence"),
    )
