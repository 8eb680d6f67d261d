"""Mark decisions and registration quality over every observation and sheet."""

from pyspark.sql import functions as F

from gradeloom.functions import marks as M
from gradeloom.functions import registration as R
from gradeloom.plans.registry import SHARED, query

ID = ["source_id", "question", "o1", "o2", "o3"]
IDS_SQL = "source_id, question, o1, o2, o3"
DENS = [f"d{i}" for i in range(1, 6)]
CORES = [f"c{i}" for i in range(1, 6)]


def _each(template: str, sep: str = ", ") -> str:
    return sep.join(template.format(i=i, x="ABCDE"[i - 1]) for i in range(1, 6))


def letters_sql(condition: str) -> str:
    return "concat_ws(',', " + _each("CASE WHEN " + condition + " THEN '{x}' END") + ")"


def measured(v):
    return v.observations.withColumn("densities", F.array(*DENS)).withColumn("cores", F.array(*CORES))


def flagged(v):
    """Observations with the page-level facts that the refinement rules read."""
    cell = (F.col("o1") % 11).cast("int")
    none = F.array().cast("array<int>")
    crosses = F.when(cell < 5, F.array(cell + 1)).when(cell == 5, F.array(F.lit(1), F.lit(2))).otherwise(none)
    return (
        measured(v)
        .withColumn("custom", F.col("o1") % 3 == 0)
        .withColumn("refined", F.col("o2") % 2 == 0)
        .withColumn("green", F.col("o1") % 2 == 1)
        .withColumn("crosses", crosses)
        .withColumn("diagonals", F.when(F.col("o2") % 3 == 0, crosses).otherwise(F.concat(crosses, F.array(F.lit(5)))))
        .withColumn("decision", M.classify_ink(F.col("densities"), F.col("cores")))
    )


def shown(df, *more):
    return df.select(
        *ID,
        F.array_join("decision.selected", ",").alias("selected"),
        F.col("decision.state").alias("state"),
        F.col("decision.reason").alias("reason"),
        *more,
    )


SHARED["o_ink"] = f"""
SELECT *, {letters_sql('d{i} >= 0.10')} AS sel0,
  CASE WHEN unresolved OR (peak < 0.10 AND peak >= 0.012) THEN 'uncertain' WHEN peak < 0.10 THEN 'blank'
       WHEN n_sel > 1 THEN 'multiple' ELSE 'single_mark' END AS st0,
  CASE WHEN unresolved OR (peak < 0.10 AND peak >= 0.012) THEN 'faint-or-competing-ink' WHEN peak < 0.10 THEN 'no-answer-ink'
       WHEN weak THEN 'core-dominance' ELSE 'clear-ink' END AS why0
FROM (SELECT b.*, ({_each('(d{i} >= 0.025 AND d{i} < 0.10 AND NOT (peak >= 0.10 AND d{i} < 0.06 AND d{i} < peak * 0.35 AND c{i} < 0.08))', ' OR ')}) AS unresolved,
        ({_each('(d{i} >= 0.025 AND d{i} < 0.10)', ' OR ')}) AS weak,
        {_each('CASE WHEN d{i} >= 0.10 THEN 1 ELSE 0 END', ' + ')} AS n_sel
      FROM (SELECT source_id, question, o1, o2, o3, block_ok, d1, d2, d3, d4, d5, c1, c2, c3, c4, c5,
                   greatest(d1, d2, d3, d4, d5) AS peak, greatest(c1, c2, c3, c4, c5) AS cpeak,
                   list_sort([c1, c2, c3, c4, c5])[3] AS med, list_sort([c1, c2, c3, c4, c5])[4] AS c_second,
                   list_sort([d1, d2, d3, d4, d5])[4] AS d_second
            FROM v_observations) b)"""


@query("top_two_margin", "P13", f"SELECT {IDS_SQL}, round(peak - d_second, 6) AS margin FROM o_ink")
def top_two_margin(v):
    return measured(v).select(*ID, M.top_two_margin(F.col("densities")).alias("margin"))


@query("row_snr", "P14", f"""
SELECT {IDS_SQL}, round(cpeak - med, 6) AS best, round(c_second - med, 6) AS runner_up,
       CASE cpeak WHEN c1 THEN 'A' WHEN c2 THEN 'B' WHEN c3 THEN 'C' WHEN c4 THEN 'D' ELSE 'E' END AS winner FROM o_ink""")
def row_snr(v):
    snr = M.row_snr(F.col("cores"))
    return measured(v).select(
        *ID, F.round(snr["best"], 6).alias("best"), F.round(snr["runner_up"], 6).alias("runner_up"), M._letter(snr["winner"]).alias("winner")
    )


@query("classify_ink", "P15", f"SELECT {IDS_SQL}, CASE WHEN st0 = 'blank' THEN '' ELSE sel0 END AS selected, st0 AS state, why0 AS reason FROM o_ink")
def classify_ink(v):
    return shown(measured(v).withColumn("decision", M.classify_ink(F.col("densities"), F.col("cores"))))


SHARED["o_refined"] = f"""
SELECT *, CASE WHEN x4 THEN cross_letter ELSE sel3 END AS sel4, CASE WHEN x4 THEN 'single_mark' ELSE st3 END AS st4,
       CASE WHEN x4 THEN 'centered-cross-geometry' ELSE why3 END AS why4
FROM (SELECT *, CASE WHEN g1 THEN cwin ELSE sel2 END AS sel3, CASE WHEN g1 THEN 'single_mark' WHEN g2 THEN 'uncertain' ELSE st2 END AS st3,
             CASE WHEN g1 THEN 'green-center-ink-dominance' WHEN g2 THEN 'multiple-without-two-centered-marks' ELSE why2 END AS why3,
             o1 % 2 = 1 AND o1 % 11 < 5 AND o2 % 3 = 0 AND (CASE WHEN g1 THEN 'single_mark' WHEN g2 THEN 'uncertain' ELSE st2 END) = 'uncertain'
               AND [c1, c2, c3, c4, c5][CAST(o1 % 11 + 1 AS INT)] >= 0.06 AS x4,
             ['A', 'B', 'C', 'D', 'E'][CAST(o1 % 11 + 1 AS INT)] AS cross_letter
      FROM (SELECT *, o1 % 2 = 1 AND cpeak >= 0.10 AND c_second < 0.02 AS g1,
                   o1 % 2 = 1 AND st2 = 'multiple' AND ({_each('CASE WHEN c{i} >= 0.08 THEN 1 ELSE 0 END', ' + ')}) < 2 AS g2
            FROM (SELECT *, CASE WHEN rc THEN dwin ELSE sel1 END AS sel2, CASE WHEN rc THEN 'single_mark' ELSE st1 END AS st2,
                         CASE WHEN rc THEN 'relative-contrast-dominance' ELSE why1 END AS why2
                  FROM (SELECT *, o2 % 2 = 0 AND st1 = 'uncertain' AND peak >= 0.045 AND dcore >= 0.08
                               AND ({_each("('{x}' = dwin OR (d{i} < peak * 0.38 AND c{i} < 0.08))", ' AND ')}) AS rc
                        FROM (SELECT *, CASE WHEN a1 THEN '' WHEN a2 THEN cwin WHEN a3 THEN {letters_sql('c{i} - med >= best * 0.70')}
                                             WHEN st0 = 'blank' THEN '' ELSE sel0 END AS sel1,
                                     CASE WHEN a1 THEN 'blank' WHEN a2 THEN 'single_mark' WHEN a3 THEN 'multiple' ELSE st0 END AS st1,
                                     CASE WHEN a1 THEN 'no-answer-ink' WHEN a2 THEN 'differential-core-dominance' WHEN a3 THEN 'competing-marks' ELSE why0 END AS why1
                              FROM (SELECT *, op AND n_sel = 0 AND peak < 0.06 AND ((best < 0.035 AND cpeak < 0.05) OR (peak < 0.035 AND cpeak < 0.03)) AS a1,
                                           op AND best >= 0.05 AND second < best * 0.45 AND cpeak >= 0.06 AS a2,
                                           op AND best >= 0.06 AND second >= best * 0.70 AS a3
                                    FROM (SELECT *, o1 % 3 = 0 AND st0 IN ('uncertain', 'multiple') AS op, cpeak - med AS best, c_second - med AS second,
                                                 CASE cpeak WHEN c1 THEN 'A' WHEN c2 THEN 'B' WHEN c3 THEN 'C' WHEN c4 THEN 'D' ELSE 'E' END AS cwin,
                                                 CASE peak WHEN d1 THEN 'A' WHEN d2 THEN 'B' WHEN d3 THEN 'C' WHEN d4 THEN 'D' ELSE 'E' END AS dwin,
                                                 CASE peak WHEN d1 THEN c1 WHEN d2 THEN c2 WHEN d3 THEN c3 WHEN d4 THEN c4 ELSE c5 END AS dcore
                                          FROM o_ink)))))))"""


@query("refine_classification", "P16", f"SELECT {IDS_SQL}, sel4 AS selected, st4 AS state, why4 AS reason FROM o_refined")
def refine_classification(v):
    return shown(M.refine_classification(flagged(v)))


@query("component_majority", "P17", f"""
SELECT {IDS_SQL}, CASE WHEN ap AND mx / area >= 0.6 THEN win WHEN st0 = 'blank' THEN '' ELSE sel0 END AS selected,
       CASE WHEN ap AND mx / area >= 0.6 THEN 'single_mark' WHEN ap THEN 'boundary_cross' ELSE st0 END AS state,
       CASE WHEN ap AND mx / area >= 0.6 THEN 'connected-mark-majority' WHEN ap THEN 'mark-straddles-two-cells' ELSE why0 END AS reason
FROM (SELECT *, CASE mx WHEN m1 THEN 'A' WHEN m2 THEN 'B' ELSE 'C' END AS win,
             st0 IN ('uncertain', 'multiple') AND cpeak < 0.08 AND area > 100 AND other < area * 0.3
             AND (CASE WHEN m1 > 0 THEN 1 ELSE 0 END + CASE WHEN m2 > 0 THEN 1 ELSE 0 END + CASE WHEN m3 > 0 THEN 1 ELSE 0 END) > 1 AS ap
      FROM (SELECT *, greatest(m1, m2, m3) AS mx, m1 + m2 + m3 AS area
            FROM (SELECT *, o1 % 150 AS m1, o2 % 40 AS m2, CASE WHEN o1 % 4 = 0 THEN 0 ELSE o1 % 70 END AS m3, o2 % 90 AS other FROM o_ink)))""")
def component_majority(v):
    mass = F.array(F.col("o1") % 150, F.col("o2") % 40, F.when(F.col("o1") % 4 == 0, 0).otherwise(F.col("o1") % 70))
    df = flagged(v).withColumn("mass", mass).withColumn("area", F.aggregate("mass", F.lit(0).cast("bigint"), lambda a, x: a + x))
    return shown(
        df.withColumn("decision", M.component_majority(F.col("decision"), F.col("cores"), F.col("mass"), F.col("area"), F.col("o2") % 90))
    )


@query("decision_gates", "P18", f"""
SELECT {IDS_SQL}, page AS page_gate, block AS block_gate, NOT (st0 IN ('single_mark', 'blank') AND NOT block) AS answer_gate,
       st0 IN ('single_mark', 'blank') AND NOT block AS auto_resolved,
       CASE WHEN page AND st0 <> 'uncertain' THEN 'normalization-review-required' WHEN st0 IN ('uncertain', 'multiple', 'blank') THEN 'review-required'
            ELSE 'uncalibrated-single' END AS band
FROM (SELECT *, o1 % 7 = 0 AS page, block_ok = 0 AS block FROM o_ink)""")
def decision_gates(v):
    page, block = F.col("o1") % 7 == 0, F.col("block_ok") == 0
    state = F.col("decision.state")
    gate = M.gates(page, block, state)
    return flagged(v).select(
        *ID, gate["page"].alias("page_gate"), gate["block"].alias("block_gate"), gate["answer"].alias("answer_gate"),
        M.auto_resolved(state, block).alias("auto_resolved"), M.confidence_band(state, page).alias("band"),
    )


@query("page_gate", "P19", """
SELECT source_id, round(least(1e0, greatest(0e0, alignment_confidence)), 4) AS confidence,
       normalization_flag = 1 OR alignment_confidence < 0.82 OR coalesce(boundary_confidence, 1e0) < 0.82 AS review FROM v_sheet_evidence""")
def page_gate(v):
    gate = R.page_gate(F.col("alignment_confidence"), F.col("normalization_flag") == 1, F.col("boundary_confidence"))
    return v.sheet_evidence.select("source_id", gate["confidence"].alias("confidence"), gate["review"].alias("review"))


@query("registration_quality", "P20", """
SELECT source_id, coalesce(a >= 0.62 AND cov >= 0.70 AND res <= 5 AND con >= 2.5, false) AS accepted,
       inliers >= 20 AND (inlier_ratio >= 0.45 OR (inliers >= 80 AND inlier_ratio >= 0.35) OR (inliers >= 150 AND inlier_ratio >= 0.30)) AS homography_valid,
       concat_ws(',', CASE WHEN a >= 0.82 THEN NULL ELSE 'normalization' END, CASE WHEN boundary_confidence >= 0.82 THEN NULL ELSE 'boundary' END,
         CASE WHEN a >= 0.78 THEN NULL ELSE 'alignment' END, CASE WHEN cov >= 0.90 THEN NULL ELSE 'grid_coverage' END,
         CASE WHEN res <= 3 THEN NULL ELSE 'residual' END, CASE WHEN con >= 2.5 THEN NULL ELSE 'contrast' END,
         CASE WHEN table_coverage >= 0.985 THEN NULL ELSE 'table_coverage' END) AS review_reasons
FROM (SELECT *, alignment_confidence AS a, grid_line_coverage AS cov, grid_residual_px AS res, grid_line_contrast AS con FROM v_sheet_evidence)""")
def registration_quality(v):
    a, cov, res, con = (F.col(c) for c in ("alignment_confidence", "grid_line_coverage", "grid_residual_px", "grid_line_contrast"))
    why = R.fallback_review(a, F.col("boundary_confidence"), a, cov, res, con, F.col("table_coverage"))
    return v.sheet_evidence.select(
        "source_id", R.accepts(a, cov, res, con).alias("accepted"),
        R.valid_homography(F.col("inliers"), F.col("inlier_ratio")).alias("homography_valid"), F.array_join(why, ",").alias("review_reasons"),
    )


@query("alignment_confidence", "P21", """
SELECT source_id, round(a, 4) AS alignment, round(fit, 4) AS grid_fit_score, round(0.82 * fit + 0.18 * geo + prior * 0.05, 4) AS candidate_score,
       round(geo, 4) AS geometry_confidence, round(0.70 * a + 0.30 * round(geo, 4), 4) AS normalization_confidence
FROM (SELECT *, 0.50 * a + 0.20 * least(1e0, cov) + 0.20 * exp(-res / 3e0) + 0.10 * least(1e0, con / 8e0) AS fit
      FROM (SELECT *, 0.45 * cov + 0.40 * exp(-res / 5e0) + 0.15 * least(1e0, con / 10e0) AS a, greatest(0e0, 1e0 - pen / 0.45) AS geo
            FROM (SELECT source_id, grid_line_coverage AS cov, grid_residual_px AS res, grid_line_contrast AS con,
                         CAST(inliers AS DOUBLE) / 300e0 AS pen, inlier_ratio AS prior FROM v_sheet_evidence)))""")
def alignment_confidence(v):
    cov, res, con = F.col("grid_line_coverage"), F.col("grid_residual_px"), F.col("grid_line_contrast")
    a = R.alignment_confidence(cov, res, con)
    scores = R.candidate_scores(a, cov, res, con, F.col("inliers").cast("double") / 300.0, F.col("inlier_ratio"))
    return v.sheet_evidence.select("source_id", F.round(a, 4).alias("alignment"), scores.alias("s")).select("source_id", "alignment", "s.*")


@query("manual_intervention", "P26", """
SELECT source_id, concat_ws(',', CASE WHEN normalization_flag = 1 THEN 'normalization_requires_review' END, CASE WHEN review_flag = 1 THEN 'registration_review_required' END,
         CASE WHEN table_coverage < 0.985 THEN 'table_coverage_below_0.985' END) AS manual_reasons,
       has_corners = 0 OR boundary_confidence IS NULL OR boundary_confidence < 0.82 OR coalesce(table_coverage < 0.985, false) AS corner_adjustment FROM v_sheet_evidence""")
def manual_intervention(v):
    m = R.manual_intervention(F.col("normalization_flag") == 1, F.col("review_flag") == 1, F.col("table_coverage"), F.col("has_corners") == 1, F.col("boundary_confidence"))
    return v.sheet_evidence.select("source_id", F.array_join(m["manual_reasons"], ",").alias("manual_reasons"), m["corner_adjustment"].alias("corner_adjustment"))


def _quad(*names):
    return F.array(*[F.array(F.col(f"x{i}") + n, F.col(f"y{i}")) for i, n in zip((1, 2, 3, 4), names)])


@query("boundary_corners", "P35", """
SELECT image_id, CASE k WHEN 0 THEN x1 + 1 WHEN 1 THEN x1 + 2 WHEN 2 THEN CASE WHEN image_id % 3 = 0 THEN x1 + 4 ELSE x1 + 3 END WHEN 3 THEN x1 + 5 ELSE 0e0 END AS left_x,
       CASE k WHEN 4 THEN 1399e0 ELSE y3 END AS right_y
FROM (SELECT *, image_id % 5 AS k FROM v_corners)""")
def boundary_corners(v):
    k = F.col("image_id") % 5
    proposal = lambda conf, edge, quad: F.struct(
        conf.cast("double").alias("confidence"), edge.cast("double").alias("edge_support"), F.lit(0.5).alias("proposal_score"), quad.alias("corners"))
    best_first = F.col("image_id") % 3 == 0
    candidates = F.when(
        k == 2,
        F.array(
            proposal(F.lit(0.9), F.when(best_first, 0.1).otherwise(0.8), _quad(3, 3, 3, 3)),
            proposal(F.lit(0.9), F.lit(0.5), _quad(4, 4, 4, 4)),
            proposal(F.lit(0.99), F.lit(0.5), F.slice(_quad(9, 9, 9, 9), 1, 3)),
        ),
    )
    nan = F.array(*[F.array(F.lit(float("nan")), F.lit(0.0))] * 4)
    corners = R.boundary_corners(
        F.when(k == 0, _quad(1, 1, 1, 1)).otherwise(F.when(k == 1, nan)), F.when(k == 1, _quad(2, 2, 2, 2)), candidates,
        F.when(k == 3, _quad(5, 5, 5, 5)), F.col("width"), F.col("height"))
    return v.corners.select("image_id", corners.alias("c")).select(
        "image_id", F.element_at(F.element_at("c", 1), 1).alias("left_x"), F.element_at(F.element_at("c", 3), 2).alias("right_y"))


@query("check_manual_corners", "V11", """
WITH e AS (SELECT *, x2-x1 AS ex1, y2-y1 AS ey1, x3-x2 AS ex2, y3-y2 AS ey2, x4-x3 AS ex3, y4-y3 AS ey3, x1-x4 AS ex4, y1-y4 AS ey4 FROM v_corners),
g AS (SELECT *, ex1*ey2-ey1*ex2 AS k1, ex2*ey3-ey2*ex3 AS k2, ex3*ey4-ey3*ex4 AS k3, ex4*ey1-ey4*ex1 AS k4,
        sqrt(ex1*ex1+ey1*ey1) AS n1, sqrt(ex2*ex2+ey2*ey2) AS n2, sqrt(ex3*ex3+ey3*ey3) AS n3, sqrt(ex4*ex4+ey4*ey4) AS n4,
        abs(x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y4-x4*y3 + x4*y1-x1*y4) / 2 / (1000 * 1400) AS share FROM e)
SELECT image_id, 'outside_frame' AS rule FROM g WHERE greatest(x1,x2,x3,x4) > width - 1 OR greatest(y1,y2,y3,y4) > height - 1 OR least(x1,x2,x3,x4,y1,y2,y3,y4) < 0
UNION ALL SELECT image_id, 'edge_too_short' FROM g WHERE least(n1,n2,n3,n4) < 56
UNION ALL SELECT image_id, 'not_convex' FROM g WHERE NOT (least(k1,k2,k3,k4) > 1e-3 OR greatest(k1,k2,k3,k4) < -1e-3)
UNION ALL SELECT image_id, 'implausible_area' FROM g WHERE NOT (share >= 0.08 AND share <= 0.999)
UNION ALL SELECT image_id, 'aspect_mismatch' FROM g WHERE abs(ln(greatest((n1+n3)/greatest(1, n2+n4), 1e-4) / (1000e0/1400e0))) > 0.75""")
def check_manual_corners(v):
    return R.check_manual_corners(v.corners, ["image_id"], 1000.0, 1400.0)


@query("alignment_metrics", "A21", """
SELECT source_id, round(m, 3) AS grid_residual_px, round(md, 3) AS grid_median_residual_px, round(cov, 4) AS grid_line_coverage, round(mc, 3) AS grid_line_contrast,
       round(0.45 * cov + 0.40 * exp(-m / 5e0) + 0.15 * least(1e0, mc / 10e0), 4) AS alignment_confidence
FROM (SELECT source_id, avg(residual) AS m, median(residual) AS md, median(contrast) AS mc, count(*) / 24e0 AS cov
      FROM (SELECT source_id, abs(CAST(o1 % 90 - 45 AS DOUBLE)) / 8e0 AS residual, CAST(o2 % 64 AS DOUBLE) / 8e0 AS contrast FROM v_observations) GROUP BY source_id)""")
def alignment_metrics(v):
    lines = v.observations.select(
        "source_id", (F.abs((F.col("o1") % 90 - 45).cast("double")) / 8.0).alias("residual"), ((F.col("o2") % 64).cast("double") / 8.0).alias("contrast"))
    return R.alignment_metrics(lines, ["source_id"], F.lit(24))
