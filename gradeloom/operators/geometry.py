"""Template geometry: cells, strips, offsets, line clustering and template versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.common import CHOICES, exact_median, expand_range, merged, previous, running, sliced, spread, top, violations, yes
from gradeloom.session import cut

# Smallest ink core of a cell, and the limits of a template.
MIN_CELL_CORE = 8
DEFAULT_TEMPLATE = "default-1"
BUILTIN_TEMPLATES = ("default-1", "default-2", "default-3")


def boundaries(start: Column, step: Column, cells: Column) -> Column:
    """Evenly spaced boundary lines of a block: ``cells`` + 1 values."""
    return F.transform(F.sequence(F.lit(0), cells), lambda i: start + i * step)


def cell_rects(blocks: DataFrame, keys: Sequence[str], inset: int = 4, carried: Sequence[str] = ()) -> DataFrame:
    """Every (question, choice) cell of every block with its outer and inner rectangle.

    ``blocks`` needs block_index, question_start, question_end, choice_count, cols, rows
    and the columns ``carried`` along to its cells.
    """
    rows = expand_range(blocks, "question_start", "question_end", "question")
    cells = expand_range(rows, F.lit(1), F.col("choice_count"), "_c")
    line = F.col("question") - F.col("question_start") + 1
    x, y = F.try_element_at("cols", F.col("_c")), F.try_element_at("rows", line)
    w, h = F.try_element_at("cols", F.col("_c") + 1) - x, F.try_element_at("rows", line + 1) - y
    return cells.select(
        *keys, "block_index", "question", F.element_at(F.array(*[F.lit(c) for c in CHOICES]), F.col("_c")).alias("choice"),
        x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"),
        (x + inset).alias("ix"), (y + inset).alias("iy"), (w - 2 * inset).alias("iw"), (h - 2 * inset).alias("ih"), *carried,
    )


def shift_rects(rects: DataFrame, offsets: DataFrame, keys: Sequence[str], x: str = "ix", y: str = "iy") -> DataFrame:
    """Rectangles moved by the offset of their block; a block without one stays."""
    moved = rects.join(merged(offsets.select(*keys, "block_index", "shift_x", "shift_y")), [*keys, "block_index"], "left")
    return _at_offset(moved, x, y)


def _at_offset(rects: DataFrame, x: str, y: str) -> DataFrame:
    return rects.withColumns(
        {x: F.col(x) + F.coalesce("shift_x", F.lit(0)), y: F.col(y) + F.coalesce("shift_y", F.lit(0))}
    ).drop("shift_x", "shift_y")


def _placed(blocks: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks with the offset of each, dealt by ``keys``."""
    offsets = spread(offsets.select(*keys, "block_index", "shift_x", "shift_y"), *keys)
    return spread(blocks.drop("shift_x", "shift_y"), *keys).join(merged(offsets), [*keys, "block_index"], "left")


def shifted_cells(blocks: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``shift_rects`` of ``cell_rects``: each block meets its offset before it is spelled out."""
    return _at_offset(cell_rects(_placed(blocks, offsets, keys), keys, carried=("shift_x", "shift_y")), "ix", "iy")


def question_block(questions: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Block of every question: the ranges are spelled out, the membership test is an equi join."""
    spelled = expand_range(blocks, "question_start", "question_end", "question").select(*keys, "question", "block_index")
    return questions.join(merged(spelled), [*keys, "question"])


def number_strips(blocks: DataFrame, keys: Sequence[str], configured: DataFrame | None = None) -> DataFrame:
    """Gap between neighbouring blocks, owned by the right one; configured strips are added."""
    order = Window.partitionBy(*keys).orderBy("block_index")
    nxt = lambda column: F.lead(column).over(order)
    right = blocks.select(
        *keys, nxt("block_index").alias("block_index"), F.element_at("cols", -1).alias("x"),
        nxt(F.element_at("cols", 1)).alias("_right"), F.greatest(F.element_at("rows", 1), nxt(F.element_at("rows", 1))).alias("y"),
        F.least(F.element_at("rows", -1), nxt(F.element_at("rows", -1))).alias("_bottom"),
    )
    gaps = right.where(F.col("block_index").isNotNull() & (F.col("_right") > F.col("x")) & (F.col("_bottom") > F.col("y"))).select(
        *keys, "block_index", "x", "y", (F.col("_right") - F.col("x")).alias("w"), (F.col("_bottom") - F.col("y")).alias("h")
    )
    return gaps if configured is None else gaps.unionByName(configured.select(*gaps.columns))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: int = 128) -> DataFrame:
    """Pairs of intersecting rectangles with the same keys (suffixes ``_l`` and ``_r``).

    Both sides are spread over square tiles, pairs meet per tile and are kept
    in the tile that holds the corner of their intersection, so each pair
    appears once and no group of rectangles is crossed with another.
    """
    def tiled(df: DataFrame, suffix: str) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(f"{c}_{suffix}") for c in df.columns if c not in keys])
        x, y, w, h = (F.col(f"{c}_{suffix}") for c in ("x", "y", "w", "h"))
        solid = named.where((w > 0) & (h > 0))
        wide = solid.withColumn("_tx", F.explode(F.sequence(F.floor(x / size), F.floor((x + w - 1) / size))))
        return wide.withColumn("_ty", F.explode(F.sequence(F.floor(y / size), F.floor((y + h - 1) / size))))

    pairs = tiled(left, "l").join(merged(tiled(right, "r")), [*keys, "_tx", "_ty"])
    left_edge, top_edge = F.greatest("x_l", "x_r"), F.greatest("y_l", "y_r")
    hit = (left_edge < F.least(F.col("x_l") + F.col("w_l"), F.col("x_r") + F.col("w_r"))) & (
        top_edge < F.least(F.col("y_l") + F.col("h_l"), F.col("y_r") + F.col("h_r"))
    )
    once = (F.floor(left_edge / size) == F.col("_tx")) & (F.floor(top_edge / size) == F.col("_ty"))
    return pairs.where(hit & once).drop("_tx", "_ty")


def check_geometry(blocks: DataFrame, cells: DataFrame, strips: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells that leave their block or run into a protected number strip."""
    outer = spread(blocks, *keys).select(
        *keys, "block_index", F.element_at("cols", 1).alias("_l"), F.element_at("rows", 1).alias("_t"),
        F.element_at("cols", -1).alias("_r"), F.element_at("rows", -1).alias("_b"),
    )
    inner = cells.select(*keys, "block_index", "question", "choice", F.col("ix").alias("x"), F.col("iy").alias("y"), F.col("iw").alias("w"), F.col("ih").alias("h"))
    leaves = inner.join(merged(outer), [*keys, "block_index"]).where(
        (F.col("x") < F.col("_l")) | (F.col("y") < F.col("_t")) | (F.col("x") + F.col("w") > F.col("_r")) | (F.col("y") + F.col("h") > F.col("_b"))
    ).select(*keys, "question", "choice", F.lit("leaves_block").alias("rule"))
    hits = overlap_join(inner.drop("block_index"), strips.select(*keys, "x", "y", "w", "h"), keys)
    return leaves.unionByName(hits.select(*keys, F.col("question_l").alias("question"), F.col("choice_l").alias("choice"), F.lit("overlaps_number_strip").alias("rule")).distinct())


def geometry_drift(persisted: DataFrame, derived: DataFrame) -> DataFrame:
    """Persisted rectangles that the template no longer gives."""
    return persisted.exceptAll(derived.select(*persisted.columns))


def offset_drift(blocks: DataFrame, offsets: DataFrame, keys: Sequence[str], compared: Sequence[str] = ("ix", "iy")) -> DataFrame:
    """``geometry_drift`` of ``shifted_cells`` against ``cell_rects``, by what ``compared`` names, without a shuffle of cells.

    Within a block a cell has one counterpart, which it meets where both are
    spelled out. Only templates that have a question in two blocks (or a block
    twice) may lose a cell to another block: their cells are counted off.
    """
    placed = spread(_placed(blocks.where("question_start <= question_end"), offsets, keys), *keys)
    by_start = Window.partitionBy(*keys).orderBy("question_start")
    before = F.max("question_end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    shared = F.bool_or(yes(F.col("_before") >= F.col("question_start"))).over(Window.partitionBy(*keys))
    placed = placed.withColumn("_before", before).withColumn("_shared", shared).drop("_before")
    columns = [*keys, "question", "choice", *compared]
    spelled = cell_rects(placed.where(~F.col("_shared")), keys, carried=("shift_x", "shift_y"))
    moved = _at_offset(spelled.withColumns({f"_{name}": F.col(name) for name in compared}), "ix", "iy")
    stays = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in compared]
    alone = moved.where(~reduce(Column.__and__, stays)).select(*columns)
    twice = placed.where("_shared")
    held = _at_offset(cell_rects(twice, keys, carried=("shift_x", "shift_y")), "ix", "iy")
    given = cell_rects(spread(blocks, *keys).join(merged(twice.select(*keys)), list(keys), "left_semi"), keys)
    return alone.unionByName(geometry_drift(held.select(*columns), given))


def check_template(blocks: DataFrame, templates: DataFrame, keys: Sequence[str], inset: int = 4) -> DataFrame:
    """Block rules, then coverage of 1..n exactly once and overlap between blocks.

    ``templates``: keys, width, height, question_count, choice_count.
    """
    increasing = lambda name: F.forall(
        F.sequence(F.lit(2), F.greatest(F.size(name), F.lit(2))), lambda i: yes(F.try_element_at(name, i) > F.try_element_at(name, i - 1))
    )
    span = 2 * inset + MIN_CELL_CORE
    wide = lambda name: F.forall(
        F.sequence(F.lit(2), F.greatest(F.size(name), F.lit(2))), lambda i: yes(F.try_element_at(name, i) - F.try_element_at(name, i - 1) >= span)
    )
    blocks = spread(blocks, *keys)
    joined = blocks.join(merged(templates.select(*keys, "width", "height", "question_count", F.col("choice_count").alias("_choices"))), list(keys))
    per_block = violations(
        joined, [*keys, "block_index"],
        {
            "choice_count": ~yes(F.col("choice_count").between(2, 5)) | (F.col("choice_count") != F.col("_choices")),
            "row_range": ~yes(F.col("question_end") - F.col("question_start") + 1 == F.col("row_count")) | (F.col("row_count") < 1),
            "boundary_count": ~yes((F.size("cols") == F.col("choice_count") + 1) & (F.size("rows") == F.col("row_count") + 1)),
            "not_increasing": ~(increasing("cols") & increasing("rows")),
            "out_of_bounds": (F.array_min("cols") < 0) | (F.array_max("cols") > F.col("width")) | (F.array_min("rows") < 0) | (F.array_max("rows") > F.col("height")),
            "cell_too_small": ~(wide("cols") & wide("rows")),
        },
    )
    covered = expand_range(blocks, "question_start", "question_end", "question").groupBy(*keys, "question").agg(F.count(F.lit(1)).alias("_n"))
    twice = covered.where("_n > 1").select(*keys).distinct().withColumn("rule", F.lit("question_twice"))
    counted = covered.join(merged(templates.select(*keys, "question_count")), list(keys)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("question").alias("_low"), F.max("question").alias("_high"), F.max("question_count").alias("_want")
    )
    gaps = counted.where((F.col("_n") != F.col("_want")) | (F.col("_low") != 1) | (F.col("_high") != F.col("_want"))).select(*keys).withColumn("rule", F.lit("coverage"))
    frames = blocks.select(
        *keys, "block_index", F.array_min("cols").alias("x"), F.array_min("rows").alias("y"),
        (F.array_max("cols") - F.array_min("cols")).alias("w"), (F.array_max("rows") - F.array_min("rows")).alias("h"),
    )
    crossed = overlap_join(frames, frames, keys, 256).where("block_index_l < block_index_r").select(*keys).distinct().withColumn("rule", F.lit("blocks_overlap"))
    whole = twice.unionByName(gaps).unionByName(crossed).withColumn("block_index", F.lit(None).cast("int"))
    return per_block.unionByName(whole.select(*per_block.columns))


def template_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest boundary error and frame overlap between two versions of a layout, per template."""
    lines = lambda df, name: spread(df, *keys).select(
        *keys, "block_index", F.concat(F.transform("cols", lambda v: v.cast("bigint")), F.transform("rows", lambda v: v.cast("bigint"))).alias(name)
    )
    pairs = lines(left, "_lines").join(merged(lines(right, "_others")), [*keys, "block_index"])
    apart = F.array_max(F.zip_with("_lines", "_others", lambda a, b: F.abs(a - b)))  # lines that one side lacks give NULL
    error = pairs.where((F.size("_lines") > 0) & (F.size("_others") > 0)).groupBy(*keys).agg(F.max(apart).alias("max_error"))
    box = lambda df, s: spread(df, *keys).groupBy(*keys).agg(
        F.min(F.element_at("cols", 1)).alias(f"l{s}"), F.max(F.element_at("cols", -1)).alias(f"r{s}"),
        F.min(F.element_at("rows", 1)).alias(f"t{s}"), F.max(F.element_at("rows", -1)).alias(f"b{s}"),
    )
    both = error.join(merged(box(left, "1")), list(keys)).join(merged(box(right, "2")), list(keys))
    zero = F.lit(0).cast("bigint")
    common = F.greatest(zero, F.least("r1", "r2") - F.greatest("l1", "l2")) * F.greatest(zero, F.least("b1", "b2") - F.greatest("t1", "t2"))
    area = (F.col("r2") - F.col("l2")) * (F.col("b2") - F.col("t2"))
    ratio = F.round(F.coalesce(F.try_divide(common.cast("double"), area.cast("double")), F.lit(0.0)), 6)
    return both.select(*keys, "max_error", ratio.alias("overlap"), ((F.col("max_error") == 0) & (common == area)).alias("geometry_match"))


def latest_templates(templates: DataFrame) -> DataFrame:
    """Newest version per template that is not deleted; built-in ids missing from the table are added."""
    newest = top(templates.where("deleted = 0"), ["template_id"], [F.col("version").desc()]).select("template_id", "version", "name", "kind")
    spark = templates.sparkSession
    builtins = spark.createDataFrame([(t, 1, t, "builtin") for t in BUILTIN_TEMPLATES], "template_id string, version bigint, name string, kind string")
    return newest.unionByName(builtins.join(newest.select("template_id"), "template_id", "left_anti"))


def resolve_template(exams: DataFrame, templates: DataFrame) -> DataFrame:
    """Exact version, newest version when none is asked for, else the default layout."""
    alive = templates.where("deleted = 0").select("template_id", "version", "row_id")
    newest = top(alive, ["template_id"], [F.col("version").desc()]).select("template_id", F.col("version").alias("_newest"), F.col("row_id").alias("_newest_row"))
    exact = alive.select("template_id", F.col("version").alias("template_version"), F.col("row_id").alias("_row"))
    joined = exams.join(exact, ["template_id", "template_version"], "left").join(newest, "template_id", "left")
    unset = F.col("template_version").isNull()
    row = F.when(unset, F.col("_newest_row")).otherwise(F.col("_row"))
    builtin = F.col("template_id").isin(*BUILTIN_TEMPLATES)
    found = ~builtin & row.isNotNull()
    return joined.select(
        "exam_id", F.when(builtin | found, F.col("template_id")).otherwise(F.lit(DEFAULT_TEMPLATE)).alias("template_id"),
        F.when(found, F.when(unset, F.col("_newest")).otherwise(F.col("template_version"))).cast("bigint").alias("version"),
        F.when(found, row).alias("template_row"),
    )


def template_usage(templates: DataFrame, exams: DataFrame) -> DataFrame:
    """Templates that may not be deleted: referenced by an exam, or built in."""
    used = templates.join(exams.select("template_id").distinct(), "template_id", "left_semi").select("template_id")
    return used.unionByName(templates.where("kind = 'builtin'").select("template_id")).distinct()


def renumber_blocks(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Contiguous question ranges in block order (a template has a handful of blocks)."""
    before = Window.partitionBy(*keys).orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("row_count").over(before), F.lit(0)) + 1
    return blocks.select(*keys, "block_index", start.alias("question_start"), (start + F.col("row_count") - 1).alias("question_end"))


def cluster_gaps(values: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Islands of values no more than ``gap`` apart, each with its rounded mean.

    Equal values are counted before the shuffle. Values are cut into slices;
    whether a slice's first island is the end of the one before tells the last
    value of the slice before, so a group with all values is split as well.
    """
    counted = values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n"))
    marked = previous(sliced(counted, [*keys, "value"], "values"), keys, "value", "value", "_prev")
    marked = marked.withColumn("_fresh", F.when(F.col("value") - F.col("_prev") <= gap, 0).otherwise(1).cast("bigint"))
    marked = running(marked, keys, "value", "_fresh", "island")
    return marked.groupBy(*keys, "island").agg(
        F.bround(F.sum(F.col("value") * F.col("_n")).cast("double") / F.sum("_n"), 0).cast("bigint").alias("line"), F.sum("_n").alias("members")
    )


def longest_regular_run(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest run of lines spaced 0.5 to 1.7 times the median spacing; the first wins a tie.

    The median uses spacings of 25 to 220 when there are any, else all. Lines
    are cut into slices; a run that goes over the border of two slices is one.
    """
    spaced = previous(sliced(lines.select(*keys, "line").distinct(), [*keys, "line"], "lines"), keys, "line", "line", "_prev")
    spaced = spaced.where(F.col("_prev").isNotNull()).withColumn("gap", F.col("line") - F.col("_prev"))
    usual = exact_median(spaced.where(F.col("gap").between(25, 220)), keys, "gap", "_usual")
    every = exact_median(spaced, keys, "gap", "_every")
    middle = every.join(usual, list(keys), "left").select(*keys, F.coalesce("_usual", "_every").alias("spacing"))
    joined = spaced.join(middle, list(keys)).withColumn("_ok", (F.col("gap") >= 0.5 * F.col("spacing")) & (F.col("gap") <= 1.7 * F.col("spacing")))
    islands = running(joined.withColumn("_break", F.when(F.col("_ok"), 0).otherwise(1).cast("bigint")), keys, "line", "_break", "_island")
    runs = islands.where("_ok").groupBy(*keys, "_island", "spacing").agg(
        F.count(F.lit(1)).alias("intervals"), F.min("_prev").alias("first_line"), F.max("line").alias("last_line")
    )
    return top(runs, list(keys), [F.col("intervals").desc(), F.col("first_line")]).drop("_island")


_CORNERS = [f"{axis}{i}" for i in (1, 2, 3, 4) for axis in ("x", "y")]


def dedupe_near(candidates: DataFrame, tolerance: float) -> DataFrame:
    """Keep the strongest corner proposal of every near-identical set, with all supporting methods.

    ``candidates``: image_id, candidate_id, proposal_score, method and x1..y4.
    The result is that of going through an image's proposals by score (then id)
    and keeping each that is near none kept before; a proposal that is not kept
    supports the first kept one it is near. That is the lexicographically first
    maximal independent set of the nearness graph, found in rounds: a proposal is
    kept when nothing undecided, near and stronger is left, and all near it are
    absorbed. Proposals near each other have centres no further apart, so only
    neighbouring spatial tiles meet and one image is spread over many tasks.
    Proposals in one small cell of corner positions are all near each other, so
    only the strongest of a cell asks; no pairs of a crowded spot are formed.
    """
    strength = F.struct((-F.col("proposal_score")).alias("weak"), "candidate_id")
    cells = [F.floor(F.col(c) / (tolerance / 1.5)).alias(f"_{c}") for c in _CORNERS]
    merged = candidates.groupBy("image_id", *_CORNERS).agg(
        F.max("proposal_score").alias("proposal_score"), F.min("candidate_id").alias("candidate_id"), F.array_sort(F.collect_set("method")).alias("methods")
    )
    centre = lambda axis: F.floor(sum(F.col(f"{axis}{i}") for i in (1, 2, 3, 4)) / 4.0 / tolerance)
    whole = cut(merged.select("*", strength.alias("_order"), F.xxhash64(*cells).alias("_cell"), centre("x").alias("_tx"), centre("y").alias("_ty")), "proposals")
    undecided = whole.select("image_id", *_CORNERS, "_order", "_cell", "_tx", "_ty")
    kept: list[DataFrame] = []
    while not undecided.isEmpty():
        asking = top(undecided, ["image_id", "_cell"], [F.col("_order")])
        blocked = _met(asking, undecided, tolerance).where(F.col("_other") < F.col("_order")).select("image_id", "_order").distinct()
        winners = cut(asking.join(blocked, ["image_id", "_order"], "left_anti"), "winners")
        kept.append(winners)
        absorbed = _met(winners, undecided, tolerance).select("image_id", F.col("_other").alias("_order")).distinct()
        undecided = cut(undecided.join(absorbed, ["image_id", "_order"], "left_anti"), "undecided")
    if not kept:
        return whole.select("image_id", "candidate_id", "proposal_score", F.lit("").alias("methods"))
    chosen = reduce(DataFrame.unionByName, kept)
    first = _met(chosen, whole.select("image_id", *_CORNERS, "_order", "_tx", "_ty"), tolerance)
    first = first.groupBy("image_id", F.col("_other").alias("_own")).agg(F.min("_order").alias("_order"))
    support = first.join(whole.select("image_id", F.col("_order").alias("_own"), F.explode("methods").alias("method")), ["image_id", "_own"])
    names = support.groupBy("image_id", "_order").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))
    return names.select("image_id", "_order.candidate_id", (-F.col("_order.weak")).alias("proposal_score"), "methods")


def _met(few: DataFrame, many: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of one image within ``tolerance`` (itself included): the row of ``few`` and ``_other``, the rank of the row of ``many``."""
    near = F.explode(F.array(*[F.struct((F.col("_tx") + i).alias("tx"), (F.col("_ty") + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = few.select("image_id", "_order", *_CORNERS, near.alias("_tile")).select("image_id", "_order", *_CORNERS, "_tile.tx", "_tile.ty")
    right = many.select("image_id", F.col("_order").alias("_other"), *[F.col(c).alias(f"o{c}") for c in _CORNERS], F.col("_tx").alias("tx"), F.col("_ty").alias("ty"))
    apart = sum(F.sqrt(sum((F.col(f"{axis}{i}") - F.col(f"o{axis}{i}")) * (F.col(f"{axis}{i}") - F.col(f"o{axis}{i}")) for axis in ("x", "y"))) for i in (1, 2, 3, 4)) / 4.0
    return left.join(right, ["image_id", "tx", "ty"]).where(apart <= tolerance).select("image_id", "_order", "_other")


def grid_cells(pages: DataFrame, grid: tuple[float, float, float, float], ink: tuple[float, float, float, float], size: int = 10) -> DataFrame:
    """``size`` x ``size`` labelled boxes per page (``page_id, width, height``), rounded half to even."""
    r = lambda value: F.bround(value, 0).cast("int")
    x1, y1, x2, y2 = r(grid[0] * F.col("width")), r(grid[1] * F.col("height")), r(grid[2] * F.col("width")), r(grid[3] * F.col("height"))
    rows = pages.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))))
    row, column = F.floor(F.col("cell") / size), F.col("cell") % size
    cw, ch = (x2 - x1) / float(size), (y2 - y1) / float(size)
    boxes = rows.select(
        "page_id", "cell", F.lpad(F.col("cell").cast("string"), 2, "0").alias("label"),
        r(x1 + column * cw).alias("x1"), r(y1 + row * ch).alias("y1"), r(x1 + (column + 1) * cw).alias("x2"), r(y1 + (row + 1) * ch).alias("y2"),
    )
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return boxes.withColumns(
        {"ix1": F.col("x1") + r(w * ink[0]), "iy1": F.col("y1") + r(h * ink[1]), "ix2": F.col("x1") + r(w * ink[2]), "iy2": F.col("y1") + r(h * ink[3])}
    )

