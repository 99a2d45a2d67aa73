"""Boxes beside the captions and lines of their page.

The nearest line is searched in blocks of a page, without a row for each pair (``pages``); ties
go to the first line. The other joins are equi-joins on the page with a residual condition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions import text as t
from leafgrid.functions.geometry import Box
from leafgrid.operators import pages as p

#: Search window, price of the wrong side, least overlap and its price. Fixed values.
WINDOW, WRONG_SIDE, FAR_ASIDE = 300.0, 120.0, 50.0


def candidates(lines: DataFrame) -> DataFrame:
    """Lines that are captions, with their kind, number and part."""
    text = F.col("text")
    rows = lines.withColumn("kind", t.caption_kind(text)).where("kind is not null")
    return rows.withColumn("number", t.figure_number(text)).withColumn("label", t.part_label(text))


def beside(items: DataFrame, lines: DataFrame, page: list[str], carry: tuple[str, ...]) -> DataFrame:
    """Each item with each line of its page; the line's box is under l_, its other columns under their names with l_."""
    own = lines.select(*page, *(F.col(c).alias("l_" + c) for c in (*Box._fields, "line_no", *carry)))
    return items.join(own, page)


def nearest_kind(items: DataFrame, captions: DataFrame, page: list[str], key: list[str], for_tables: bool = False) -> DataFrame:
    """Key, kind and distance of each item's nearest caption; null beyond the window or without captions.

    For figures a caption aside (little shared width) costs more, for tables one that
    shares little area.
    """

    def run(rows, lines):
        a, b = p.corners(rows), p.corners(lines, "l_")

        def parts(own, part):
            x, y = p.at_boxes(a, own), p.at_lines(b, part)
            gap, below, above = p.gap_sides(x, y)
            aside = p.overlap(x, y) < 0.1 if for_tables else p.across(x, y) < 0.2
            return gap, gap + np.where(below if for_tables else above, WRONG_SIDE, 0.0) + np.where(aside, FAR_ASIDE, 0.0)

        _, at = p.least(rows.num_rows, lines.num_rows, lambda own, part: parts(own, part)[1])
        gap = _gap_at(a, b, at)
        near = gap <= WINDOW
        return p.taken(lines, "l_kind", np.where(near, at, -1)), pa.array(gap, mask=~near)

    lines = captions.select(*page, *Box._fields, "line_no", "kind")
    return p.beside_each(items.select(*page, *_beyond(key, page), *_missing(key)), lines, page, ["line_no"], _same, run, "kind string, distance double").select(*key, "kind", "distance")


def _same(lines):
    return lines


def _beyond(key: list[str], page: list[str]) -> list[str]:
    return [k for k in key if k not in page]


def _missing(names: list[str]) -> list[str]:
    """The corners that are not among the names."""
    return [x for x in Box._fields if x not in names]


def _gap_at(a: p.Corners, b: p.Corners, at: np.ndarray) -> np.ndarray:
    """The vertical gap between boxes and their lines, NaN where there is none."""
    if not len(b[0]):
        return np.full(len(at), np.nan)
    return np.where(at < 0, np.nan, p.gap_sides(a, tuple(x[at] for x in b))[0])


def signature(items: DataFrame, captions: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Key and text of each item's nearest caption by a score within the window; empty for none."""
    return signed(items.select(*page, *_beyond(key, page), *_missing(key)), captions, page).select(*key, "signature")


def signed(items: DataFrame, captions: DataFrame, page: list[str]) -> DataFrame:
    """Items with ``signature``."""

    def run(rows, lines):
        a, b = p.corners(rows), p.corners(lines, "l_")

        def score(own, part):
            x, y = p.at_boxes(a, own), p.at_lines(b, part)
            return p.gap_sides(x, y)[0] + np.where(p.across(x, y) < 0.2, FAR_ASIDE, 0.0)

        best, at = p.least(rows.num_rows, lines.num_rows, score)
        return (p.taken(lines, "l_text", np.where(best <= WINDOW, at, -1)).fill_null(""),)

    lines = captions.select(*page, *Box._fields, "line_no", "text")
    return p.beside_each(items, lines, page, ["line_no", "text"], _same, run, "signature string")


def nearest_line(items: DataFrame, captions: DataFrame, page: list[str]) -> DataFrame:
    """Items with ``line_no`` of their nearest caption, one above counting 100 more; null on pages without captions."""

    def run(rows, lines):
        a, b = p.corners(rows), p.corners(lines, "l_")

        def score(own, part):
            x, y = p.at_boxes(a, own), p.at_lines(b, part)
            return p.distance(x, y) + np.where(p.stands_above(x, y), 100.0, 0.0)

        _, at = p.least(rows.num_rows, lines.num_rows, score)
        # where nothing can be measured, the first line of the page
        return (p.taken(lines, "l_line_no", np.maximum(at, 0 if lines.num_rows else -1)),)

    lines = captions.select(*page, *Box._fields, "line_no")
    return p.beside_each(items, lines, page, ["line_no"], _same, run, f"line_no {dict(lines.dtypes)['line_no']}")


def distances(items: DataFrame, captions: DataFrame, page: list[str]) -> DataFrame:
    """Items with ``far``, the distance of the nearest caption of their type, one above counting 100 more, and ``any_far``, that of the
    nearest of any kind; null for none."""

    def run(rows, lines):
        a, b = p.corners(rows), p.corners(lines, "l_")
        n, m = rows.num_rows, lines.num_rows
        any_far = p.least(n, m, lambda own, part: p.distance(p.at_boxes(a, own), p.at_lines(b, part)))[0]
        far = np.full(n, np.inf)
        for kind in ("figure", "table"):
            mine, those = np.flatnonzero(p.equals(rows, "type", kind)), np.flatnonzero(p.equals(lines, "l_kind", kind))
            x_, y_ = tuple(v[mine] for v in a), tuple(v[those] for v in b)

            def score(own, part, x_=x_, y_=y_):
                x, y = p.at_boxes(x_, own), p.at_lines(y_, part)
                return p.distance(x, y) + np.where(p.stands_above(x, y), 100.0, 0.0)

            far[mine] = p.least(mine.size, those.size, score)[0]
        return pa.array(far, mask=np.isinf(far)), pa.array(any_far, mask=np.isinf(any_far))

    lines = captions.select(*page, *Box._fields, "line_no", "kind")
    return p.beside_each(items, lines, page, ["line_no"], _same, run, "far double, any_far double")


def indexed(items: DataFrame, page: list[str]) -> DataFrame:
    """Items with their place on the page among those of their type, from 0, by row and column."""
    w = Window.partitionBy(*page, "type").orderBy("y0", "x0", "ord")
    return items.withColumn("item_index", F.row_number().over(w) - 1)


def aligned(items: DataFrame, captions: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Key, caption, its line, its type, the part's label and the item's final type.

    Score: gap, price of the wrong side, less 30 for a caption of the item's type and 50
    or 20 for a number that is the item's place or next to it. The final type is the
    caption's where it has one.
    """

    def run(rows, lines):
        a, b = p.corners(rows), p.corners(lines, "l_")
        kinds = [(p.equals(rows, "type", k), p.equals(lines, "l_kind", k)) for k in ("figure", "table")]
        place, number = p.floats(rows, "item_index"), p.floats(lines, "l_number")
        (figure, figures), (table, tables) = kinds

        def bonus(own, number, figures, tables):
            matching = np.where((figure[own, None] & figures) | (table[own, None] & tables), 30.0, 0.0)
            off = np.abs(number - 1 - place[own, None])
            return matching, np.where(number < 0, 0.0, np.where(off == 0, 50.0, np.where(off <= 1, 20.0, 0.0)))

        def score(own, part):
            gap, below, above = p.gap_sides(p.at_boxes(a, own), p.at_lines(b, part))
            wrong = np.where((figure[own, None] & above) | (table[own, None] & below), WRONG_SIDE, 0.0)
            matching, numbered = bonus(own, number[None, part], figures[None, part], tables[None, part])
            return np.where(gap < WINDOW, gap + wrong - matching - numbered, np.inf)

        # no score is below what the best kind and number on the page would take off it
        n, classes = rows.num_rows, np.unique(np.stack([number, figures, tables]), axis=1)
        floor = np.full(n, -80.0)
        if 0 < classes.shape[1] <= 64:
            floor = -sum(bonus(np.arange(n), classes[0][None], classes[1][None] > 0, classes[2][None] > 0)).max(1)
        _, at = p.least(n, lines.num_rows, score, floor)
        return tuple(p.taken(lines, "l_" + c, at) for c in ("text", "line_no", "label"))

    placed = items if "item_index" in items.columns else indexed(items, page)
    lines = captions.select(*page, *Box._fields, "line_no", "text", "kind", "number", "label")
    own = placed.select(*page, *_beyond(key, page), *_missing(key), "type", "item_index")
    out = p.beside_each(own, lines, page, ["line_no", "text", "label"], _same, run, f"b_text string, b_line_no {dict(lines.dtypes)['line_no']}, b_label string")
    kind = t.caption_type(F.col("b_text"))
    return out.select(
        *key, F.coalesce("b_text", F.lit("No matching caption found.")).alias("caption"), F.col("b_line_no").alias("line_no"),
        F.col("b_label").alias("label"), F.when(kind != "", kind).otherwise(F.col("type")).alias("final_type"),
        F.coalesce((kind != "") & (kind != F.col("type")), F.lit(False)).alias("overridden"),
    )


def captioned(items: DataFrame, captions: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Key, caption and label of items with ``boxless``: the best caption; the first of the page for an item without a box, null
    if there is none; what is said of an item on a page without captions, and of one without a matching caption."""
    first = captions.groupBy(*page).agg(F.min_by(F.struct("text", "label"), "line_no").alias("first"))
    best = aligned(items.where("not boxless"), captions, page, key).select(*key, F.col("caption").alias("best"), F.col("label").alias("best_label"))
    rows = items.select(*key, "boxless").join(first, page, "left").join(best, key, "left")
    said = F.when(F.col("boxless"), F.col("first.text")).when(F.col("first").isNull(), F.lit("No caption found.")).otherwise(F.col("best"))
    return rows.select(*key, said.alias("caption"), F.when(F.col("boxless"), F.col("first.label")).otherwise(F.col("best_label")).alias("label"))


def joined_text(rows: DataFrame, key: list[str], sep: str, name: str) -> DataFrame:
    """Texts of lines in the order of their numbers as one text for each key."""
    ordered = F.array_sort(F.collect_list(F.struct("l_line_no", "l_text")))
    return rows.groupBy(*key).agg(F.concat_ws(sep, F.transform(ordered, lambda s: s["l_text"])).alias(name), F.count("*").alias("n_lines"))


def _texts(items: DataFrame, lines: DataFrame, page: list[str], key: list[str], pad: float, meets, name: str) -> DataFrame:
    """Key, text and number of the lines that ``meets`` finds at each item that has any, none being more than ``pad`` above or below it."""

    def prepare(lines):
        b, order, tallest = p.by_height(lines)
        return b, order, tallest, p.taken(lines, "l_text", np.arange(lines.num_rows))

    def run(rows, ready):
        a, (b, order, tallest, texts) = p.corners(rows), ready
        counts, who, what = np.zeros(rows.num_rows, np.int64), [], []
        for own, part in p.bands(a[1] - pad, a[3] + pad, b[1], tallest):
            i, k = np.nonzero(meets(p.at_boxes(a, own), p.at_lines(b, part)))
            who.append(own[i])
            what.append(order[part][k])
        if not who:
            return pa.nulls(rows.num_rows, pa.string()), pa.array(counts)
        who, what = np.concatenate(who), np.concatenate(what)
        place = np.lexsort((what, who))
        who, what = who[place], what[place]
        counts += np.bincount(who, minlength=rows.num_rows)
        found = texts.take(pa.array(what))
        if found.null_count:
            there = found.is_valid().to_numpy(zero_copy_only=False)
            who, found = who[there], found.drop_null()
        ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=rows.num_rows))])
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), found.cast(pa.large_string()))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())), pa.array(counts)

    own = items.select(*page, *_beyond(key, page), *_missing(key))
    out = p.beside_each(own, lines.select(*page, *Box._fields, "line_no", "text"), page, ["line_no", "text"], prepare, run, f"{name} string, n_lines long", most=500)
    return out.where("n_lines > 0").select(*key, name, "n_lines")


def nearby(items: DataFrame, lines: DataFrame, page: list[str], key: list[str], most: float) -> DataFrame:
    """Key and text of the lines within a distance of each item that has any."""
    return _texts(items, lines, page, key, most, lambda a, b: p.distance(a, b) <= most, "near")


def inside(items: DataFrame, lines: DataFrame, page: list[str], key: list[str]) -> DataFrame:
    """Key and text of the lines that an item overlaps."""
    return _texts(items, lines, page, key, 0.0, lambda a, b: p.intersection(a, b) > 0, "inside")


def coverage(items: DataFrame, lines: DataFrame, page: list[str], key: list[str], wide: float = 0.6) -> DataFrame:
    """Key, covered share of each item's area (at most 1) and the number of wide lines in it."""

    def run(rows, ready):
        a, (b, _, tallest) = p.corners(rows), ready
        part_, wide_ = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
        for own, part in p.bands(a[1], a[3], b[1], tallest):
            x, y = p.at_boxes(a, own), p.at_lines(b, part)
            shared = p.intersection(x, y)
            part_[own] = shared.sum(1)
            wide_[own] = ((shared > 0) & ((y[2] - y[0]) / np.maximum(1.0, x[2] - x[0]) >= wide)).sum(1)
        whole = p.area(a)
        return pa.array(np.where(whole > 0, np.minimum(1.0, p.ratio(part_, whole)), 0.0)), pa.array(wide_)

    own = items.select(*page, *_beyond(key, page), *_missing(key))
    return p.beside_each(own, lines.select(*page, *Box._fields, "line_no"), page, ["line_no"], p.by_height, run, "coverage double, wide_lines long").select(*key, "coverage", "wide_lines")


def text_region(covered: DataFrame, least: float = 0.35, lines: int = 2) -> Column:
    return (covered["coverage"] >= least) & (covered["wide_lines"] >= lines)


def barrier(a: Box, b: Box, line: Box, least: float = 0.6) -> Column:
    """A line crosses the gap between two boxes, stacked or side by side.

    Boxes that are stacked are tested as such; a stacked pair with a gap of at most 2 or
    without shared width has no barrier and is not tested as side by side.
    """
    stacked = (a.y1 <= b.y0) | (b.y1 <= a.y0)
    a_up = a.y0 < b.y0
    pick = lambda first, x, y: Box(*(F.when(first, p).otherwise(q) for p, q in zip(x, y, strict=True)))
    upper, lower = pick(a_up, a, b), pick(a_up, b, a)
    gap = Box(F.greatest(upper.x0, lower.x0), upper.y1, F.least(upper.x1, lower.x1), lower.y0)
    real = (gap.y1 > gap.y0 + 2) & (gap.x1 > gap.x0)
    over = lambda other: g.across_overlap(line, other, 1.0) >= least
    crossed = (g.intersection(gap, line) > 0) & over(gap) & over(upper) & over(lower)
    side = (a.x1 <= b.x0) | (b.x1 <= a.x0)
    a_left = a.x0 < b.x0
    left, right = pick(a_left, a, b), pick(a_left, b, a)
    slot = Box(left.x1, F.greatest(left.y0, right.y0), right.x0, F.least(left.y1, right.y1))
    open_ = (slot.x1 > slot.x0 + 2) & (slot.y1 > slot.y0)
    along = lambda other: g.down_overlap(line, other, 1.0) >= least
    cut = (g.intersection(slot, line) > 0) & along(slot) & along(left) & along(right)
    return F.when(stacked & real & crossed, True).when(stacked & ~real, False).otherwise(side & open_ & cut)


def multiline(lines: DataFrame, page: list[str], most_gap: float = 12.0, after: int = 3, before: int = 2) -> DataFrame:
    """Each caption line with its continuation and the lines around it.

    A caption goes on while the next line is no caption and begins at most ``most_gap``
    below. Breaks are numbered by a running sum, so that a caption and what
    continues it are one group. The snippet has two lines before and three after.
    """
    own = Window.partitionBy(*page).orderBy("line_no")
    starts = t.is_caption(F.col("text"))
    rows = lines.withColumn("place", F.row_number().over(own)).withColumn("starts", starts)
    gap = F.col("y0") - F.lag("y1").over(own)
    rows = rows.withColumn("breaks", F.col("starts") | F.coalesce(gap > most_gap, F.lit(True)))
    rows = rows.withColumn("run", F.sum(F.col("breaks").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*page, "run").agg(
        F.bool_or("starts").alias("is_caption"), F.min("place").alias("first"), F.count("*").alias("n"), F.min("line_no").alias("line_no"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"])).alias("caption"), *g.union_all(Box.of()),
    ).where("is_caption")
    line = rows.select(*page, F.col("place").alias("l_line_no"), F.col("text").alias("l_text"))
    around = runs.join(line, page).where((F.col("l_line_no") >= F.col("first") - before) & (F.col("l_line_no") < F.col("first") + F.col("n") + after))
    snippet = joined_text(around, [*page, "run"], "\n", "snippet").drop("n_lines")
    return runs.join(snippet, [*page, "run"]).drop("run", "is_caption", "first")
