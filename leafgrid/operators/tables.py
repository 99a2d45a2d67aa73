"""Regions of tables from ruled lines, text lines and captions, and the union of several ways to find tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions import text as t
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.operators import merging as m

CORNERS = Box._fields
#: A note under a table. Fixed value.
FOOTNOTE = r"(?iU)^\s*(note|notes|footnote|注|备注)\b"


def ruled_regions(segments: DataFrame, page: list[str], width: float, height: float, least_share: float = 0.3, lines: tuple[int, int] = (2, 8)) -> DataFrame:
    """Regions of tables with a few long rules: segments (x0, x1, y, seg_id) chained to rules within 6, rules to
    groups by gaps, and groups of ``lines`` rules padded and cut to the page."""
    w = Window.partitionBy(*page)
    long = segments.where(F.col("x1") - F.col("x0") >= int(width * least_share))
    rules = m.clusters(long, page, ["y", "seg_id"], F.col("y") - F.lag("y").over(w.orderBy("y", "seg_id")) > 6, "rule")
    rules = rules.groupBy(*page, "rule").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.avg("y").cast("int").alias("y"))
    gap = F.col("y") - F.lag("y").over(w.orderBy("y", "rule"))
    groups = m.clusters(rules, page, ["y", "rule"], gap > max(15, int(height * 0.08)), "run")
    k = groups.groupBy(*page, "run").agg(F.count("*").alias("n"), *(f(c).alias(n) for f, c, n in ((F.min, "x0", "x0"), (F.max, "x1", "x1"), (F.min, "y", "top"), (F.max, "y", "bottom"))))
    k = k.where(F.col("n").between(*lines)).withColumn("pad", F.greatest(F.lit(10), ((F.col("bottom") - F.col("top")) * 0.25).cast("int")))
    zero = F.lit(0.0)
    return k.select(
        *page, "n", F.greatest(zero, F.col("x0") - F.col("pad")).alias("x0"), F.greatest(zero, F.col("top") - F.col("pad")).alias("y0"),
        F.least(F.lit(float(width)), F.col("x1") + F.col("pad")).alias("x1"), F.least(F.lit(float(height)), F.col("bottom") + F.col("pad")).alias("y1"),
    )


def drifting_lines(segments: DataFrame, page: list[str], near: int = 10) -> DataFrame:
    """Segments in their order folded to lines (k, y, x0, x1): one less than ``near`` below a line joins it, widens it and
    moves it half way, so that the line drifts."""
    grouped = segments.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("all"))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        moved = F.struct(F.floor((last["y"] + s["y"]) / 2).cast("int").alias("y"), F.least(last["x0"], s["x0"]).alias("x0"), F.greatest(last["x1"], s["x1"]).alias("x1"))
        return F.when((F.size(acc) > 0) & (s["y"] - F.try_element_at(acc, F.lit(-1))["y"] < near), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(moved))).otherwise(F.concat(acc, F.array(s)))

    # the first segment begins the list, so that there always is a last line
    folded = F.aggregate(F.slice("all", 2, F.size("all")), F.slice(F.col("all"), 1, 1), step)
    return grouped.select(*page, F.posexplode(folded).alias("k", "s")).select(*page, "k", "s.*")


def simple_tables(lines: DataFrame, existing: DataFrame, page: list[str], width: float, height: float) -> DataFrame:
    """Three lines in a row with gaps between 20 and 300 that no existing box overlaps by more than a half."""
    w = Window.partitionBy(*page).orderBy("k")
    at = lambda c, n: F.lead(c, n).over(w)
    rows = lines.select(
        *page, "k", F.col("y").alias("l1"), at("y", 1).alias("l2"), at("y", 2).alias("l3"),
        F.least("x0", at("x0", 1), at("x0", 2)).alias("x0"), F.greatest("x1", at("x1", 1), at("x1", 2)).alias("x1"),
    ).where("l3 is not null and l2 - l1 > 20 and l2 - l1 < 300 and l3 - l2 > 20 and l3 - l2 < 300")
    zero = F.lit(0.0)
    box = Box(F.greatest(zero, F.col("x0")), F.greatest(zero, F.col("l1") - 10), F.least(F.lit(float(width)), F.col("x1")), F.least(F.lit(float(height)), F.col("l3") + 10))
    rows = rows.select(*page, "k", *box.named()).withColumn("score", F.lit(0.7))
    return uncovered(rows, existing, page, 0.5)


def uncovered(rows: DataFrame, existing: DataFrame, page: list[str], most: float) -> DataFrame:
    """Rows that no existing box of their page overlaps by more than ``most`` (IoU)."""
    other = existing.select(*(F.col(p).alias("e_" + p) for p in page), *(F.col(c).alias("e_" + c) for c in CORNERS))
    same = [rows[p] == other["e_" + p] for p in page]
    return rows.join(other, [*same, g.iou(Box.of(), Box.of("e_")) > most], "left_anti")


def widest_lines(segments: DataFrame, page: list[str], near: int = 5) -> DataFrame:
    """Segments in their order folded to lines (k, y, x0, x1): of those less than ``near`` from the kept one the wider stays."""
    grouped = segments.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("y", "x0", "x1"))).alias("all"))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = s["x1"] - s["x0"] > last["x1"] - last["x0"]
        head = F.slice(acc, 1, F.size(acc) - 1)
        return F.when(F.abs(s["y"] - last["y"]) < near, F.when(wider, F.concat(head, F.array(s))).otherwise(acc)).otherwise(F.concat(acc, F.array(s)))

    folded = F.aggregate(F.slice("all", 2, F.size("all")), F.slice(F.col("all"), 1, 1), step)
    return grouped.select(*page, F.posexplode(folded).alias("k", "s")).select(*page, "k", "s.*")


def missed_tables(lines: DataFrame, existing: DataFrame, page: list[str], ink, total: tuple[int, int] = (50, 500), least_gap: int = 20) -> DataFrame:
    """All triples of lines with like gaps that hold ink and that no existing table covers, each box once.

    A line meets the lines of its own and the next ranges of ``total[1]`` alone, so that a page of many
    lines makes no more triples than may pass.
    """
    reach = total[1]
    side = lambda n: lines.select(*page, *(F.col(c).alias(n + c) for c in ("k", "y", "x0", "x1")))
    ranged = lambda n, steps: side(n).withColumn("range", F.explode(F.array(*(F.floor(F.col(n + "y") / reach) - s for s in steps))))
    a, b, c = ranged("a", (0,)), ranged("b", (0, 1)), ranged("c", (0, 1))
    rows = a.join(b, [*page, "range"]).where(F.col("by") - F.col("ay") >= least_gap).join(c, [*page, "range"])
    rows = rows.where((F.col("cy") - F.col("by") >= least_gap) & (F.col("cy") - F.col("ay")).between(*total))
    up, down = F.col("by") - F.col("ay"), F.col("cy") - F.col("by")
    box = Box(F.least("ax0", "bx0", "cx0").cast("double"), (F.col("ay") - 5).cast("double"), F.greatest("ax1", "bx1", "cx1").cast("double"), (F.col("cy") + 5).cast("double"))
    rows = rows.where(F.least(up, down) / F.greatest(up, down) > 0.2).select(*page, "ak", "bk", "ck", *box.named()).where("x1 > x0").where(ink(Box.of()) > 0.05)
    left = uncovered(rows, existing, page, 0.3)
    order = [F.col(c).alias("o" + c) for c in ("ak", "bk", "ck")]
    return m.greedy_distinct(left, page, order, 0.7, ("ak", "bk", "ck"))


def refined(boxes: DataFrame, lines: DataFrame, page: list[str], least: int = 2, share: float = 0.5, pad: float = 8, least_area: float = 0.25) -> DataFrame:
    """Boxes of tables drawn in to the cluster of text lines that looks most like a table.

    Captions, notes and narrow lines do not count. A single line far above or below the others goes.
    Clusters end at gaps of more than 1.6 of the middle height (10 at least); that of the most lines, times how
    their widths and margins vary, counts, the upper one of equals. A box that would keep less than
    ``least_area`` of its area stays.
    """
    key = [*page, "ord"]
    item, line = Box.of(), Box.of("l_")
    said = F.trim("l_text")
    meets = (line.x1 > item.x0) & (line.x0 < item.x1) & (line.y1 > item.y0) & (line.y0 < item.y1)
    wide = g.width(line) / F.greatest(F.lit(1.0), g.width(item)) >= share
    rows = o.beside(boxes.select(*key, *CORNERS), lines, page, ("text",)).where(meets & wide & ~(t.is_caption(said) | said.rlike(FOOTNOTE)))
    whole = Window.partitionBy(*key)
    order = whole.orderBy("l_y0", "l_line_no")
    rows = rows.withColumns({"n": F.count("*").over(whole), "k": F.row_number().over(order)}).where(F.col("n") >= least)
    middle = rows.groupBy(*key).agg(m.upper_median(F.collect_list(F.col("l_y1") - F.col("l_y0"))).alias("mh"))
    rows = rows.join(middle, key).withColumn("limit", F.greatest(F.lit(10), (F.col("mh") * 1.6).cast("int")))
    # the first line, then the last of what is left, where they stand alone
    below = F.lead("l_y0").over(order) - F.col("l_y1")
    rows = rows.withColumn("drop_first", (F.col("k") == 1) & (F.col("n") > least) & (below > 2 * F.col("limit"))).where(~F.coalesce("drop_first", F.lit(False)))
    rows = rows.withColumns({"m": F.count("*").over(whole), "j": F.row_number().over(order)})
    above = F.col("l_y0") - F.lag("l_y1").over(order)
    rows = rows.withColumn("drop_last", (F.col("j") == F.col("m")) & (F.col("n") > least) & (F.col("m") >= 2) & (above > 2 * F.col("limit"))).where(~F.coalesce("drop_last", F.lit(False)))
    rows = rows.withColumn("left", F.count("*").over(whole)).where(F.col("left") >= least)
    runs = m.clusters(rows, key, ["l_y0", "l_line_no"], F.col("l_y0") - F.lag("l_y1").over(order) > F.col("limit"))
    width = F.col("l_x1") - F.col("l_x0")
    score = F.round(F.count("*") * (1 + m.variation(width) + m.variation(F.col("l_x0")) + m.variation(F.col("l_x1"))), 9)
    found = runs.groupBy(*key, "run").agg(F.count("*").alias("size"), score.alias("s"), *(f("l_" + c).alias("n" + c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    best = found.where(F.col("size") >= least).groupBy(*key).agg(F.max_by(F.struct(*("n" + c for c in CORNERS)), F.struct("s", -F.col("run"))).alias("b"))
    out = boxes.join(best, key, "left")
    b = Box.of()
    new = Box(F.greatest(b.x0, F.col("b.nx0") - pad), F.greatest(b.y0, F.col("b.ny0") - pad), F.least(b.x1, F.col("b.nx1") + pad), F.least(b.y1, F.col("b.ny1") + pad))
    fits = F.col("b").isNotNull() & F.coalesce(g.signed_area(new) >= g.signed_area(b) * least_area, F.lit(False))
    return out.select(*key, *(F.when(fits, n).otherwise(old).alias(c) for c, n, old in zip(CORNERS, new, b, strict=True)), fits.alias("refined"))


def caption_regions(captions: DataFrame, page: list[str], width: float, height: float, reach: float = 0.6, least: float = 40) -> DataFrame:
    """Where the table of each table caption may be: below it, down to the next caption, then above it; ``choice`` 1 and 2."""
    w = Window.partitionBy(*page).orderBy("y0", "line_no")
    end = F.least(F.lit(float(height)), F.col("y1") + height * reach)
    below = F.struct(F.lit(1).alias("choice"), F.col("y1").alias("top"), F.least(end, F.lead("y0").over(w)).alias("bottom"))
    above = F.struct(F.lit(2).alias("choice"), F.greatest(F.lit(0.0), F.col("y0") - height * reach).alias("top"), F.col("y0").alias("bottom"))
    both = captions.where("kind = 'table'").select(*page, "line_no", below.alias("below"), above.alias("above"))
    rows = both.select(*page, "line_no", F.explode(F.array("below", "above")).alias("r")).select(*page, "line_no", "r.*").where(F.col("bottom") - F.col("top") > least)
    return rows.select(*page, "line_no", "choice", F.lit(0.0).alias("x0"), F.col("top").alias("y0"), F.lit(float(width)).alias("x1"), F.col("bottom").alias("y1"))


def has_cells(grid: Column) -> Column:
    """A grid with a cell that is not empty."""
    return F.exists(grid, lambda row: F.exists(row, lambda c: F.coalesce(c != "", F.lit(False))))


def best_strategy(found: DataFrame, page: list[str]) -> DataFrame:
    """The strategy that found most tables on each page; of equals the first by ``rank``. found: strategy, rank."""
    n = found.groupBy(*page, "strategy", "rank").agg(F.count("*").alias("n"))
    return n.groupBy(*page).agg(F.min_by(F.struct("strategy", "n"), F.struct((-F.col("n")).alias("s"), "rank")).alias("b")).select(*page, "b.*")


def first_success(tried: DataFrame, key: list[str]) -> DataFrame:
    """The first of the settings tried, by ``rank``, whose grid has a cell."""
    return tried.where(has_cells(F.col("grid"))).groupBy(*key).agg(F.min_by(F.struct("strategy", "grid"), "rank").alias("b")).select(*key, "b.*")


def enhanced(existing: DataFrame, candidates: DataFrame, page: list[str], least_score: float = 0.5, most: float = 0.3, share: float = 0.05) -> DataFrame:
    """Existing tables and the sure candidates that none of them covers, drawn in by ``share`` of each side."""
    added = uncovered(candidates.where(F.col("score") >= least_score), existing, page, most)
    small = g.shrink(Box.of(), share)
    added = added.select(*page, "ord", *small.named(), "score", F.lit(True).alias("added"))
    return existing.select(*page, "ord", *CORNERS, "score", F.lit(False).alias("added")).unionByName(added)


def table_items(strategies: list[DataFrame], doc: str, page: list[str], cells: Column, reason, most: float = 0.7) -> DataFrame:
    """The tables of several strategies, in their order, as items: copies go or take the place of worse ones, invalid ones
    go, the others are numbered. Each strategy gives page, corners, score, source and what ``reason`` looks at."""
    rows = None
    for k, found in enumerate(strategies):
        own = found.withColumn("strategy_no", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    ordered = rows.withColumn("seq", F.row_number().over(Window.partitionBy(*page).orderBy("strategy_no", "ord")))
    carry = tuple(c for c in ordered.columns if c not in (*page, *CORNERS, "score"))
    kept = m.replacing_distinct(ordered.withColumn("best", F.col("score")), page, [(-F.col("score")).alias("o1"), F.col("seq").alias("o2")], cells, most, (*carry, "best"))
    valid = kept.withColumnRenamed("best", "score").withColumn("reason", reason).where("reason is null")
    number = F.row_number().over(Window.partitionBy(doc).orderBy(*[p for p in page if p != doc], "place"))
    return valid.withColumn("item_id", F.format_string("table_%04d", number)).drop("reason")
