"""Stages that turn candidate boxes of a page into figures: groups under captions, visual groups, splits and drops.

Features that pixels give (ink, whether two boxes are joined by a line, how alike they look)
enter as columns, so that every stage stays declarative.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.operators import merging as m
from leafgrid.session import staged

CORNERS = Box._fields
#: Farthest parts of a subfigure group, how far their sizes may differ; the same for visual groups. Fixed values.
GROUP_DISTANCE, GROUP_SPREAD = 100.0, 4.0
VISUAL_DISTANCE, VISUAL_GROWTH, VISUAL_LIKENESS, LINK_DISTANCE = 150.0, 3.0, 0.3, 200.0


def nearest_caption(rows: DataFrame, captions: DataFrame, page: list[str]) -> DataFrame:
    """Rows with ``line_no`` of their nearest caption, one above counting 100 more; null on pages without captions."""
    return o.nearest_line(rows, captions, page)


def merged_group() -> list[Column]:
    """One box of a group: the union, the best score, the type of the first best, how many."""
    best = F.min_by("type", F.struct((-F.col("score")).alias("s"), F.col("ord")))
    return [*g.union_all(Box.of()), F.max("score").alias("score"), best.alias("type"), F.count("*").cast("int").alias("merged_from"), F.min("ord").alias("ord")]


def farthest(rows: DataFrame, by: list[str]) -> DataFrame:
    """The greatest distance between two boxes of each group that has two."""
    side = lambda p: rows.select(*by, *(F.col(x).alias(p + x) for x in ("ord", *CORNERS)))
    pairs = side("a_").join(side("b_"), by).where("a_ord < b_ord")
    return pairs.groupBy(*by).agg(F.max(g.distance(Box.of("a_"), Box.of("b_"))).alias("far"))


def _merge(rows: DataFrame, page: list[str], group: str, together: DataFrame) -> DataFrame:
    """Boxes of the groups in ``together`` as one each, the others as they are."""
    by = [*page, group]
    own = rows.join(together.select(*by).withColumn("together", F.lit(True)), by, "left")
    alone = F.when(F.col("together"), F.lit(None)).otherwise(F.col("ord"))
    key = F.when(F.col("together"), F.col(group)).otherwise(F.lit(None))
    return own.withColumns({"alone": alone, "group": key}).groupBy(*page, "group", "alone").agg(*merged_group()).drop("group", "alone")


def caption_merge(rows: DataFrame, captions: DataFrame, page: list[str]) -> DataFrame:
    """Boxes that share their nearest caption as one, if they are close together and of like size."""
    near = nearest_caption(rows, captions, page)
    return _merge(near, page, "line_no", subfigure_groups(near, page))


def subfigure_groups(near: DataFrame, page: list[str]) -> DataFrame:
    """Captions whose boxes are parts of one figure: two or more, at most GROUP_DISTANCE apart, the largest at most GROUP_SPREAD times the smallest."""
    by = [*page, "line_no"]
    rows = near.where("line_no is not null")
    b = Box.of()
    apart = [F.max(b.x0) - F.min(b.x1), F.max(b.y0) - F.min(b.y1)]
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(g.area(b)).alias("most"), F.min(g.area(b)).alias("least"), apart[0].alias("wide"), apart[1].alias("tall"))
    # what their sizes and bounds rule out needs no pairs
    alike = (F.col("n") > 1) & (F.col("most") <= GROUP_SPREAD * F.col("least")) & (F.col("wide") <= GROUP_DISTANCE) & (F.col("tall") <= GROUP_DISTANCE)
    sizes = sizes.where(alike).drop("wide", "tall")
    return sizes.join(farthest(rows.join(sizes.select(*by), by, "left_semi"), by), by).where(F.col("far") <= GROUP_DISTANCE)


def links(rows: DataFrame, page: list[str], joined: Column, most: float = LINK_DISTANCE) -> DataFrame:
    """Pairs (a, b) of boxes of a page that lie near each other and are joined to the eye; ``joined`` sees a_ and b_ columns."""
    side = lambda p: rows.select(*page, *(F.col(x).alias(p + x) for x in ("ord", *CORNERS)))
    pairs = side("a_").join(side("b_"), page).where("a_ord < b_ord")
    return pairs.where((g.distance(Box.of("a_"), Box.of("b_")) <= most) & joined).select(*page, F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def visual_merge(rows: DataFrame, edges: DataFrame, alike: Callable[[Box, Box], Column], page: list[str]) -> DataFrame:
    """Components of linked boxes as one box each, where their union is not much larger than they are, they are close,
    and the first two look alike."""
    comps = m.components(edges, rows.select(*page, "ord"), page)
    own = rows.join(comps, [*page, "ord"])
    by = [*page, "comp"]
    x0, y0, x1, y1 = g.union_all(Box.of())
    two = F.slice(F.array_sort(F.collect_list(F.struct("ord", *CORNERS))), 1, 2)
    groups = own.groupBy(*by).agg(x0, y0, x1, y1, F.count("*").alias("n"), F.sum(g.area(Box.of())).alias("areas"), two.alias("two"))
    first = lambda k: Box(*(F.get("two", F.lit(k))[c] for c in CORNERS))
    fits = (F.col("n") > 1) & (g.area(Box.of()) <= VISUAL_GROWTH * F.col("areas")) & (F.col("far") <= VISUAL_DISTANCE) & (alike(first(0), first(1)) >= VISUAL_LIKENESS)
    return _merge(own, page, "comp", groups.join(farthest(own, by), by).where(fits))


def typed_merge(rows: DataFrame, look: Column, edges: DataFrame, captions: DataFrame, page: list[str]) -> DataFrame:
    """Merging by kind: flowcharts by their links, composites by caption, tables and single figures not at all.

    ``look``: flowchart, composite or single, for figures; edges: links between boxes.
    """
    kinds = rows.withColumn("kind", F.when(F.col("type") == "table", "table").otherwise(look))
    flow = kinds.where("kind = 'flowchart'")
    ends = lambda c: flow.select(*page, F.col("ord").alias(c))
    own = edges.join(ends("a"), [*page, "a"], "left_semi").join(ends("b"), [*page, "b"], "left_semi")
    comps = flow.join(m.components(own, flow.select(*page, "ord"), page), [*page, "ord"])
    merged = [comps.groupBy(*page, "comp").agg(*merged_group()).drop("comp")]
    merged.append(caption_merge(kinds.where("kind = 'composite'"), captions, page))
    merged.append(kinds.where("kind not in ('flowchart', 'composite')").groupBy(*page, F.col("ord").alias("own")).agg(*merged_group()).drop("own"))
    out = merged[0]
    for more in merged[1:]:
        out = out.unionByName(more)
    return out


def renumbered(rows: DataFrame, page: list[str]) -> DataFrame:
    """The boxes of a stage, worked out, in the order of their first members."""
    return staged(rows.withColumn("ord", F.row_number().over(Window.partitionBy(*page).orderBy("ord", "y0", "x0"))))


def merge_stages(rows: DataFrame, captions: DataFrame, page: list[str], look: Column, joined: Column, alike: Callable[[Box, Box], Column], noise: Column) -> DataFrame:
    """All stages in their order: overlap, caption, kind, links, noise; ``look`` and ``noise`` are worked out on the boxes of their stage."""
    out = staged(m.overlap_merge(rows, page).withColumnRenamed("merged_ord", "ord").drop("merged_from"))
    out = renumbered(caption_merge(out, captions, page), page)
    out = renumbered(typed_merge(out, look, links(out, page, joined), captions, page), page)
    out = renumbered(visual_merge(out, links(out, page, joined), alike, page), page)
    return out.where(noise.isNull())


def in_grid(points: DataFrame, page: list[str], near: float = 50.0) -> DataFrame:
    """Whether the points (x, y, ord) of a page lie in a grid.

    A point less than ``near`` below the one before is in its row. There must be two rows or more that
    differ by one point at most; where all have two, half of the columns of the first two must be
    aligned, and where all have one, they must stand in one column.
    """
    order = ["y", "ord"]
    gap = F.col("y") - F.lag("y").over(Window.partitionBy(*page).orderBy(*order))
    rows = m.clusters(points, page, order, gap >= near, "row_no")
    rows = rows.withColumn("col_no", F.row_number().over(Window.partitionBy(*page, "row_no").orderBy("x", "y", "ord")))
    sizes = rows.groupBy(*page, "row_no").agg(F.count("*").alias("n")).groupBy(*page).agg(F.count("*").alias("n_rows"), F.min("n").alias("least"), F.max("n").alias("most"))
    pick = lambda k, c: F.max(F.when(F.col("row_no") == k, F.col("x"))).alias(c)
    columns = rows.where("row_no <= 2").groupBy(*page, "col_no").agg(pick(1, "x1"), pick(2, "x2")).where("x1 is not null and x2 is not null")
    aligned = columns.groupBy(*page).agg(F.count("*").alias("n_cols"), F.count_if(F.abs(F.col("x1") - F.col("x2")) <= near).alias("n_aligned"))
    spread = rows.groupBy(*page).agg((F.max("x") - F.min("x")).alias("spread"))
    out = sizes.join(spread, page).join(aligned, page, "left")
    even = (F.col("n_rows") >= 2) & (F.col("most") - F.col("least") <= 1)
    wide = (F.col("least") >= 2) & (F.coalesce("n_aligned", F.lit(0)) >= F.col("n_cols") / 2)
    return out.select(*page, "n_rows", F.coalesce(even & (wide | ((F.col("most") == 1) & (F.col("spread") <= near))), F.lit(False)).alias("in_grid"))


def text_bands(boxes: DataFrame, lines: DataFrame, captions: DataFrame, page: list[str], wide: float = 0.6, least: int = 2, centre: tuple[float, float] = (0.3, 0.7), most_height: float = 0.25) -> DataFrame:
    """Key, top and bottom of the band of wide lines in the middle of a box that splits it.

    With fewer than ``least`` wide lines the first caption in the box takes their place. Lines are
    clustered where gaps are at most 1.8 of their middle height (12 at least); the cluster with the
    greatest number times height counts, the upper one of equals.
    """
    key = [*page, "ord"]
    item, line = Box.of(), Box.of("l_")
    inside = g.intersection(item, line) > 0
    own = o.beside(boxes.select(*key, *CORNERS), lines, page, ()).where(inside & (g.width(line) / F.greatest(F.lit(1.0), g.width(item)) >= wide))
    n = own.groupBy(*key).agg(F.count("*").alias("n"))
    near = o.beside(boxes.select(*key, *CORNERS), captions, page, ()).where(inside)
    first = near.groupBy(*key).agg(F.min(F.struct("l_line_no", *("l_" + c for c in CORNERS), *CORNERS)).alias("c")).join(n, key, "left").where(f"n is null or n < {least}")
    own = own.join(first.select(*key), key, "left_anti").select(*key, *CORNERS, "l_line_no", *("l_" + c for c in CORNERS))
    rows = own.unionByName(first.select(*key, *(f"c.{c}" for c in CORNERS), "c.l_line_no", *(f"c.l_{c}" for c in CORNERS)))
    middle = rows.groupBy(*key).agg(m.upper_median(F.collect_list(F.col("l_y1") - F.col("l_y0"))).alias("mh"))
    rows = rows.join(middle, key)
    gap = F.col("l_y0") - F.lag("l_y1").over(Window.partitionBy(*key).orderBy("l_y0", "l_line_no"))
    runs = m.clusters(rows, key, ["l_y0", "l_line_no"], gap > F.greatest(F.lit(12), (F.col("mh") * 1.8).cast("int")))
    sized = runs.groupBy(*key, *CORNERS, "run").agg(F.count("*").alias("n"), F.min("l_y0").alias("top"), F.max("l_y1").alias("bottom"))
    height, tall = F.col("y1") - F.col("y0"), F.col("bottom") - F.col("top")
    place = ((F.col("top") + F.col("bottom")) / 2 - F.col("y0")) / F.greatest(F.lit(1.0), height)
    fit = sized.where(place.between(*centre) & (tall <= height * most_height) & (F.col("n") * tall > 0))
    best = fit.groupBy(*key).agg(F.min_by(F.struct("top", "bottom"), F.struct((-F.col("n") * tall).alias("s"), "run")).alias("b"))
    return best.select(*key, "b.*")


def split_by_bands(boxes: DataFrame, bands: DataFrame, page: list[str], ink: Callable[[Box], Column], pad: float = 4, least_area: float = 2000, least_ink: float = 0.01) -> DataFrame:
    """Boxes cut at their band where both halves are large enough and hold ink: ``part`` 1 and 2, and 0 of a box that stays whole."""
    key = [*page, "ord"]
    rows = boxes.join(bands, key, "left")
    b = Box.of()
    upper = Box(b.x0, b.y0, b.x1, F.greatest(b.y0, F.col("top") - pad))
    lower = Box(b.x0, F.least(b.y1, F.col("bottom") + pad), b.x1, b.y1)
    fine = lambda x: (g.area(x) >= least_area) & (ink(x) >= least_ink)
    made = lambda part, x: F.struct(F.lit(part).alias("part"), *x.named())
    both = F.coalesce(fine(upper) & fine(lower), F.lit(False))
    parts = F.when(both, F.array(made(1, upper), made(2, lower))).otherwise(F.array(made(0, b)))
    return rows.select(*key, F.explode(parts).alias("p")).select(*key, "p.*")


def section_text(boxes: DataFrame, lines: DataFrame, page: list[str], words, least: int = 4) -> DataFrame:
    """Keys of boxes with ``least`` lines or more in them that say a word of a section."""
    key = [*page, "ord"]
    joined = o.inside(boxes.select(*key, *CORNERS), lines, page, key)
    low = F.lower("inside")
    said = F.lit(False)
    for w in words:
        said = said | low.contains(w.lower())
    return joined.where((F.col("n_lines") >= least) & said).select(*key)


def caption_conflict(rows: DataFrame, captions: DataFrame, page: list[str], kind: str, share: float = 0.7) -> DataFrame:
    """Keys of boxes of a kind whose nearest caption is of the other kind and near."""
    key = [*page, "ord"]
    near = o.nearest_kind(rows.where(F.col("type") == kind), captions, page, key, for_tables=kind == "table")
    other = "figure" if kind == "table" else "table"
    return near.where((F.col("kind") == other) & (F.col("distance") < o.WINDOW * share)).select(*key)
