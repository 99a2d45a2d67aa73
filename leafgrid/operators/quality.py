"""Quality of detections: dimension scores, issues and anomalies, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box

#: Weights of the first model: detection, content, caption, size, position. Fixed values.
FIRST = {"detection": 0.3, "content": 0.3, "caption": 0.2, "size": 0.1, "position": 0.1}
#: Weights of the second model. Fixed values.
SECOND = {"detection": 0.30, "content": 0.25, "boundary": 0.20, "caption": 0.15, "position": 0.10}


def content(ink: Column, least: float = 0.005) -> Column:
    return F.when(ink < least, 0.0).when(ink > 0.5, 1.0).otherwise((ink - least) / (0.5 - least))


def caption(distance: Column) -> Column:
    """By the distance of the nearest caption of the kind (100 more if above); none counts 0.3."""
    return F.when(distance.isNull(), 0.3).when(distance < 50, 1.0).when(distance < 150, 0.8).when(distance < 300, 0.6).otherwise(0.4)


def size(b: Box, page_area: Column) -> Column:
    share = g.area(b) / page_area
    return F.when(g.area(b) == 0, 0.0).when((share < 0.005) | (share > 0.95), 0.3).when(share.between(0.01, 0.8), 1.0).otherwise(0.7)


def margins(b: Box, w: Column, h: Column) -> Column:
    least = F.least(b.x0, w - b.x1, b.y0, h - b.y1)
    return F.when(least < 5, 0.5).when(least < 20, 0.7).otherwise(1.0)


def first_overall(scores: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in FIRST.items():
        total = total + scores[name] * weight
    return total


def nearest_caption(distance: Column) -> Column:
    """Second model; no caption is neutral."""
    return F.when(distance.isNull(), 0.5).when(distance < 50, 1.0).when(distance < 100, 0.8).when(distance < 200, 0.5).otherwise(0.2)


def place(b: Box, w: Column, h: Column) -> Column:
    """Less at the edge, in the header and the footer, more in the middle; within 0 and 1."""
    edge = (b.x0 < 20) | (b.y0 < 20) | (b.x1 > w - 20) | (b.y1 > h - 20)
    margin = (b.y0 < h * 0.1) | (b.y1 > h * 0.9)
    middle = F.abs((b.y0 + b.y1) / 2 - h / 2) / (h / 2) < 0.5
    score = F.lit(1.0) - F.when(edge, 0.3).otherwise(0.0) - F.when(margin, 0.2).otherwise(0.0) + F.when(middle, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def second_overall(scores: dict[str, Column], text_share: Column, stamp: Column) -> Column:
    """Weighted sum, cut for regions of text and for preprint stamps."""
    total = F.lit(0.0)
    for name, weight in SECOND.items():
        total = total + scores[name] * weight
    return total * F.when(text_share > 0.7, 0.2).when(text_share > 0.5, 0.6).otherwise(1.0) * F.when(stamp, 0.1).otherwise(1.0)


def issues(scores: dict[str, Column], text_share: Column, stamp: Column, has_captions: Column) -> Column:
    """Names of what is wrong, in a fixed order."""
    low = lambda name, least: F.when(scores[name] < least, F.lit("low_" + name))
    return F.array_compact(F.array(
        low("detection", 0.5), low("content", 0.5), low("boundary", 0.5), F.when(has_captions & (scores["caption"] < 0.3), F.lit("low_caption")),
        low("position", 0.5), F.when(text_share > 0.7, F.lit("text")).when(text_share > 0.5, F.lit("some_text")), F.when(stamp, F.lit("stamp")),
    ))


def anomalies(b: Box, page_area: Column, ink: Column) -> Column:
    """Structs of kind and severity: size against the page, shape, emptiness."""
    share, aspect = g.signed_area(b) / page_area, g.aspect(b, 0.0)
    found = lambda holds, kind, severity: F.when(holds, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    return F.array_compact(F.array(
        found(share > 0.9, "oversized", "high"), found(share < 0.001, "undersized", "medium"),
        found((aspect > 10) | ((aspect < 0.1) & (aspect > 0)), "extreme_aspect_ratio", "medium"), found(ink < 0.005, "sparse_content", "high"),
    ))


#: What to do about each issue. Fixed values.
ADVICE = {
    "low_detection": "Consider using ensemble detection or adjusting thresholds",
    "low_content": "Refine bbox boundaries to remove excess whitespace",
    "low_boundary": "Apply boundary refinement algorithm",
    "low_caption": "Verify this is a valid figure/table",
    "low_position": "Check if this is a valid figure or page artifact",
    "text": "Filter this detection as false positive",
    "stamp": "Filter this detection as arXiv ID false positive",
}


def advice(found: Column) -> Column:
    """What to do about each of the issues, in their order; some issues have no advice."""
    table = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return F.array_compact(F.transform(found, lambda i: F.try_element_at(table, i)))


def input_issues(there: Column, readable: Column, w: Column, h: Column, kind: Column, sharpness: Column) -> Column:
    """What is wrong with an image: not found or unreadable, and nothing else then; size, kind, blur."""
    found = F.array_compact(F.array(
        F.when((w < 50) | (h < 50), F.lit("small")), F.when((w > 5000) | (h > 5000), F.lit("large")),
        F.when(~kind.isin("figure", "table", "chart", "unknown"), F.lit("kind")), F.when(sharpness < 10, F.lit("blurred")),
    ))
    return F.when(~there, F.array(F.lit("not_found"))).when(~readable, F.array(F.lit("unreadable"))).otherwise(found)


def input_valid(found: Column) -> Column:
    """Only what is not there or cannot be read makes an image invalid."""
    return ~F.arrays_overlap(found, F.array(F.lit("not_found"), F.lit("unreadable")))


def diagnosis(b: Box, w: Column, h: Column, ink: Column, h_lines: Column, v_lines: Column) -> list[Column]:
    """Place, centre, size and shape of a box cut to whole pixels of the page, its ink and lines, and whether it has the structure of a table."""
    x0, y0, x1, y1 = g.whole_pixels(b)
    k = Box(F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0), F.least(w, x1), F.least(h, y1))
    cx, cy = g.centre(k)
    return [
        (k.x0 / w).alias("left_share"), (k.y0 / h).alias("top_share"), (cx / w).alias("centre_x"), (cy / h).alias("centre_y"), (g.signed_area(k) / (w * h)).alias("area_share"),
        F.when(g.height(k) > 0, g.width(k) / g.height(k)).otherwise(F.lit(0.0)).alias("aspect"), ink.alias("ink"), h_lines.alias("h_lines"), v_lines.alias("v_lines"),
        ((h_lines > 50) & (v_lines > 50)).alias("structured"),
    ]
