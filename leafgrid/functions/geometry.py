"""Boxes as four columns, and their algebra as expressions.

Coordinates have their origin at the top left. ``Box`` holds columns, so that every
function here stays inside generated code; nothing is a user function.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The box in the columns ``<prefix>x0`` and so on."""
        return cls(*(F.col(prefix + c).cast("double") for c in cls._fields))

    def named(self, prefix: str = "") -> list[Column]:
        """The four columns under the names ``<prefix>x0`` and so on."""
        return [c.alias(prefix + n) for n, c in zip(self._fields, self, strict=True)]


def width(b: Box) -> Column:
    return b.x1 - b.x0


def height(b: Box) -> Column:
    return b.y1 - b.y0


def area(b: Box) -> Column:
    """Area; a side that runs backwards counts as 0."""
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def signed_area(b: Box) -> Column:
    return width(b) * height(b)


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * F.greatest(
        F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    )


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part / whole, and ``empty`` where whole is not positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return ratio(both, area(a) + area(b) - both)


def unclamped_iou(a: Box, b: Box) -> Column:
    """IoU by signed areas; 0 for boxes that do not overlap."""
    both = intersection(a, b)
    whole = signed_area(a) + signed_area(b) - both
    return F.when((both > 0) & (whole != 0), both / whole).otherwise(F.lit(0.0))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area."""
    return ratio(intersection(a, b), F.least(area(a), area(b)))


def contains(a: Box, b: Box, share: float = 0.9) -> Column:
    """One box lies in the other, whichever it is."""
    return overlap_ratio(a, b) >= share


def gaps(a: Box, b: Box) -> tuple[Column, Column]:
    """Signed gaps (horizontal, vertical): negative where the sides overlap."""
    across = F.greatest(a.x0, b.x0) - F.least(a.x1, b.x1)
    down = F.greatest(a.y0, b.y0) - F.least(a.y1, b.y1)
    return across, down


def distance(a: Box, b: Box) -> Column:
    """Euclidean gap; 0 for boxes that touch or overlap."""
    dx, dy = (F.greatest(F.lit(0.0), g) for g in gaps(a, b))
    return F.sqrt(dx * dx + dy * dy)


def close(a: Box, b: Box, most: float = 50.0) -> Column:
    return distance(a, b) <= most


def drop_below(a: Box, b: Box) -> Column:
    """How far b begins below the end of a; negative if it does not."""
    return b.y0 - a.y1


def aspect(b: Box, flat: float = INFINITY) -> Column:
    """Width over height; ``flat`` for a height of 0."""
    return F.when(height(b) == 0, F.lit(flat)).otherwise(width(b) / F.when(height(b) == 0, F.lit(1.0)).otherwise(height(b)))


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2


def side_overlap(a0: Column, a1: Column, b0: Column, b1: Column, least: float = 0.0) -> Column:
    """Shared length over the shorter side (at least ``least``); 0 where that is 0."""
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return ratio(shared, F.greatest(F.lit(least), F.least(a1 - a0, b1 - b0)))


def across_overlap(a: Box, b: Box, least: float = 0.0) -> Column:
    return side_overlap(a.x0, a.x1, b.x0, b.x1, least)


def down_overlap(a: Box, b: Box, least: float = 0.0) -> Column:
    return side_overlap(a.y0, a.y1, b.y0, b.y1, least)


def position(a: Box, b: Box) -> Column:
    """Where b lies as seen from a: inside, overlap, or the side of the longer way between centres."""
    (ax, ay), (bx, by) = centre(a), centre(b)
    dx, dy = bx - ax, by - ay
    return (
        F.when(contains(a, b, 0.8), "inside")
        .when(iou(a, b) > 0.1, "overlap")
        .when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right").otherwise("left"))
        .otherwise(F.when(dy > 0, "below").otherwise("above"))
    )


def expand(b: Box, pad: float, max_x: Column | None = None, max_y: Column | None = None) -> Box:
    """Pad every side; the low sides stop at 0, the high ones at a bound if there is one."""
    zero = F.lit(0.0)
    x1, y1 = b.x1 + pad, b.y1 + pad
    return Box(
        F.greatest(zero, b.x0 - pad), F.greatest(zero, b.y0 - pad),
        x1 if max_x is None else F.least(x1, max_x), y1 if max_y is None else F.least(y1, max_y),
    )


def expand_if_bounded(b: Box, pad: float, max_x: Column | None = None, max_y: Column | None = None) -> Box:
    """Pad every side; only an axis with a bound is clamped, at 0 and at the bound."""
    zero = F.lit(0.0)
    x = (b.x0 - pad, b.x1 + pad) if max_x is None else (F.greatest(zero, b.x0 - pad), F.least(max_x, b.x1 + pad))
    y = (b.y0 - pad, b.y1 + pad) if max_y is None else (F.greatest(zero, b.y0 - pad), F.least(max_y, b.y1 + pad))
    return Box(x[0], y[0], x[1], y[1])


def clamp(b: Box, w: Column, h: Column) -> Box:
    """The part of the box on a page of w by h."""
    zero = F.lit(0.0)
    inside = lambda v, top: F.greatest(zero, F.least(v, top))
    return Box(inside(b.x0, w), inside(b.y0, h), inside(b.x1, w), inside(b.y1, h))


def shrink(b: Box, share: float = 0.05) -> Box:
    dx, dy = width(b) * share, height(b) * share
    return Box(b.x0 + dx, b.y0 + dy, b.x1 - dx, b.y1 - dy)


def scaled(b: Box, zoom: float) -> Box:
    return Box(*(c * zoom for c in b))


def whole_pixels(b: Box) -> Box:
    """Coordinates cut toward 0."""
    return Box(*(c.cast("int") for c in b))


def flipped(b: Box, page_height: Column) -> Box:
    """From an origin at the bottom left to one at the top left, or back."""
    return Box(b.x0, page_height - b.y1, b.x1, page_height - b.y0)


def from_corner(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def union_all(b: Box, prefix: str = "") -> list[Column]:
    """Aggregates that span all boxes of a group."""
    return Box(F.min(b.x0), F.min(b.y0), F.max(b.x1), F.max(b.y1)).named(prefix)
