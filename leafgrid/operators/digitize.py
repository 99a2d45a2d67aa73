"""Values read off charts: pixels as rows, bars as boxes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import pages as p
from leafgrid.operators import raster

INK, WHITE, DARK = 245, 240, 200


def pixel_facts(pixels: DataFrame, image: list[str], size: Column) -> DataFrame:
    """Share of ink and white of each image, and the bounds of its ink; pixels without a row are white."""
    inked = F.col("v") <= INK
    at = lambda f, c: f(F.when(inked, F.col(c)))
    return pixels.groupBy(*image).agg(
        (F.count_if(inked) / size).alias("ink"), ((size - F.count("*") + F.count_if(F.col("v") > WHITE)) / size).alias("white"),
        at(F.min, "x").alias("x0"), at(F.min, "y").alias("y0"), at(F.max, "x").alias("x1"), at(F.max, "y").alias("y1"),
    )


def curve(rasters: DataFrame, image: list[str], xs: tuple[float, float], ys: tuple[float, float], most: int = 300) -> DataFrame:
    """One point a column: the median of the pixels of the largest dark component, every (n // most)-th of n, mapped to the axes.

    The axes span the whole width and height of the raster.
    """
    points = raster.largest_component(rasters, image, DARK).groupBy(*image, "width", "height", "x").agg(F.median("y").alias("y"))
    each = Window.partitionBy(*image)
    points = points.withColumn("k", F.row_number().over(each.orderBy("x")) - 1).withColumn("n", F.count("*").over(each))
    points = points.where((F.col("n") <= most) | (F.col("k") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0))
    x = F.lit(xs[0]) + F.col("x") / F.col("width") * (xs[1] - xs[0])
    y = F.lit(ys[1]) - F.col("y") / F.col("height") * (ys[1] - ys[0])
    return points.select(*image, "x", "y", F.round(x, 6).alias("value_x"), F.round(y, 6).alias("value_y"))


class Axes(NamedTuple):
    """Where the axes of a bar chart are: the line under the bars, the line left of them, and the far ends."""

    x_axis: Column
    y_axis: Column
    x_max: Column
    y_min: Column


def orientation(n_vertical: Column, n_horizontal: Column) -> Column:
    """Bars lie if horizontal lines are more than one and a half times the vertical ones; else they stand."""
    lying = (n_horizontal > n_vertical * 1.5) & ~(n_vertical > n_horizontal * 1.5)
    return F.when(lying, "horizontal").otherwise("vertical")


def axes(segments: DataFrame, image: list[str], width: float, height: float, edge: float = 50.0) -> DataFrame:
    """Axes of each image from segments (x0, y0, x1, y1): the lowest nearly horizontal and the leftmost nearly
    vertical one, ``edge`` from the border where there is none, and the orientation of its bars."""
    angle = F.abs(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    flat, steep = (angle < 0.2) | (angle > 2.9), (angle > 1.4) & (angle < 1.7)
    found = segments.groupBy(*image).agg(
        F.max(F.when(flat, (F.col("y0") + F.col("y1")) / 2)).alias("low"), F.min(F.when(steep, (F.col("x0") + F.col("x1")) / 2)).alias("left"),
        F.count_if((angle > 1.3) & (angle < 1.8)).alias("n_vertical"), F.count_if((angle < 0.3) | (angle > 2.8)).alias("n_horizontal"),
    )
    return found.select(
        *image, F.coalesce(F.col("low").cast("int"), F.lit(int(height - edge))).alias("x_axis"), F.coalesce(F.col("left").cast("int"), F.lit(int(edge))).alias("y_axis"),
        F.lit(int(width - edge)).alias("x_max"), F.lit(int(edge)).alias("y_min"), orientation(F.col("n_vertical"), F.col("n_horizontal")).alias("orientation"),
    )


def bar_value(b: Box, stands: Column, at: Axes) -> Column:
    """The end of a bar as a percentage of its axis, two places; 0 for an axis without length."""
    tall, long = at.x_axis - at.y_min, at.x_max - at.y_axis
    up = F.when(tall > 0, (at.x_axis - b.y0) / tall * 100).otherwise(F.lit(0.0))
    right = F.when(long > 0, (b.x1 - at.y_axis) / long * 100).otherwise(F.lit(0.0))
    return F.round(F.when(stands, up).otherwise(right), 2)


def valid_bar(b: Box, stands: Column, at: Axes, least_width: float = 5, least_height: float = 10) -> Column:
    """Large enough, in the plot area, and not much shorter along its value than across it."""
    w, h = g.width(b), g.height(b)
    up = (b.y1 >= at.y_min) & (b.y0 <= at.x_axis) & b.x0.between(at.y_axis, at.x_max) & (h >= w * 0.8)
    right = (b.x1 >= at.y_axis) & (b.x0 <= at.x_max) & b.y0.between(at.y_min, at.x_axis) & (w >= h * 0.8)
    return (w >= least_width) & (h >= least_height) & F.when(stands, up).otherwise(right)


def bar_labels(bars: DataFrame, texts: DataFrame, image: list[str], most: float = 100.0, off: float = 20.0) -> DataFrame:
    """The text nearest to the place of each bar's label, below a standing bar and left of a lying one; Bar_n without one.

    Bars have image, bar (their number), corners and orientation; texts have image, line_no, text
    and corners. Of texts equally far the first counts.
    """

    def prepare(lines):
        x0, y0, x1, y1 = p.corners(lines, "l_")
        return (x0 + x1) / 2, (y0 + y1) / 2, p.taken(lines, "l_text", np.arange(lines.num_rows))

    def run(rows, ready):
        (x0, y0, x1, y1), (x, y, said) = p.corners(rows), ready
        stands = p.equals(rows, "orientation", "vertical")
        aim_x = np.where(stands, x0 + np.floor((x1 - x0) / 2), x0 - off)
        aim_y = np.where(stands, y1 + off, y0 + np.floor((y1 - y0) / 2))
        at = p.nearest_points(aim_x, aim_y, x, y, most)
        return (said.take(pa.array(at, pa.int64(), mask=at < 0)),)

    lines = texts.select(*image, "line_no", "text", *p.CORNERS)
    named = p.beside_each(bars.select(*image, "bar", *p.CORNERS, "orientation"), lines, image, ["line_no", "text"], prepare, run, "near string")
    label = F.when(F.col("near") != "", F.col("near")).otherwise(F.format_string("Bar_%d", "bar"))
    return named.select(*image, "bar", label.alias("label"))
