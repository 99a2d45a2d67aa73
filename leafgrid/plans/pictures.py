"""Queries of what rasters show."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from leafgrid.catalogue import query
from leafgrid.operators import pictures as pc
from leafgrid.operators import raster
from leafgrid.plans.scoring import _PX, _pixels

_ALL = f"""WITH {_PX}, px1 AS (SELECT img_id, x, y, v FROM px), n AS (SELECT img_id, count(*) AS n FROM px1 GROUP BY ALL)"""


def _rasters(spark, sf_dir):
    return raster.from_pixels(_pixels(spark, sf_dir), ["img_id"], 64, 64)


@query(f"""{_ALL}, b AS (SELECT img_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px1 WHERE v <= 245 GROUP BY ALL),
c AS (SELECT *, greatest(0, x0 - 5) AS cx, greatest(0, y0 - 5) AS cy FROM b)
SELECT img_id, cx::INT AS x0, cy::INT AS y0, (cx + least(64 - cx, x1 - x0 + 10))::INT AS x1, (cy + least(64 - cy, y1 - y0 + 10))::INT AS y1, least(1, (x1 - x0) * (y1 - y0) / 4096)::DOUBLE AS precision FROM c""")
def content_refine(spark, sf_dir):
    """The box of each raster's ink with some space around it, and how much of the raster the ink's box fills."""
    return pc.measured(_rasters(spark, sf_dir), ["img_id"], lambda g: [(*pc.refined(g), pc.precision(g))], "x0 int, y0 int, x1 int, y1 int, precision double")


@query(f"""{_ALL}, h AS (SELECT img_id, v, count(*) AS k FROM (SELECT img_id, v FROM px1 UNION ALL SELECT img_id, 255 FROM n, generate_series(1, 4096 - n.n)) GROUP BY ALL),
s AS (SELECT img_id, max(v) - min(v) AS contrast, sum(k * v) / 4096 AS mean, sum(k * v * v) / 4096 AS square, -sum(k / 4096 * log2(k / 4096 + 1e-10)) AS entropy FROM h GROUP BY ALL)
SELECT img_id, contrast::INT AS contrast, round(square - mean * mean, 6) AS variance, round(entropy, 6) AS entropy FROM s""")
def grey_features(spark, sf_dir):
    """Contrast, variance and entropy of the grey of each raster."""
    kernel = lambda g: [(int(g.max()) - int(g.min()), round(float(g.var()), 6), round(pc.entropy(g), 6))]
    return pc.measured(_rasters(spark, sf_dir), ["img_id"], kernel, "contrast int, variance double, entropy double")


@query()
def picture_scores(spark, sf_dir):
    """How much each raster looks like each kind; kernels have tests of their own."""
    return pc.measured(_rasters(spark, sf_dir), ["img_id"], lambda g: [(*pc.scores(g), pc.text_likeness(g), pc.composite(g))], pc.SCORES + ", text double, composite boolean")


@query()
def table_rules(spark, sf_dir):
    """Rules, grids and lines of text in each raster, and the box that it is drawn in to."""
    kernel = lambda g: [(*pc.table_rules(g, 6), *pc.text_lines(g), *pc.drawn_in(g, 10))]
    return pc.measured(_rasters(spark, sf_dir), ["img_id"], kernel, f"{pc.RULES}, {pc.LINES}, x0 int, y0 int, x1 int, y1 int")


@query(f"""{_ALL} SELECT img_id, 1::INT AS part, 20::INT AS width, 30::INT AS height FROM n""")
def previews(spark, sf_dir):
    """Crops of rasters as PNG files, read back: their number and size."""
    rasters = _rasters(spark, sf_dir)
    boxes = rasters.select("img_id", *(F.lit(float(v)).alias(c) for c, v in (("x0", 10), ("y0", 5), ("x1", 30), ("y1", 35))))
    shots = pc.previews(boxes, rasters, ["img_id"], ["img_id"])
    size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    return shots.select("img_id", F.lit(1).alias("part"), size(17).alias("width"), size(21).alias("height"))


def unpng(data: bytes) -> np.ndarray:
    """The grey raster of a PNG file that ``pictures.png`` made, for tests."""
    w, h = (int.from_bytes(data[k : k + 4], "big") for k in (16, 20))
    at = data.index(b"IDAT")
    size = int.from_bytes(data[at - 4 : at], "big")
    return np.frombuffer(zlib.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(h, w + 1)[:, 1:]
