"""Queries of quality scores and of values read off charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafgrid import sources
from leafgrid.catalogue import query
from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.operators import digitize as dz
from leafgrid.operators import filters as f
from leafgrid.operators import quality as q
from leafgrid.operators import raster
from leafgrid.plans import common as c
from leafgrid.plans.captioning import KEY, _K, _ON
from leafgrid.plans.detections import _FACTS, H, W, facts, facts_of

def B():
    return Box.of()


_FAR = f"{c.s_distance('b.', 'k.')} + CASE WHEN {c.s_overlap('b.', 'k.')} < 0.8 AND {c.s_iou('b.', 'k.')} <= 0.1 AND abs(k.x0 + k.x1 - b.x0 - b.x1) <= abs(k.y0 + k.y1 - b.y0 - b.y1) AND k.y0 + k.y1 <= b.y0 + b.y1 THEN 100 ELSE 0 END"
_NEAR = f"near AS (SELECT b.doc_no, b.page_index, b.ord, min({_FAR}) FILTER (WHERE b.type = k.kind) AS far, min({c.s_distance('b.', 'k.')}) AS any_far FROM b JOIN k ON {_ON} GROUP BY ALL)"
_BUCKET = "CASE WHEN {0} IS NULL THEN {1} WHEN {0} < 50 THEN 1 WHEN {0} < {2} THEN 0.8 WHEN {0} < {3} THEN {4} ELSE {5} END"
_CONTENT = "CASE WHEN ink < 0.005 THEN 0 WHEN ink > 0.5 THEN 1 ELSE (ink - 0.005::DOUBLE) / 0.495::DOUBLE END"
_EDGE = "(x0 < 20 OR y0 < 20 OR x1 > 880 OR y1 > 930)"


def _scored(spark, sf_dir):
    return facts_of(o.distances(c.boxes(spark, sf_dir), o.candidates(c.captions(spark, sf_dir)), c.PAGE))


@query(c.sql("bc", f"""WITH {_FACTS}, {_K}, {_NEAR}, s AS (SELECT d.*, {_CONTENT} AS content, {_BUCKET.format('far', '0.3', '150', '300', '0.6', '0.4')} AS caption,
 CASE WHEN w * h = 0 THEN 0 WHEN w * h / 855000 < 0.005 OR w * h / 855000 > 0.95 THEN 0.3 WHEN w * h / 855000 BETWEEN 0.01 AND 0.8 THEN 1 ELSE 0.7 END AS size,
 CASE WHEN least(x0, 900 - x1, y0, 950 - y1) < 5 THEN 0.5 WHEN least(x0, 900 - x1, y0, 950 - y1) < 20 THEN 0.7 ELSE 1 END AS position
 FROM d LEFT JOIN near USING (doc_no, page_index, ord))
SELECT doc_no, page_index, ord, round(content, 6)::DOUBLE AS content, caption::DOUBLE AS caption, size::DOUBLE AS size, position::DOUBLE AS position,
 round(score * 0.3::DOUBLE + content * 0.3::DOUBLE + caption::DOUBLE * 0.2::DOUBLE + size::DOUBLE * 0.1::DOUBLE + position::DOUBLE * 0.1::DOUBLE, 6) AS overall FROM s"""))
def quality_v1(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    s = {"detection": F.col("score"), "content": q.content(F.col("ink")), "caption": q.caption(F.col("far")), "size": q.size(B(), W() * H()), "position": q.margins(B(), W(), H())}
    return rows.select(*KEY, F.round(s["content"], 6).alias("content"), *(s[k].alias(k) for k in ("caption", "size", "position")), F.round(q.first_overall(s), 6).alias("overall"))


_SECOND = f"""v AS (SELECT d.*, {_CONTENT} AS content, structure / 900 AS boundary, (structure + ord) % 10 / 10 AS text_share, ({_BUCKET.format('any_far', '0.5', '100', '200', '0.5', '0.2')})::DOUBLE AS caption,
 greatest(0, least(1, 1::DOUBLE - CASE WHEN {_EDGE} THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN y0 < 95 OR y1 > 855 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN abs(cy - 475) / 475 < 0.5 THEN 0.1::DOUBLE ELSE 0 END)) AS position,
 cx < 270 AND cy < 190 AND w * h / 855000 <= 0.05 AND w / h > 1.5 AND w / h < 8 AS stamp, any_far IS NOT NULL AS has_captions FROM d LEFT JOIN near USING (doc_no, page_index, ord)),
z AS (SELECT *, round((score * 0.3::DOUBLE + content * 0.25::DOUBLE + boundary * 0.2::DOUBLE + caption * 0.15::DOUBLE + position * 0.1::DOUBLE) * CASE WHEN text_share > 0.7 THEN 0.2::DOUBLE WHEN text_share > 0.5 THEN 0.6::DOUBLE ELSE 1 END
 * CASE WHEN stamp THEN 0.1::DOUBLE ELSE 1 END, 6) AS overall FROM v)"""


def _second(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("text_share", (F.col("structure") + F.col("ord")) % 10 / 10)
    s = {"detection": F.col("score"), "content": q.content(F.col("ink")), "boundary": F.col("structure") / 900, "caption": q.nearest_caption(F.col("any_far")), "position": q.place(B(), W(), H())}
    stamp = f.arxiv_corner(B(), W(), H())
    overall = F.round(q.second_overall(s, F.col("text_share"), stamp), 6)
    return rows.withColumn("overall", overall).withColumn("issues", q.issues(s, F.col("text_share"), stamp, F.col("any_far").isNotNull()))


@query(c.sql("bc", f"""WITH {_FACTS}, {_K}, {_NEAR}, {_SECOND} SELECT doc_no, page_index, ord, overall, concat_ws(',', CASE WHEN score < 0.5 THEN 'low_detection' END, CASE WHEN content < 0.5 THEN 'low_content' END,
 CASE WHEN boundary < 0.5 THEN 'low_boundary' END, CASE WHEN has_captions AND caption < 0.3 THEN 'low_caption' END, CASE WHEN position < 0.5 THEN 'low_position' END,
 CASE WHEN text_share > 0.7 THEN 'text' WHEN text_share > 0.5 THEN 'some_text' END, CASE WHEN stamp THEN 'stamp' END) AS issues FROM z"""))
def quality_v2(spark, sf_dir):
    return _second(spark, sf_dir).select(*KEY, "overall", F.concat_ws(",", "issues").alias("issues"))


@query(c.sql("bc", f"""WITH {_FACTS}, {_K}, {_NEAR}, {_SECOND} SELECT type, count(*) AS n, round(avg(overall), 6) AS mean, min(overall) AS least, max(overall) AS most,
 round(stddev_pop(overall), 6) AS std, count(*) FILTER (WHERE overall < 0.4) AS low, round(count(*) FILTER (WHERE overall < 0.4) / count(*), 6) AS low_ratio FROM z GROUP BY ALL"""))
def quality_stats(spark, sf_dir):
    low = F.col("overall") < 0.4
    return _second(spark, sf_dir).groupBy("type").agg(
        F.count("*").alias("n"), F.round(F.avg("overall"), 6).alias("mean"), F.min("overall").alias("least"), F.max("overall").alias("most"),
        F.round(F.stddev_pop("overall"), 6).alias("std"), F.count_if(low).alias("low"), F.round(F.count_if(low) / F.count("*"), 6).alias("low_ratio"),
    )


@query(c.sql("bc", f"""WITH {_FACTS}, {_K}, {_NEAR}, {_SECOND} SELECT doc_no, page_index, ord, overall >= 0.4 AS passed FROM z"""))
def low_quality(spark, sf_dir):
    return _second(spark, sf_dir).select(*KEY, (F.col("overall") >= 0.4).alias("passed"))


@query(c.sql("b", f"""WITH {_FACTS} SELECT doc_no, page_index, ord, unnest(kinds) AS kind FROM (SELECT *, list_filter([CASE WHEN w * h / 40000 > 0.9 THEN 'oversized' END,
 CASE WHEN w * h / 40000 < 0.001 THEN 'undersized' END, CASE WHEN w / h > 10 OR w / h < 0.1 THEN 'extreme_aspect_ratio' END, CASE WHEN ink < 0.005 THEN 'sparse_content' END], lambda x: x IS NOT NULL) AS kinds FROM d)"""))
def anomalies(spark, sf_dir):
    return facts(spark, sf_dir).select(*KEY, F.explode(q.anomalies(B(), F.lit(40000.0), F.col("ink"))).alias("a")).select(*KEY, "a.kind")


_PX = f"px AS (SELECT img_id, x, y, min(v) AS v FROM ({sources.view('pixels')}) GROUP BY ALL)"


def _pixels(spark, sf_dir):
    return sources.entity(spark, sf_dir, "pixels").groupBy("img_id", "x", "y").agg(F.min("v").alias("v"))


@query(f"WITH {_PX} SELECT img_id, count(*) FILTER (WHERE v <= 245) / 4096 AS ink, (4096 - count(*) + count(*) FILTER (WHERE v > 240)) / 4096 AS white, min(x) FILTER (WHERE v <= 245) AS x0, min(y) FILTER (WHERE v <= 245) AS y0, max(x) FILTER (WHERE v <= 245) AS x1, max(y) FILTER (WHERE v <= 245) AS y1 FROM px GROUP BY ALL")
def ink_ratio(spark, sf_dir):
    """Share of dark and of white pixels of 64 by 64 images and the bounds of what is dark; pixels that no row has are white."""
    return dz.pixel_facts(_pixels(spark, sf_dir), ["img_id"], F.lit(4096))


_LARGEST = """dk AS (SELECT img_id, x, y, y * 64 + x AS i FROM px WHERE v <= 200),
reach AS (SELECT img_id, i, i AS t FROM dk UNION SELECT r.img_id, r.i, d.i FROM reach r JOIN dk e ON r.img_id = e.img_id AND r.t = e.i JOIN dk d ON d.img_id = e.img_id AND abs(d.x - e.x) <= 1 AND abs(d.y - e.y) <= 1),
lab AS (SELECT img_id, i, min(t) AS comp FROM reach GROUP BY ALL),
big AS (SELECT img_id, comp FROM (SELECT img_id, comp, row_number() OVER (PARTITION BY img_id ORDER BY count(*) DESC, comp) AS r FROM lab GROUP BY img_id, comp) WHERE r = 1),
lg AS (SELECT dk.img_id, dk.x, dk.y FROM dk JOIN lab USING (img_id, i) JOIN big USING (img_id, comp))"""


@query(f"""WITH RECURSIVE {_PX}, {_LARGEST}, m AS (SELECT img_id, x, median(y) AS y FROM lg GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY img_id) AS n FROM m)
SELECT img_id, x, y, round(x / 64 * 10, 6) AS value_x, round(5 - y / 64 * 5, 6) AS value_y FROM r WHERE n <= 5 OR k % (n // 5) = 0""")
def curve_median(spark, sf_dir):
    """The curve of a line plot: median pixel of each column of the largest dark component, thinned, on the axes 0..10 and 0..5."""
    rasters = raster.from_pixels(_pixels(spark, sf_dir), ["img_id"], 64, 64)
    return dz.curve(rasters, ["img_id"], (0.0, 10.0), (0.0, 5.0), most=5)


_STROKES = f"st AS (SELECT * FROM ({sources.view('strokes')}))"
_AXES = """an AS (SELECT *, abs(atan2((y1 - y0)::DOUBLE, (x1 - x0)::DOUBLE)) AS a FROM st),
ax AS (SELECT chart_no, coalesce(trunc(max((y0 + y1) / 2) FILTER (WHERE a < 0.2 OR a > 2.9))::INT, 1050) AS x_axis, coalesce(trunc(min((x0 + x1) / 2) FILTER (WHERE a > 1.4 AND a < 1.7))::INT, 50) AS y_axis,
 850 AS x_max, 50 AS y_min, count(*) FILTER (WHERE a > 1.3 AND a < 1.8) AS nv, count(*) FILTER (WHERE a < 0.3 OR a > 2.8) AS nh FROM an GROUP BY ALL),
axes AS (SELECT chart_no, x_axis, y_axis, x_max, y_min, CASE WHEN nv > nh * 1.5 THEN 'vertical' WHEN nh > nv * 1.5 THEN 'horizontal' ELSE 'vertical' END AS orientation FROM ax)"""


def _axes(spark, sf_dir):
    return dz.axes(sources.entity(spark, sf_dir, "strokes"), ["chart_no"], 900, 1100)


@query(f"WITH {_STROKES}, {_AXES} SELECT * FROM axes")
def bar_axes(spark, sf_dir):
    """Axes of charts of 900 by 1100 and whether their bars stand."""
    return _axes(spark, sf_dir)


_BARS = f"""bars AS (SELECT b.doc_no, b.page_index, ord, x0, y0, x1, y1, x_axis, y_axis, x_max, y_min, orientation, row_number() OVER (PARTITION BY b.doc_no, b.page_index ORDER BY
 CASE orientation WHEN 'vertical' THEN x0 + floor((x1 - x0) / 2) ELSE y0 + floor((y1 - y0) / 2) END, ord)::INT AS bar FROM b JOIN axes ON doc_no % 200 = chart_no)"""


def _bars(spark, sf_dir):
    """The boxes of a page as the bars of a chart, in order."""
    rows = c.boxes(spark, sf_dir).withColumn("chart_no", F.col("doc_no") % 200).join(_axes(spark, sf_dir), "chart_no")
    middle = F.when(F.col("orientation") == "vertical", F.col("x0") + F.floor((F.col("x1") - F.col("x0")) / 2)).otherwise(F.col("y0") + F.floor((F.col("y1") - F.col("y0")) / 2))
    return rows.withColumn("bar", F.row_number().over(Window.partitionBy(*c.PAGE).orderBy(middle, "ord")))


@query(c.sql("b", f"""WITH {_STROKES}, {_AXES}, {_BARS} SELECT doc_no, page_index, bar, round(CASE orientation WHEN 'vertical' THEN CASE WHEN x_axis > y_min THEN (x_axis - y0) / (x_axis - y_min) * 100 ELSE 0 END
 ELSE CASE WHEN x_max > y_axis THEN (x1 - y_axis) / (x_max - y_axis) * 100 ELSE 0 END END, 2) AS value,
 x1 - x0 >= 5 AND y1 - y0 >= 10 AND CASE orientation WHEN 'vertical' THEN NOT (y1 < y_min OR y0 > x_axis OR x0 < y_axis OR x0 > x_max) AND y1 - y0 >= (x1 - x0) * 0.8
 ELSE NOT (x1 < y_axis OR x0 > x_max OR y0 < y_min OR y0 > x_axis) AND x1 - x0 >= (y1 - y0) * 0.8 END AS valid FROM bars"""))
def bar_values(spark, sf_dir):
    """Bars in their order with the end of each as a percentage of the axis, and whether it can be a bar."""
    rows = _bars(spark, sf_dir)
    at, stands = dz.Axes(*(F.col(x) for x in dz.Axes._fields)), F.col("orientation") == "vertical"
    return rows.select(*c.PAGE, "bar", dz.bar_value(B(), stands, at).alias("value"), dz.valid_bar(B(), stands, at).alias("valid"))


@query(c.sql("bc", f"""WITH {_STROKES}, {_AXES}, {_BARS}, far AS (SELECT s.doc_no, s.page_index, s.bar, c.text,
 sqrt(((c.x0 + c.x1) / 2 - CASE orientation WHEN 'vertical' THEN s.x0 + floor((s.x1 - s.x0) / 2) ELSE s.x0 - 20 END) ** 2 + ((c.y0 + c.y1) / 2 - CASE orientation WHEN 'vertical' THEN s.y1 + 20 ELSE s.y0 + floor((s.y1 - s.y0) / 2) END) ** 2) AS far,
 c.line_no FROM bars s JOIN c USING (doc_no, page_index)), best AS (SELECT *, row_number() OVER (PARTITION BY doc_no, page_index, bar ORDER BY far, line_no) AS r FROM far)
SELECT doc_no, page_index, bar, CASE WHEN far < 100 AND text <> '' THEN text ELSE 'Bar_' || bar END AS label FROM bars LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (doc_no, page_index, bar)"""))
def bar_labels(spark, sf_dir):
    """Bars with the nearest text at the place of their label."""
    return dz.bar_labels(_bars(spark, sf_dir).select(*c.PAGE, "bar", *c.CORNERS, "orientation"), c.captions(spark, sf_dir), c.PAGE)


def _runs(along: str, across: str, least: int) -> str:
    """Pixels of each image in runs of at least ``least`` dark ones along a direction."""
    return f"""(SELECT img_id, sum(n)::BIGINT AS n FROM (SELECT img_id, {across}, k, count(*) AS n FROM (SELECT img_id, {across}, {along} - row_number() OVER (PARTITION BY img_id, {across} ORDER BY {along}) AS k
 FROM px WHERE v <= 245) GROUP BY ALL HAVING count(*) >= {least}) GROUP BY 1)"""


#: The rule's shortest line, and a short one that these small rasters hold.
LINES = (40, 3)


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH {_PX} SELECT {n} AS line, i.img_id, i.ink, coalesce(a.n, 0) AS across_pixels, coalesce(d.n, 0) AS down_pixels FROM (SELECT img_id, count(*) FILTER (WHERE v <= 245) / 4096 AS ink FROM px GROUP BY ALL) i
LEFT JOIN {_runs('x', 'y', n)} a USING (img_id) LEFT JOIN {_runs('y', 'x', n)} d USING (img_id))""" for n in LINES))
def raster_features(spark, sf_dir):
    """Ink and pixels in lines of rasters of 64 by 64, by the kernels on rasters."""
    rasters = raster.from_pixels(_pixels(spark, sf_dir), ["img_id"], 64, 64)
    one, two = (raster.with_features(rasters, ["img_id"], n).select(F.lit(n).alias("line"), "img_id", "ink", "across_pixels", "down_pixels") for n in LINES)
    return one.unionByName(two)
