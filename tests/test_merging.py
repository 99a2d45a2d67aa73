from pyspark.sql import functions as F

from leafgrid.functions.geometry import Box
from leafgrid.operators import digitize as dz
from leafgrid.operators import merging as m
from leafgrid.operators import raster

BOX = "page int, ord int, x0 double, y0 double, x1 double, y1 double, type string, score double"


def test_components_of_a_union_that_is_dealt_already(spark):
    """Both branches are dealt by page; the groups must not be cut, whatever the optimizer drops."""
    n = 4000
    nodes = spark.range(n * 5).select((F.col("id") % n).cast("int").alias("page"), (F.col("id") / n).cast("int").alias("ord"))
    nodes = nodes.groupBy("page", "ord").count()
    edges = nodes.where("ord > 0").groupBy("page", "ord").count().select("page", (F.col("ord") - 1).alias("a"), F.col("ord").alias("b"))
    nodes, edges = nodes.repartition(7, "page"), edges.repartition(7, "page")
    got = m.components(edges, nodes, ["page"])
    assert got.count() == n * 5 and got.where("comp <> 0").count() == 0


def test_a_better_table_takes_the_place_at_the_end(spark):
    rows = [(0, 1, 0.0, 0.0, 100.0, 100.0, "table", 0.9, 4), (0, 2, 300.0, 0.0, 400.0, 100.0, "table", 0.8, 4), (0, 3, 5.0, 0.0, 100.0, 100.0, "table", 0.7, 9), (0, 4, 0.0, 40.0, 100.0, 140.0, "table", 0.6, 99)]
    df = spark.createDataFrame(rows, BOX + ", cells int")
    got = m.replacing_distinct(df, ["page"], [(-F.col("score")).alias("o")], F.col("cells"), 0.7, ("ord",)).collect()
    assert sorted((r.place, r.ord) for r in got) == [(1, 2), (2, 3), (3, 4)]


def _merged(spark, rows, lines=()):
    boxes = spark.createDataFrame(rows, BOX + ", signature string")
    lines = spark.createDataFrame(list(lines), "page int, line_no int, x0 double, y0 double, x1 double, y1 double")
    return sorted((r.x0, r.y0, r.x1, r.y1, r.merged_from) for r in m.proximity_merge(boxes, lines, ["page"]).collect())


def test_boxes_grow_while_they_absorb(spark):
    row = lambda k, y, sig="": (0, k, 0.0, y, 100.0, y + 50, "figure", 0.5, sig)
    chain = [row(k, 60.0 * k) for k in range(14)]  # each touches only the one before it
    assert _merged(spark, chain) == [(0.0, 0.0, 100.0, 830.0, 14)]
    assert len(_merged(spark, [row(0, 0.0, "Figure 1"), row(1, 60.0, "Figure 2")])) == 2
    assert len(_merged(spark, [row(0, 0.0, "Figure 1"), row(1, 60.0), row(2, 120.0, "Figure 2")])) == 2  # the signature is handed on
    assert len(_merged(spark, chain[:2], [(0, 1, 0.0, 52.0, 100.0, 58.0)])) == 2
    assert len(_merged(spark, chain[:2], [(0, 1, 90.0, 52.0, 200.0, 58.0), (1, 2, 0.0, 52.0, 100.0, 58.0)])) == 1


def test_overlap_merging_is_one_pass_and_ten_more(spark):
    # each pass joins a box with its neighbours by its own extent alone
    rows = [(0, k, 70.0 * k, 0.0, 70.0 * k + 100, 10.0, "figure", 0.5) for k in range(3)]
    df = spark.createDataFrame(rows, BOX)
    assert m.overlap_merge(df, ["page"], 0.1, 0.25).count() == 1
    assert m.overlap_merge(df, ["page"], 0.1, 0.25, again=0).count() == 2


def test_bars(spark):
    at = dz.Axes(*(F.lit(x) for x in (500, 50, 800, 50)))
    df = spark.createDataFrame([(0, 0, 100.0, 275.0, 140.0, 500.0, "f", 1.0), (0, 1, 100.0, 490.0, 140.0, 500.0, "f", 1.0), (0, 2, 20.0, 100.0, 60.0, 500.0, "f", 1.0), (0, 3, 100.0, 100.0, 140.0, 109.0, "f", 1.0)], BOX)
    got = df.select("ord", dz.bar_value(Box.of(), F.lit(True), at).alias("v"), dz.valid_bar(Box.of(), F.lit(True), at).alias("ok"), dz.valid_bar(Box.of(), F.lit(False), at).alias("lies")).orderBy("ord").collect()
    assert [r.v for r in got] == [50.0, 2.22, 88.89, 88.89]
    assert [r.ok for r in got] == [True, False, False, False] and [r.lies for r in got] == [False, True, False, False]


def test_the_curve_is_the_largest_component(spark):
    import numpy as np

    grey = np.full((10, 20), 255, np.uint8)
    grey[5, 2:12] = 0
    grey[4, 2] = 0
    grey[0, 15:20] = 100  # a smaller one
    df = spark.createDataFrame([(1, bytearray(grey.tobytes()), 10, 20), (2, None, 0, 0)], "img int, pixels binary, height int, width int")
    got = {r.x: (r.y, r.value_x, r.value_y) for r in dz.curve(df, ["img"], (0.0, 20.0), (0.0, 10.0)).collect()}
    assert set(got) == set(range(2, 12)) and got[2] == (4.5, 2.0, 5.5) and got[11] == (5.0, 11.0, 5.0)
    assert raster.largest_component(df, ["img"], 200).count() == 11
