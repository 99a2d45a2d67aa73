import random

from pyspark.sql import functions as F

from leafgrid.operators import captions as o
from leafgrid.operators import evaluation as e
from leafgrid.operators import merging as m

BOX = "doc int, page int, ord int, x0 double, y0 double, x1 double, y1 double, type string, score double"


def some_boxes(spark, seed, n=60):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        x, y = r.randint(0, 80), r.randint(0, 80)
        rows.append((k % 3, k % 2, k, float(x), float(y), float(x + r.randint(5, 40)), float(y + r.randint(5, 40)), r.choice(["figure", "table"]), r.random()))
    return rows, spark.createDataFrame(rows, BOX)


def test_first_wins(spark):
    rows, df = some_boxes(spark, 1)
    got = {x.ord for x in m.greedy_distinct(df, ["doc", "page"], [F.col("ord").alias("o1")], 0.2, ("ord",)).collect()}
    kept: dict = {}
    for r in rows:
        own = kept.setdefault(r[:2], [])
        if all(m.iou_value(r[3:7], q[3:7]) <= 0.2 for q in own):
            own.append(r)
    assert got == {r[2] for own in kept.values() for r in own}


def test_greedy_matching_and_rates(spark):
    rows, df = some_boxes(spark, 2)
    _, other = some_boxes(spark, 2)
    truth = df.withColumn("id", F.col("ord"))
    found = other.where("ord % 4 <> 0").withColumn("id", F.col("ord")).withColumn("x0", F.col("x0") + 1)
    pairs = [(-m.iou_value(a[3:7], (b[3] + 1, *b[4:7])), a[2], b[2], a[0]) for a in rows for b in rows if b[2] % 4 and a[:2] == b[:2] and a[7] == b[7] and m.iou_value(a[3:7], (b[3] + 1, *b[4:7])) >= 0.5]
    used, want = (set(), set()), set()
    for _, a, b, _ in sorted(pairs):
        if a not in used[0] and b not in used[1]:
            used[0].add(a), used[1].add(b), want.add((a, b))
    assert {(x.gt, x.pred) for x in e.matches(truth, found, "doc", "page").collect()} == want
    overall = e.report(truth, found, "doc", "page").where("doc is null").first()
    assert (overall.tp, overall.fp + overall.tp, overall.fn + overall.tp) == (len(want), 45, 60)


def test_no_rows_make_no_rows(spark):
    df = spark.createDataFrame([], BOX)
    ids = df.withColumn("id", F.col("ord"))
    assert e.matches(ids, ids, "doc", "page").count() == 0
    r = e.report(ids, ids, "doc", "page").collect()
    assert all(x.precision == 0 and x.f1 == 0 for x in r)
    assert m.overlap_merge(df, ["doc", "page"]).count() == 0


def test_components(spark):
    _, df = some_boxes(spark, 3, 12)
    edges = spark.createDataFrame([(0, 0, 0, 6)], "doc int, page int, a int, b int")
    got = {x.ord: x.comp for x in m.components(edges, df, ["doc", "page"]).collect()}
    assert got[6] == 0 and all(v == k for k, v in got.items() if k != 6)


def test_upper_median(spark):
    rows = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([5.0],)], "h array<double>")
    assert [r.v for r in rows.select(m.upper_median(F.col("h")).alias("v")).collect()] == [3.0, 5.0]


def test_caption_ties_go_to_the_first_line(spark):
    items = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 50.0, 50.0, "figure", 0.5)], BOX)
    lines = spark.createDataFrame([(0, 0, n, f"Figure 9 {n}", 0.0, 60.0, 50.0, 70.0) for n in (7, 3)], "doc int, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    out = o.aligned(items, o.candidates(lines), ["doc", "page"], ["doc", "page", "ord"]).first()
    assert out.line_no == 3 and out.final_type == "figure"
    far = lines.withColumn("y0", F.col("y0") + 1000).withColumn("y1", F.col("y1") + 1000)
    assert o.aligned(items, o.candidates(far), ["doc", "page"], ["doc", "page", "ord"]).first().caption == "No matching caption found."


def test_continued_captions(spark):
    rows = [(0, 1, "Figure 1 a", 0.0, 10.0), (0, 2, "goes on", 12.0, 20.0), (0, 3, "Table 1", 22.0, 30.0), (0, 4, "text", 90.0, 99.0)]
    lines = spark.createDataFrame([(d, n, t, 0.0, y, 50.0, z) for d, n, t, y, z in rows], "page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    out = {r.line_no: r for r in o.multiline(lines, ["page"]).collect()}
    assert out[1].caption == "Figure 1 a goes on" and out[1].n == 2 and out[3].caption == "Table 1" and set(out) == {1, 3}
    assert out[1].snippet == "Figure 1 a\ngoes on\nTable 1\ntext"
