import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import merging as m


class Later:
    """A box whose columns are made when they are asked for, as columns need a session."""

    def __init__(self, prefix):
        self.prefix = prefix

    def __getattr__(self, name):
        return getattr(Box.of(self.prefix), name)


A, B = Later("a_"), Later("b_")


def one(spark, a, b, *columns):
    row = spark.createDataFrame([(*map(float, a), *map(float, b))], "a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double")
    return row.select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()



@pytest.mark.parametrize(
    "a, b, iou, gap, where",
    [
        ((0, 0, 10, 10), (10, 0, 20, 10), 0.0, 0.0, "right"),
        ((0, 0, 10, 10), (0, 0, 10, 10), 1.0, 0.0, "inside"),
        ((0, 0, 100, 100), (10, 10, 20, 20), 0.01, 0.0, "inside"),
        ((0, 0, 10, 10), (13, 14, 20, 20), 0.0, 5.0, "below"),
        ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3, 0.0, "overlap"),
    ],
)
def test_pairs(spark, a, b, iou, gap, where):
    r = one(spark, a, b, g.iou(A, B), g.distance(A, B), g.position(A, B), g.iou(B, A))
    assert r.c0 == pytest.approx(iou) == r.c3 and r.c1 == gap and r.c2 == where


def test_contains_is_symmetric_and_flat_boxes_have_no_end(spark):
    r = one(spark, (0, 0, 100, 100), (10, 10, 20, 20), g.contains(A, B), g.contains(B, A))
    assert r.c0 and r.c1
    assert one(spark, (0, 0, 5, 0), (0, 0, 1, 1), g.aspect(A), g.aspect(A, 0.0), g.iou(A, A)) == (math.inf, 0.0, 0.0)


def test_the_two_ways_to_expand(spark):
    w = F.lit(50.0)
    r = one(spark, (2, 2, 48, 20), (0, 0, 1, 1), *g.expand(A, 4, w), *g.expand_if_bounded(A, 4, w))
    assert tuple(r) == (0, 0, 50, 24, 0, -2, 50, 24)


side = st.integers(0, 60)
box = st.tuples(side, side, side, side).map(lambda t: (t[0], t[1], t[0] + t[2], t[1] + t[3]))


@given(box, box)
@settings(max_examples=200, deadline=None)
def test_plain_iou_is_symmetric_and_within_one(a, b):
    assert m.iou_value(a, b) == m.iou_value(b, a) and 0 <= m.iou_value(a, b) <= 1
    assert m.overlap_value(a, b) >= m.iou_value(a, b)


def _joins(a, b):
    return m.iou_value(a["box"], b["box"]) >= 0.3 or m.overlap_value(a["box"], b["box"]) >= 0.7


@given(st.lists(box, max_size=8))
@settings(max_examples=200, deadline=None)
def test_merging_is_a_fixpoint_and_loses_no_box(boxes):
    rows = [{"box": tuple(map(float, b)), "score": 0.5, "type": "figure", "n": 1, "sig": ""} for b in boxes]
    grown = m.absorb(rows, _joins)
    assert sum(r["n"] for r in grown) == len(rows)
    for out, again in ((grown, m.absorb(grown, _joins)), (done := m.merge_rounds(rows, _joins, 100), m.merge_rounds(done, _joins, 1))):
        assert [o["box"] for o in again] == [o["box"] for o in out]
        for r in rows:
            assert any(o["box"][0] <= r["box"][0] and o["box"][1] <= r["box"][1] and o["box"][2] >= r["box"][2] and o["box"][3] >= r["box"][3] for o in out)


def test_the_two_counts_of_merging():
    rows = [{"box": (0.0, 0.0, 10.0, 10.0), "score": s, "type": t, "n": 2, "sig": g} for s, t, g in ((0.2, "figure", ""), (0.9, "table", "Table 1"))]
    joins = lambda a, b: True
    assert m.merge_rounds(rows, joins, 1)[0] == {"box": (0, 0, 10, 10), "score": 0.9, "type": "table", "n": 2}
    assert m.absorb(rows, joins)[0] == {"box": (0, 0, 10, 10), "score": 0.9, "type": "table", "n": 4, "sig": "Table 1"}
