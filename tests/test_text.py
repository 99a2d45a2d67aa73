import pytest

from leafgrid.functions import text as t
from leafgrid.operators import classify as k


def value(spark, text, make):
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "text string").select(make(F.col("text")).alias("v")).first().v


@pytest.mark.parametrize(
    "text, is_caption, kind, number, label",
    [
        ("Figure 1(a). x", True, "figure", 1, "a"), ("Fig. 3a.", True, "figure", 3, "a"), ("Table 2", True, "table", 2, None), ("图1 x", False, None, -1, None),
        ("图 1 x", True, "figure", -1, None), ("表：a", True, "table", -1, None), ("Scheme 4", True, "figure", -1, None), ("see Figure 3 and Table 2", False, None, 3, None),
    ],
)
def test_captions(spark, text, is_caption, kind, number, label):
    assert value(spark, text, t.is_caption) is is_caption
    assert value(spark, text, t.caption_kind) == kind
    assert value(spark, text, t.figure_number) == number
    assert value(spark, text, t.part_label) == label


def test_quantities(spark):
    found = value(spark, "5 seconds at 300 K, 2.5 MPa, pH = 7.5, 450 nm", t.conditions)
    assert [(c.name, c.value) for c in found] == [("temperature", "300 K"), ("wavelength", "450 nm"), ("pressure", "2.5 MPa"), ("time", "5 s"), ("ph", "pH = 7.5")]
    assert value(spark, "TiO2 NaCl and Fe2O3 At X TiO2", t.materials) == ["TiO2", "NaCl", "Fe2O3"]
    assert [(m.value, m.unit) for m in value(spark, "2.5 mg of 3 μm", t.measurements)] == [("2.5", "mg"), ("3", "μm")]


def test_no_evidence_is_a_bar_chart(spark):
    rows = spark.createDataFrame([("",)], "text string")
    from pyspark.sql import functions as F

    rows, main = k.with_main_scores(rows, F.col("text"), {}, {})
    rows, sub = k.with_sub_scores(rows, F.col("text"), "chart")
    r = rows.select(k.best(main).alias("m"), k.best(sub).alias("s"), k.calibrated(F.greatest(*sub.values())).alias("c")).first()
    assert (r.m, r.s, round(r.c, 4)) == ("chart", "bar_chart", 0.5312)
