import pytest
from pyspark.sql import functions as F

from leafgrid.config import Settings, as_bool, as_number, as_text
from leafgrid.operators import detectors as d

BOX = {"x0": 0.0, "y0": 0.0, "x1": 10.0, "y1": 10.0}


def test_settings():
    s = Settings.read({"max_workers": "8", "enable_visual_merge": "off", "fusion_strategy": " voting ", "nms_iou_threshold": "none", "detector_weights": {"DocLayout": "0.9"}, "other": 1})
    assert (s.max_workers, s.enable_visual_merge, s.fusion_strategy, s.nms_iou_threshold, s.detector_weights) == (8, False, "voting", 0.5, {"doclayout": 0.9})
    assert Settings.read(s.as_dict()) == s
    with pytest.raises(ValueError, match="fusion_strategy.*max_workers") as e:
        Settings.read({"fusion_strategy": "best", "max_workers": 0})
    assert "confidence" not in str(e.value)
    with pytest.raises(ValueError, match="sum to 1"):
        Settings.read({"quality_weights": {"a": 0.5}})
    assert as_bool("Yes", False) and not as_bool("off", True) and as_bool("?", True)
    assert as_number("x", 3) == 3 and as_number(" 4 ", 3, int) == 4 and as_text("  ", "d") == "d"


def pages(spark):
    return spark.createDataFrame([(1, bytearray(b"xxxx")), (2, bytearray(b"bad")), (3, bytearray(b"")), (4, None)], "page int, image binary")


def test_detectors_and_their_cascade(spark):
    def find(data):  # workers do not import this module
        if data == b"bad":
            raise RuntimeError("no model")
        for k in range(len(data)):
            yield {**BOX, "x0": 20.0 * k, "x1": 20.0 * k + 10, "label": "Figure" if k % 2 else "text", "score": 0.9 - 0.2 * k}

    one = d.detect(pages(spark), ["page"], "one", find)
    assert [(r.page, r.type, r.x0, r.detector) for r in one.collect()] == [(1, "figure", 20.0, "one")]
    always = lambda data: iter([{**BOX, "label": "table", "score": 0.6}])
    two = d.detect(pages(spark), ["page"], "two", always)
    assert sorted((r.page, r.detector) for r in d.cascade([one, two], ["page"]).collect()) == [(1, "one"), (2, "two"), (3, "two")]
    assert sorted((r.page, r.x0, r.run, r.score) for r in d.pooled([one.select("page", "x0", "y0", "x1", "y1"), two.select("page", "x0", "y0", "x1", "y1")] * 2, ["page"]).collect()) == [
        (1, 0.0, 1, 0.8), (1, 20.0, 0, 0.8), (2, 0.0, 1, 0.8), (3, 0.0, 1, 0.8)]


def test_text_of_crops_and_stamps(spark):
    read = lambda data: iter([{"text": t} for t in data.decode().split("|")]) if data != b"bad" else 1 / 0
    crops = spark.createDataFrame([(1, bytearray(b"arXiv|1234")), (2, bytearray(b"bad")), (3, None)], "n int, image binary")
    assert sorted((r.n, r.ocr_text) for r in d.recognised(crops, ["n"], read).collect()) == [(1, "arXiv 1234"), (2, ""), (3, "")]
    figures = crops.selectExpr("n", "image", "'figure' as type", "100d as x0", "10d as y0", "200d as x1", "40d as y1")
    w, h = F.lit(900.0), F.lit(1000.0)
    assert sorted((r.n, r.removed) for r in d.stamps(figures, ["n"], read, w, h).collect()) == [(1, True), (2, False), (3, False)]
    assert all(r.removed for r in d.stamps(figures, ["n"], None, w, h).collect())


def test_structure_and_classifiers(spark):
    rows = lambda data: iter([{"label": "row", "score": 0.9}, {"label": "row", "score": 0.5}, {"label": "cell", "score": 0.7}])
    crops = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"bad")), (3, bytearray(b"c"))], "n int, image binary")
    assert [tuple(r) for r in d.structure(crops, ["n"], rows).orderBy("n").collect()] == [(1, 1, 0, 1), (2, 1, 0, 1), (3, 1, 0, 1)]
    first = lambda data: iter([{"kind": "bar", "confidence": 0.9 if data == b"a" else 0.1}]) if data != b"bad" else 1 / 0
    second = lambda data: iter([{"kind": "photo", "confidence": 0.4}] if data != b"c" else [])
    got = sorted((r.n, r.kind, r.confidence) for r in d.classified(crops, ["n"], first, second).collect())
    assert got == [(1, "bar", 0.9), (2, "photo", 0.4), (3, "unknown", 0.0)]
