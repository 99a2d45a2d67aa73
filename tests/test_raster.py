import numpy as np

from leafgrid.operators import raster


def flood(dark):
    seen, sizes = set(), []
    for start in zip(*np.nonzero(dark), strict=True):
        if start in seen:
            continue
        todo, n = [start], 0
        seen.add(start)
        while todo:
            y, x = todo.pop()
            n += 1
            for p in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if 0 <= p[0] < dark.shape[0] and 0 <= p[1] < dark.shape[1] and dark[p] and p not in seen:
                    seen.add(p)
                    todo.append(p)
        sizes.append(n)
    return sorted(sizes)


def test_components_match_flood_fill():
    rng = np.random.default_rng(3)
    for share in (0.1, 0.4, 0.6):
        dark = rng.random((23, 31)) < share
        assert sorted(np.unique(raster.labelled(dark)[dark], return_counts=True)[1].tolist()) == flood(dark)


def test_features_of_a_drawn_page(spark):
    grey = np.full((60, 80), 255, np.uint8)
    grey[10, 5:70] = 0  # a rule of 65 pixels
    grey[20:50, 40] = 0  # a rule of 30 pixels
    out = raster.features(grey, 40)
    assert out[2:6] == (5, 10, 69, 49) and out[6:8] == (65, 0) and out[8:10] == (2, 65)
    assert abs(out[0] - 95 / 4800) < 1e-12 and abs(out[1] - (1 - 95 / 4800)) < 1e-12
    rows = spark.createDataFrame([(1, bytearray(grey.tobytes()), 60, 80), (2, None, 0, 0), (3, bytearray(b""), 0, 0)], "id int, pixels binary, height int, width int")
    got = {r.id: r for r in raster.with_features(rows, ["id"]).collect()}
    assert got[1].across_pixels == 65 and got[2].ink == 0.0 and got[3].x0 is None
    assert raster.with_features(rows.where("false"), ["id"]).count() == 0


def test_text_rows():
    dark = np.zeros((40, 20), bool)
    dark[3:9, 2:15] = dark[15:21, 2:15] = dark[30:32, 2:15] = True
    assert raster.text_rows(dark) == 2
