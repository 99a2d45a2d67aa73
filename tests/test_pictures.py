import numpy as np

from leafgrid.operators import pictures as pc
from leafgrid.plans.pictures import unpng
from leafgrid.sources import files as fl


def blank(h=100, w=200):
    return np.full((h, w), 255, np.uint8)


def test_refined_bounds():
    g = blank()
    assert pc.refined(g) == (0, 0, 200, 100) and pc.precision(g) == 0
    g[20:40, 3:50] = 0
    assert pc.refined(g) == (0, 15, 57, 45)  # cut at the left, so that the width is kept
    assert pc.precision(g) == 20 * 47 / g.size


def test_lines_of_text():
    g = blank(100, 200)
    for y in (10, 30, 50, 70):
        g[y : y + 10, 10:190:3] = 0  # strokes two apart
    g[90:93, 10:190] = 0  # too thin
    assert pc.text_lines(g) == (4, 10.0, 0.0, 40.0)
    assert pc.text_lines(blank(0, 0)) == (0, 0.0, 0.0, 0.0)
    assert pc.otsu(g) < 255


def test_splits():
    g = blank(120, 300)
    g[20:80, 20:100] = 0
    g[20:80, 180:260] = 0
    assert pc.split(g) == [(10, 10, 110, 90), (170, 10, 270, 90)]
    g[40:50, 100:165] = 0  # 15 apart
    assert pc.split(g) == []
    g = blank(120, 300)
    g[20:80, 20:100] = 0
    assert pc.split(g) == []


def test_grids_and_composites():
    assert pc.in_grid([(0, 0), (100, 5), (2, 100), (98, 103)])
    assert not pc.in_grid([(0, 0), (100, 5), (200, 100), (298, 103)])
    assert pc.in_grid([(0, 0), (20, 80)]) and not pc.in_grid([(0, 0), (80, 80)]) and not pc.in_grid([(0, 0), (100, 0)])
    g = blank(200, 200)
    for y in (10, 120):
        for x in (10, 120):
            g[y : y + 60, x : x + 60] = 0
    assert pc.composite(g) and not pc.composite(blank())


def test_table_rules():
    g = blank(120, 300)
    for y in (10, 50, 100):
        g[y, 20:280] = 0
    h_pixels, v_pixels, h_rules, v_rules, grid, simple, crossings = pc.table_rules(g)
    assert h_rules == 3 and v_rules == 0 and not grid and simple and crossings == 0 and h_pixels > 3 * 250 and v_pixels == 0
    g[10:100, 150] = 0
    assert pc.table_rules(g)[3] >= 1


def test_ruled_boxes():
    g = blank(200, 400)
    for y in (20, 60, 100):
        g[y, 50:250] = 0
    for x in (50, 150, 249):
        g[20:101, x] = 0
    g[150, 10:390] = 0  # a rule alone
    assert pc.ruled_boxes(g) == [(50, 20, 250, 101)]
    assert pc.ruled_boxes(blank()) == [] == pc.ruled_boxes(blank(0, 0))


def test_drawn_in():
    g = blank(200, 300)
    for y in (60, 100, 140):
        g[y, 50:250] = 0
    x0, y0, x1, y1 = pc.drawn_in(g)
    assert 20 <= x0 < 50 and 30 <= y0 < 60 and 250 < x1 <= 285 and 140 < y1 <= 175
    assert pc.drawn_in(blank()) == (0, 0, 200, 100)
    g = blank(100, 100)
    g[30:70, 30:70:3] = 0  # no rules: rows and columns with ink
    assert pc.drawn_in(g) == (15, 15, 84, 84)


def test_beside_a_caption():
    g = blank(400, 300)
    g[100:200, 50:250] = 0  # a figure
    g[210:220, 50:250] = 0  # its caption, as text
    lines = [(50, 210, 250, 220)]
    assert pc.beside_caption(g, lines, lines) == [(50, 100, 250, 200)]
    assert pc.beside_caption(blank(400, 300), lines, lines) == []


def test_peaks_and_textures():
    v = np.array([0, 5, 0, 0, 7, 7, 7, 0, 0, 0, 0, 0, 0, 0, 6, 0])
    assert pc.peaks(v, 1, 1).tolist() == [1, 5, 14] and pc.peaks(v, 6, 1).tolist() == [5, 14] and pc.peaks(v, 1, 6).tolist() == [5, 14]
    r = np.random.default_rng(1)
    noise = r.integers(0, 256, (64, 64)).astype(np.uint8)
    assert pc.laplacian_variance(noise) > 500 and pc.laplacian_variance(blank()) == 0
    assert pc.entropy(noise) > 7 and abs(pc.entropy(blank())) < 1e-6
    microscopy, sem, tem, chart, heatmap, spectrum, figure = pc.scores(noise)
    assert microscopy == 1.0 and figure == "photo" and tem >= 0.5
    assert pc.scores(blank())[-1] == "chart" and pc.scores(blank(0, 0)) == (0.0,) * 6 + ("unknown",)
    assert pc.photo_score(60, 2, 900) == 1.0


def test_text_looks_like_text():
    r = np.random.default_rng(2)
    g = blank(200, 300)
    for y in range(10, 190, 18):
        for x in range(10, 290, 9):
            g[y : y + r.integers(5, 8), x : x + 4] = 0
    assert pc.text_likeness(g) >= 0.7 > pc.text_likeness(blank())


def test_previews(spark):
    g = np.arange(60, dtype=np.uint8).reshape(6, 10)
    pages = spark.createDataFrame([(1, bytearray(g.tobytes()), 6, 10)], "page int, pixels binary, height int, width int")
    boxes = spark.createDataFrame([(1, 7, 2.0, 1.0, 5.9, 4.0), (1, 8, 20.0, 1.0, 25.0, 4.0)], "page int, ord int, x0 double, y0 double, x1 double, y1 double")
    got = {r.ord: r.png for r in pc.previews(boxes, pages, ["page"], ["page", "ord"]).collect()}
    assert got[8] is None and (unpng(bytes(got[7])) == g[1:4, 2:5]).all()


def test_hooks_read_documents_and_survive_errors(spark, tmp_path):
    for name, text in (("a", b"one\ntwo"), ("b", b""), ("c", b"bad")):
        (tmp_path / name).write_bytes(text)

    def read(content):
        if content == b"bad":
            raise ValueError("broken")
        for k, line in enumerate(content.split(b"\n") if content else []):
            yield {"line_no": k, "text": line.decode()}

    rows = fl.documents(spark, f"{tmp_path}/*", read, "line_no int, text string").collect()
    assert sorted((r.path[-1], r.line_no, r.text, r.error) for r in rows if not r.error) == [("a", 0, "one", None), ("a", 1, "two", None)]
    assert [(r.path[-1], r.text, r.error) for r in rows if r.error] == [("c", None, "ValueError: broken")]
    assert all(len(r.doc_id) == 12 for r in rows)
    assert fl.capable({"json": "json", "none": "no_such_module"}) == {"json": True, "none": False}


def test_packages(spark, tmp_path):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([("d1", "fig_0001", "figure", 0, 1.0, 2.0, 3.0, 4.0), ("d2", "table_0001", "table", 1, 1.0, 2.0, 3.0, 4.0)], "doc string, item_id string, type string, page_index int, x0 double, y0 double, x1 double, y1 double")
    fl.write_package(items, "doc", F.concat("doc", F.lit(".pdf")), str(tmp_path / "p"), {"ocr": False})
    got = fl.read_items(spark, str(tmp_path / "p"), "doc").collect()
    assert sorted((r.doc, r.item_id, r.subtype, tuple(r.bbox), r.caption) for r in got) == [("d1", "fig_0001", "unknown", (1.0, 2.0, 3.0, 4.0), ""), ("d2", "table_0001", "unknown", (1.0, 2.0, 3.0, 4.0), "")]
    assert (tmp_path / "p/evidence/doc=d1/item_id=fig_0001").is_dir() and (tmp_path / "p/params/doc=d2").is_dir()


def test_csv_round_trip(spark, tmp_path):
    rows = [('a "b", c', 1.5), ("", 2.0), ("x\ny", 3.0)]
    df = spark.createDataFrame(rows[:1], "category string, value double")
    fl.write_csv(df, str(tmp_path / "c"))
    assert [tuple(r) for r in fl.read_csv(spark, str(tmp_path / "c"), "category string, value double").collect()] == rows[:1]
    grid = spark.createDataFrame([([["a", None], ['q"', "x,y"]],)], "grid array<array<string>>")
    from pyspark.sql import functions as F

    assert grid.select(fl.csv_text(F.col("grid")).alias("t")).first().t == 'a,\n"q""","x,y"\n'
