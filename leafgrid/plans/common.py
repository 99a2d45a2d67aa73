"""What the queries share: numbered boxes, pairs of a page, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafgrid import sources

PAGE = ["doc_no", "page_index"]
ORDER = ["y0", "x0", "y1", "x1", "type", "detector", "score", "l_orderkey", "l_partkey", "l_suppkey"]
TRUTH_ORDER = ["y0", "x0", "y1", "x1", "type", "l_orderkey", "l_partkey", "l_suppkey"]
CORNERS = ("x0", "y0", "x1", "y1")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """Rows with their place among those of ``by`` in a total order; equal rows are interchangeable."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def corners(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("double") for c in CORNERS})


def boxes(spark: SparkSession, sf_dir: str, dealt: list[str] | None = None) -> DataFrame:
    """Detections: doc_no, page_index, ord, corners, type, detector, score; ``dealt``: the part of the page's key that rows are dealt by."""
    rows = sources.entity(spark, sf_dir, "boxes")
    rows = numbered(rows.repartition(*dealt) if dealt else rows, PAGE, ORDER)
    return corners(rows).select(*PAGE, "ord", *CORNERS, "type", "detector", "score")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(sources.entity(spark, sf_dir, "truth"), PAGE, TRUTH_ORDER)
    return corners(rows).select(*PAGE, "ord", *CORNERS, "type")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(sources.entity(spark, sf_dir, "captions"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corners(sources.entity(spark, sf_dir, "lines")).withColumn("line_no", F.col("line_no").cast("int"))


def pairs(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one page with the first box's columns under a_ and the second's under b_."""
    side = lambda p: rows.select(*PAGE, *(F.col(c).alias(p + c) for c in ("ord", *CORNERS, *keep)))
    return side("a_").join(side("b_"), PAGE).where("a_ord < b_ord")


_BOXES = f"""b AS (SELECT doc_no, page_index, row_number() OVER (PARTITION BY doc_no, page_index ORDER BY {", ".join(ORDER)})::INT AS ord,
 x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, type, detector, score FROM fx_boxes)"""
_TRUTH = f"""g AS (SELECT doc_no, page_index, row_number() OVER (PARTITION BY doc_no, page_index ORDER BY {", ".join(TRUTH_ORDER)})::INT AS ord,
 x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, type FROM fx_truth)"""
_CAPTIONS = "c AS (SELECT doc_no, page_index, line_no, text, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM fx_captions)"
_LINES = "l AS (SELECT doc_id, page_index, line_no::INT AS line_no, text, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM fx_lines)"
_PAIRS = f"""p AS (SELECT a.doc_no, a.page_index, {", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in ("ord", *CORNERS, "type", "score"))}
 FROM b a JOIN b b ON a.doc_no = b.doc_no AND a.page_index = b.page_index AND a.ord < b.ord)"""
_NEEDS = {"b": [("fx_boxes", "boxes")], "g": [("fx_truth", "truth")], "c": [("fx_captions", "captions")], "l": [("fx_lines", "lines")], "p": []}
_CTE = {"b": _BOXES, "g": _TRUTH, "c": _CAPTIONS, "l": _LINES, "p": _PAIRS}


def sql(use: str, select: str, recursive: bool = False) -> str:
    """A query over boxes b, truth g, captions c, lines l, pairs p: ``use`` names those it needs."""
    ctes = []
    for k in use:
        ctes += [f"{n} AS ({sources.view(v)})" for n, v in _NEEDS[k]] + [_CTE[k]]
    own = select.strip()
    if own.startswith("WITH "):
        return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + ",\n" + own[5:]
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" + own


def s_area(p: str) -> str:
    return f"(greatest(0, {p}x1 - {p}x0) * greatest(0, {p}y1 - {p}y0))"


def s_inter(p: str, q: str) -> str:
    return f"(greatest(0, least({p}x1, {q}x1) - greatest({p}x0, {q}x0)) * greatest(0, least({p}y1, {q}y1) - greatest({p}y0, {q}y0)))"


def s_iou(p: str, q: str) -> str:
    i = s_inter(p, q)
    return f"(CASE WHEN {s_area(p)} + {s_area(q)} - {i} > 0 THEN {i} / ({s_area(p)} + {s_area(q)} - {i}) ELSE 0 END)"


def s_overlap(p: str, q: str) -> str:
    return f"(CASE WHEN least({s_area(p)}, {s_area(q)}) > 0 THEN {s_inter(p, q)} / least({s_area(p)}, {s_area(q)}) ELSE 0 END)"


def s_distance(p: str, q: str) -> str:
    dx = f"greatest(0, greatest({p}x0, {q}x0) - least({p}x1, {q}x1))"
    dy = f"greatest(0, greatest({p}y0, {q}y0) - least({p}y1, {q}y1))"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"
