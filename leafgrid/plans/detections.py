"""Queries of filters and scores on detections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafgrid.catalogue import query
from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import filters as f
from leafgrid.plans import common as c

KEY = ("doc_no", "page_index", "ord")
#: Page size of the queries, in pixels.
def W():
    return F.lit(900.0)


def H():
    return F.lit(950.0)


_FACTS = """d AS (SELECT *, (x0 * 7 + y0 * 3) % 100 / 250 AS ink, (x0 * 13 + y0) % 900 AS structure, ord % 4 + 1 AS n_rows, (ord + page_index) % 4 + 1 AS n_cols,
 CASE (x0 + y0)::BIGINT % 9 WHEN 0 THEN 'Abstract and results' WHEN 1 THEN 'University of Nowhere' WHEN 2 THEN 'see [1] and [2], et al.' WHEN 3 THEN 'Page 3 draft'
 WHEN 4 THEN 'a = b + c' WHEN 5 THEN 'Sample Value Result = 3' WHEN 6 THEN '参考文献' ELSE 'plain words' END AS near,
 (x1 - x0) AS w, (y1 - y0) AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CASE WHEN (x0 * 3 + y0)::BIGINT % 4 = 0 THEN 'arXiv:2101.00001v1' ELSE 'a picture' END AS ocr,
 (x0 + y0)::BIGINT % 2 = 0 AS confirmed, ord % 6 AS n_lines, x0 % 40 / 100 AS width_variation, (x0 * 5 + y0) % 150 AS h_lines, (y0 * 7 + x0) % 150 AS v_lines,
 ord % 5 + 1 AS t_n, y0 % 24 + 1 AS t_gap, x0 % 9 AS t_deviation, (y1 - y0) * ((x0 + y0) % 10) / 10 AS t_heights, (x0 * 11) % 120 AS grid_h, (y0 * 13) % 120 AS grid_v, (x0 * 17 + y0) % 36 / 10 AS edge_ratio FROM b)"""


def facts(spark, sf_dir):
    """Detections with the features that pixels and recognised text would give."""
    return facts_of(c.boxes(spark, sf_dir))


def facts_of(rows):
    texts = ["Abstract and results", "University of Nowhere", "see [1] and [2], et al.", "Page 3 draft", "a = b + c", "Sample Value Result = 3", "参考文献"]
    pick = (F.col("x0") + F.col("y0")).cast("long") % 9
    near = F.lit("plain words")
    for k, t in enumerate(texts):
        near = F.when(pick == k, F.lit(t)).otherwise(near)
    return (
        rows.withColumn("ink", (F.col("x0") * 7 + F.col("y0") * 3) % 100 / 250)
        .withColumn("structure", (F.col("x0") * 13 + F.col("y0")) % 900)
        .withColumn("n_rows", F.col("ord") % 4 + 1)
        .withColumn("n_cols", (F.col("ord") + F.col("page_index")) % 4 + 1)
        .withColumn("near", near)
        .withColumn("ocr", F.when((F.col("x0") * 3 + F.col("y0")).cast("long") % 4 == 0, "arXiv:2101.00001v1").otherwise("a picture"))
        .selectExpr(
            "*", "cast(x0 + y0 as long) % 2 = 0 as confirmed", "ord % 6 as n_lines", "x0 % 40 / 100 as width_variation", "(x0 * 5 + y0) % 150 as h_lines", "(y0 * 7 + x0) % 150 as v_lines",
            "ord % 5 + 1 as t_n", "y0 % 24 + 1 as t_gap", "x0 % 9 as t_deviation", "(y1 - y0) * ((x0 + y0) % 10) / 10 as t_heights", "(x0 * 11) % 120 as grid_h", "(y0 * 13) % 120 as grid_v",
            "(x0 * 17 + y0) % 36 / 10 as edge_ratio",
        )
    )


def _any(column: str, words) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words)


def _sum(column: str, words) -> str:
    return " + ".join(f"contains({column}, '{w}')::INT" for w in words)


_DETECTOR = "CASE {0} WHEN 'doclayout' THEN {1} WHEN 'table_transformer' THEN {2} WHEN 'publaynet' THEN {3} ELSE {4} END"
_WEIGHT = _DETECTOR.format("detector", "0.4::DOUBLE", "0.35::DOUBLE", "0.25::DOUBLE", "0.5::DOUBLE")
_TRUST = _DETECTOR.format("detector", "0.85::DOUBLE", "0.9::DOUBLE", "0.75::DOUBLE", "0.7::DOUBLE")
_LEAST = _DETECTOR.format("detector", "0.5", "0.7", "0.5", "0.5")
_RANK = "CASE detector WHEN 'table_transformer' THEN CASE type WHEN 'table' THEN 3 ELSE 1 END WHEN 'doclayout' THEN 2 ELSE 1 END"


@query(c.sql("b", "SELECT type, detector, count(*) AS n, count(*) FILTER (WHERE score BETWEEN 0 AND 1 AND type IN ('figure', 'table')) AS n_valid FROM b GROUP BY ALL"))
def det_validate(spark, sf_dir):
    ok = f.valid(Box.of(), F.col("type"), F.col("score"))
    return c.boxes(spark, sf_dir).groupBy("type", "detector").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"))


@query(c.sql("b", f"SELECT doc_no, page_index, ord, detector, score FROM b WHERE score >= {_LEAST}"))
def det_confidence_filter(spark, sf_dir):
    rows = c.boxes(spark, sf_dir).where(F.col("score") >= f.least_confidence(F.col("detector")))
    return rows.select(*KEY, "detector", "score")


@query(c.sql("b", f"SELECT doc_no, page_index, ord, {_WEIGHT} AS weight, {_TRUST} AS reliability, score * {_WEIGHT} * {_TRUST} AS weighted FROM b"))
def det_weighted_score(spark, sf_dir):
    d = F.col("detector")
    return c.boxes(spark, sf_dir).select(*KEY, f.weight(d).alias("weight"), f.reliability(d).alias("reliability"), f.weighted_score(d, F.col("score")).alias("weighted"))


@query(c.sql("b", f"""
SELECT doc_no, page_index, ord, detector, priority FROM (SELECT *, {_RANK} AS priority,
 row_number() OVER (PARTITION BY doc_no, page_index ORDER BY {_RANK} DESC, score DESC, ord) AS k FROM b) WHERE k = 1"""))
def det_priority_best(spark, sf_dir):
    rows = c.boxes(spark, sf_dir).withColumn("priority", f.priority(F.col("detector"), F.col("type")))
    best = rows.groupBy(*c.PAGE).agg(F.max(F.struct("priority", "score", (-F.col("ord")).alias("neg"), "detector")).alias("b"))
    return best.select(*c.PAGE, (-F.col("b.neg")).alias("ord"), "b.detector", "b.priority")


_SMALL = "(SELECT doc_no, page_index, ord, x0, y0, x0 + (x1 - x0) / 3 AS x1, y0 + (y1 - y0) / 2 AS y1 FROM b)"


@query(c.sql("b", f"SELECT doc_no, page_index, ord FROM {_SMALL} WHERE x1 - x0 >= 40 AND y1 - y0 >= 40 AND (x1 - x0) * (y1 - y0) >= 2000"))
def size_filter(spark, sf_dir):
    """Boxes, cut to a sixth here, that are large enough."""
    rows = c.boxes(spark, sf_dir).withColumns({"x1": F.col("x0") + (F.col("x1") - F.col("x0")) / 3, "y1": F.col("y0") + (F.col("y1") - F.col("y0")) / 2})
    return rows.where(f.large_enough(Box.of())).select(*KEY)


@query(c.sql("b", """
SELECT b.doc_no, b.page_index, ord, area / 36000 AS page_ratio, n_lines, area / 36000 > 0.85 AND n_lines >= 6 AS skipped
FROM (SELECT *, (x1 - x0) * (y1 - y0) AS area, count(*) OVER (PARTITION BY doc_no, page_index) AS n_lines FROM b) b"""))
def page_ratio_filter(spark, sf_dir):
    b = Box.of()
    rows = c.boxes(spark, sf_dir).withColumn("n_lines", F.count("*").over(Window.partitionBy(*c.PAGE)))
    skipped = f.fills_text_page(b, F.lit(36000.0), F.col("n_lines"))
    return rows.select(*KEY, (g.area(b) / 36000).alias("page_ratio"), "n_lines", skipped.alias("skipped"))


@query(c.sql("b", f"""WITH {_FACTS}
SELECT doc_no, page_index, ord, (cy < 95 AND w * h / 855000 < 0.05 AND w / h > 1.5 AND w / h < 8)
 OR (cx < 135 AND cy > 190 AND cy < 760 AND h > 142.5 AND w * h / 855000 > 0.02 AND w * h / 855000 < 0.15) AS candidate FROM d WHERE type = 'figure'"""))
def arxiv_candidates(spark, sf_dir):
    return c.boxes(spark, sf_dir).where("type = 'figure'").select(*KEY, f.arxiv_candidate(Box.of(), W(), H()).alias("candidate"))


@query(c.sql("b", f"""WITH {_FACTS}
SELECT doc_no, page_index, ord FROM d WHERE cx < 270 AND cy < 190 AND w * h / 855000 <= 0.05 AND w / h > 1.5 AND w / h < 8"""))
def arxiv_id_rule(spark, sf_dir):
    return c.boxes(spark, sf_dir).where(f.arxiv_corner(Box.of(), W(), H())).select(*KEY)


_MARGIN = """CASE WHEN cy < 95 AND h < 47.5 THEN 'header' WHEN cy > 855 AND h < 47.5 THEN 'footer'
 WHEN cx < 45 AND w < 90 THEN 'left_edge' WHEN cx > 855 AND w < 90 THEN 'right_edge' END"""


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, {_MARGIN} AS reason FROM d"))
def position_heuristics(spark, sf_dir):
    return c.boxes(spark, sf_dir).select(*KEY, f.margin_reason(Box.of(), W(), H()).alias("reason"))


_PATTERN = f"""CASE WHEN ({_any('lower(near)', f.TITLE_PATTERNS)}) AND h < 76 THEN 'title' WHEN ({_any('lower(near)', f.AUTHOR_PATTERNS)}) AND h < 95 THEN 'author'
 WHEN {_sum('lower(near)', f.REFERENCE_PATTERNS)} >= 2 THEN 'references' WHEN {_any('lower(near)', f.MARGIN_PATTERNS)} THEN 'margin' END"""


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, {_PATTERN} AS reason FROM d"))
def ocr_pattern(spark, sf_dir):
    return facts(spark, sf_dir).select(*KEY, f.pattern_reason(F.col("near"), Box.of(), H()).alias("reason"))


def _s_lines(density: float) -> str:
    return f"(t_n >= 3 AND t_gap > 0 AND t_deviation < t_gap * 0.5::DOUBLE AND t_gap >= greatest(5, h * 0.05::DOUBLE) AND t_gap <= least(30, h * 0.15::DOUBLE) AND t_heights / h > {density}::DOUBLE)"


_DENSE = "((ink > 0.08 AND structure < 200) OR (ink > 0.1 AND structure < 400) OR (structure < 100 AND ink > 0.02))"
_UNCONFIRMED = "(score BETWEEN 0.5 AND 0.7 AND NOT confirmed)"
_TEXT = f"""CASE WHEN type <> 'table' THEN NULL WHEN score < 0.7 THEN 'confidence' WHEN {_MARGIN} IS NOT NULL THEN 'place:' || {_MARGIN}
 WHEN {_PATTERN} IS NOT NULL THEN 'pattern:' || {_PATTERN} WHEN {_s_lines(0.4)} THEN 'lines' WHEN {_DENSE} THEN 'density' WHEN {_UNCONFIRMED} THEN 'unconfirmed' END"""


def _lines() -> f.Lines:
    return f.Lines(*(F.col(x) for x in ("t_n", "t_gap", "t_deviation", "t_heights")))


def _seen() -> f.Seen:
    return f.Seen(F.col("near"), F.col("ink"), F.col("structure"), _lines(), F.col("confirmed"))


def _text_reason():
    return f.text_reason(Box.of(), F.col("type"), F.col("score"), _seen(), W(), H())


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, {_TEXT} AS reason FROM d"))
def text_fp_cascade(spark, sf_dir):
    return facts(spark, sf_dir).select(*KEY, _text_reason().alias("reason"))


@query(c.sql("b", f"""WITH {_FACTS} SELECT doc_no, page_index, ord, CASE WHEN score < 0.7 THEN 'confidence' END AS confidence, 'place:' || {_MARGIN} AS place, 'pattern:' || {_PATTERN} AS pattern,
 CASE WHEN {_s_lines(0.4)} THEN 'lines' END AS lines, CASE WHEN {_DENSE} THEN 'density' END AS density, CASE WHEN {_UNCONFIRMED} THEN 'unconfirmed' END AS unconfirmed FROM d WHERE type = 'table'"""))
def explain_filter(spark, sf_dir):
    """Every rule's verdict on each table, not the first one's alone."""
    rules = f.text_rules(Box.of(), F.col("score"), _seen(), W(), H())
    return facts(spark, sf_dir).where("type = 'table'").select(*KEY, *(r.alias(n) for n, r in rules.items()))


@query(c.sql("b", f"WITH {_FACTS}, s AS (SELECT * FROM d WHERE type = 'table' AND score BETWEEN 0.5 AND 0.7) SELECT doc_no, page_index, ord, CASE WHEN {_DENSE} THEN 'density' WHEN {_UNCONFIRMED} THEN 'unconfirmed' END AS reason FROM s"))
def middling_tables(spark, sf_dir):
    """Tables of middling scores by the last two rules, the others off."""
    rows = facts(spark, sf_dir).where("type = 'table' and score between 0.5 and 0.7")
    reason = f.text_reason(Box.of(), F.col("type"), F.col("score"), _seen(), W(), H(), without=("confidence", "place", "pattern", "lines"))
    return rows.select(*KEY, reason.alias("reason"))


_RAW = "r AS (SELECT doc_no, page_index, ord, CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 13 = 0 THEN 'nan'::DOUBLE ELSE x0 END AS x0, y0, x1, y1, CASE WHEN (x0 + y0)::BIGINT % 7 = 0 THEN 'formula' ELSE type END AS type, score * 1.25::DOUBLE AS score FROM b)"


@query(c.sql("b", f"WITH {_RAW} SELECT doc_no, page_index, ord, CASE WHEN x0 IS NULL OR isnan(x0) THEN 'coordinates' WHEN type NOT IN ('figure', 'table') THEN 'type' WHEN score NOT BETWEEN 0 AND 1 THEN 'score' END AS reason FROM r WHERE reason IS NOT NULL"))
def det_quarantine(spark, sf_dir):
    """Detections that are none, with the reason, set aside."""
    rows = c.boxes(spark, sf_dir)
    x0 = F.when(F.col("ord") % 11 == 0, None).when(F.col("ord") % 13 == 0, float("nan")).otherwise(F.col("x0"))
    kind = F.when((F.col("x0") + F.col("y0")).cast("long") % 7 == 0, "formula").otherwise(F.col("type"))
    rows = rows.withColumns({"type": kind, "x0": x0, "score": F.col("score") * 1.25})
    return f.removed(rows, f.det_reason(Box.of(), F.col("type"), F.col("score"))).select(*KEY, "reason")


@query(c.sql("b", """SELECT doc_no, page_index, ord, array_to_string(list_filter([CASE WHEN score * 1.25::DOUBLE NOT BETWEEN 0 AND 1 THEN 'overall' END, CASE WHEN (x0 - 20) / 500 NOT BETWEEN 0 AND 1 THEN 'size' END,
 CASE WHEN CASE WHEN ord % 3 = 0 THEN NULL ELSE (y0 - 30) / 600 END NOT BETWEEN 0 AND 1 THEN 'position' END], lambda x: x IS NOT NULL), ',') AS broken FROM b"""))
def range_checks(spark, sf_dir):
    """Which scores of a result are not between 0 and 1."""
    values = {"overall": F.col("score") * 1.25, "size": (F.col("x0") - 20) / 500, "position": F.when(F.col("ord") % 3 != 0, (F.col("y0") - 30) / 600)}
    return c.boxes(spark, sf_dir).select(*KEY, F.concat_ws(",", f.out_of_unit(values)).alias("broken"))


_CANDIDATE = """((cy < 95 AND w * h / 855000 < 0.05 AND w / h > 1.5 AND w / h < 8) OR (cx < 135 AND cy > 190 AND cy < 760 AND h > 142.5 AND w * h / 855000 > 0.02 AND w * h / 855000 < 0.15))"""


@query(c.sql("b", f"""WITH {_FACTS} SELECT doc_no, page_index, ord, type = 'figure' AND {_CANDIDATE} AND contains(lower(ocr), 'arxiv') AS removed, type = 'figure' AND {_CANDIDATE} AS removed_unread FROM d"""))
def arxiv_filter(spark, sf_dir):
    """Figures removed as preprint stamps, with recognised text and without."""
    candidate, kind = f.arxiv_candidate(Box.of(), W(), H()), F.col("type")
    both = [f.arxiv_removed(kind, candidate, F.col("ocr"), on).alias(n) for n, on in (("removed", True), ("removed_unread", False))]
    return facts(spark, sf_dir).select(*KEY, *both)


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, cy / 950 AS centre_y, w * h / 855000 AS share, w / h AS aspect FROM d WHERE type = 'figure' AND cy < 95 AND w * h < 855000 * 0.05::DOUBLE AND w / h > 1.5 AND w / h < 8"))
def arxiv_suspects(spark, sf_dir):
    """Small wide figures at the top, with what makes them suspect."""
    b = Box.of()
    rows = c.boxes(spark, sf_dir).where(f.arxiv_suspect(b, F.col("type"), W(), H()))
    return rows.select(*KEY, (g.centre(b)[1] / H()).alias("centre_y"), (g.signed_area(b) / (W() * H())).alias("share"), g.aspect(b).alias("aspect"))


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, type, ink * 2.5::DOUBLE AS ink, h_lines, v_lines FROM d WHERE type = 'table' AND ink * 2.5::DOUBLE > 0.8 AND h_lines < 100 AND v_lines < 100 AND structure < 600"))
def text_suspects(spark, sf_dir):
    """Tables that may be text: much ink, no lines, no structure."""
    rows = facts(spark, sf_dir).withColumn("ink", F.col("ink") * 2.5)
    suspect = f.text_suspect(F.col("type"), F.col("ink"), F.col("h_lines"), F.col("v_lines"), F.col("structure") >= 600)
    return rows.where(suspect).select(*KEY, "type", "ink", "h_lines", "v_lines")


@query(c.sql("b", f"WITH {_FACTS} SELECT coalesce({_TEXT}, 'kept') AS reason, count(*) AS n FROM d GROUP BY ALL"))
def removed_by_reason(spark, sf_dir):
    return facts(spark, sf_dir).groupBy(F.coalesce(_text_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(c.sql("b", f"""WITH {_FACTS}, t AS (SELECT *, {_TEXT} AS reason FROM d)
SELECT doc_no, page_index, ord, 'kept' AS part FROM t WHERE reason IS NULL UNION ALL SELECT doc_no, page_index, ord, 'removed' FROM t WHERE reason IS NOT NULL"""))
def kept_removed(spark, sf_dir):
    rows, reason = facts(spark, sf_dir), _text_reason()
    part = lambda df, name: df.select(*KEY, F.lit(name).alias("part"))
    return part(f.kept(rows, reason), "kept").unionByName(part(f.removed(rows, reason), "removed"))


_SIGNS, _WORDS = _sum('near', f.MATH_SIGNS), _sum('lower(near)', [w.lower() for w in f.TABLE_WORDS])
_EQUATION = f"((coalesce(w / nullif(h, 0), 0) > 4 AND h < 100) OR ({_SIGNS} > {_WORDS} AND {_SIGNS} >= 2) OR edge_ratio > 3)"


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, {_EQUATION} AS equation FROM d"))
def math_equation(spark, sf_dir):
    return facts(spark, sf_dir).select(*KEY, f.equation(Box.of(), F.col("near"), F.col("edge_ratio")).alias("equation"))


_CITATIONS = " + ".join(f"regexp_matches(lower(near), '{p}')::INT" for p in f.CITATION_PATTERNS)
_TABLE = f"""CASE WHEN w * h < 5000 THEN 'area' WHEN w / h > 8 OR w / h < 0.15 THEN 'aspect' WHEN n_rows < 2 OR n_cols < 2 THEN 'cells'
 WHEN (cy < 95 OR cy > 855) AND h < 47.5 THEN 'margin' WHEN (cx < 45 OR cx > 855) AND w < 90 THEN 'edge' WHEN {_CITATIONS} >= 2 THEN 'citations'
 WHEN ({_any('lower(near)', f.TEXT_WORDS)}) AND h < 76 THEN 'section' WHEN h_lines < 30 AND v_lines < 30 AND n_lines >= 4 AND width_variation < 0.15::DOUBLE THEN 'paragraph'
 WHEN {_s_lines(0.3)} THEN 'lines' WHEN ink > 0.04 AND structure < 400 THEN 'ink' WHEN ink > 0.08 AND structure < 800 THEN 'dense'
 WHEN structure < 200 AND ink > 0.015 THEN 'bare' WHEN grid_h < 50 AND grid_v < 50 THEN 'grid' WHEN {_EQUATION} THEN 'equation' END"""


def _table_reason():
    of = lambda *names: (F.col(n) for n in names)
    seen = f.Table(*of("n_rows", "n_cols", "near", "ink", "structure", "h_lines", "v_lines", "n_lines", "width_variation"), _lines(), *of("grid_h", "grid_v", "edge_ratio"))
    return f.table_reason(Box.of(), seen, W(), H())


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, {_TABLE} AS reason FROM d WHERE type = 'table'"))
def valid_table(spark, sf_dir):
    return facts(spark, sf_dir).where("type = 'table'").select(*KEY, _table_reason().alias("reason"))


@query(c.sql("b", f"WITH {_FACTS}, t AS (SELECT *, {_TABLE} AS reason FROM d WHERE type = 'table') SELECT doc_no, page_index, ord FROM t WHERE reason IS NULL"))
def invalid_table_filter(spark, sf_dir):
    """The tables that are valid."""
    return f.kept(facts(spark, sf_dir).where("type = 'table'"), _table_reason()).select(*KEY)


@query(c.sql("b", f"""WITH {_FACTS}
SELECT doc_no, page_index, ord, CASE WHEN (w / h > 5 OR w / h < 0.2) AND ink < 0.05 THEN 'arrow' WHEN w * h < 500 THEN 'tiny' WHEN w * h < 4000 THEN 'small'
 WHEN ink < 0.005 THEN 'empty' END AS reason FROM d"""))
def noise_filter(spark, sf_dir):
    return facts(spark, sf_dir).select(*KEY, f.noise_reason(Box.of(), F.col("ink"), 4000).alias("reason"))


@query(c.sql("b", "SELECT type, count(*) AS n FROM b GROUP BY ALL"))
def type_counts(spark, sf_dir):
    return c.boxes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


@query(c.sql("b", "SELECT doc_no, detector, count(*) AS n FROM b GROUP BY ALL"))
def label_histogram(spark, sf_dir):
    return c.boxes(spark, sf_dir).groupBy("doc_no", "detector").agg(F.count("*").alias("n"))
