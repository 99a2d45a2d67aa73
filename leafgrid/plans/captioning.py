"""Queries of captions and lines beside boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.catalogue import query
from leafgrid.functions import text as t
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.plans import common as c

KEY = [*c.PAGE, "ord"]
_END = r"(\b|$)"
_WORD = "[^\\p{L}\\p{N}_]"
#: what a caption begins with where \b knows ASCII only
S_CAPTION = rf"(?i)^\s*((fig\.?|figure|table|tab\.?|scheme|chart)\b|[图表]($|{_WORD}))"
S_FIGURE = rf"(?i)^\s*((fig\.?|figure|scheme|chart)\b|图($|{_WORD}))"
S_TABLE = rf"(?i)^\s*((table|tab\.?)\b|表($|{_WORD}))"
_KIND = f"CASE WHEN regexp_matches(trim(text), '{S_FIGURE}') THEN 'figure' WHEN regexp_matches(trim(text), '{S_TABLE}') THEN 'table' END"
_NUMBER = r"coalesce(try_cast(nullif(regexp_extract(text, '(?i)(?:fig\.?|figure|table|tab\.?)\s*(\d+)', 1), '') AS INT), -1)"
_LABEL = "coalesce(" + ", ".join(f"nullif(lower(regexp_extract(text, '{p}', 1)), '')" for p in t.LABELS) + ")"
_TYPE = r"CASE WHEN regexp_matches(lower(trim({0})), '^(fig|figure|scheme|chart|图)') THEN 'figure' WHEN regexp_matches(lower(trim({0})), '^(table|tab\.|表)') THEN 'table' ELSE '' END"
_K = f"k AS (SELECT *, {_KIND} AS kind, {_NUMBER} AS number, {_LABEL} AS label FROM c WHERE {_KIND} IS NOT NULL)"
_GAP = "CASE WHEN k.y0 > b.y1 THEN k.y0 - b.y1 WHEN k.y1 < b.y0 THEN b.y0 - k.y1 ELSE 0 END"
_SHARED = "CASE WHEN greatest(0, least(b.x1, k.x1) - greatest(b.x0, k.x0)) / greatest(1, least(b.x1 - b.x0, k.x1 - k.x0)) < 0.2 THEN 50 ELSE 0 END"
_ON = "b.doc_no = k.doc_no AND b.page_index = k.page_index"
_B = "b.doc_no, b.page_index, b.ord"


def _captions(spark, sf_dir):
    return o.candidates(c.captions(spark, sf_dir))


@query(c.sql("c", f"SELECT line_no, text, regexp_matches(text, '{S_CAPTION}') AS is_caption, {_KIND} AS kind, {_TYPE.format('text')} AS type, {_NUMBER} AS number, {_LABEL} AS label FROM c"))
def caption_lines(spark, sf_dir):
    x = F.col("text")
    return c.captions(spark, sf_dir).select(
        "line_no", "text", t.is_caption(x).alias("is_caption"), t.caption_kind(x).alias("kind"), t.caption_type(x).alias("type"),
        t.figure_number(x).alias("number"), t.part_label(x).alias("label"),
    )


def _nearest_sql(wrong: str, aside: str) -> str:
    return c.sql("bc", f"""WITH {_K}, s AS (SELECT {_B}, k.kind, {_GAP} AS gap, row_number() OVER (PARTITION BY {_B} ORDER BY {_GAP} + CASE WHEN {wrong} THEN 120 ELSE 0 END
 + {aside}, k.line_no) AS r FROM b JOIN k ON {_ON})
SELECT b.doc_no, b.page_index, b.ord, CASE WHEN gap <= 300 THEN s.kind END AS kind, (CASE WHEN gap <= 300 THEN gap END)::DOUBLE AS distance
FROM b LEFT JOIN s ON s.doc_no = b.doc_no AND s.page_index = b.page_index AND s.ord = b.ord AND s.r = 1""")


@query(_nearest_sql("k.y1 < b.y0", _SHARED))
def nearest_caption_kind(spark, sf_dir):
    return o.nearest_kind(c.boxes(spark, sf_dir), _captions(spark, sf_dir), c.PAGE, KEY)


@query(_nearest_sql("k.y0 > b.y1", f"CASE WHEN {c.s_overlap('b.', 'k.')} < 0.1 THEN 50 ELSE 0 END"))
def nearest_caption_kind_table(spark, sf_dir):
    return o.nearest_kind(c.boxes(spark, sf_dir), _captions(spark, sf_dir), c.PAGE, KEY, for_tables=True)


@query(c.sql("bc", f"""WITH {_K}, s AS (SELECT {_B}, k.text, {_GAP} + {_SHARED} AS score, row_number() OVER (PARTITION BY {_B} ORDER BY {_GAP} + {_SHARED}, k.line_no) AS r FROM b JOIN k ON {_ON})
SELECT b.doc_no, b.page_index, b.ord, coalesce(CASE WHEN s.score <= 300 THEN s.text END, '') AS signature
FROM b LEFT JOIN s ON s.doc_no = b.doc_no AND s.page_index = b.page_index AND s.ord = b.ord AND s.r = 1"""))
def caption_signature(spark, sf_dir):
    return o.signature(c.boxes(spark, sf_dir), _captions(spark, sf_dir), c.PAGE, KEY)


@query(c.sql("bc", f"""WITH {_K}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_no, page_index, type ORDER BY y0, x0, ord) - 1 AS item_index FROM b),
s AS (SELECT b.doc_no, b.page_index, b.ord, k.text, k.line_no, k.label, row_number() OVER (PARTITION BY {_B} ORDER BY {_GAP}
 + CASE WHEN (b.type = 'figure' AND k.y1 < b.y0) OR (b.type = 'table' AND k.y0 > b.y1) THEN 120 ELSE 0 END - CASE WHEN b.type = k.kind THEN 30 ELSE 0 END
 - CASE WHEN k.number < 0 THEN 0 WHEN k.number - 1 = item_index THEN 50 WHEN abs(k.number - 1 - item_index) <= 1 THEN 20 ELSE 0 END, k.line_no) AS r
 FROM i b JOIN k ON {_ON} WHERE {_GAP} < 300)
SELECT b.doc_no, b.page_index, b.ord, coalesce(s.text, 'No matching caption found.') AS caption, s.line_no, s.label,
 CASE WHEN s.text IS NULL OR {_TYPE.format('s.text')} = '' THEN b.type ELSE {_TYPE.format('s.text')} END AS final_type,
 coalesce({_TYPE.format('s.text')} NOT IN ('', b.type) AND s.text IS NOT NULL, false) AS overridden
FROM b LEFT JOIN s ON s.doc_no = b.doc_no AND s.page_index = b.page_index AND s.ord = b.ord AND s.r = 1"""))
def caption_align(spark, sf_dir):
    return o.aligned(c.boxes(spark, sf_dir), _captions(spark, sf_dir), c.PAGE, KEY)


@query(c.sql("bc", f"""SELECT {_B}, string_agg(k.text, ' ' ORDER BY k.line_no) AS near, count(*) AS n_lines FROM b JOIN c k ON {_ON}
WHERE {c.s_distance('b.', 'k.')} <= 50 GROUP BY ALL"""))
def nearby_text(spark, sf_dir):
    return o.nearby(c.boxes(spark, sf_dir), c.captions(spark, sf_dir), c.PAGE, KEY, 50.0)


@query(c.sql("bc", f"""SELECT {_B}, string_agg(k.text, ' ' ORDER BY k.line_no) AS inside, count(*) AS n_lines FROM b JOIN c k ON {_ON}
WHERE {c.s_inter('b.', 'k.')} > 0 GROUP BY ALL"""))
def lines_in_box(spark, sf_dir):
    return o.inside(c.boxes(spark, sf_dir), c.captions(spark, sf_dir), c.PAGE, KEY)


_COVER = f"""v AS (SELECT {_B}, least(1, coalesce(sum({c.s_inter('b.', 'k.')}) FILTER (WHERE k.line_no IS NOT NULL), 0) / any_value({c.s_area('b.')}))::DOUBLE AS coverage,
 count(*) FILTER (WHERE k.line_no IS NOT NULL AND {c.s_inter('b.', 'k.')} > 0 AND (k.x1 - k.x0) / greatest(1, b.x1 - b.x0) >= 0.6) AS wide_lines
 FROM b LEFT JOIN c k ON {_ON} GROUP BY ALL)"""


@query(c.sql("bc", f"WITH {_COVER} SELECT * FROM v"))
def text_coverage(spark, sf_dir):
    return o.coverage(c.boxes(spark, sf_dir), c.captions(spark, sf_dir), c.PAGE, KEY)


#: The rule's least coverage and wide lines, and low ones that the boxes here pass more often.
REGIONS = ((0.35, 2), (0.05, 1))


@query(" UNION ALL ".join(f"SELECT {x}::DOUBLE AS least, * FROM ({c.sql('bc', f'WITH {_COVER} SELECT doc_no, page_index, ord FROM v WHERE coverage >= {x} AND wide_lines >= {n}')})" for x, n in REGIONS))
def likely_text_region(spark, sf_dir):
    covered = o.coverage(c.boxes(spark, sf_dir), c.captions(spark, sf_dir), c.PAGE, KEY)
    one, two = (covered.where(o.text_region(covered, x, n)).select(F.lit(x).alias("least"), *KEY) for x, n in REGIONS)
    return one.unionByName(two)


def _share(axis: str, p: str, q: str) -> str:
    a, b = f"{axis}0", f"{axis}1"
    return f"greatest(0, least({p}{b}, {q}{b}) - greatest({p}{a}, {q}{a})) / greatest(1, least({p}{b} - {p}{a}, {q}{b} - {q}{a}))"


def _crossing(axis: str) -> str:
    """Pairs apart along the other axis that a line crosses, the first box nearer the origin."""
    o_, far, near = ("y", "y1", "y0") if axis == "x" else ("x", "x1", "x0")
    gap = (f"greatest(f_{axis}0, s_{axis}0)", f"least(f_{axis}1, s_{axis}1)")
    slot = f"SELECT *, {gap[0]} AS q_{axis}0, {gap[1]} AS q_{axis}1, f_{far} AS q_{near}, s_{near} AS q_{far} FROM {{}} WHERE s_{near} > f_{far} + 2 AND {gap[1]} > {gap[0]}"
    return slot, f"({c.s_inter('q_', 'k.')} > 0 AND {_share(axis, 'k.', 'q_')} >= 0.6 AND {_share(axis, 'k.', 'f_')} >= 0.6 AND {_share(axis, 'k.', 's_')} >= 0.6)"


def _ordered(axis: str, name: str, where: str) -> str:
    cols = ", ".join(f"CASE WHEN a_{axis}0 < b_{axis}0 THEN a_{x} ELSE b_{x} END AS f_{x}, CASE WHEN a_{axis}0 < b_{axis}0 THEN b_{x} ELSE a_{x} END AS s_{x}" for x in c.CORNERS)
    return f"{name} AS (SELECT doc_no, page_index, a_ord, b_ord, {cols} FROM p WHERE {where})"


_STACKED, _ASIDE = "(a_y1 <= b_y0 OR b_y1 <= a_y0)", "(a_x1 <= b_x0 OR b_x1 <= a_x0)"
(_SX, _CX), (_SY, _CY) = _crossing("x"), _crossing("y")


@query(c.sql("bcp", f"""WITH {_ordered('y', 'st', _STACKED)}, su AS ({_SX.format('st')}), {_ordered('x', 'si', _ASIDE)}, so AS ({_SY.format('si')}),
hit AS (SELECT DISTINCT su.doc_no, su.page_index, a_ord, b_ord FROM su JOIN c k ON k.doc_no = su.doc_no AND k.page_index = su.page_index WHERE {_CX}),
cut AS (SELECT DISTINCT so.doc_no, so.page_index, a_ord, b_ord FROM so JOIN c k ON k.doc_no = so.doc_no AND k.page_index = so.page_index WHERE {_CY}
 AND ((so.doc_no, so.page_index, so.a_ord, so.b_ord) NOT IN (SELECT (doc_no, page_index, a_ord, b_ord) FROM st)
  OR (so.doc_no, so.page_index, so.a_ord, so.b_ord) IN (SELECT (doc_no, page_index, a_ord, b_ord) FROM su)))
SELECT * FROM hit UNION SELECT * FROM cut"""))
def text_barrier(spark, sf_dir):
    """Pairs of boxes of a page that a caption line stands between."""
    rows = o.beside(c.pairs(c.boxes(spark, sf_dir)), c.captions(spark, sf_dir), c.PAGE, ())
    crossed = rows.where(o.barrier(Box.of("a_"), Box.of("b_"), Box.of("l_")))
    return crossed.select(*c.PAGE, "a_ord", "b_ord").distinct()


#: The rule's greatest gap within a caption, and a wide one that the lines here pass more often.
GAPS = (12.0, 40.0)


def _runs(gap: float) -> str:
    return f"""t AS (SELECT *, row_number() OVER w AS place, regexp_matches(text, '{S_CAPTION}') AS starts, coalesce(y0 - lag(y1) OVER w > {gap}, true) AS far
 FROM c WINDOW w AS (PARTITION BY doc_no ORDER BY line_no)),
u AS (SELECT *, sum((starts OR far)::INT) OVER (PARTITION BY doc_no ORDER BY line_no) AS run FROM t),
r AS (SELECT doc_no, run, min(place) AS first, count(*) AS n, min(line_no) AS line_no, string_agg(text, ' ' ORDER BY place) AS caption,
 min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM u GROUP BY ALL HAVING bool_or(starts))"""


def _multilines(spark, sf_dir, *columns: str):
    one, two = (o.multiline(c.captions(spark, sf_dir), ["doc_no"], x).select(F.lit(x).alias("gap"), *columns) for x in GAPS)
    return one.unionByName(two)


@query(" UNION ALL ".join(f"SELECT {x}::DOUBLE AS gap, * FROM ({c.sql('c', f'WITH {_runs(x)} SELECT doc_no, line_no, n, caption, x0, y0, x1, y1 FROM r')})" for x in GAPS))
def caption_multiline(spark, sf_dir):
    """Captions with the lines that continue them."""
    return _multilines(spark, sf_dir, "doc_no", "line_no", "n", "caption", *c.CORNERS)


@query(" UNION ALL ".join(f"""SELECT {x}::DOUBLE AS gap, * FROM ({c.sql('c', f"""WITH {_runs(x)} SELECT r.doc_no, r.line_no, string_agg(t.text, chr(10) ORDER BY t.place) AS snippet
FROM r JOIN t ON t.doc_no = r.doc_no AND t.place >= r.first - 2 AND t.place < r.first + r.n + 3 GROUP BY r.doc_no, r.line_no, r.run""")})""" for x in GAPS))
def evidence_snippet(spark, sf_dir):
    """Captions with the lines around them."""
    return _multilines(spark, sf_dir, "doc_no", "line_no", "snippet")


@query(c.sql("l", f"""SELECT doc_id, page_index, string_agg(text, ' ' ORDER BY line_no) AS page_text, count(*) AS n_lines FROM l GROUP BY ALL"""))
def page_text(spark, sf_dir):
    rows = c.lines(spark, sf_dir).select("doc_id", "page_index", F.col("line_no").alias("l_line_no"), F.col("text").alias("l_text"))
    return o.joined_text(rows, ["doc_id", "page_index"], " ", "page_text")
