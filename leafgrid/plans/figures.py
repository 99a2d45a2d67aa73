"""Queries of the stages that make figures of candidate boxes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafgrid import sources
from leafgrid.catalogue import query
from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.operators import figures as fg
from leafgrid.operators import filters as f
from leafgrid.plans import common as c
from leafgrid.plans.captioning import _GAP, _K, _ON, _SHARED, KEY
from leafgrid.plans.detections import _EQUATION, _FACTS, H, W, facts

_FAR = f"""{c.s_distance('b.', 'k.')} + CASE WHEN {c.s_overlap('b.', 'k.')} < 0.8 AND {c.s_iou('b.', 'k.')} <= 0.1
 AND abs(k.x0 + k.x1 - b.x0 - b.x1) <= abs(k.y0 + k.y1 - b.y0 - b.y1) AND k.y0 + k.y1 <= b.y0 + b.y1 THEN 100 ELSE 0 END"""
_PAGE = "doc_no, page_index"
_MERGED = "min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS score, arg_min(type, {'s': -score, 'o': ord}) AS type, count(*)::INT AS merged_from"


def _near(of: str, name: str) -> str:
    """Boxes of a CTE with the line of their nearest caption."""
    return f"""{name}r AS (SELECT b.*, k.line_no, row_number() OVER (PARTITION BY b.doc_no, b.page_index, b.ord ORDER BY {_FAR}, k.line_no) AS r FROM {of} b LEFT JOIN k ON {_ON}), {name} AS (SELECT * FROM {name}r WHERE r = 1)"""


def _grouped(of: str, name: str, by: str) -> str:
    """Groups of a CTE that are subfigures, and their boxes merged, the others as they are."""
    return f"""{name}s AS (SELECT {_PAGE}, {by}, count(*) AS n, max({c.s_area('')}) AS most, min({c.s_area('')}) AS least FROM {of} WHERE {by} IS NOT NULL GROUP BY ALL),
{name}f AS (SELECT a.doc_no, a.page_index, a.{by}, max({c.s_distance('a.', 'z.')}) AS far FROM {of} a JOIN {of} z ON a.doc_no = z.doc_no AND a.page_index = z.page_index AND a.{by} = z.{by} AND a.ord < z.ord GROUP BY ALL),
{name}g AS (SELECT {_PAGE}, {by}, true AS together FROM {name}s JOIN {name}f USING ({_PAGE}, {by}) WHERE n > 1 AND far <= 100 AND most <= 4 * least),
{name} AS (SELECT {_PAGE}, {_MERGED} FROM {of} LEFT JOIN {name}g USING ({_PAGE}, {by}) GROUP BY {_PAGE}, CASE WHEN together THEN {by} END, CASE WHEN together IS NULL THEN ord END)"""


_OUT = f"{_PAGE}, x0, y0, x1, y1, score, type, merged_from"
_SHOWN = ("doc_no", "page_index", "x0", "y0", "x1", "y1", "score", "type", "merged_from")


def _captions(spark, sf_dir):
    return o.candidates(c.captions(spark, sf_dir))


@query(c.sql("bc", f"WITH {_K}, {_near('b', 'n')}, {_grouped('n', 'm', 'line_no')} SELECT {_OUT} FROM m"))
def caption_merge(spark, sf_dir):
    """Boxes under one caption as one, where they are parts of one figure."""
    return fg.caption_merge(c.boxes(spark, sf_dir), _captions(spark, sf_dir), c.PAGE).select(*_SHOWN)


def _joined():
    return (F.col("a_ord") + F.col("b_ord")) % 3 != 0


def _alike(a: Box, b: Box):
    return (a.x0 + b.y0) % 10 / 10


_EDGES = f"ed AS MATERIALIZED (SELECT {_PAGE}, a_ord AS a, b_ord AS b FROM p WHERE {c.s_distance('a_', 'b_')} <= 200 AND (a_ord + b_ord) % 3 <> 0)"


def _comps(of: str, edges: str, name: str) -> str:
    return f"""{name}b AS MATERIALIZED (SELECT * FROM {edges} UNION ALL SELECT {_PAGE}, b, a FROM {edges}),
{name}r AS (SELECT {_PAGE}, ord, ord AS t FROM {of} UNION SELECT r.doc_no, r.page_index, r.ord, e.b FROM {name}r r JOIN {name}b e ON e.doc_no = r.doc_no AND e.page_index = r.page_index AND e.a = r.t),
{name} AS (SELECT {of}.*, comp FROM {of} JOIN (SELECT {_PAGE}, ord, min(t) AS comp FROM {name}r GROUP BY ALL) USING ({_PAGE}, ord))"""


@query(c.sql("bp", f"""WITH {_EDGES}, {_comps('b', 'ed', 'q')},
s AS (SELECT {_PAGE}, comp, count(*) AS n, sum({c.s_area('')}) AS areas, (max(x1) - min(x0)) * (max(y1) - min(y0)) AS whole, list({{'x0': x0, 'y0': y0}} ORDER BY ord) AS l FROM q GROUP BY ALL),
fa AS (SELECT a.doc_no, a.page_index, a.comp, max({c.s_distance('a.', 'z.')}) AS far FROM q a JOIN q z ON a.doc_no = z.doc_no AND a.page_index = z.page_index AND a.comp = z.comp AND a.ord < z.ord GROUP BY ALL),
gr AS (SELECT {_PAGE}, comp, true AS together FROM s JOIN fa USING ({_PAGE}, comp) WHERE whole <= 3 * areas AND far <= 150 AND (l[1].x0 + l[2].y0) % 10 / 10 >= 0.3::DOUBLE)
SELECT {_PAGE}, {_MERGED} FROM q LEFT JOIN gr USING ({_PAGE}, comp) GROUP BY {_PAGE}, CASE WHEN together THEN comp END, CASE WHEN together IS NULL THEN ord END""", recursive=True))
def visual_merge(spark, sf_dir):
    """Boxes joined by lines as one, if they are close, alike and fill their union."""
    rows = c.boxes(spark, sf_dir)
    return fg.visual_merge(rows, fg.links(rows, c.PAGE, _joined()), _alike, c.PAGE).select(*_SHOWN)


_LOOK = "CASE WHEN type = 'table' THEN 'table' WHEN (x0 + y0)::BIGINT % 3 = 0 THEN 'flowchart' WHEN (x0 + y0)::BIGINT % 3 = 1 THEN 'composite' ELSE 'single' END"


def _look():
    return F.when((F.col("x0") + F.col("y0")).cast("long") % 3 == 0, "flowchart").when((F.col("x0") + F.col("y0")).cast("long") % 3 == 1, "composite").otherwise("single")


@query(c.sql("bcp", f"""WITH {_K}, {_EDGES}, ty AS MATERIALIZED (SELECT *, {_LOOK} AS look FROM b), fl AS MATERIALIZED (SELECT * FROM ty WHERE look = 'flowchart'), co AS MATERIALIZED (SELECT * FROM ty WHERE look = 'composite'),
fe AS MATERIALIZED (SELECT ed.* FROM ed JOIN fl x ON x.doc_no = ed.doc_no AND x.page_index = ed.page_index AND x.ord = ed.a JOIN fl y ON y.doc_no = ed.doc_no AND y.page_index = ed.page_index AND y.ord = ed.b),
{_comps('fl', 'fe', 'q')}, {_near('co', 'n')}, {_grouped('n', 'm', 'line_no')}
SELECT {_PAGE}, {_MERGED} FROM q GROUP BY {_PAGE}, comp UNION ALL SELECT {_OUT} FROM m
UNION ALL SELECT {_PAGE}, x0, y0, x1, y1, score, type, 1 FROM ty WHERE look IN ('table', 'single')""", recursive=True))
def typed_merge(spark, sf_dir):
    """Flowcharts merged by links, composites by caption, tables and single figures left."""
    rows = c.boxes(spark, sf_dir)
    return fg.typed_merge(rows, _look(), fg.links(rows, c.PAGE, _joined()), _captions(spark, sf_dir), c.PAGE).select(*_SHOWN)


@query()
def merge_pipeline(spark, sf_dir):
    """All merging stages in their order; each stage alone has SQL."""
    ink = (F.col("x0") * 7 + F.col("y0") * 3) % 100 / 250
    out = fg.merge_stages(c.boxes(spark, sf_dir), _captions(spark, sf_dir), c.PAGE, _look(), _joined(), _alike, f.noise_reason(Box.of(), ink))
    return out.select(*_SHOWN)


@query(c.sql("b", f"""WITH pt AS (SELECT {_PAGE}, ord, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM b),
t AS (SELECT *, coalesce(y - lag(y) OVER w >= 50, true) AS brk FROM pt WINDOW w AS (PARTITION BY {_PAGE} ORDER BY y, ord)),
u AS (SELECT *, sum(brk::INT) OVER (PARTITION BY {_PAGE} ORDER BY y, ord)::INT AS row_no FROM t), v AS (SELECT *, row_number() OVER (PARTITION BY {_PAGE}, row_no ORDER BY x, y, ord) AS col_no FROM u),
sz AS (SELECT {_PAGE}, count(*) AS n_rows, min(n) AS least, max(n) AS most FROM (SELECT {_PAGE}, row_no, count(*) AS n FROM v GROUP BY ALL) GROUP BY ALL),
cl AS (SELECT a.doc_no, a.page_index, count(*) AS n_cols, count(*) FILTER (WHERE abs(a.x - z.x) <= 50) AS n_aligned FROM v a JOIN v z ON a.doc_no = z.doc_no AND a.page_index = z.page_index AND a.col_no = z.col_no
 WHERE a.row_no = 1 AND z.row_no = 2 GROUP BY ALL), sp AS (SELECT {_PAGE}, max(x) - min(x) AS spread FROM v GROUP BY ALL)
SELECT {_PAGE}, n_rows, n_rows >= 2 AND most - least <= 1 AND ((least >= 2 AND coalesce(n_aligned, 0) >= coalesce(n_cols, 0) / 2) OR (most = 1 AND spread <= 50)) AS in_grid FROM sz JOIN sp USING ({_PAGE}) LEFT JOIN cl USING ({_PAGE})"""))
def grid_check(spark, sf_dir):
    """Whether the boxes of a page are arranged in a grid."""
    x, y = g.centre(Box.of())
    return fg.in_grid(c.boxes(spark, sf_dir).select(*c.PAGE, "ord", x.alias("x"), y.alias("y")), c.PAGE)


_DOC = ["doc_id", "page_index"]
_D = "doc_id, page_index"
_REGION = "50 + doc_id % 40 AS x0, 30 + doc_id * 7 % 100 AS y0, 600 + doc_id % 40 AS x1, 300 + doc_id * 7 % 700 AS y1"
_REGIONS = f"rg AS (SELECT doc_id, page_index, 1 AS ord, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM (SELECT DISTINCT doc_id, page_index, {_REGION} FROM l))"


def _regions(spark, sf_dir):
    """One region of each page of the documents."""
    pages = c.lines(spark, sf_dir).select(*_DOC).distinct().selectExpr(*_DOC, "1 as ord", *sources._split(_REGION))
    return c.corners(pages)


_INK_OF = "((({0} * 7 + {1} * 3) % 100) / 250)"


def _ink_of(b: Box):
    return (b.x0 * 7 + b.y0 * 3) % 100 / 250


_BAND = f"""{_REGIONS}, il AS (SELECT r.doc_id, r.page_index, r.x0, r.y0, r.x1, r.y1, k.line_no, k.y0 AS ly0, k.y1 AS ly1, (k.x1 - k.x0) / greatest(1, r.x1 - r.x0) >= 0.6::DOUBLE AS wide, k.line_no % 17 = 3 AS cap
 FROM rg r JOIN l k ON r.doc_id = k.doc_id AND r.page_index = k.page_index WHERE {c.s_inter('r.', 'k.')} > 0),
wi AS (SELECT * FROM il WHERE wide), nw AS (SELECT {_D}, count(*) AS n FROM wi GROUP BY ALL),
fc AS (SELECT * FROM (SELECT il.*, row_number() OVER (PARTITION BY {_D} ORDER BY line_no) AS r, n FROM il LEFT JOIN nw USING ({_D}) WHERE cap) WHERE r = 1 AND (n IS NULL OR n < 2)),
ba AS (SELECT {_D}, x0, y0, x1, y1, line_no, ly0, ly1 FROM wi WHERE ({_D}) NOT IN (SELECT ({_D}) FROM fc) UNION ALL SELECT {_D}, x0, y0, x1, y1, line_no, ly0, ly1 FROM fc),
mh AS (SELECT {_D}, list_sort(list(ly1 - ly0))[len(list(ly1 - ly0)) // 2 + 1] AS mh FROM ba GROUP BY ALL),
bt AS (SELECT ba.*, coalesce(ly0 - lag(ly1) OVER w > greatest(12, trunc(1.8::DOUBLE * mh)), true) AS brk FROM ba JOIN mh USING ({_D}) WINDOW w AS (PARTITION BY {_D} ORDER BY ly0, line_no)),
bu AS (SELECT *, sum(brk::INT) OVER (PARTITION BY {_D} ORDER BY ly0, line_no)::INT AS run FROM bt),
bk AS (SELECT {_D}, y0, y1, run, count(*) AS n, min(ly0) AS top, max(ly1) AS bottom FROM bu GROUP BY ALL),
band AS (SELECT {_D}, top, bottom FROM (SELECT *, row_number() OVER (PARTITION BY {_D} ORDER BY n * (bottom - top) DESC, run) AS r FROM bk
 WHERE ((top + bottom) / 2 - y0) / greatest(1, y1 - y0) BETWEEN 0.3 AND 0.7 AND bottom - top <= (y1 - y0) * 0.25::DOUBLE AND n * (bottom - top) > 0) WHERE r = 1)"""


@query(c.sql("l", f"""WITH {_BAND}, h AS (SELECT rg.*, greatest(y0, top - 4) AS cut1, least(y1, bottom + 4) AS cut2 FROM rg LEFT JOIN band USING ({_D})),
s AS (SELECT *, coalesce((x1 - x0) * greatest(0, cut1 - y0) >= 2000 AND (x1 - x0) * greatest(0, y1 - cut2) >= 2000 AND {_INK_OF.format('x0', 'y0')} >= 0.01::DOUBLE AND {_INK_OF.format('x0', 'cut2')} >= 0.01::DOUBLE, false) AS both_ FROM h)
SELECT {_D}, ord, 1 AS part, x0, y0, x1, cut1 AS y1 FROM s WHERE both_ UNION ALL SELECT {_D}, ord, 2, x0, cut2, x1, y1 FROM s WHERE both_ UNION ALL SELECT {_D}, ord, 0, x0, y0, x1, y1 FROM s WHERE NOT both_"""))
def band_split(spark, sf_dir):
    """Regions of pages cut in two at a band of text in their middle."""
    rows, lines = _regions(spark, sf_dir), c.lines(spark, sf_dir)
    bands = fg.text_bands(rows, lines, lines.where("line_no % 17 = 3"), _DOC)
    return fg.split_by_bands(rows, bands, _DOC, _ink_of)


_SAID = " OR ".join(f"contains(lower(inside), '{w}')" for w in f.TEXT_WORDS)


@query(" UNION ALL ".join(f"""SELECT * FROM ({c.sql('bc', f'''WITH i AS (SELECT b.doc_no, b.page_index, b.ord, string_agg(k.text, ' ' ORDER BY k.line_no) AS inside, count(*) AS n FROM b JOIN c k ON b.doc_no = k.doc_no
 WHERE {c.s_inter("b.", "k.")} > 0 GROUP BY ALL) SELECT {n} AS least, doc_no, page_index, ord FROM i WHERE n >= {n} AND ({_SAID})''')})""" for n in (4, 2)))
def section_text(spark, sf_dir):
    """Boxes with lines in them that name a section; captions of the whole document stand for lines."""
    lines = c.captions(spark, sf_dir)
    own = c.boxes(spark, sf_dir).withColumn("ord", F.col("page_index") * 1_000_000 + F.col("ord"))
    runs = [fg.section_text(own, lines, ["doc_no"], f.TEXT_WORDS, n).selectExpr(f"{n} as least", "doc_no", "cast(ord div 1000000 as int) as page_index", "cast(ord % 1000000 as int) as ord") for n in (4, 2)]
    return runs[0].unionByName(runs[1])


def _conflict_sql(kind: str, wrong: str, aside: str) -> str:
    return f"""SELECT doc_no, page_index, ord, '{kind}' AS type FROM (SELECT b.doc_no, b.page_index, b.ord, k.kind, {_GAP} AS gap, row_number() OVER (PARTITION BY b.doc_no, b.page_index, b.ord ORDER BY {_GAP}
 + CASE WHEN {wrong} THEN 120 ELSE 0 END + {aside}, k.line_no) AS r FROM b JOIN k ON {_ON} WHERE b.type = '{kind}') WHERE r = 1 AND kind = '{'figure' if kind == 'table' else 'table'}' AND gap < 210"""


_CONFLICT = _conflict_sql("figure", "k.y1 < b.y0", _SHARED) + " UNION ALL " + _conflict_sql("table", "k.y0 > b.y1", f"CASE WHEN {c.s_overlap('b.', 'k.')} < 0.1 THEN 50 ELSE 0 END")


@query(c.sql("bc", f"WITH {_K} {_CONFLICT}"))
def caption_conflicts(spark, sf_dir):
    """Figures near the caption of a table, and tables near that of a figure."""
    rows, captions = c.boxes(spark, sf_dir), _captions(spark, sf_dir)
    of = lambda kind: fg.caption_conflict(rows, captions, c.PAGE, kind).select(*KEY, F.lit(kind).alias("type"))
    return of("figure").unionByName(of("table"))


@query(c.sql("b", f"WITH {_FACTS} SELECT doc_no, page_index, ord, ink FROM d WHERE ink >= 0.01::DOUBLE"))
def ink_filter(spark, sf_dir):
    """Boxes that hold some ink."""
    return facts(spark, sf_dir).where("ink >= 0.01").select(*KEY, "ink")


_COVERAGE = f"""v AS (SELECT b.doc_no, b.page_index, b.ord, least(1, coalesce(sum({c.s_inter('b.', 'k.')}) FILTER (WHERE k.line_no IS NOT NULL), 0) / any_value({c.s_area('b.')}))::DOUBLE AS coverage,
 count(*) FILTER (WHERE k.line_no IS NOT NULL AND {c.s_inter('b.', 'k.')} > 0 AND (k.x1 - k.x0) / greatest(1, b.x1 - b.x0) >= 0.6) AS wide_lines FROM b LEFT JOIN c k ON {_ON} GROUP BY ALL)"""
_FIGURES = f"""{_FACTS}, {_K}, {_COVERAGE}, cf AS ({_CONFLICT}), fx AS (SELECT d.*, coverage, wide_lines, cf.type IS NOT NULL AS conflict, count(*) OVER (PARTITION BY d.doc_no, d.page_index) AS n_page FROM d
 JOIN v USING (doc_no, page_index, ord) LEFT JOIN cf USING (doc_no, page_index, ord)),
rs AS (SELECT doc_no, page_index, ord, CASE WHEN w < 40 OR h < 40 OR w * h < 2000 THEN 'small' WHEN w * h / 855000 > 0.85 AND n_page >= 6 THEN 'page' WHEN ink < 0.01::DOUBLE THEN 'empty'
 WHEN coverage >= 0.35 AND wide_lines >= 2 THEN 'text' WHEN {_EQUATION} THEN 'equation' WHEN conflict THEN 'caption'
 WHEN page_index = 1 AND ((cy < 95 AND w * h / 855000 < 0.05 AND w / h > 1.5 AND w / h < 8) OR (cx < 135 AND cy > 190 AND cy < 760 AND h > 142.5 AND w * h / 855000 > 0.02 AND w * h / 855000 < 0.15)) AND contains(lower(ocr), 'arxiv') THEN 'arxiv' END AS reason,
 greatest(0, x0 - 4) AS x0, greatest(0, y0 - 4) AS y0, least(900, x1 + 4) AS x1, least(950, y1 + 4) AS y1 FROM fx WHERE type = 'figure')"""


@query(c.sql("bc", f"""WITH {_FIGURES} SELECT *, CASE WHEN reason IS NULL THEN printf('fig_%04d', row_number() OVER (PARTITION BY doc_no, reason IS NULL ORDER BY page_index, ord)) END AS item_id FROM rs"""))
def figure_items(spark, sf_dir):
    """Candidate boxes of figures through all drops: the reason, or the id of the item and its padded box."""
    rows, captions = facts(spark, sf_dir), _captions(spark, sf_dir)
    covered = o.coverage(c.boxes(spark, sf_dir), c.captions(spark, sf_dir), c.PAGE, KEY)
    conflict = fg.caption_conflict(c.boxes(spark, sf_dir), captions, c.PAGE, "figure").withColumn("conflict", F.lit(True))
    rows = rows.withColumn("n_page", F.count("*").over(Window.partitionBy(*c.PAGE))).where("type = 'figure'").join(covered, KEY).join(conflict, KEY, "left")
    b = Box.of()
    stamp = (F.col("page_index") == 1) & f.arxiv_removed(F.col("type"), f.arxiv_candidate(b, W(), H()), F.col("ocr"))
    reason = f.first_reason(
        ("small", ~f.large_enough(b)), ("page", f.fills_text_page(b, W() * H(), F.col("n_page"))), ("empty", F.col("ink") < 0.01), ("text", (F.col("coverage") >= 0.35) & (F.col("wide_lines") >= 2)),
        ("equation", f.equation(b, F.col("near"), F.col("edge_ratio"))), ("caption", F.coalesce("conflict", F.lit(False))), ("arxiv", stamp),
    )
    made = rows.select(*KEY, reason.alias("reason"), *g.expand(b, 4, W(), H()).named())
    place = F.row_number().over(Window.partitionBy("doc_no", F.col("reason").isNull()).orderBy("page_index", "ord"))
    return made.withColumn("item_id", F.when(F.col("reason").isNull(), F.format_string("fig_%04d", place)))
