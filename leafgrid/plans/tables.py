"""Queries of regions of tables and of the union of strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid import sources
from leafgrid.catalogue import query
from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.operators import tables as tb
from leafgrid.plans import common as c
from leafgrid.plans.captioning import _K, KEY, S_CAPTION
from leafgrid.plans.detections import _FACTS, _TABLE, _table_reason, facts
from leafgrid.plans.figures import _D, _DOC, _INK_OF, _REGIONS, _ink_of, _regions
from leafgrid.plans.grouping import _SEGMENTS, _segments

_PAGE = "doc_no, page_index"


_SPREAD = "(x0::BIGINT * 16 + seg_id % 16)"


@query(_SEGMENTS + f"g0 AS (SELECT {_SPREAD} AS page_no, y, x0, x1, seg_id FROM s WHERE x1 - x0 >= 270)" + """, t AS (SELECT *, coalesce(y - lag(y) OVER w > 6, true) AS brk FROM g0 WINDOW w AS (PARTITION BY page_no ORDER BY y, seg_id)),
u AS (SELECT *, sum(brk::INT) OVER (PARTITION BY page_no ORDER BY y, seg_id)::INT AS rule FROM t),
li AS (SELECT page_no, rule, min(x0) AS x0, max(x1) AS x1, trunc(avg(y))::INT AS y FROM u GROUP BY ALL),
t2 AS (SELECT *, coalesce(y - lag(y) OVER w > 96, true) AS brk FROM li WINDOW w AS (PARTITION BY page_no ORDER BY y, rule)),
u2 AS (SELECT *, sum(brk::INT) OVER (PARTITION BY page_no ORDER BY y, rule)::INT AS run FROM t2),
k AS (SELECT page_no, run, count(*) AS n, min(x0) AS x0, max(x1) AS x1, min(y) AS top, max(y) AS bottom, greatest(10, trunc((max(y) - min(y)) * 0.25::DOUBLE)) AS pad FROM u2 GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8)
SELECT page_no, n, greatest(0, x0 - pad) AS x0, greatest(0, top - pad)::DOUBLE AS y0, least(900, x1 + pad) AS x1, least(1200, bottom + pad)::DOUBLE AS y1 FROM k""")
def ruled_regions(spark, sf_dir):
    """Regions of two to eight long rules on pages of 900 by 1200; segments that begin alike stand on sixteen pages here."""
    segments = _segments(spark, sf_dir).withColumn("page_no", (F.col("x0").cast("long") * 16 + F.col("seg_id") % 16).cast("long"))
    return tb.ruled_regions(segments, ["page_no"], 900, 1200)


def _folded(name: str, joins: str, merged: str) -> str:
    """Lines of a page folded from its segments in their order: ``joins`` and ``merged`` see the last line l and a segment x."""
    return f"""{name}q AS (SELECT page_no, list({{'y': y, 'x0': x0, 'x1': x1}} ORDER BY y, x0, x1) AS todo FROM s GROUP BY ALL),
{name}f AS (SELECT page_no, todo[2:] AS todo, todo[:1] AS out FROM {name}q UNION ALL SELECT page_no, todo[2:], CASE WHEN {joins} THEN list_append(out[:-2], {merged}) ELSE list_append(out, x) END
 FROM (SELECT *, todo[1] AS x, out[-1] AS l FROM {name}f WHERE len(todo) > 0)),
{name} AS (SELECT page_no, k, b.y AS y, b.x0 AS x0, b.x1 AS x1 FROM (SELECT page_no, unnest(out) AS b, generate_subscripts(out, 1) - 1 AS k FROM {name}f WHERE len(todo) = 0))"""


_DRIFT = _folded("li", "x.y - l.y < 10", "{'y': ((l.y + x.y) // 2)::INT, 'x0': least(l.x0, x.x0), 'x1': greatest(l.x1, x.x1)}")
_WIDER = _folded("li", "abs(x.y - l.y) < 5", "CASE WHEN x.x1 - x.x0 > l.x1 - l.x0 THEN x ELSE l END")
_EXIST = f"ex AS (SELECT (doc_no % 200)::BIGINT AS page_no, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE + 150 AS x1, y1::DOUBLE + 100 AS y1 FROM ({sources.view('boxes')}) WHERE type = 'table' AND page_index = 1)"


def _existing(spark, sf_dir):
    rows = c.corners(sources.entity(spark, sf_dir, "boxes")).where("type = 'table' and page_index = 1")
    return rows.select((F.col("doc_no") % 200).cast("long").alias("page_no"), "x0", "y0", (F.col("x1") + 150).alias("x1"), (F.col("y1") + 100).alias("y1"))


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(_SEGMENTS) + f"""{_DRIFT}, {_EXIST}, w3 AS (SELECT page_no, k, y AS l1, lead(y, 1) OVER w AS l2, lead(y, 2) OVER w AS l3, least(x0, lead(x0, 1) OVER w, lead(x0, 2) OVER w) AS mx0,
 greatest(x1, lead(x1, 1) OVER w, lead(x1, 2) OVER w) AS mx1 FROM li WINDOW w AS (PARTITION BY page_no ORDER BY k)),
bx AS (SELECT page_no, k, greatest(0, mx0) AS x0, greatest(0, l1 - 10)::DOUBLE AS y0, least(900, mx1) AS x1, least(1200, l3 + 10)::DOUBLE AS y1, 0.7::DOUBLE AS score FROM w3
 WHERE l3 IS NOT NULL AND l2 - l1 > 20 AND l2 - l1 < 300 AND l3 - l2 > 20 AND l3 - l2 < 300)
SELECT * FROM bx b WHERE NOT EXISTS (SELECT 1 FROM ex e WHERE e.page_no = b.page_no AND {c.s_iou('b.', 'e.')} > 0.5)""")
def simple_tables(spark, sf_dir):
    """Three lines in a row, the lines drifting as they take in segments, where no table is yet."""
    segments = _segments(spark, sf_dir)
    return tb.simple_tables(tb.drifting_lines(segments, ["page_no"]), _existing(spark, sf_dir), ["page_no"], 900, 1200)


@query(_recursive(_SEGMENTS) + f"""{_WIDER}, {_EXIST}, l8 AS (SELECT * FROM li),
tr AS (SELECT a.page_no, a.k AS ak, b.k AS bk, d.k AS ck, least(a.x0, b.x0, d.x0) AS x0, (a.y - 5)::DOUBLE AS y0, greatest(a.x1, b.x1, d.x1) AS x1, (d.y + 5)::DOUBLE AS y1
 FROM l8 a JOIN l8 b ON a.page_no = b.page_no AND b.y - a.y >= 20 JOIN l8 d ON d.page_no = a.page_no AND d.y - b.y >= 20
 WHERE d.y - a.y BETWEEN 50 AND 500 AND least(b.y - a.y, d.y - b.y) / greatest(b.y - a.y, d.y - b.y) > 0.2),
un AS (SELECT * FROM tr b WHERE x1 > x0 AND {_INK_OF.format('x0', 'y0')} > 0.05::DOUBLE AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.page_no = b.page_no AND {c.s_iou('b.', 'e.')} > 0.3)),
q AS (SELECT page_no, row_number() OVER (PARTITION BY page_no ORDER BY ak, bk, ck) AS i, count(*) OVER (PARTITION BY page_no) AS n, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'ak': ak, 'bk': bk, 'ck': ck}} AS b FROM un),
f AS (SELECT page_no, i, n, [b] AS kept FROM q WHERE i = 1 UNION ALL SELECT f.page_no, q.i, f.n, CASE WHEN len(list_filter(f.kept, lambda y: {c.s_iou('y.', 'q.b.')} > 0.7)) > 0 THEN f.kept ELSE list_append(f.kept, q.b) END
 FROM f JOIN q ON q.page_no = f.page_no AND q.i = f.i + 1)
SELECT page_no, b.ak AS ak, b.bk AS bk, b.ck AS ck, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM (SELECT page_no, unnest(kept) AS b FROM f WHERE i = n)""")
def missed_tables(spark, sf_dir):
    """All triples of rules with like gaps that hold ink and where no table is, each box once."""
    segments = _segments(spark, sf_dir)
    return tb.missed_tables(tb.widest_lines(segments, ["page_no"]), _existing(spark, sf_dir), ["page_no"], _ink_of)


_NOTE = "(?i)^\\s*((note|notes|footnote)\\b|(注|备注)($|[^\\p{L}\\p{N}_]))"
_CV = "(1 + stddev_pop(lx1 - lx0) / greatest(1, avg(lx1 - lx0)) + stddev_pop(lx0) / greatest(1, avg(lx0)) + stddev_pop(lx1) / greatest(1, avg(lx1)))"


@query(c.sql("l", f"""WITH {_REGIONS}, a AS (SELECT r.doc_id, r.page_index, k.line_no, k.x0 AS lx0, k.y0 AS ly0, k.x1 AS lx1, k.y1 AS ly1 FROM rg r JOIN l k ON r.doc_id = k.doc_id AND r.page_index = k.page_index
 WHERE k.x1 > r.x0 AND k.x0 < r.x1 AND k.y1 > r.y0 AND k.y0 < r.y1 AND (k.x1 - k.x0) / greatest(1, r.x1 - r.x0) >= 0.5 AND NOT regexp_matches(trim(k.text), '{S_CAPTION}') AND NOT regexp_matches(trim(k.text), '{_NOTE}')),
b0 AS (SELECT *, count(*) OVER (PARTITION BY {_D}) AS n, row_number() OVER (PARTITION BY {_D} ORDER BY ly0, line_no) AS k FROM a),
mh AS (SELECT {_D}, greatest(10, trunc(1.6::DOUBLE * list_sort(list(ly1 - ly0))[len(list(ly1 - ly0)) // 2 + 1])) AS lim FROM b0 WHERE n >= 2 GROUP BY ALL),
b1 AS (SELECT *, lead(ly0) OVER (PARTITION BY {_D} ORDER BY ly0, line_no) - ly1 AS below FROM b0 JOIN mh USING ({_D}) WHERE n >= 2),
b2 AS (SELECT *, count(*) OVER (PARTITION BY {_D}) AS m, row_number() OVER (PARTITION BY {_D} ORDER BY ly0, line_no) AS j, ly0 - lag(ly1) OVER (PARTITION BY {_D} ORDER BY ly0, line_no) AS above FROM b1 WHERE NOT coalesce(k = 1 AND n > 2 AND below > 2 * lim, false)),
b3 AS (SELECT *, count(*) OVER (PARTITION BY {_D}) AS rest FROM b2 WHERE NOT coalesce(j = m AND n > 2 AND m >= 2 AND above > 2 * lim, false)),
t AS (SELECT *, coalesce(ly0 - lag(ly1) OVER (PARTITION BY {_D} ORDER BY ly0, line_no) > lim, true) AS brk FROM b3 WHERE rest >= 2), u AS (SELECT *, sum(brk::INT) OVER (PARTITION BY {_D} ORDER BY ly0, line_no)::INT AS run FROM t),
g0 AS (SELECT {_D}, run, round(count(*) * {_CV}, 9) AS s, min(lx0) AS nx0, min(ly0) AS ny0, max(lx1) AS nx1, max(ly1) AS ny1 FROM u GROUP BY ALL HAVING count(*) >= 2),
g1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_D} ORDER BY s DESC, run) AS r FROM g0) WHERE r = 1),
z AS (SELECT rg.*, greatest(x0, nx0 - 8) AS zx0, greatest(y0, ny0 - 8) AS zy0, least(x1, nx1 + 8) AS zx1, least(y1, ny1 + 8) AS zy1, nx0 IS NOT NULL AS has FROM rg LEFT JOIN g1 USING ({_D})),
y AS (SELECT *, has AND coalesce((zx1 - zx0) * (zy1 - zy0) >= (x1 - x0) * (y1 - y0) * 0.25, false) AS refined FROM z)
SELECT {_D}, ord, CASE WHEN refined THEN zx0 ELSE x0 END AS x0, CASE WHEN refined THEN zy0 ELSE y0 END AS y0, CASE WHEN refined THEN zx1 ELSE x1 END AS x1, CASE WHEN refined THEN zy1 ELSE y1 END AS y1, refined FROM y"""))
def refined_tables(spark, sf_dir):
    """Regions of pages drawn in to the text lines that look most like a table."""
    return tb.refined(_regions(spark, sf_dir), c.lines(spark, sf_dir), _DOC)


@query(c.sql("c", f"""WITH {_K}, n AS (SELECT *, lead(y0) OVER (PARTITION BY doc_no ORDER BY y0, line_no) AS nxt FROM k WHERE kind = 'table'),
r AS (SELECT doc_no, line_no, 1 AS choice, y1 AS top, least(900, y1 + 540::DOUBLE, coalesce(nxt, 900)) AS bottom FROM n UNION ALL SELECT doc_no, line_no, 2, greatest(0, y0 - 540::DOUBLE), y0 FROM n)
SELECT doc_no, line_no, choice, 0::DOUBLE AS x0, top AS y0, 850::DOUBLE AS x1, bottom AS y1 FROM r WHERE bottom - top > 40"""))
def caption_regions(spark, sf_dir):
    """Where the table of each caption may be; the captions of a document stand on one page here."""
    return tb.caption_regions(o.candidates(c.captions(spark, sf_dir)), ["doc_no"], 850, 900)


@query(c.sql("b", """SELECT doc_no, page_index, ord, (x1 - x0 - ord % 9 * 20) * (y1 - y0 - ord % 5 * 10) / ((x1 - x0) * (y1 - y0)) AS ratio FROM b
WHERE (x1 - x0 - ord % 9 * 20) * (y1 - y0 - ord % 5 * 10) / ((x1 - x0) * (y1 - y0)) >= 0.3::DOUBLE"""))
def shrink_sanity(spark, sf_dir):
    """Boxes that kept three tenths or more of their area when they were drawn in."""
    small = Box(F.col("x0"), F.col("y0"), F.col("x1") - F.col("ord") % 9 * 20, F.col("y1") - F.col("ord") % 5 * 10)
    ratio = g.signed_area(small) / g.signed_area(Box.of())
    return c.boxes(spark, sf_dir).select(*KEY, ratio.alias("ratio")).where("ratio >= 0.3")


_GRID = "list_transform(string_split(text, chr(10)), lambda r: string_split(r, ' '))"


def _grids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.transform(F.split("text", "\n"), lambda r: F.split(r, " ")).alias("grid"))


@query(f"SELECT doc_id, len(g) AS row_count, len(g[1]) AS col_count, len(list_filter(flatten(g), lambda x: x <> '')) > 0 AS has_cells FROM (SELECT doc_id, {_GRID} AS g FROM documents)")
def grid_counts(spark, sf_dir):
    """Rows and columns of grids, and whether they hold anything."""
    grid = F.col("grid")
    return _grids(spark, sf_dir).select("doc_id", F.size(grid).cast("long").alias("row_count"), F.size(F.get(grid, F.lit(0))).cast("long").alias("col_count"), tb.has_cells(grid).alias("has_cells"))


_RANK = "CASE detector WHEN 'table_transformer' THEN 1 WHEN 'doclayout' THEN 2 ELSE 3 END"


def _rank():
    d = F.col("detector")
    return F.when(d == "table_transformer", 1).when(d == "doclayout", 2).otherwise(3)


@query(c.sql("b", f"""WITH n AS (SELECT doc_no, CASE WHEN (x0 + y0)::BIGINT % 5 < 3 THEN detector ELSE 'lines' END AS strategy, CASE WHEN (x0 + y0)::BIGINT % 5 < 3 THEN {_RANK} ELSE 4 END AS rank, count(*) AS n FROM b WHERE type = 'table' GROUP BY ALL)
SELECT doc_no, strategy, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY n DESC, rank) AS r FROM n) WHERE r = 1"""))
def best_strategy(spark, sf_dir):
    """The strategy that found most tables of each document, the first of equals."""
    own = (F.col("x0") + F.col("y0")).cast("long") % 5 < 3
    rows = c.boxes(spark, sf_dir).where("type = 'table'").withColumns({"strategy": F.when(own, F.col("detector")).otherwise("lines"), "rank": F.when(own, _rank()).otherwise(4)})
    return tb.best_strategy(rows, ["doc_no"])


_SEPS = (("tabs", "\t"), ("semicolons", "; "), ("commas", ", "), ("words", " "))
_WAYS = " UNION ALL ".join(f"SELECT doc_id, {k} AS rank, '{n}' AS strategy, len(string_split(text, '{s}')) AS n_cells FROM documents WHERE contains(text, '{s}') AND len(list_filter(string_split(text, '{s}'), lambda x: x <> '')) > 0" for k, (n, s) in enumerate(_SEPS))


@query(f"SELECT doc_id, strategy, n_cells FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS r FROM ({_WAYS})) WHERE r = 1")
def first_success(spark, sf_dir):
    """The first of four ways to cut a text that gives a cell."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ways = [F.struct(F.lit(k).alias("rank"), F.lit(n).alias("strategy"), F.when(F.contains("text", F.lit(s)), F.array(F.split("text", s))).otherwise(F.array(F.array().cast("array<string>"))).alias("grid")) for k, (n, s) in enumerate(_SEPS)]
    tried = docs.select("doc_id", F.explode(F.array(*ways)).alias("w")).select("doc_id", "w.*")
    return tb.first_success(tried, ["doc_id"]).select("doc_id", "strategy", F.size(F.get("grid", F.lit(0))).cast("long").alias("n_cells"))


@query(c.sql("b", f"""WITH e AS (SELECT * FROM b WHERE type = 'table'), a AS (SELECT * FROM b x WHERE type = 'figure' AND score >= 0.5 AND NOT EXISTS (SELECT 1 FROM e WHERE e.doc_no = x.doc_no AND e.page_index = x.page_index AND {c.s_iou('x.', 'e.')} > 0.3))
SELECT doc_no, page_index, ord, x0, y0, x1, y1, score, false AS added FROM e
UNION ALL SELECT doc_no, page_index, ord, x0 + (x1 - x0) * 0.05::DOUBLE, y0 + (y1 - y0) * 0.05::DOUBLE, x1 - (x1 - x0) * 0.05::DOUBLE, y1 - (y1 - y0) * 0.05::DOUBLE, score, true FROM a"""))
def enhanced_tables(spark, sf_dir):
    """Tables and what a second finder adds to them."""
    rows = c.boxes(spark, sf_dir)
    return tb.enhanced(rows.where("type = 'table'"), rows.where("type = 'figure'"), c.PAGE)


@query(c.sql("b", f"""WITH {_FACTS}, k0 AS (SELECT *, n_rows * n_cols AS cells, row_number() OVER (PARTITION BY {_PAGE} ORDER BY {_RANK}, ord) AS seq FROM d),
q AS (SELECT {_PAGE}, row_number() OVER w AS i, count(*) OVER (PARTITION BY {_PAGE}) AS n, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'ord': ord, 'cells': cells}} AS b FROM k0 WINDOW w AS (PARTITION BY {_PAGE} ORDER BY score DESC, seq)),
f AS (SELECT {_PAGE}, i, n, [b] AS kept FROM q WHERE i = 1 UNION ALL SELECT {_PAGE}, i, n, CASE WHEN hit IS NULL THEN list_append(kept, x)
 WHEN x.cells > kept[hit].cells THEN list_append(list_filter(kept, lambda y: y.ord <> kept[hit].ord), x) ELSE kept END
 FROM (SELECT f.doc_no, f.page_index, q.i, f.n, f.kept, q.b AS x, list_position(list_transform(f.kept, lambda y: {c.s_iou('y.', 'q.b.')} > 0.05), true) AS hit
 FROM f JOIN q ON q.doc_no = f.doc_no AND q.page_index = f.page_index AND q.i = f.i + 1)),
e AS (SELECT {_PAGE}, b.ord AS ord, place FROM (SELECT {_PAGE}, unnest(kept) AS b, generate_subscripts(kept, 1) AS place FROM f WHERE i = n)),
v AS (SELECT d.*, place, {_TABLE} AS reason FROM d JOIN e USING ({_PAGE}, ord))
SELECT doc_no, page_index, ord, printf('table_%04d', row_number() OVER (PARTITION BY doc_no ORDER BY page_index, place)) AS item_id FROM v WHERE reason IS NULL""", recursive=True))
def table_items(spark, sf_dir):
    """Boxes of three detectors as the tables of three strategies: copies and invalid ones go, the rest are numbered."""
    rows = facts(spark, sf_dir)
    by = [rows.where(F.col("detector") == d) for d in ("table_transformer", "doclayout", "publaynet")]
    made = tb.table_items(by, "doc_no", c.PAGE, F.col("n_rows") * F.col("n_cols"), _table_reason(), 0.05)
    return made.select(*KEY, "item_id")
