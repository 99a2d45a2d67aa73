"""Queries of merging, de-duplication and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafgrid import sources
from leafgrid.catalogue import query
from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.operators import figures as fg
from leafgrid.operators import merging as m
from leafgrid.operators import tables as tb
from leafgrid.plans import common as c
from leafgrid.plans.captioning import _GAP, _K, _ON, _SHARED, KEY


def A():
    return Box.of("a_")


def B():
    return Box.of("b_")


def _fold(order: str, test: str, by: str = "doc_no, page_index") -> str:
    """First-wins de-duplication in SQL: boxes in order, each against the list of those that stayed."""
    item = "{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'ord': ord}"
    return f"""q AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS i, count(*) OVER (PARTITION BY {by}) AS n, {item} AS b FROM b),
f AS (SELECT {by}, i, n, [b] AS kept FROM q WHERE i = 1 UNION ALL SELECT {', '.join('f.' + k.strip() for k in by.split(','))}, q.i, f.n,
 CASE WHEN len(list_filter(f.kept, lambda y: {test})) > 0 THEN f.kept ELSE list_append(f.kept, q.b) END
 FROM f JOIN q ON {' AND '.join(f'q.{k.strip()} = f.{k.strip()}' for k in by.split(','))} AND q.i = f.i + 1),
e AS (SELECT {by}, unnest(kept) AS b FROM f WHERE i = n)"""


_IOU = c.s_iou("y.", "q.b.")


@query(c.sql("b", f"WITH {_fold('ord', f'{_IOU} > 0.1')} SELECT doc_no, page_index, b.ord AS ord FROM e", recursive=True))
def greedy_dedup(spark, sf_dir):
    """First wins: no two boxes that stay overlap by more than a tenth."""
    return m.greedy_distinct(c.boxes(spark, sf_dir), c.PAGE, [F.col("ord").alias("o1")], 0.1, ("ord",)).select(*KEY)


@query(c.sql("b", f"WITH {_fold('score DESC, ord', f'{_IOU} > 0.05')} SELECT doc_no, page_index, b.ord AS ord FROM e", recursive=True))
def weighted_nms(spark, sf_dir):
    """Non-maximum suppression by score."""
    return m.greedy_distinct(c.boxes(spark, sf_dir), c.PAGE, [(-F.col("score")).alias("o1"), F.col("ord").alias("o2")], 0.05, ("ord",)).select(*KEY)


def _s_replacing(most: float) -> str:
    """De-duplication in SQL where a box worth more takes the place of the first kept one that it overlaps."""
    return f"""k0 AS (SELECT *, (ord % 4 + 1) * (page_index % 3 + 1) AS cells FROM b),
q AS (SELECT doc_no, page_index, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_no, page_index) AS n, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'ord': ord, 'cells': cells}} AS b
 FROM k0 WINDOW w AS (PARTITION BY doc_no, page_index ORDER BY score DESC, ord)),
f AS (SELECT doc_no, page_index, i, n, [b] AS kept FROM q WHERE i = 1 UNION ALL SELECT doc_no, page_index, i, n, CASE WHEN hit IS NULL THEN list_append(kept, x)
 WHEN x.cells > kept[hit].cells THEN list_append(list_filter(kept, lambda y: y.ord <> kept[hit].ord), x) ELSE kept END
 FROM (SELECT f.doc_no, f.page_index, q.i, f.n, f.kept, q.b AS x, list_position(list_transform(f.kept, lambda y: {_IOU} > {most}), true) AS hit
 FROM f JOIN q ON q.doc_no = f.doc_no AND q.page_index = f.page_index AND q.i = f.i + 1)),
e AS (SELECT doc_no, page_index, unnest(kept) AS b, generate_subscripts(kept, 1)::INT AS place FROM f WHERE i = n)"""


#: The threshold of the rule, and a low one that the boxes here often pass.
DEDUP = (0.7, 0.05)


@query(" UNION ALL ".join(f"SELECT * FROM ({c.sql('b', f'WITH {_s_replacing(x)} SELECT {x}::DOUBLE AS most, doc_no, page_index, place, b.ord AS ord FROM e', recursive=True)})" for x in DEDUP))
def table_dedup(spark, sf_dir):
    """Tables by falling score; one that overlaps a kept one goes, or takes its place if it has more cells."""
    rows = c.boxes(spark, sf_dir)
    cells = (F.col("ord") % 4 + 1) * (F.col("page_index") % 3 + 1)
    order = [(-F.col("score")).alias("o1"), F.col("ord").alias("o2")]
    runs = [m.replacing_distinct(rows, c.PAGE, order, cells, x, ("ord",)).select(F.lit(x).alias("most"), *c.PAGE, "place", "ord") for x in DEDUP]
    return runs[0].unionByName(runs[1])


def _least(x: str, of: str) -> str:
    return f"list_min(list_transform({of}, lambda y: y.{x}))"


def _most(x: str, of: str) -> str:
    return f"list_max(list_transform({of}, lambda y: y.{x}))"


_H = f"{c.s_iou('h.', 'y.')} >= 0.3 OR {c.s_overlap('h.', 'y.')} >= 0.7"
_UNION = f"""{{'x0': {_least('x0', 'own')}, 'y0': {_least('y0', 'own')}, 'x1': {_most('x1', 'own')}, 'y1': {_most('y1', 'own')}, 'score': {_most('score', 'own')},
 'type': list_filter(own, lambda t: t.score = {_most('score', 'own')})[1].type, 'n': len(own)::INT}}"""
_PLACED = "unnest(out) AS b, generate_subscripts(out, 1)::INT AS merged_ord"
_SHOWN = "doc_no, page_index, merged_ord, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.score AS score, b.type AS type, b.n AS merged_from"


@query(c.sql("b", f"""WITH q AS (SELECT doc_no, page_index, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score, 'type': type, 'n': 1::INT}} ORDER BY ord) AS todo FROM b GROUP BY ALL),
f AS (SELECT doc_no, page_index, 1 AS turn, false AS changed, todo, todo[:0] AS out FROM q UNION ALL
SELECT doc_no, page_index, CASE WHEN h IS NULL THEN turn + 1 ELSE turn END, CASE WHEN h IS NULL THEN false ELSE changed OR len(own) > 1 END,
 CASE WHEN h IS NULL THEN out ELSE rest END, CASE WHEN h IS NULL THEN todo ELSE list_append(out, CASE WHEN len(own) = 1 THEN h ELSE {_UNION} END) END
 FROM (SELECT *, list_prepend(h, list_filter(todo[2:], lambda y: {_H})) AS own, list_filter(todo[2:], lambda y: NOT ({_H})) AS rest FROM (SELECT *, todo[1] AS h FROM f))
 WHERE len(todo) > 0 OR (changed AND turn < 11)),
e AS (SELECT doc_no, page_index, {_PLACED} FROM f WHERE len(todo) = 0 AND NOT (changed AND turn < 11)) SELECT {_SHOWN} FROM e""", recursive=True))
def overlap_merge(spark, sf_dir):
    """Boxes of a page merged while they overlap; each takes what joins it, pass by pass."""
    return m.overlap_merge(c.boxes(spark, sf_dir), c.PAGE)


def _s_span(a: str, b: str, s: str) -> str:
    return f"(greatest(0, least({a}{s}1, {b}{s}1) - greatest({a}{s}0, {b}{s}0)) / greatest(1, least({a}{s}1 - {a}{s}0, {b}{s}1 - {b}{s}0)))"


def _s_slot(s: str, o: str) -> str:
    """Whether a line l stands in the gap between boxes h and x along s, the other axis being o; null where the gap is none."""
    first = lambda v: f"(CASE WHEN h.{s}0 < x.{s}0 THEN h.{v} ELSE x.{v} END)"
    second = lambda v: f"(CASE WHEN h.{s}0 < x.{s}0 THEN x.{v} ELSE h.{v} END)"
    low, high, left, right = first(s + "1"), second(s + "0"), f"greatest(h.{o}0, x.{o}0)", f"least(h.{o}1, x.{o}1)"
    slot = f"(greatest(0, least(l.{o}1, {right}) - greatest(l.{o}0, {left})) / greatest(1, least(l.{o}1 - l.{o}0, {right} - {left})))"
    over = " AND ".join([f"{slot} >= 0.6", *(f"{_s_span('l.', p, o)} >= 0.6" for p in ("h.", "x."))])
    touch = f"least(l.{s}1, {high}) > greatest(l.{s}0, {low}) AND least(l.{o}1, {right}) > greatest(l.{o}0, {left})"
    return f"""(CASE WHEN {high} <= {low} + 2 OR {right} <= {left} THEN NULL ELSE len(list_filter(bars, lambda l: {touch} AND {over})) > 0 END)"""


_JOINS = f"""NOT (h.sig <> '' AND x.sig <> '' AND h.sig <> x.sig)
 AND (({_s_span('h.', 'x.', 'x')} >= 0.65 AND greatest(h.y0, x.y0) - least(h.y1, x.y1) <= 16) OR ({_s_span('h.', 'x.', 'y')} >= 0.65 AND greatest(h.x0, x.x0) - least(h.x1, x.x1) <= 16))
 AND NOT (CASE WHEN h.y1 <= x.y0 OR x.y1 <= h.y0 THEN CASE WHEN {_s_slot('y', 'x')} IS NULL THEN false WHEN {_s_slot('y', 'x')} THEN true WHEN h.x1 <= x.x0 OR x.x1 <= h.x0 THEN coalesce({_s_slot('x', 'y')}, false) ELSE false END
 WHEN h.x1 <= x.x0 OR x.x1 <= h.x0 THEN coalesce({_s_slot('x', 'y')}, false) ELSE false END)"""
_GROWN = """{'x0': least(h.x0, x.x0), 'y0': least(h.y0, x.y0), 'x1': greatest(h.x1, x.x1), 'y1': greatest(h.y1, x.y1), 'score': greatest(h.score, x.score),
 'type': CASE WHEN h.score >= x.score THEN h.type ELSE x.type END, 'n': h.n + x.n, 'sig': CASE WHEN h.sig <> '' THEN h.sig ELSE x.sig END}"""


@query(c.sql("bc", f"""WITH {_K}, sg AS (SELECT b.doc_no, b.page_index, b.ord, k.text, {_GAP} + {_SHARED} AS s, row_number() OVER (PARTITION BY b.doc_no, b.page_index, b.ord ORDER BY {_GAP} + {_SHARED}, k.line_no) AS r FROM b JOIN k ON {_ON}),
q AS (SELECT doc_no, page_index, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score, 'type': type, 'n': 1::INT, 'sig': coalesce(text, '')}} ORDER BY ord) AS todo
 FROM b LEFT JOIN (SELECT doc_no, page_index, ord, text FROM sg WHERE r = 1 AND s <= 300) USING (doc_no, page_index, ord) GROUP BY ALL),
bl AS (SELECT doc_no, page_index, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY line_no) AS bars FROM c GROUP BY ALL),
f AS (SELECT doc_no, page_index, coalesce(bars, []) AS bars, false AS changed, todo[1] AS h, todo[2:] AS todo, todo[:0] AS rest, todo[:0] AS out FROM q LEFT JOIN bl USING (doc_no, page_index) UNION ALL
SELECT doc_no, page_index, bars, CASE WHEN x IS NOT NULL THEN changed OR joined WHEN len(rest) > 0 THEN changed ELSE false END,
 CASE WHEN x IS NOT NULL THEN CASE WHEN joined THEN {_GROWN} ELSE h END WHEN len(rest) > 0 THEN rest[1] WHEN changed THEN list_append(out, h)[1] END,
 CASE WHEN x IS NOT NULL THEN todo[2:] WHEN len(rest) > 0 THEN rest[2:] WHEN changed THEN list_append(out, h)[2:] ELSE todo END,
 CASE WHEN x IS NOT NULL AND NOT joined THEN list_append(rest, x) WHEN x IS NOT NULL THEN rest ELSE rest[:0] END,
 CASE WHEN x IS NOT NULL THEN out WHEN len(rest) > 0 THEN list_append(out, h) WHEN changed THEN out[:0] ELSE list_append(out, h) END
 FROM (SELECT *, coalesce({_JOINS}, false) AS joined FROM (SELECT *, todo[1] AS x FROM f WHERE h IS NOT NULL))),
e AS (SELECT doc_no, page_index, {_PLACED} FROM f WHERE h IS NULL) SELECT {_SHOWN} FROM e""", recursive=True))
def proximity_merge(spark, sf_dir):
    """Boxes absorbed by aligned ones close by, but for those under other captions or behind a line."""
    rows, lines = c.boxes(spark, sf_dir), c.captions(spark, sf_dir)
    return m.proximity_merge(o.signed(rows, o.candidates(lines), c.PAGE), lines, c.PAGE)


_REACH = f"""ed AS (SELECT doc_no, page_index, a_ord AS a, b_ord AS b FROM p WHERE {c.s_distance('a_', 'b_')} <= 50),
both_ AS (SELECT * FROM ed UNION ALL SELECT doc_no, page_index, b, a FROM ed),
reach AS (SELECT doc_no, page_index, ord, ord AS to_ FROM b UNION SELECT r.doc_no, r.page_index, r.ord, e.b FROM reach r JOIN both_ e
 ON e.doc_no = r.doc_no AND e.page_index = r.page_index AND e.a = r.to_)"""


@query(c.sql("bp", f"WITH {_REACH} SELECT doc_no, page_index, ord, min(to_) AS comp FROM reach GROUP BY ALL", recursive=True))
def components(spark, sf_dir):
    """Boxes of a page joined by gaps of at most 50."""
    rows = c.boxes(spark, sf_dir)
    edges = c.pairs(rows).where(g.close(A(), B())).select(*c.PAGE, F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))
    return m.components(edges, rows, c.PAGE)


_NEAREST = f"""n AS (SELECT b.doc_no, b.page_index, b.ord, b.x0, b.y0, b.x1, b.y1, b.score, b.type, k.line_no, row_number() OVER (PARTITION BY b.doc_no, b.page_index, b.ord ORDER BY
 {c.s_distance('b.', 'k.')} + CASE WHEN {c.s_overlap('b.', 'k.')} < 0.8 AND {c.s_iou('b.', 'k.')} <= 0.1
 AND abs(k.x0 + k.x1 - b.x0 - b.x1) <= abs(k.y0 + k.y1 - b.y0 - b.y1) AND k.y0 + k.y1 <= b.y0 + b.y1 THEN 100 ELSE 0 END, k.line_no) AS r FROM b JOIN k ON {_ON})"""


def _with_nearest(spark, sf_dir):
    captions = o.candidates(c.captions(spark, sf_dir))
    return o.nearest_line(c.boxes(spark, sf_dir), captions, c.PAGE).where("line_no is not null")


@query(c.sql("bc", f"""WITH {_K}, {_NEAREST}
SELECT doc_no, page_index, line_no, count(*) AS merged_from, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(score) AS score,
 arg_min(type, {{'s': -score, 'o': ord}}) AS type FROM n WHERE r = 1 GROUP BY ALL"""))
def caption_groups(spark, sf_dir):
    """Boxes that share their nearest caption as one: union, best score, type of the first best."""
    return _with_nearest(spark, sf_dir).groupBy(*c.PAGE, "line_no").agg(
        F.count("*").alias("merged_from"), *g.union_all(Box.of()), F.max("score").alias("score"),
        F.min_by("type", F.struct((-F.col("score")).alias("s"), F.col("ord"))).alias("type"),
    )


@query(c.sql("bcp", f"""WITH {_K}, {_NEAREST}, q AS (SELECT a.doc_no, a.page_index, a.line_no, max({c.s_distance('a.', 'z.')}) AS far FROM n a JOIN n z
 ON a.doc_no = z.doc_no AND a.page_index = z.page_index AND a.line_no = z.line_no AND a.ord < z.ord WHERE a.r = 1 AND z.r = 1 GROUP BY ALL),
s AS (SELECT doc_no, page_index, line_no, count(*) AS n_boxes, max({c.s_area('')}) / min({c.s_area('')}) AS spread FROM n WHERE r = 1 GROUP BY ALL)
SELECT s.doc_no, s.page_index, s.line_no, n_boxes, n_boxes > 1 AND far <= 100 AND spread <= 4 AS is_group FROM s LEFT JOIN q USING (doc_no, page_index, line_no) WHERE n_boxes > 1"""))
def subfigure_groups(spark, sf_dir):
    """Whether boxes under one caption are parts of one figure: close together and of like size."""
    rows = _with_nearest(spark, sf_dir)
    by = [*c.PAGE, "line_no"]
    size = rows.groupBy(*by).agg(F.count("*").alias("n_boxes")).where("n_boxes > 1")
    out = size.join(fg.subfigure_groups(rows, c.PAGE).select(*by, F.lit(True).alias("is_group")), by, "left")
    return out.select(*by, "n_boxes", F.coalesce("is_group", F.lit(False)).alias("is_group"))


_SEGMENTS = f"WITH s AS (SELECT page_no, y::INT AS y, x0::DOUBLE AS x0, x1::DOUBLE AS x1, seg_id FROM ({sources.view('segments')})), "


def _segments(spark, sf_dir):
    rows = sources.entity(spark, sf_dir, "segments")
    return rows.select("page_no", F.col("y").cast("int").alias("y"), F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"), "seg_id")


#: The rule's least overlap, and a low one that the boxes here pass more often.
COVERS, CONFIRMS = (0.3, 0.05), (0.5, 0.05)


def _each(values: tuple, select: str, use: str = "b") -> str:
    return " UNION ALL ".join(f"SELECT {v}::DOUBLE AS most, * FROM ({c.sql(use, select.replace('@', str(v)))})" for v in values)


def _both(values: tuple, run):
    one, two = (run(v).withColumn("most", F.lit(v)) for v in values)
    return one.unionByName(two)


@query(_each(COVERS, f"""SELECT doc_no, page_index, ord FROM b a WHERE type = 'figure' AND NOT EXISTS (SELECT 1 FROM b t WHERE t.type = 'table' AND t.doc_no = a.doc_no
 AND t.page_index = a.page_index AND {c.s_iou('a.', 't.')} > @)"""))
def uncovered_tables(spark, sf_dir):
    """Candidates that no detected table covers."""
    rows = c.boxes(spark, sf_dir)
    tables, own = rows.where("type = 'table'"), rows.where("type = 'figure'")
    return _both(COVERS, lambda most: tb.uncovered(own, tables, c.PAGE, most).select(*KEY))


@query(c.sql("b", "SELECT DISTINCT doc_no, page_index FROM b WHERE (doc_no, page_index) NOT IN (SELECT (doc_no, page_index) FROM b WHERE type = 'table')"))
def pages_without_tables(spark, sf_dir):
    rows = c.boxes(spark, sf_dir).select(*c.PAGE, "type")
    return rows.groupBy(*c.PAGE).agg(F.bool_or(F.col("type") == "table").alias("has")).where("not has").select(*c.PAGE)


@query(_each(CONFIRMS, f"""SELECT doc_no, page_index, ord FROM b a WHERE type = 'table' AND EXISTS (SELECT 1 FROM b t WHERE t.detector = 'table_transformer' AND t.doc_no = a.doc_no
 AND t.page_index = a.page_index AND t.ord <> a.ord AND {c.s_iou('a.', 't.')} > @)"""))
def verified_semi(spark, sf_dir):
    """Tables that a second detector confirms."""
    rows = c.boxes(spark, sf_dir)
    second = rows.where("detector = 'table_transformer'").select(*(F.col(x).alias("b_" + x) for x in (*c.PAGE, "ord", *c.CORNERS)))
    own = rows.where("type = 'table'")
    same = (own["doc_no"] == second["b_doc_no"]) & (own["page_index"] == second["b_page_index"]) & (own["ord"] != second["b_ord"])
    return _both(CONFIRMS, lambda most: own.join(second, same & (g.iou(Box.of(), Box.of("b_")) > most), "left_semi").select(*KEY))
