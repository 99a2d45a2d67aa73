"""Queries of evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafgrid.catalogue import query
from leafgrid.operators import evaluation as e
from leafgrid.plans import common as c

_MATCH = f"""o AS (SELECT g.doc_no, g.page_index, g.ord AS gt, b.ord AS pred, {c.s_iou('g.', 'b.')} AS iou FROM g JOIN b ON g.doc_no = b.doc_no AND g.page_index = b.page_index AND g.type = b.type
 WHERE {c.s_iou('g.', 'b.')} >= 0.5),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_no, page_index ORDER BY iou DESC, gt, pred) AS i, count(*) OVER (PARTITION BY doc_no, page_index) AS n FROM o),
f AS (SELECT doc_no, page_index, i, n, [{{'gt': gt, 'pred': pred, 'iou': iou}}] AS taken FROM k WHERE i = 1 UNION ALL SELECT f.doc_no, f.page_index, k.i, f.n,
 CASE WHEN len(list_filter(f.taken, lambda y: y.gt = k.gt OR y.pred = k.pred)) > 0 THEN f.taken ELSE list_append(f.taken, {{'gt': k.gt, 'pred': k.pred, 'iou': k.iou}}) END
 FROM f JOIN k ON k.doc_no = f.doc_no AND k.page_index = f.page_index AND k.i = f.i + 1),
m AS (SELECT doc_no, page_index, unnest(taken) AS m FROM f WHERE i = n)"""


def _sides(spark, sf_dir):
    pick = lambda df: df.select(*c.PAGE, F.col("ord").alias("id"), *c.CORNERS, "type")
    return pick(c.truth(spark, sf_dir)), pick(c.boxes(spark, sf_dir))


@query(c.sql("bg", f"""WITH {_MATCH}, d AS (SELECT doc_no, count(*) AS n_gt, 0 AS n_pred, 0 AS tp, 0::DOUBLE AS s FROM g GROUP BY 1 UNION ALL SELECT doc_no, 0, count(*), 0, 0 FROM b GROUP BY 1
 UNION ALL SELECT doc_no, 0, 0, count(*), sum(m.iou) FROM m GROUP BY 1),
t AS (SELECT doc_no, sum(n_gt)::BIGINT AS n_gt, sum(n_pred)::BIGINT AS n_pred, sum(tp)::BIGINT AS tp, sum(s) AS s FROM d GROUP BY ROLLUP (doc_no)),
r AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END AS p, CASE WHEN n_gt > 0 THEN tp / n_gt ELSE 0 END AS q FROM t)
SELECT doc_no, n_gt, n_pred, tp, n_pred - tp AS fp, n_gt - tp AS fn, round(p, 6) AS precision, round(q, 6) AS recall,
 round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, round(CASE WHEN tp > 0 THEN s / tp ELSE 0 END, 6) AS mean_iou FROM r""", recursive=True))
def greedy_match_eval(spark, sf_dir):
    """Rates of every document and, with a null document, overall."""
    return e.report(*_sides(spark, sf_dir), "doc_no", "page_index")


@query(c.sql("bg", f"""WITH {_MATCH} SELECT doc_no, page_index, ord AS id, 'missed' AS side FROM g WHERE (doc_no, page_index, ord) NOT IN (SELECT (doc_no, page_index, m.gt) FROM m)
UNION ALL SELECT doc_no, page_index, ord, 'false' FROM b WHERE (doc_no, page_index, ord) NOT IN (SELECT (doc_no, page_index, m.pred) FROM m)""", recursive=True))
def unmatched(spark, sf_dir):
    """Annotations without a detection and detections without an annotation."""
    truth, found = _sides(spark, sf_dir)
    hit = e.matches(truth, found, *c.PAGE)
    left = lambda df, col, side: df.join(hit.select(*c.PAGE, F.col(col).alias("id")), [*c.PAGE, "id"], "left_anti").select(*c.PAGE, "id", F.lit(side).alias("side"))
    return left(truth, "gt", "missed").unionByName(left(found, "pred", "false"))
