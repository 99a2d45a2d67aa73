"""Queries of captions without a box, packages, diagnostics, validation and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafgrid import session
from leafgrid.catalogue import query
from leafgrid.functions import geometry as g
from leafgrid.functions.geometry import Box
from leafgrid.operators import captions as o
from leafgrid.operators import evaluation as e
from leafgrid.operators import filters as f
from leafgrid.operators import merging as m
from leafgrid.operators import quality as q
from leafgrid.plans import common as c
from leafgrid.plans.captioning import _GAP, _K, _ON, KEY
from leafgrid.plans.detections import _DETECTOR, _FACTS, H, W, facts
from leafgrid.plans.evaluation import _MATCH, _sides
from leafgrid.plans.exports import _IDS, _items
from leafgrid.plans.grouping import _fold
from leafgrid.plans.scoring import _NEAR, _SECOND, _second
from leafgrid.sources import files as fl
from leafgrid.sources import items as it

_PAGE = "doc_no, page_index"


# ---- captions of items without a box, and their counts

_FALLBACK = f"""{_K}, i AS (SELECT *, row_number() OVER (PARTITION BY doc_no, page_index, type ORDER BY y0, x0, ord) - 1 AS item_index, ord % 5 = 0 AS boxless FROM b),
pc AS (SELECT {_PAGE}, f.t AS first_text, f.l AS first_label FROM (SELECT {_PAGE}, arg_min({{'t': text, 'l': label}}, line_no) AS f FROM k GROUP BY ALL)),
s AS (SELECT b.doc_no, b.page_index, b.ord, k.text, k.label, row_number() OVER (PARTITION BY b.doc_no, b.page_index, b.ord ORDER BY {_GAP}
 + CASE WHEN (b.type = 'figure' AND k.y1 < b.y0) OR (b.type = 'table' AND k.y0 > b.y1) THEN 120 ELSE 0 END - CASE WHEN b.type = k.kind THEN 30 ELSE 0 END
 - CASE WHEN k.number < 0 THEN 0 WHEN k.number - 1 = item_index THEN 50 WHEN abs(k.number - 1 - item_index) <= 1 THEN 20 ELSE 0 END, k.line_no) AS r
 FROM i b JOIN k ON {_ON} WHERE {_GAP} < 300 AND NOT boxless),
cf AS (SELECT i.doc_no, i.page_index, i.ord, CASE WHEN boxless THEN first_text WHEN first_text IS NULL THEN 'No caption found.' ELSE coalesce(s.text, 'No matching caption found.') END AS caption,
 CASE WHEN boxless THEN first_label ELSE s.label END AS label FROM i LEFT JOIN pc USING ({_PAGE}) LEFT JOIN s ON s.doc_no = i.doc_no AND s.page_index = i.page_index AND s.ord = i.ord AND s.r = 1)"""


def _captioned(spark, sf_dir):
    rows = o.indexed(c.boxes(spark, sf_dir), c.PAGE).withColumn("boxless", F.col("ord") % 5 == 0)
    return o.captioned(rows, o.candidates(c.captions(spark, sf_dir)), c.PAGE, KEY)


@query(c.sql("bc", f"WITH {_FALLBACK} SELECT * FROM cf"))
def caption_fallbacks(spark, sf_dir):
    """Captions of items: the best one, the page's first for items without a box, and what is said where there is none."""
    return _captioned(spark, sf_dir)


@query(c.sql("bc", f"WITH {_FALLBACK} SELECT count(*) AS items, count(*) FILTER (WHERE caption IS NOT NULL AND caption <> '' AND NOT contains(caption, 'No')) AS with_caption, count(*) FILTER (WHERE label IS NOT NULL) AS with_label FROM cf"))
def caption_counts(spark, sf_dir):
    """How many items have a caption, and a label of a part."""
    has = F.col("caption").isNotNull() & (F.col("caption") != "") & ~F.col("caption").contains("No")
    return _captioned(spark, sf_dir).agg(F.count("*").alias("items"), F.count_if(has).alias("with_caption"), F.count_if(F.col("label").isNotNull()).alias("with_label"))


# ---- variants of IoU

_UNCLAMPED = "CASE WHEN least(a_x1, b_x1) <= greatest(a_x0, b_x0) OR least(a_y1, b_y1) <= greatest(a_y0, b_y0) THEN 0 ELSE {0} / ((a_x1 - a_x0) * (a_y1 - a_y0) + (b_x1 - b_x0) * (b_y1 - b_y0) - {0}) END"


@query(c.sql("bp", f"""SELECT doc_no, page_index, a_ord, b_ord, {_UNCLAMPED.format(c.s_inter('a_', 'b_'))} AS unclamped, {c.s_iou('a_', 'b_')} AS cornered FROM p WHERE {c.s_iou('a_', 'b_')} > 0"""))
def bbox_iou_variants(spark, sf_dir):
    """IoU by unclamped areas, and of boxes given by corner and size."""
    a, b = Box.of("a_"), Box.of("b_")
    sized = lambda x: g.from_corner(x.x0, x.y0, g.width(x), g.height(x))
    rows = c.pairs(c.boxes(spark, sf_dir)).where(g.iou(a, b) > 0)
    return rows.select(*c.PAGE, "a_ord", "b_ord", g.unclamped_iou(a, b).alias("unclamped"), g.iou(sized(a), sized(b)).alias("cornered"))


# ---- detectors: weights changed, labels, classes

_NEW_WEIGHT = "CASE detector WHEN 'doclayout' THEN 0.9::DOUBLE WHEN 'publaynet' THEN 0.25::DOUBLE ELSE {0} END".format(_DETECTOR.format("detector", "0.9::DOUBLE", "0.35::DOUBLE", "0.25::DOUBLE", "0.5::DOUBLE"))


@query(c.sql("b", f"SELECT doc_no, page_index, ord, {_NEW_WEIGHT} AS weight FROM b"))
def updated_weights(spark, sf_dir):
    """Weights after an update: one is taken, one that is out of range is not."""
    weights = f.updated({n: v[0] for n, v in f.DETECTORS.items()}, {"DocLayout": 0.9, "legacy": 1.5})
    return c.boxes(spark, sf_dir).select(*KEY, f.of_detector(F.col("detector"), weights, 0.5).alias("weight"))


_CLASSES = "CASE WHEN cls < 9 THEN ['" + "', '".join(f.LAYOUT_CLASSES) + "'][cls + 1] ELSE 'unknown' END"


@query(c.sql("b", f"WITH l0 AS (SELECT *, (x0 + y0)::BIGINT % 11 AS cls FROM b), l1 AS (SELECT *, {_CLASSES} AS label FROM l0) SELECT doc_no, page_index, ord, label, label IN ('figure', 'table') AND score >= 0.5 AS kept FROM l1"))
def layout_labels(spark, sf_dir):
    """Labels of class numbers, and the sure figures and tables among them."""
    label = f.class_label((F.col("x0") + F.col("y0")).cast("long") % 11, f.LAYOUT_CLASSES)
    rows = c.boxes(spark, sf_dir).withColumn("label", label)
    return rows.select(*KEY, "label", f.layout_kept(F.col("label"), F.col("score")).alias("kept"))


# ---- evaluation

@query(c.sql("bg", f"""WITH {_MATCH}, pr AS (SELECT DISTINCT doc_no FROM b WHERE doc_no % 7 <> 0), gd AS (SELECT DISTINCT doc_no FROM g)
SELECT (SELECT count(*) FROM gd) AS annotated, (SELECT count(*) FROM gd JOIN pr USING (doc_no)) AS evaluated, (SELECT count(*) FROM m JOIN pr USING (doc_no)) AS tp,
 (SELECT count(*) FROM g JOIN pr USING (doc_no)) AS n_gt, (SELECT count(*) FROM b JOIN pr USING (doc_no) JOIN gd USING (doc_no)) AS n_pred""", recursive=True))
def eval_loaded(spark, sf_dir):
    """Documents with predictions alone are evaluated; the annotations and predictions come from JSON files."""
    truth, found = _sides(spark, sf_dir)
    folder, schema = session.scratch(spark, "eval"), "doc_no long, page_index int, id int, x0 double, y0 double, x1 double, y1 double, type string"
    fl.write_json(truth, f"{folder}/truth", compression="gzip")
    fl.write_json(found.where("doc_no % 7 <> 0"), f"{folder}/found", compression="gzip")
    truth, found = (fl.read_json(spark, f"{folder}/{n}", schema) for n in ("truth", "found"))
    own, pred = e.evaluable(truth, found, "doc_no")
    hit = e.matches(own, pred, "doc_no", "page_index")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    docs = lambda df, name: one(df.select("doc_no").distinct(), name)
    return docs(truth, "annotated").join(docs(own, "evaluated")).join(one(hit, "tp")).join(one(own, "n_gt")).join(one(pred, "n_pred"))


# ---- packages, CSV, annotations

@query(c.sql("b", f"""WITH {_IDS} SELECT doc_no, item_id, page_index, x0, y0, x1, y1, '' AS caption_text, 'Extracted from PDF|Aligned Caption|Enriched with AI' AS trace, 2.0::DOUBLE AS zoom, 'paper_' || doc_no || '.pdf' AS source_pdf, true AS layout FROM i"""))
def package_export(spark, sf_dir):
    """A package written as JSON files and read back: manifests, evidence and parameters of every item."""
    folder = session.scratch(spark, "package")
    items = _items(spark, sf_dir)
    name = F.concat(F.lit("paper_"), F.col("doc_no").cast("string"), F.lit(".pdf"))
    able = {"ocr": False, "camelot": False, "layout": True}
    # by document alone: a package of one document makes a folder for each item, which a whole corpus should not
    fl.write_json(fl.manifests(items, "doc_no", name, able), f"{folder}/manifest", compression="gzip")
    fl.write_json(fl.evidence(items, "doc_no"), f"{folder}/evidence", compression="gzip")
    fl.write_json(fl.params(items, "doc_no", 2.0), f"{folder}/params", compression="gzip")
    manifest = fl.read_json(spark, f"{folder}/manifest", "doc_no long, meta struct<source_pdf: string>, capabilities struct<layout: boolean>")
    ev = fl.read_json(spark, f"{folder}/evidence", "doc_no long, item_id string, page_index int, bbox array<double>, caption_text string, extraction_trace array<string>")
    pm = fl.read_json(spark, f"{folder}/params", "doc_no long, item_id string, extraction_config struct<zoom: double>")
    out = ev.join(pm, ["doc_no", "item_id"]).join(manifest, "doc_no")
    corner = [F.get("bbox", F.lit(k)).alias(x) for k, x in enumerate(c.CORNERS)]
    return out.select("doc_no", "item_id", "page_index", *corner, "caption_text", F.concat_ws("|", "extraction_trace").alias("trace"), F.col("extraction_config.zoom").alias("zoom"), F.col("meta.source_pdf").alias("source_pdf"), F.col("capabilities.layout").alias("layout"))


@query(c.sql("b", "SELECT doc_no, page_index, 'Bar_' || ord || ', \"part\"' AS category, round((y1 - y0) / 190 * 100, 2) AS value FROM b"))
def bar_csv(spark, sf_dir):
    """Values of bars written as CSV without a header and read back."""
    folder = session.scratch(spark, "csv")
    category = F.concat(F.lit("Bar_"), F.col("ord").cast("string"), F.lit(', "part"'))
    fl.write_csv(c.boxes(spark, sf_dir).select("doc_no", "page_index", category.alias("category"), F.round(g.height(Box.of()) / 190 * 100, 2).alias("value")), folder)
    return fl.read_csv(spark, folder, "doc_no long, page_index int, category string, value double")


_QUOTED = """CASE WHEN regexp_matches(x, '[,"\\r\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END"""


@query(f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '), lambda x: {_QUOTED}), ',')), chr(10)) || chr(10) AS csv FROM documents""")
def table_csv(spark, sf_dir):
    """Grids as CSV texts without a header."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", fl.csv_text(F.transform(F.split("text", "\n"), lambda l: F.split(l, " "))).alias("csv"))  # noqa: E741


@query(c.sql("b", "SELECT doc_no, count(*) AS items, count(*) FILTER (WHERE ord % 4 + 1 > 1) AS merged FROM b GROUP BY ROLLUP (doc_no)"))
def merged_report(spark, sf_dir):
    """Items of each document and overall, and those that were made of several boxes."""
    rows = c.boxes(spark, sf_dir).withColumn("merged_from", F.col("ord") % 4 + 1)
    return rows.rollup("doc_no").agg(F.count("*").alias("items"), F.count_if(F.col("merged_from") > 1).alias("merged"))


@query(c.sql("bg", "SELECT doc_no, doc_no IN (SELECT doc_no FROM b WHERE score >= 0.97) AS has_manifest FROM (SELECT DISTINCT doc_no FROM g)"))
def scanned_documents(spark, sf_dir):
    """Documents and whether they have a manifest; those without one are skipped, not failed."""
    docs, _ = _sides(spark, sf_dir)
    return it.scanned(docs.select("doc_no").distinct(), c.boxes(spark, sf_dir).where("score >= 0.97"), "doc_no")


@query(c.sql("b", f"""WITH {_IDS}, n AS (SELECT doc_no, count(*) AS n, max(x1) AS wide FROM i GROUP BY ALL) SELECT doc_no, item_id, page_index, x0, y0, x1, y1, 'extracted' AS source FROM i
UNION ALL SELECT doc_no, printf('manual_%04d', n + 1), 1, 0::DOUBLE, 20::DOUBLE, least(900, wide + 300), 950::DOUBLE, 'manual' FROM n"""))
def manual_items(spark, sf_dir):
    """Items of each document and one that a user adds, its box cut to the page."""
    items = _items(spark, sf_dir)
    n = items.groupBy("doc_no").agg(F.count("*").alias("n"), F.max("x1").alias("wide"))
    added = n.select("doc_no", F.lit(1).alias("page_index"), F.lit(-30.0).alias("x0"), F.lit(20.0).alias("y0"), (F.col("wide") + 300).alias("x1"), F.lit(2000.0).alias("y1"), "n")
    return it.with_manual(items, added, "doc_no", W(), H())


@query("SELECT doc_no, replace('items/temp_' || o || '/table.csv', 'temp_' || o, printf('table_%04d', o)) AS csv, replace('items/temp_' || o || '/preview.png', 'temp_' || o, printf('table_%04d', o)) AS png FROM (SELECT o_orderkey % 2000 AS doc_no, o_custkey::BIGINT AS o FROM orders)")
def renamed_artifacts(spark, sf_dir):
    """Paths of artifacts under their items' final ids."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 2000).alias("doc_no"), F.col("o_custkey").cast("long").alias("o"))
    old = F.concat(F.lit("temp_"), F.col("o").cast("string"))
    made = rows.withColumn("old", old).withColumn("paths", F.create_map(F.lit("csv"), F.concat(F.lit("items/"), "old", F.lit("/table.csv")), F.lit("png"), F.concat(F.lit("items/"), "old", F.lit("/preview.png"))))
    paths = it.renamed(F.col("paths"), F.col("old"), F.format_string("table_%04d", "o"))
    return made.withColumn("paths", paths).select("doc_no", F.col("paths")["csv"].alias("csv"), F.col("paths")["png"].alias("png"))


# ---- diagnostics, recommendations, validation

@query(c.sql("b", f"""WITH {_FACTS}, k AS (SELECT *, greatest(0, trunc(x0)) AS cx0, greatest(0, trunc(y0)) AS cy0, least(600, trunc(x1)) AS cx1, least(650, trunc(y1)) AS cy1 FROM d)
SELECT doc_no, page_index, ord, cx0 / 600 AS left_share, cy0 / 650 AS top_share, (cx0 + cx1) / 2 / 600 AS centre_x, (cy0 + cy1) / 2 / 650 AS centre_y, (cx1 - cx0) * (cy1 - cy0) / 390000 AS area_share,
 CASE WHEN cy1 - cy0 > 0 THEN (cx1 - cx0) / (cy1 - cy0) ELSE 0 END AS aspect, ink, h_lines, v_lines, h_lines > 50 AND v_lines > 50 AS structured FROM k"""))
def diagnostic_features(spark, sf_dir):
    """What a diagnosis looks at: place, size and shape on the page, ink and lines."""
    return facts(spark, sf_dir).select(*KEY, *q.diagnosis(Box.of(), F.lit(600.0), F.lit(650.0), F.col("ink"), F.col("h_lines"), F.col("v_lines")))


@query(c.sql("b", f"""WITH {_FACTS} SELECT page_index, count(*) AS detections, count(*) FILTER (WHERE type = 'figure') AS figures, count(*) FILTER (WHERE type = 'figure' AND cy < 95 AND w * h < 855000 * 0.05::DOUBLE AND w / h > 1.5 AND w / h < 8) AS arxiv_suspects,
 count(*) FILTER (WHERE type = 'table' AND ink * 2.5::DOUBLE > 0.8 AND h_lines < 100 AND v_lines < 100 AND structure < 600) AS text_suspects FROM d GROUP BY ROLLUP (page_index)"""))
def diagnostic_sums(spark, sf_dir):
    """Suspects of each batch of pages and of all."""
    rows = facts(spark, sf_dir)
    kind = F.col("type")
    text = f.text_suspect(kind, F.col("ink") * 2.5, F.col("h_lines"), F.col("v_lines"), F.col("structure") >= 600)
    return rows.rollup("page_index").agg(
        F.count("*").alias("detections"), F.count_if(kind == "figure").alias("figures"), F.count_if(f.arxiv_suspect(Box.of(), kind, W(), H())).alias("arxiv_suspects"), F.count_if(text).alias("text_suspects")
    )


@query(c.sql("b", f"""WITH {_FACTS}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_no ORDER BY page_index, ord) AS r FROM d WHERE type = 'figure' AND cy < 95 AND w * h < 855000 * 0.05::DOUBLE AND w / h > 1.5 AND w / h < 8)
SELECT doc_no, count(*) AS n, 'suspects: ' || count(*) || '; ' || string_agg(printf('%d/%d (%d %%)', page_index, ord, floor(w / h * 100)::BIGINT), ', ' ORDER BY page_index, ord) FILTER (WHERE r <= 5) AS report FROM s GROUP BY ALL"""))
def suspect_report(spark, sf_dir):
    """A line of text for each document with suspects: how many, and the first five."""
    rows = c.boxes(spark, sf_dir).where(f.arxiv_suspect(Box.of(), F.col("type"), W(), H()))
    one = F.format_string("%d/%d (%d %%)", F.col("page_index").cast("long"), F.col("ord").cast("long"), F.floor(g.aspect(Box.of()) * 100))
    grouped = rows.groupBy("doc_no").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("page_index", "ord", one.alias("said")))), 1, 5).alias("first"))
    return grouped.select("doc_no", "n", F.concat(F.lit("suspects: "), F.col("n").cast("string"), F.lit("; "), F.array_join("first.said", ", ")).alias("report"))


_ADVICE = "concat_ws('; ', " + ", ".join(f"CASE WHEN {cond} THEN '{q.ADVICE[name]}' END" for name, cond in (
    ("low_detection", "score < 0.5"), ("low_content", "content < 0.5"), ("low_boundary", "boundary < 0.5"), ("low_caption", "has_captions AND caption < 0.3"), ("low_position", "position < 0.5"),
    ("text", "text_share > 0.7"), ("stamp", "stamp"),
)) + ")"


@query(c.sql("bc", f"WITH {_FACTS}, {_K}, {_NEAR}, {_SECOND} SELECT doc_no, page_index, ord, {_ADVICE} AS advice FROM z"))
def recommendations(spark, sf_dir):
    """What to do about the issues of each detection."""
    return _second(spark, sf_dir).select(*KEY, F.concat_ws("; ", q.advice(F.col("issues"))).alias("advice"))


@query(c.sql("b", """WITH v AS (SELECT *, (x1 - x0) - 60 AS iw, (y1 - y0) * 30 AS ih, CASE ord % 7 WHEN 0 THEN 'map' WHEN 1 THEN 'chart' ELSE type END AS kind, (x0 * 3 + y0) % 60 AS sharp FROM b)
SELECT doc_no, page_index, ord, ord % 11 <> 0 AND ord % 13 <> 0 AS is_valid, CASE WHEN ord % 11 = 0 THEN 'not_found' WHEN ord % 13 = 0 THEN 'unreadable' ELSE concat_ws(',', CASE WHEN iw < 50 OR ih < 50 THEN 'small' END,
 CASE WHEN iw > 5000 OR ih > 5000 THEN 'large' END, CASE WHEN kind NOT IN ('figure', 'table', 'chart', 'unknown') THEN 'kind' END, CASE WHEN sharp < 10 THEN 'blurred' END) END AS issues FROM v"""))
def input_validation(spark, sf_dir):
    """Whether an image can be analysed, and what is wrong with it."""
    rows = c.boxes(spark, sf_dir)
    kind = F.when(F.col("ord") % 7 == 0, "map").when(F.col("ord") % 7 == 1, "chart").otherwise(F.col("type"))
    found = q.input_issues(F.col("ord") % 11 != 0, F.col("ord") % 13 != 0, g.width(Box.of()) - 60, g.height(Box.of()) * 30, kind, (F.col("x0") * 3 + F.col("y0")) % 60)
    return rows.withColumn("found", found).select(*KEY, q.input_valid(F.col("found")).alias("is_valid"), F.concat_ws(",", "found").alias("issues"))


@query(c.sql("l", """WITH n AS (SELECT *, lead(y0) OVER (PARTITION BY doc_id, page_index ORDER BY y0, line_no) - y1 AS gap FROM l WHERE x1 - x0 >= 300)
SELECT doc_id, page_index, count(*) AS n, round(avg(gap), 6) AS gap, round(stddev_pop(gap), 6) AS deviation, sum(y1 - y0) AS heights FROM n GROUP BY ALL"""))
def line_gaps(spark, sf_dir):
    """Gaps between the long lines of a page: mean, deviation, and the lines' heights together."""
    by = ["doc_id", "page_index"]
    gap = F.lead("y0").over(Window.partitionBy(*by).orderBy("y0", "line_no")) - F.col("y1")
    rows = c.lines(spark, sf_dir).where("x1 - x0 >= 300").withColumn("gap", gap)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("gap"), 6).alias("gap"), F.round(F.stddev_pop("gap"), 6).alias("deviation"), F.sum(F.col("y1") - F.col("y0")).alias("heights"))


@query(c.sql("b", f"WITH {_fold('detector, ord', c.s_iou('y.', 'q.b.') + ' > 0.5')} SELECT doc_no, page_index, b.ord AS ord FROM e", recursive=True))
def bars_union(spark, sf_dir):
    """Bars that several ways found, each once: the first way's first."""
    return m.greedy_distinct(c.boxes(spark, sf_dir), c.PAGE, [F.col("detector").alias("o1"), F.col("ord").alias("o2")], 0.5, ("ord",)).select(*KEY)


@query(c.sql("b", f"""WITH {_IDS} SELECT doc_no, item_id, type, 'table' AS subtype, page_index, x0 / 2 AS pdf_x0, y0 / 2 AS pdf_y0, x1 / 2 AS pdf_x1, y1 / 2 AS pdf_y1, score AS detection_score, detector AS detection_source, ord % 4 + 2 AS row_count, ord % 3 + 2 AS col_count,
 'items/' || item_id || '/table.csv' AS table_csv FROM i WHERE type = 'table'"""))
def item_rows(spark, sf_dir):
    """Items of tables with all that is known of them."""
    rows = _items(spark, sf_dir).where("type = 'table'").withColumns({"row_count": F.col("ord") % 4 + 2, "col_count": F.col("ord") % 3 + 2})
    made = it.table_items(rows, F.col("score"), F.col("detector"), F.lit("lines"), 2.0)
    return made.select("doc_no", "item_id", "type", "subtype", "page_index", *(F.col(f"pdf_bbox.{x}").alias("pdf_" + x) for x in c.CORNERS), "detection_score", "detection_source", "row_count", "col_count", F.col("artifacts")["table_csv"].alias("table_csv"))
