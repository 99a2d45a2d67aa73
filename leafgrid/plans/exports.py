"""Queries of export: ids, manifests, annotations and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leafgrid.catalogue import query
from leafgrid.plans import common as c
from leafgrid.sources import items as a

_IDS = "i AS (SELECT *, printf('%s_%04d', CASE type WHEN 'figure' THEN 'fig' ELSE 'table' END, row_number() OVER (PARTITION BY doc_no, type ORDER BY page_index, ord)) AS item_id FROM b)"


def _items(spark, sf_dir):
    # dealt by document once: its pages are numbered where its items are
    return a.with_ids(c.boxes(spark, sf_dir, ["doc_no"]), "doc_no", ["page_index", "ord"])


@query(c.sql("b", f"WITH {_IDS} SELECT doc_no, page_index, ord, item_id FROM i"))
def item_ids(spark, sf_dir):
    return _items(spark, sf_dir).select(*c.PAGE, "ord", "item_id")


@query(c.sql("b", f"WITH {_IDS} SELECT doc_no, count(*) AS n, string_agg(item_id || ':' || type || ':unknown', ',' ORDER BY item_id) AS items FROM i GROUP BY ALL"))
def manifest_json(spark, sf_dir):
    """The manifest of each document; read back from its JSON."""
    manifest = a.manifests(_items(spark, sf_dir), "doc_no")
    back = a.items_of(manifest)
    # by the id alone: beyond 9999 items an id may begin with another one, which the text behind it must not decide
    ordered = F.array_sort(F.collect_list(F.struct("item_id", F.concat_ws(":", "item_id", "type", "subtype").alias("said"))))
    return back.groupBy("doc_no").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda s: s["said"]), ",").alias("items"))


_ACTION = "CASE ord % 5 WHEN 0 THEN 'delete' WHEN 1 THEN 'modify' ELSE 'keep' END"


@query(c.sql("b", f"""WITH {_IDS}, e AS (SELECT *, {_ACTION} AS action FROM i) SELECT doc_no, count(*) AS total_items, count(*) FILTER (WHERE type = 'figure') AS figures,
 count(*) FILTER (WHERE type = 'table') AS tables, count(*) FILTER (WHERE action <> 'keep') AS verified, 0::BIGINT AS added, count(*) FILTER (WHERE action = 'modify') AS modified FROM e WHERE action <> 'delete' GROUP BY ALL"""))
def annotation_stats(spark, sf_dir):
    seeds = a.seeds(_items(spark, sf_dir))
    action = F.when(F.col("ord") % 5 == 0, "delete").when(F.col("ord") % 5 == 1, "modify").otherwise("keep")
    edited = seeds.withColumn("action", action).withColumn("verified", F.col("action") != "keep")
    return a.stats(edited, "doc_no")


@query(c.sql("b", f"""WITH {_IDS}, e AS (SELECT *, {_ACTION} AS action FROM i)
SELECT doc_no, item_id, CASE action WHEN 'modify' THEN x0 + 5 ELSE x0 END AS x0, y0, x1, y1, action FROM e WHERE action <> 'delete'
UNION ALL SELECT doc_no, 'added_' || item_id, 0, 0, 10, 10, 'add' FROM i WHERE ord = 1 AND page_index = 1"""))
def annotation_edits(spark, sf_dir):
    """Seeds with a table of edits applied: kept, deleted, moved and added items."""
    items = _items(spark, sf_dir)
    action = F.when(F.col("ord") % 5 == 0, "delete").when(F.col("ord") % 5 == 1, "modify")
    moved = F.when(action == "modify", F.struct((F.col("x0") + 5).alias("x0"), *(F.col(x) for x in c.CORNERS[1:])))
    edits = items.select("doc_no", "item_id", action.alias("action"), moved.alias("bbox")).where("action is not null")
    corner = F.struct(*(F.lit(float(v)).alias(x) for x, v in zip(c.CORNERS, (0, 0, 10, 10), strict=True)))
    new = items.where("ord = 1 and page_index = 1").select("doc_no", F.concat(F.lit("added_"), F.col("item_id")).alias("item_id"), F.lit("add").alias("action"), corner.alias("bbox"))
    return a.edited(items, edits.unionByName(new), ["doc_no", "item_id"])


@query(c.sql("b", "SELECT doc_no, count(*) AS items, count(*) FILTER (WHERE type = 'figure') AS figures, count(*) FILTER (WHERE type = 'table') AS tables, count(*) FILTER (WHERE score > 0.8) AS sure FROM b GROUP BY ROLLUP (doc_no)"))
def report_rollup(spark, sf_dir):
    """Counts of each document and, with a null document, of all."""
    n = lambda cond: F.count_if(cond)
    return c.boxes(spark, sf_dir).rollup("doc_no").agg(
        F.count("*").alias("items"), n(F.col("type") == "figure").alias("figures"), n(F.col("type") == "table").alias("tables"), n(F.col("score") > 0.8).alias("sure")
    )


@query(c.sql("b", "SELECT doc_no, page_index, ord, type, 1 AS part FROM b WHERE type = 'figure' UNION ALL SELECT doc_no, page_index, ord, type, 2 FROM b WHERE type = 'table'"))
def union_items(spark, sf_dir):
    """Figures, then tables."""
    rows = c.boxes(spark, sf_dir)
    part = lambda kind, k: rows.where(F.col("type") == kind).select(*c.PAGE, "ord", "type", F.lit(k).alias("part"))
    return part("figure", 1).unionByName(part("table", 2))


@query(c.sql("b", "SELECT doc_no, page_index, ord, type, row_number() OVER (PARTITION BY doc_no, page_index, type ORDER BY y0, x0, ord) - 1 AS item_index FROM b"))
def item_index(spark, sf_dir):
    w = Window.partitionBy(*c.PAGE, "type").orderBy("y0", "x0", "ord")
    return c.boxes(spark, sf_dir).select(*c.PAGE, "ord", "type", (F.row_number().over(w) - 1).cast("long").alias("item_index"))


@query("SELECT page_id, substring(sha256(html), 1, 12) AS doc_id, length(html) AS n_chars FROM pages")
def content_ids(spark, sf_dir):
    """Ids of documents by their content."""
    return a.content_ids(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html").select("page_id", "doc_id", F.length("html").cast("long").alias("n_chars"))


@query("SELECT doc_id, row_no, col_no, cell FROM (SELECT doc_id, row_no, unnest(string_split(line, ' ')) AS cell, generate_subscripts(string_split(line, ' '), 1) - 1 AS col_no FROM (SELECT doc_id, unnest(string_split(text, chr(10)))AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row_no FROM documents)) WHERE cell <> ''")
def table_cells(spark, sf_dir):
    """Grids of cells in long form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grid = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return a.cells(docs.select("doc_id", grid.alias("grid")), "doc_id").where("cell <> ''").select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "cell")
