"""Items in and out: ids, manifests, annotations, cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgrid.functions.geometry import Box

ITEM = "item_id string, type string, subtype string, page_index int, bbox array<double>, caption string"


def content_ids(files: DataFrame, content: str) -> DataFrame:
    """The first twelve hex digits of the SHA-256 of each content as ``doc_id``."""
    return files.withColumn("doc_id", F.substring(F.sha2(F.col(content).cast("binary"), 256), 1, 12))


def with_ids(rows: DataFrame, doc: str, order: list[str]) -> DataFrame:
    """``item_id`` by type and place in the document: fig_0001, table_0001 and so on."""
    place = F.row_number().over(Window.partitionBy(doc, "type").orderBy(*order))
    return rows.withColumn("item_id", F.format_string("%s_%04d", F.when(F.col("type") == "figure", "fig").otherwise("table"), place))


def manifests(items: DataFrame, doc: str) -> DataFrame:
    """One JSON manifest a document, its items in the order of their ids; what is not known is empty or unknown."""
    known = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in items.columns else F.lit(default)
    item = F.struct("item_id", "type", known("subtype", "unknown").alias("subtype"), "page_index", F.array(*Box._fields).alias("bbox"), known("caption", "").alias("caption"))
    return items.groupBy(doc).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("manifest"))


def items_of(manifest: DataFrame) -> DataFrame:
    """The items of manifests as rows."""
    parsed = F.from_json("manifest", f"items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")
    others = [c for c in manifest.columns if c != "manifest"]
    return manifest.select(*others, F.explode(parsed["items"]).alias("i")).select(*others, "i.*")


def seeds(items: DataFrame) -> DataFrame:
    """Items as annotations that nobody has looked at."""
    return items.withColumn("verified", F.lit(False)).withColumn("action", F.lit("keep"))


def stats(annotations: DataFrame, doc: str) -> DataFrame:
    """Counts of the annotations of each document that are not deleted."""
    n = F.count_if
    action = F.col("action")
    return annotations.where(action != "delete").groupBy(doc).agg(
        F.count("*").alias("total_items"), n(F.col("type") == "figure").alias("figures"), n(F.col("type") == "table").alias("tables"),
        n("verified").alias("verified"), n(action == "add").alias("added"), n(action == "modify").alias("modified"),
    )


def edited(items: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """Items with edits (key, action, bbox) applied: deleted ones go, modified ones move, added ones come."""
    own = items.select(*key, *Box._fields)
    change = edits.where("action <> 'add'").withColumnRenamed("bbox", "to")
    kept = own.join(change, key, "left").where("action is null or action <> 'delete'")
    moved = kept.select(*key, *(F.coalesce(f"to.{c}", c).alias(c) for c in Box._fields), F.coalesce("action", F.lit("keep")).alias("action"))
    new = edits.where("action = 'add'").select(*key, *(F.col(f"bbox.{c}").alias(c) for c in Box._fields), "action")
    return moved.unionByName(new)


def cells(tables: DataFrame, key: str) -> DataFrame:
    """Grids (array of rows of cells) in long form, rows and columns from 0."""
    rows = tables.select(key, F.posexplode("grid").alias("row_no", "row"))
    return rows.select(key, "row_no", F.posexplode("row").alias("col_no", "cell"))


def scanned(docs: DataFrame, items: DataFrame, doc: str) -> DataFrame:
    """Documents and ``has_manifest``: whether any item of theirs is there."""
    there = items.select(doc).distinct().withColumn("has_manifest", F.lit(True))
    return docs.join(there, doc, "left").select(doc, F.coalesce("has_manifest", F.lit(False)).alias("has_manifest"))


def with_manual(items: DataFrame, added: DataFrame, doc: str, width, height) -> DataFrame:
    """Items and those that users add (corners, page_index, and n: how many items their document has), cut to the page and numbered on."""
    from leafgrid.functions import geometry as g

    own = items.select(doc, "item_id", "page_index", *Box._fields, F.lit("extracted").alias("source"))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("page_index", *Box._fields)) + F.col("n")
    new = added.withColumn("item_id", F.format_string("manual_%04d", place.cast("long")))
    return own.unionByName(new.select(doc, "item_id", "page_index", *g.clamp(Box.of(), width, height).named(), F.lit("manual").alias("source")))


def renamed(paths, old, new):
    """A map of paths with an item's old id replaced by its new one."""
    return F.transform_values(paths, lambda _, v: F.replace(v, old, new))


def table_items(tables: DataFrame, score, source, strategy, zoom: float) -> DataFrame:
    """Tables (item_id, page_index, corners, row_count, col_count) as items, with their box on the page's own scale and the paths of their files."""
    path = lambda name: F.concat(F.lit("items/"), F.col("item_id"), F.lit("/" + name))
    return tables.select(
        *[c for c in tables.columns if c not in ("type", "subtype", "score", "detector")], F.lit("table").alias("type"), F.lit("table").alias("subtype"),
        F.struct(*((F.col(c) / zoom).alias(c) for c in Box._fields)).alias("pdf_bbox"), score.alias("detection_score"), source.alias("detection_source"), strategy.alias("extraction_strategy"),
        F.create_map(F.lit("table_csv"), path("table.csv"), F.lit("preview_png"), path("preview.png")).alias("artifacts"),
    )
