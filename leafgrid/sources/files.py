"""Files in and out: JSON, CSV and packages of a document's items, written by executors side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.functions.geometry import Box

VERSION = "leafgrid-v1"
TRACE = ("Extracted from PDF", "Aligned Caption", "Enriched with AI")


def write_json(rows: DataFrame, path: str, by: list[str] | None = None, compression: str = "none") -> None:
    """Rows as JSON lines, in folders by the columns ``by``; readers see by a file's name how it is compressed."""
    (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").json(path, compression=compression)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; fields that a line lacks are null."""
    return spark.read.schema(schema).json(path)


def write_csv(rows: DataFrame, path: str, header: bool = False) -> None:
    rows.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("escape", '"').csv(path)


def csv_text(grid: Column) -> Column:
    """A grid of cells as CSV without a header: cells with a comma, a quote or a line end are quoted, null ones are empty."""
    quoted = lambda c: F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = lambda row: F.array_join(F.transform(row, lambda c: quoted(F.coalesce(c, F.lit("")))), ",")
    return F.concat(F.array_join(F.transform(grid, line), "\n"), F.lit("\n"))


def manifests(items: DataFrame, doc: str, source: Column, capabilities: dict[str, bool]) -> DataFrame:
    """One manifest a document: meta, capabilities and its items in the order of their ids. ``source`` is a column of items.

    What an item does not say is empty or unknown. The time of writing is left to the sink.
    """
    known = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c) if c in items.columns else F.lit(default).alias(c)
    item = F.struct("item_id", "type", known("subtype", "unknown"), "page_index", F.array(*Box._fields).alias("bbox"), known("caption", ""), known("evidence_snippet", ""))
    meta = F.struct(F.lit(VERSION).alias("version"), F.col(doc).cast("string").alias("doc_id"), F.col("source").alias("source_pdf"), F.lit("heuristic alignment").alias("note"))
    able = F.struct(*(F.lit(v).alias(k) for k, v in capabilities.items()))
    grouped = items.withColumn("source", source).groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("items"), F.min("source").alias("source"))
    return grouped.select(doc, meta.alias("meta"), able.alias("capabilities"), "items")


def evidence(items: DataFrame, doc: str) -> DataFrame:
    """What each item rests on: page, box, caption and its box, snippet, and the steps that made it."""
    known = lambda c, kind: F.col(c) if c in items.columns else F.lit(None).cast(kind)
    return items.select(
        doc, "item_id", "page_index", F.array(*Box._fields).alias("bbox"), F.coalesce(known("caption", "string"), F.lit("")).alias("caption_text"),
        known("caption_bbox", "array<double>").alias("caption_bbox"), F.coalesce(known("evidence_snippet", "string"), F.lit("")).alias("snippet_text"), F.array(*map(F.lit, TRACE)).alias("extraction_trace"),
    )


def params(items: DataFrame, doc: str, zoom: float, engine: str = "baseline") -> DataFrame:
    return items.select(doc, "item_id", F.struct(F.lit(zoom).alias("zoom"), F.lit(engine).alias("engine")).alias("extraction_config"))


def write_package(items: DataFrame, doc: str, source: Column, folder: str, capabilities: dict[str, bool], zoom: float = 2.0) -> None:
    """Manifests by document, evidence and parameters by document and item, as JSON under ``folder``."""
    stamped = manifests(items, doc, source, capabilities).withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    write_json(stamped, f"{folder}/manifest", [doc])
    write_json(evidence(items, doc), f"{folder}/evidence", [doc, "item_id"])
    write_json(params(items, doc, zoom), f"{folder}/params", [doc, "item_id"])


def read_items(spark: SparkSession, folder: str, doc: str, kind: str = "string") -> DataFrame:
    """The items of all manifests under a package folder; documents without a manifest are not there."""
    item = "item_id: string, type: string, subtype: string, page_index: int, bbox: array<double>, caption: string, evidence_snippet: string"
    found = spark.read.schema(f"{doc} {kind}, items array<struct<{item}>>").option("basePath", f"{folder}/manifest").json(f"{folder}/manifest")
    return found.select(doc, F.explode("items").alias("i")).select(doc, "i.*")


def documents(spark: SparkSession, pattern: str, read: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of files: doc_id (the first twelve hex digits of the SHA-256 of the content), path, and what ``read`` makes of
    the content, one dict for each row of ``schema``. A file that cannot be read gives one row with ``error`` and nulls."""
    files = spark.read.format("binaryFile").load(pattern)
    rows = files.select(F.substring(F.sha2("content", 256), 1, 12).alias("doc_id"), "path", "content")
    return hooked(rows, ["doc_id", "path"], "content", read, schema)


def hooked(rows: DataFrame, key: list[str], column: str, run: Callable, schema: str) -> DataFrame:
    """Key and the rows that a user's function makes of each value of a column, as dicts; ``error`` where it raised.

    The hook for readers of documents, recognisers of text, detectors and classifiers: whatever it
    loads, it loads once for each task, at its first call there. A value it makes no row of has none.
    """
    from pyspark.sql.types import StructType

    types = dict(rows.dtypes)
    made = StructType.fromDDL(schema)
    names = [f.name for f in made.fields]
    full = ", ".join([*(f"{k} {types[k]}" for k in key), *schema.split(", "), "error string"]) if schema else ", ".join(f"{k} {types[k]}" for k in key) + ", error string"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in made.fields]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, out, errors = [], [], []
            for i, value in enumerate(batch.column(column).to_pylist()):
                try:
                    got, error = list(run(value)), None
                except Exception as e:  # a broken document must not end the job
                    got, error = [{}], f"{type(e).__name__}: {e}"[:500]
                for r in got:
                    place.append(i)
                    out.append(r)
                    errors.append(error)
            at = pa.array(place, pa.int64())
            cols = [*(batch.column(k).take(at) for k in key), *(pa.array([r.get(n) for r in out], t) for n, t in zip(names, arrow, strict=True)), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*key, *names, "error"])

    return rows.select(*key, column).mapInArrow(stream, full)


def capable(modules: dict[str, str]) -> dict[str, bool]:
    """Which optional modules the driver can import, by the name of what they give."""
    import importlib.util

    return {name: importlib.util.find_spec(module) is not None for name, module in modules.items()}
