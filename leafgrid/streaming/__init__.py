"""Manifests as a stream: items of each document, once, as files arrive.

The work on a document needs nothing of other documents, so that a stream of files is
the batch query with a source that grows. State is kept for repeated ids alone, and
only within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.sources.items import items_of

SCHEMA = "doc_id string, created_at timestamp, manifest string"


def manifests(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Manifest files (JSON lines) of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def items(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Items of each manifest; a document that comes again within ``late`` is left out."""
    once = stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["doc_id"])
    return items_of(once)


def counts(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Items by type and window of their manifest's time."""
    rows = items(stream, late)
    return rows.groupBy(F.window("created_at", window), "type").agg(F.count("*").alias("n"))
