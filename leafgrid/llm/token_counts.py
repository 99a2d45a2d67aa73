"""Token counts: additive totals by source, language and tokenizer version, kept up by deltas.

A ledger is a folder. ``log`` holds one small file for each version, which names the batch
that made it and the folder of its totals. A commit sums a batch's signed changes and the
totals of the last version, writes them aside and then publishes the next file of the log in
one step that fails if another writer was first; it then starts again from that version. A batch
that the log names already changes nothing, so that a repeated or retried commit is safe.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.bpe_ids import encoder
from leafgrid.llm.store import drop_path, fresh_path, keep, small_batches

GROUP = ("source", "lang", "version")
_TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"


def counted(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """doc_id, source, lang, version and n_tokens of every row; a null text has no tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            for part in textnum.by_size(batch, "text"):
                n = [len(own.ids(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    out = slim.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")
    return out.select("doc_id", "source", "lang", F.lit(version).alias("version"), "n_tokens")


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add counted rows."""
    return rows.select("doc_id", *GROUP, F.lit(None).cast("long").alias("old_tokens"), F.col("n_tokens").alias("new_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take counted rows away."""
    return rows.select("doc_id", *GROUP, F.col("n_tokens").alias("old_tokens"), F.lit(None).cast("long").alias("new_tokens"))


def revisions(rows: DataFrame, new_tokens) -> DataFrame:
    """Changes of the counts of rows that stay."""
    return rows.select("doc_id", *GROUP, F.col("n_tokens").alias("old_tokens"), new_tokens.cast("long").alias("new_tokens"))


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums of changes: a null old count is an insert, a null new count a delete, both null nothing."""
    here = lambda c: F.col(c).isNotNull().cast("long")
    return changes.groupBy(*GROUP).agg(
        F.sum(here("new_tokens") - here("old_tokens")).alias("n_docs"),
        F.sum(F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).cast("long").alias("n_tokens"),
    )


_LOG = "batch string, totals string"


class Ledger:
    """Totals by source, lang and version in a folder that all executors share.

    The folder must be on a file system that renames in one step: a local or mounted one, or HDFS.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last version; 0 before any commit."""
        log = self._at(f"{self.path}/log")
        if not self._fs.exists(log):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _log(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(_LOG).json(f"{self.path}/log" if version is None else f"{self.path}/log/{version:020d}.json")

    def _totals(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], _TOTALS)
        return self.spark.read.schema(_TOTALS).parquet(f"{self.path}/totals/{self._log(version).first()['totals']}")

    def totals(self) -> DataFrame:
        """Groups with a document or a token."""
        return self._totals(self.version())

    def batches(self) -> DataFrame:
        """The batches that the totals hold."""
        return self._log().select("batch") if self.version() else self.spark.createDataFrame([], "batch string")

    def _publish(self, version: int, record: dict) -> bool:
        """Make the file of a version in one step; False if there is one."""
        to = f"{self.path}/log/{version:020d}.json"
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        out = self._fs.create(self._at(aside), False)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self._fs.mkdirs(self._at(f"{self.path}/log"))
        try:
            if self._fs.getScheme() == "file":
                os.link(_local(aside), _local(to))
            else:
                none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                kinds = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                kinds[0] = none
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(self._at(aside), self._at(to), kinds)
            return True
        except Exception:
            if self._fs.exists(self._at(to)):
                return False
            raise
        finally:
            self._fs.delete(self._at(aside), False)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False if the totals have it already.

        Changes hold GROUP, old_tokens and new_tokens: see ``delta`` for nulls in the counts; a null
        source, lang or version is a group of its own; equal changes count each; no changes make a
        version of the same totals.
        """
        added: DataFrame | None = None
        while True:
            now = self.version()
            if not self.batches().where(F.col("batch") == batch).isEmpty():
                return False
            added = keep(delta(changes), "delta") if added is None else added
            both = self._totals(now).unionByName(added)
            summed = both.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            name = uuid.uuid4().hex
            summed.where("n_docs <> 0 or n_tokens <> 0").coalesce(1).write.parquet(f"{self.path}/totals/{name}")
            if self._publish(now + 1, {"batch": batch, "totals": name}):
                return True
            drop_path(self.spark, f"{self.path}/totals/{name}")


def _local(path: str) -> Path:
    return Path(unquote(urlparse(path).path) if path.startswith("file:") else path)


def rolled_up(totals: DataFrame) -> DataFrame:
    """The totals with sums over lang, over source and over all; ``level`` counts the columns summed over."""
    out = totals.rollup("version", "source", "lang").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().alias("g"))
    level = F.bit_count("g").cast("int")
    return out.select("version", "source", "lang", level.alias("level"), "n_docs", "n_tokens")


def maintained(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """Totals of a table, with an end id for every document, after four batches, each committed twice:
    all rows inserted; the end id added to every count; rows without any text deleted, and inserted again.

    Null sources and languages are groups of their own; a null or empty text counts its end id;
    repeated rows count each; an empty table gives no groups; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = keep(counted(docs, vocabulary, version), "token-counts")
    ledger = Ledger(spark, fresh_path(spark, "ledger"))
    with_end = rows.withColumn("n_tokens", F.col("n_tokens") + 1)
    empty = with_end.where("n_tokens = 1")
    for name, changes in (("load", inserts(rows)), ("end-ids", revisions(rows, F.col("n_tokens") + 1)), ("withdraw-empty", deletes(empty)), ("return-empty", inserts(empty))):
        ledger.commit(name, changes)
        ledger.commit(name, changes)
    return rolled_up(ledger.totals())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents, an end id each, by source and language."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return maintained(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k")
