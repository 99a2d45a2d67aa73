"""Encoding and decoding of whole tables by a SentencePiece model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.piece_model import SPACE, PieceModel
from leafgrid.llm.store import small_batches

_loaded: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of this worker process for a file."""
    if path not in _loaded:
        _loaded[path] = PieceModel.load(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text has no ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in textnum.by_size(batch, "text", 1 << 19):
                ids = [x.astype("int32") for x in own.encode_all(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _slim(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""
    small_batches(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [own.restored(b"".join([own.bytes_of[i] for i in ids or []])) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def coding_report(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32 and round_trip of every row.

    round_trip: the decoded ids are the text, U+2581 read as a space. A null or empty
    text has no ids and comes back empty; repeated rows are coded each; no rows give no
    rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for part in textnum.by_size(batch, "text", 1 << 19):
                rows = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for text, ids in zip(texts, own.encode_all(texts), strict=True):
                    rows.append((len(text), len(ids), zlib.crc32(ids.tobytes()), own.decode(ids) == text.replace(SPACE, " ")))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))],
                    names=["doc_id", "n_chars", "n_ids", "ids_crc32", "round_trip"],
                )

    return _slim(docs).mapInArrow(run, "doc_id long, n_chars long, n_ids long, ids_crc32 long, round_trip boolean")


def op10_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return coding_report(docs, public_tokenizers.path("piece_bpe_32k.model"))
