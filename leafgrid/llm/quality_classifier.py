"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text is the set of its n-grams of one to four bytes, and of one to four words that are
told apart only as new, as the word before, or as the word before that; all hashed. Each
indicator is scaled by the log ratio of its smoothed shares in the two classes, each text
scaled to length one, and a linear hinge loss fitted by dual coordinate descent. The
model learns from a bounded sample of labelled texts; every text is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.store import small_batches

ORDERS = (1, 2, 3, 4)
FEATURES = 1 << 16
#: Labelled texts that a model learns from at most, those of the least hash.
MOST_LABELLED = 4_000
FOLDS, HELD_FOLD = 3, 1
COST = 1.0
EPOCHS = 30
#: Bytes of a text that are hashed at once.
SLICE = 1 << 20


def _bucket(grams: np.ndarray, kind: int) -> np.ndarray:
    return ((grams + np.uint64(kind << 33)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)


def indicators(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ascending numbers of the features that a text has, given by its bytes and the hashes of its words."""
    seen = np.zeros(FEATURES, bool)
    news = np.zeros(len(words), np.uint64)
    news[2:][words[2:] == words[:-2]] = 2
    news[1:][words[1:] == words[:-1]] = 1
    for k in ORDERS:
        if len(news) >= k:
            seen[_bucket(sum(news[i : len(news) - k + 1 + i] * np.uint64(3**i) for i in range(k)), 8 + k)] = True
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE + max(ORDERS) - 1]
        padded = np.zeros(len(part) + 8, np.uint8)
        padded[: len(part)] = part
        fours = np.ndarray((len(part),), "<u4", padded, strides=(1,)).astype(np.uint64)
        for k in ORDERS:
            if len(part) >= k:
                gram = fours[: len(part) - k + 1] & np.uint64((1 << 8 * k) - 1)
                seen[_bucket(gram, k)] = True
    return np.flatnonzero(seen)


def featured(texts: pa.Array) -> Iterator[np.ndarray]:
    """The features of each text."""
    data, offsets = textnum.raw(texts)
    words, _, bounds = textnum.words(texts)
    for i in range(len(texts)):
        yield indicators(data[offsets[i] : offsets[i + 1]], words[bounds[i] : bounds[i + 1]])


@dataclass(frozen=True)
class Model:
    """Margin of a text: (ratios * weights) summed over its features by its length, plus bias."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def score(self, features: np.ndarray) -> float:
        """Chance-like score between 0 and 1; at least a half if the margin is not negative."""
        if self.constant is not None:
            return self.constant
        r = self.ratios[features]
        length = float(np.sqrt(r @ r)) or 1.0
        margin = float(r @ self.weights[features]) / length + self.bias
        return float(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30))))


def squeezed(features: np.ndarray) -> bytes:
    """Ascending features as two bytes each, or as one bit of each possible one if that is not longer: 8 KB at most."""
    if 2 * len(features) < FEATURES // 8:
        return features.astype("<u2").tobytes()
    seen = np.zeros(FEATURES, bool)
    seen[features] = True
    return np.packbits(seen).tobytes()


class Squeezed(Sequence):
    """The features of texts, held as ``squeezed`` and made one by one."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.blobs = blobs

    def __len__(self) -> int:
        return len(self.blobs)

    def __getitem__(self, i: int) -> np.ndarray:
        blob = self.blobs[i]
        if len(blob) == FEATURES // 8:
            return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8)).view(bool))
        return np.frombuffer(blob, "<u2").astype(np.int64)


def fit(rows: Sequence[np.ndarray], labels: list[int], cost: float = COST, epochs: int = EPOCHS) -> Model:
    """The model of texts given by their features; one class alone gives a constant score."""
    y = np.where(np.array(labels) == 1, 1.0, -1.0) if labels else np.zeros(0)
    if not len(y) or abs(y.sum()) == len(y):
        return Model(np.zeros(0), np.zeros(0), 0.0, 0.5 if not len(y) else float(y[0] > 0))
    shares = {}
    for sign in (1.0, -1.0):
        counts = np.ones(FEATURES)
        for f, s in zip(rows, y, strict=True):
            if s == sign:
                counts[f] += 1
        shares[sign] = counts / counts.sum()
    ratios = np.log(shares[1.0] / shares[-1.0])
    weights, bias = np.zeros(FEATURES), 0.0
    # texts are scaled when they are met, as all of them would fill the driver's memory
    lengths = [float(np.sqrt(x @ x)) or 1.0 for x in (ratios[f] for f in rows)]
    square = np.array([x @ x + 1.0 for x in (ratios[f] / n for f, n in zip(rows, lengths, strict=True))])
    alpha = np.zeros(len(y))
    order, rng = np.arange(len(y)), np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order:
            f = rows[i]
            x = ratios[f] / lengths[i]
            slope = y[i] * (x @ weights[f] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[f] += step * x
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return Model(ratios, weights, float(bias))


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_FOLD):
    """True for documents whose labels are not learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [squeezed(x) for part in textnum.by_size(batch, "text") for x in featured(part.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "features"])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model of the labelled rows that are not held out, those of the least hash.

    Labels that are null or that disagree for one doc_id are left out.
    """
    small_batches(docs.sparkSession)
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `most` rows of at most FEATURES / 8 bytes
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").mapInArrow(_featured, "doc_id long, label int, features binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["features"])))
    return fit(Squeezed([bytes(r["features"]) for r in rows]), [r["label"] for r in rows])


def _scores(batch: pa.RecordBatch, model: Model) -> list[float]:
    out = []
    for part in textnum.by_size(batch, "text"):
        out += [model.score(x) for x in featured(part.column("text"))]
    return out


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null text counts as empty, and an empty text gets the score of the bias; repeated
    rows are scored one by one; no rows give no rows; further columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch, model), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model takes for good, with the columns they came with.

    A null or empty text has the score of the bias; a null doc_id does not matter; repeated rows are
    scored one by one; no rows give no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s >= 0.5 for s in _scores(batch, model)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score for quality."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, learn(docs, labels))
