"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

Each block is article (1) or not (0). Features are the tags and names above a block and
the shape of its text. The field is trained on labelled pages of many layouts, by
stochastic gradients of the conditional likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.html_blocks import Block, Node, blocks
from leafgrid.llm.html_training import labelled_page
from leafgrid.llm.store import small_batches

PAGES, EPOCHS = 1000, 6
RATE, DECAY = 0.3, 1e-4


def node_features(node: Node) -> list[str]:
    """What a node above a block says."""
    return [f"tag={node.tag}", *(f"name={n}" for n in node.names), *(f"stem={n[:4]}" for n in node.names)]


def own_features(found: list[Block]) -> list[set[str]]:
    """What is known of each block but for the nodes above it: its shape, the tags beside it and its place."""
    out = []
    for k, b in enumerate(found):
        words = b.text.count(" ") + 1
        share = b.in_links / max(1, len(b.text))
        own = {
            "bias", f"last={b.last}", f"words={min(words.bit_length(), 7)}", f"linked={0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
            f"stop={b.text[-1] in '.!?…'}", f"marks={min(3, b.text.count(',') + b.text.count('. '))}",
            f"before={found[k - 1].last if k else None}", f"after={found[k + 1].last if k + 1 < len(found) else None}",
        }
        if words >= 20 and share < 0.3:
            own |= {"prose", f"prose in {b.last}", f"prose before {found[k - 1].last if k else None} after {found[k + 1].last if k + 1 < len(found) else None}"}
        if "©" in b.text or "copyright" in b.text[:40].lower():
            own.add("copyright")
        out.append(own)
    if out:
        out[0].add("first prose" if "prose" in out[0] else "first")
        out[-1].add("end prose" if "prose" in out[-1] else "end")
    return out


def features(found: list[Block]) -> list[set[str]]:
    """All features of each block."""
    return [own | {f for n in b.path() for f in node_features(n)} for own, b in zip(own_features(found), found, strict=True)]


@dataclass
class Field:
    """Weights of features and of transitions between labels; start is a transition from 0."""

    index: dict[str, int]
    weights: np.ndarray  # (features, 2)
    moves: np.ndarray  # (2, 2)

    def emissions(self, own: list[set[str]]) -> np.ndarray:
        get = self.index.get
        return np.array([self.weights[[i for f in x if (i := get(f)) is not None]].sum(axis=0) for x in own]).reshape(-1, 2)

    def of_page(self, found: list[Block]) -> np.ndarray:
        """Emissions of all features of the blocks of a page: from block to block only the nodes between them are looked at."""
        out = self.emissions(own_features(found))
        get, weights = self.index.get, self.pairs
        path: list[tuple[Node, list[int]]] = []
        counts: dict[int, int] = {}
        w0 = w1 = 0.0
        for k, b in enumerate(found):
            fresh, at = [], b.node
            while at is not None and not (at.depth < len(path) and path[at.depth][0] is at):
                fresh.append(at)
                at = at.above
            while len(path) > (at.depth + 1 if at else 0):
                for i in path.pop()[1]:
                    counts[i] -= 1
                    if not counts[i]:
                        w0, w1 = w0 - weights[i][0], w1 - weights[i][1]
            for node in reversed(fresh):
                known = [i for f in node_features(node) if (i := get(f)) is not None]
                for i in known:
                    counts[i] = counts.get(i, 0) + 1
                    if counts[i] == 1:
                        w0, w1 = w0 + weights[i][0], w1 + weights[i][1]
                path.append((node, known))
            out[k] += (w0, w1)
        return out

    @property
    def pairs(self) -> list[list[float]]:
        if "_pairs" not in self.__dict__:
            self._pairs = self.weights.tolist()
        return self._pairs

    def decode(self, own: list[set[str]]) -> list[int]:
        """The most likely labels of blocks with these features."""
        return self.viterbi(self.emissions(own))

    def viterbi(self, emissions: np.ndarray) -> list[int]:
        """The most likely labels; of ties the lower label."""
        e = emissions.tolist()
        if not e:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = m00 + e[0][0], m01 + e[0][1]
        back = []
        for e0, e1 in e[1:]:
            to0, to1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            back.append((int(to0), int(to1)))
            s0, s1 = (s1 + m10 if to0 else s0 + m00) + e0, (s1 + m11 if to1 else s0 + m01) + e1
        at = int(s1 > s0)
        out = [at]
        for b in reversed(back):
            at = b[at]
            out.append(at)
        return out[::-1]


def marginals(emissions: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each block and the summed P(label, next label), by forward and backward sums."""
    n = len(emissions)
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    m = np.exp(moves)
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    for k in range(n):
        x = (m[0] if k == 0 else f[k - 1] @ m) * e[k]
        f[k] = x / x.sum()
    for k in range(n - 2, -1, -1):
        x = m @ (e[k + 1] * b[k + 1])
        b[k] = x / x.sum()
    p = f * b
    p /= p.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for k in range(n - 1):
        x = f[k][:, None] * m * (e[k + 1] * b[k + 1])[None, :]
        pairs += x / x.sum()
    pairs[0] += p[0]  # the start
    return p, pairs


def labelled(seed: int) -> tuple[list[set[str]], list[int]]:
    """Features and labels of the blocks of one labelled page."""
    parts = labelled_page(seed)
    found = blocks("".join(t for t, _ in parts))
    labels: list[int] = []
    before = 0
    page = ""
    for text, label in parts:
        page += text
        now = len(blocks(page))
        labels += [label] * (now - before)
        before = now
    return features(found), labels[: len(found)]


def train(pages: int = PAGES, epochs: int = EPOCHS, first_seed: int = 0) -> Field:
    """The field learned from that many labelled pages."""
    data = [x for x in (labelled(first_seed + k) for k in range(pages)) if x[0]]
    index: dict[str, int] = {}
    for own, _ in data:
        for x in own:
            for f in sorted(x):
                index.setdefault(f, len(index))
    rows = [[np.array([index[f] for f in x]) for x in own] for own, _ in data]
    field = Field(index, np.zeros((len(index), 2)), np.zeros((2, 2)))
    seen_w, seen_m = np.full((len(index), 2), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for d in rng.permutation(len(data)):
            ids, labels = rows[d], data[d][1]
            e = np.array([field.weights[i].sum(axis=0) for i in ids])
            p, pairs = marginals(e, field.moves)
            truth = np.eye(2)[labels]
            seen = np.zeros((2, 2))
            np.add.at(seen, ([0, *labels[:-1]], labels), 1)
            flat = np.concatenate(ids)
            slope = np.repeat(truth - p, [len(i) for i in ids], axis=0)
            step = np.zeros_like(field.weights)
            np.add.at(step, flat, slope)
            step -= DECAY * field.weights
            seen_w += step**2
            field.weights += RATE * step / np.sqrt(seen_w)
            step = seen - pairs - DECAY * field.moves
            seen_m += step**2
            field.moves += RATE * step / np.sqrt(seen_m)
    return field


@lru_cache(maxsize=1)
def trained() -> Field:
    return train()


def main_text(page: str | None, field: Field) -> str:
    """The blocks of the article, joined by an empty line."""
    found = blocks(page)
    return "\n\n".join(b.text for b, y in zip(found, field.viterbi(field.of_page(found)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null page is empty; an empty page, and one without an article, has an empty text;
    repeated rows are worked on each; no rows give no rows; further columns are ignored.
    """
    small_batches(pages.sparkSession)
    field = field or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.by_size(batch, "html"):
                texts = [main_text(h, field) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
