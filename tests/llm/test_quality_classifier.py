import random

import numpy as np
from llm_words import words

from leafgrid.llm import quality_classifier as c


def tables(spark):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        good = k % 4 != 0
        text = words(k, r.randint(20, 80))
        rows.append((k, text if good else " ".join(w + r.choice(["###", "&&&", "!!"]) for w in text.split())))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_folds(spark):
    import zlib

    docs, labels = tables(spark)
    out = c.classify(docs, c.learn(docs, labels)).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_learned_from(spark):
    from pyspark.sql import functions as F

    docs, labels = tables(spark)
    flipped = labels.withColumn("quality", F.when(c.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = c.learn(docs, labels), c.learn(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_dual_coordinate_descent_meets_the_margin_conditions():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 12)) for _ in range(60)]
    y = [int(5 in f) for f in rows]
    m = c.fit(rows, y, cost=100.0, epochs=400)
    assert all((m.score(f) >= 0.5) == bool(t) for f, t in zip(rows, y, strict=True))


def test_ratios_and_optimum_by_brute_force():
    """Ratios by counting; the fitted loss is that of the dual problem solved by projected gradients."""
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, rng.integers(3, 15))) for _ in range(50)]
    labels = [int(rng.random() < (0.8 if 3 in f or 7 in f else 0.3)) for f in rows]
    cost = 0.7
    m = c.fit(rows, labels, cost=cost, epochs=3000)
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    shares = []
    for sign in (1, -1):
        n = [1 + sum(k in f for f, s in zip(rows, y, strict=True) if s == sign) for k in range(c.FEATURES)]
        shares.append(np.array(n) / sum(n))
    assert np.allclose(m.ratios, np.log(shares[0] / shares[1]))
    x = np.zeros((len(rows), 41))
    for i, f in enumerate(rows):
        x[i, f] = m.ratios[f]
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    x[:, 40] = 1  # the bias
    q = (x @ x.T) * np.outer(y, y)
    a = np.zeros(len(y))
    for _ in range(60_000):
        a = np.clip(a - (q @ a - 1) / np.linalg.norm(q, 2), 0, cost)
    dual = a.sum() - 0.5 * a @ q @ a
    w = np.append(m.weights[:40], m.bias)
    primal = 0.5 * w @ w + cost * np.maximum(0, 1 - y * (x @ w)).sum()
    assert dual <= primal <= dual * 1.002
    margins = x @ w
    assert np.allclose([m.score(f) for f in rows], 1 / (1 + np.exp(-2 * margins)))


def test_indicators_are_the_grams_of_bytes_and_of_repeats():
    from leafgrid.llm import textnum
    import pyarrow as pa

    text = "ab a a b ab"
    data, _ = textnum.raw(pa.array([text]))
    hashes, _, _ = textnum.words(pa.array([text]))
    got = set(c.indicators(data, hashes).tolist())
    raw, w = text.encode(), text.split()
    new = [1 if k and w[k] == w[k - 1] else 2 if k > 1 and w[k] == w[k - 2] else 0 for k in range(len(w))]
    bucket = lambda gram, kind: ((gram + (kind << 33)) * 0x9E3779B97F4A7C15 % 2**64) >> 48
    want = {bucket(int.from_bytes(raw[i : i + n], "little"), n) for n in (1, 2, 3, 4) for i in range(len(raw) - n + 1)}
    want |= {bucket(sum(new[i + j] * 3**j for j in range(n)), 8 + n) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)}
    assert got == want


def test_odd_tables(spark, odd_docs, no_docs):
    docs, labels = tables(spark)
    model = c.learn(docs, labels)
    assert c.classify(odd_docs, model).count() == odd_docs.count()
    assert c.classify(no_docs, model).count() == 0
    assert c.keep_good(odd_docs, model).columns == odd_docs.columns
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in c.classify(odd_docs, c.learn(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, None), (None, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    assert {r.score for r in c.classify(odd_docs, c.learn(docs, one)).collect()} <= {0.5, 1.0}


def test_long_texts_do_not_fill_the_driver(spark, monkeypatch):
    """Features reach the driver in 8 KB a text at most, are held there as they come, and give the same model."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(c.FEATURES) < share) for share in (0.001, 0.06, 0.07, 0.5, 1.0, 0.0) * 4]
    blobs = [c.squeezed(f) for f in rows]
    assert max(map(len, blobs)) == c.FEATURES // 8
    held = c.Squeezed(blobs)
    assert len(held) == len(rows) and all(np.array_equal(a, b) for a, b in zip(held, rows, strict=True))
    labels = [k % 2 for k in range(len(rows))]
    a, b = c.fit(rows, labels), c.fit(held, labels)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias

    text = "".join(chr(int(x)) for x in rng.integers(33, 1000, 200_000))
    docs = spark.createDataFrame([(k, text[k:]) for k in range(12)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(c, "fit", lambda rows, labels: seen.extend(rows.blobs))
    c.learn(docs, spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int"))
    assert seen and all(len(x) == c.FEATURES // 8 for x in seen)
