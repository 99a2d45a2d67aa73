import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafgrid.llm import language_model as lm
from leafgrid.llm import messages, seating


def texts(n=160):
    """Texts in which a word says which words may follow, and some of them again."""
    r = random.Random(6)
    words = [f"w{k}{'aeiou'[k % 5]}" for k in range(80)] + [f"rare{k}s" for k in range(300)]
    after = {w: r.sample(words[:80], 6) + r.sample(words, 6) for w in [*words, ""]}
    out = []
    for k in range(n):
        w, text = "", []
        for _ in range(r.randint(0, 60)):
            w = r.choices(after[w], [1 / (i + 1) for i in range(12)])[0]
            text.append(w)
        out.append((k, " ".join(text)))
    return out


def cut(text):
    low = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
    return (text or "").encode().translate(low).split()


def learned(d):
    return d is None or zlib.crc32(str(d).encode()) % 5 != 1


@pytest.fixture(params=[(500_000, 4_000_000, 8), (40, 200, 3), (0, 300, 1)])
def sizes(request, monkeypatch):
    """Everything in few parts; many parts, split words and few frequent pairs; none at all."""
    for name, x in zip(("FREQUENT", "PART_TOKENS", "LEAST_PARTS"), request.param, strict=True):
        monkeypatch.setattr(lm, name, x)


def test_counts_base_and_gain(spark, sizes):
    rows = [*texts(), (1000, None), (1001, "A Ü ü a"), (None, "w1 w2"), (1001, "A Ü ü a")]
    out = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    tokens = [(d, cut(t) + [None]) for d, t in rows]
    counts = Counter(w for d, ws in tokens if learned(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = lambda ws: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    want = sorted((str(d), not learned(d), len(ws), sum(counts[w] > 0 for w in ws), n, round(base(ws), 6)) for d, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in out)


def scores(spark, rows):
    return {r.doc_id: r.score for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}


def test_scores_do_not_depend_on_settings(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(lm, "PART_TOKENS", 500)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        few = scores(spark, rows)
        spark.conf.set("spark.sql.shuffle.partitions", "19")
        assert scores(spark, rows) == pytest.approx(few, abs=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    monkeypatch.setattr(lm, "FREQUENT", 25)
    assert scores(spark, rows) == pytest.approx(few, abs=1e-9)


class Restaurant:
    """Customers of each dish at their tables, seated one by one; an independent reading of the model."""

    def __init__(self, parent, discount, strength):
        self.parent, self.d, self.s, self.at, self.n, self.t = parent, discount, strength, defaultdict(list), 0, 0

    def p(self, w):
        own = self.at.get(w, ())
        return (sum(own) - self.d * len(own) + (self.s + self.d * self.t) * self.parent.p(w)) / (self.s + self.n)

    def sit(self, w, r):
        own = self.at[w]
        weights = [x - self.d for x in own] + [(self.s + self.d * self.t) * self.parent.p(w)]
        k = r.choices(range(len(weights)), weights)[0]
        self.n += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            self.t += 1
            self.parent.sit(w, r)

    def leave(self, w, r):
        own = self.at[w]
        k = r.choices(range(len(own)), own)[0]
        own[k] -= 1
        self.n -= 1
        if not own[k]:
            del own[k]
            self.t -= 1
            self.parent.leave(w, r)


class Even:
    def __init__(self, n):
        self.n = n

    def p(self, w):
        return 1 / self.n

    def sit(self, w, r):
        pass

    leave = sit


def letter(w):
    if w is None:
        return ""
    w = w[:-1] if len(w) > 1 and w[-1:] in b".,;:!?" else w
    return w[-1:]


def test_scores_are_those_of_customers_seated_one_by_one(spark):
    rows = texts(120)
    model = lm.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    r = random.Random(1)
    train = [(b, w) for d, t in rows if learned(d) for b, w in zip([None, *cut(t)], [*cut(t), None], strict=True)]
    top = Restaurant(Even(model.corpus.words + 1), model.letters.top_discount, lm.TOP_STRENGTH)
    letters, words = {}, {}

    def of(b):
        if b not in words:
            parent = letters.setdefault(letter(b), Restaurant(top, model.letters.discount, lm.LETTER_STRENGTH))
            words[b] = Restaurant(parent, model.words.discount, lm.STRENGTH)
        return words[b]

    for b, w in train:
        of(b).sit(w, r)
    held = [(d, list(zip([None, *cut(t)], [*cut(t), None], strict=True))) for d, t in rows if not learned(d)]
    sums = Counter()
    for turn in range(24):
        for b, w in r.sample(train, len(train)):
            of(b).leave(w, r)
            of(b).sit(w, r)
        if turn >= 8:
            for d, pairs in held:
                for i, (b, w) in enumerate(pairs):
                    sums[d, i] += of(b).p(w) / 16
    got = scores(spark, rows)
    want = {d: sum(math.log10(sums[d, i]) for i in range(len(pairs))) for d, pairs in held}
    n = sum(len(pairs) for _, pairs in held)
    assert abs(sum(got[d] - want[d] for d in want)) / n < 0.015
    apart = [abs(got[d] - want[d]) / len(pairs) for d, pairs in held if len(pairs) > 5]
    assert np.mean(apart) < 0.03


def test_predictive_probabilities_add_up_to_one(spark, sizes):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    m = lm.learn(docs)
    frames = {k: df.toPandas() for k, df in (("pairs", m.pairs), ("answers", m.answers), ("tables", m.tables))}
    seen, own, less, tables, customers = {}, {}, Counter(), Counter(), Counter()
    for _, r in frames["pairs"].iterrows():
        part = lm.Part.of(m.corpus, frames["pairs"][frames["pairs"].part == r.part])
        k, t8, o8, q8, _ = (a[part.ask[1]].astype(float) / s for a, s in zip(lm._answers(frames["answers"][frames["answers"].part == r.part]), (1, 64, 64, 64, 1), strict=True))
        x, y = k - m.letters.discount * t8, o8 - m.letters.top_discount * q8
        mean = np.minimum(part.c, 1).astype(float)
        mean[part.c > 1] = messages.unpacked(frames["tables"].set_index("part").blob[r.part])[0] / 64
        for h, b, let, c, t, i, j in zip(part.h.tolist(), part.before.tolist(), part.letter.tolist(), part.c, mean, x, y, strict=True):
            seen[h, let], own[h] = i, j
            less[b] += c - m.words.discount * t
            tables[b] += t
            customers[b] += c
    known = {h for h, y in own.items() if y > 0}
    assert len(known) == m.corpus.words
    for let in {x for _, x in seen}:
        whole = sum(m.letters.probability(let, seen.get((h, let), 0.0), own[h]) for h in known) + m.letters.probability(let, 0.0, 0.0)
        assert whole == pytest.approx(1)
    for b, n in customers.items():
        assert lm._probability(less[b], 1.0, n, tables[b], m.words.discount) == pytest.approx(1)


def test_table_numbers_follow_their_weights():
    keys = np.random.default_rng(2).integers(0, 2**63, 60_000).astype(np.uint64)
    t = seating.draw_tables(np.full(60_000, 6), np.full(60_000, 0.7), 0.5, keys, 3)
    w = np.exp(np.log(0.7) * np.arange(1, 7) + seating.log_stirling(seating.EXACT, 0.5)[6, 1:7])
    assert np.allclose(np.bincount(t, minlength=7)[1:] / 60_000, w / w.sum(), atol=0.01)


@pytest.mark.parametrize("discount", [0.3, 0.67])
def test_table_numbers_of_many_customers_follow_their_weights(discount):
    keys = np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64)
    exact = seating.log_stirling(2000, discount)
    for c, a in ((65, 0.01), (65, 20), (300, 1.0), (300, 1000.0), (1000, 10.0), (2000, 0.2), (2000, 100.0), (2000, 600.0)):
        t = seating.draw_tables(np.full(20_000, c), np.full(20_000, a), discount, keys, 1)
        k = np.arange(1, c + 1)
        w = np.log(a) * k + exact[c, 1 : c + 1]
        w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        mean = (w * k).sum()
        spread = np.sqrt((w * k * k).sum() - mean**2)
        assert abs(t.mean() - mean) < 0.02 * mean + 0.1, (c, a)
        assert abs(t.std() - spread) < 0.05 * spread + 0.05, (c, a)


def test_contexts_are_the_words_before():
    h, before, let, b = lm.tokens(pa.array(["The end. of", None, "", "the"]))
    assert b.tolist() == [0, 4, 5, 6, 8] and [chr(x) if x else "" for x in let] == ["", "e", "d", "f", "", "", "", "e"]
    assert before.tolist() == [lm._END, *h[:-1]] and h[0] == h[6] and before[4] == before[6] == lm._END


def test_messages():
    r = np.random.default_rng(1)
    arrays = [r.integers(0, 2**63, 100).astype(np.uint64), np.zeros(0, "<u2"), r.random(7), r.integers(0, 9, 50).astype("<u4"), np.arange(3, dtype=np.uint8)]
    for x, y in zip(arrays, messages.unpacked(messages.packed(*arrays)), strict=True):
        assert x.dtype == y.dtype and (x == y).all()
    assert messages.unpacked(messages.packed()) == []
    for keys in (np.sort(arrays[0]), np.zeros(0, np.uint64), np.array([0, 1, 2, 3, 2**64 - 1], np.uint64)):
        x = np.concatenate([arrays[0], arrays[0] + np.uint64(1), np.array([0, 2, 4, 2**64 - 1], np.uint64)])
        at, there = messages.Index(keys).find(x)
        assert there.tolist() == np.isin(x, keys).tolist() and (keys[at[there]] == x[there]).all()
    common = messages.Common(arrays[0][:40])
    assert (common.whole(*common.short(arrays[0])) == arrays[0]).all()


def test_thresholds_keep_the_bound():
    r = np.random.default_rng(4)
    for most in (0, 1, 10, 500, 10_000):
        c = np.floor(r.pareto(0.7, 5000) + 1).astype(np.int64)
        least = lm._threshold(np.bincount(lm._bin(c), minlength=lm._BINS), most)
        assert (c >= least).sum() <= most


def test_empty_table(spark, no_docs, odd_docs):
    assert lm.score_texts(no_docs).count() == 0
    assert lm.score_texts(odd_docs).count() == odd_docs.count()
    none = odd_docs.where("doc_id = 6")  # held out, so that nothing is learned
    assert not learned(6) or none.count() == 1
    assert lm.score_texts(none.withColumn("doc_id", F.lit(6))).first().n_tokens == 1
