"""LM scoring: a hierarchical Pitman-Yor model of words, learned from and applied to a whole corpus.

A word is seated in the restaurant of the word before it. Restaurants of words that end in the
same letter share a parent, the restaurant of that letter; all letters share one grandparent,
whose base is uniform over the known words and one for all unknown ones. Tables of a
restaurant are customers of its parent. Table numbers are drawn by Gibbs sweeps (``seating``),
level by level: word restaurants given the letters' probabilities, then the letters' given the
tables of the words', and again. A sweep draws a restaurant's dishes from its table number of
the sweep before. A dish's probability is linear in its own table numbers, so that the
average of the predictive probabilities over the sampled sweeps is taken by averaging these.

How it is dealt:
1. Words are counted: totals, and the most frequent words, which get short codes.
2. Pairs (word before, word) of all texts are counted, per task and then by part; parts go by
   the word before, and where that is very frequent by the word too, so that all parts are alike.
3. Letters' restaurants are dealt by word. Parts ask them for each (word, letter) that they have,
   telling the customers they send, first one for each pair and then the tables that sweeps
   gave; an answer is in the order of the question.
4. Scores of the FREQUENT most frequent pairs go to all tasks; other tokens go to their
   part and come back as sums for each text.
The number of parts follows from the number of tokens. All chance is named by words and sweeps, so
that scores do not depend on parts, partitions or settings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgrid.llm import textnum
from leafgrid.llm.messages import Common, Index, packed, unpacked
from leafgrid.llm.seating import SAMPLES, pair_keys, seat_dishes
from leafgrid.llm.store import forget, keep, small_batches

FOLDS, HELD_FOLD = 5, 1
#: Words with short codes, and pairs whose scores all tasks hold: 20 bytes and 24 bytes each in every task.
COMMON, FREQUENT = 500_000, 500_000
#: Tokens of a part, about; and the least number of parts.
PART_TOKENS, LEAST_PARTS = 2_000_000, 8
#: Parts that words are counted in.
WORD_PARTS = 64
#: Strengths of the restaurants of words, of letters and of the grandparent.
STRENGTH, LETTER_STRENGTH, TOP_STRENGTH = 1.0, 10.0, 10.0
#: Discount of the letters' restaurants until the tables of the first run tell it.
FIRST_DISCOUNT = 0.7
#: Bytes of text looked at together, and the pairs or tokens that a task holds back before it sends them.
CHUNK, HELD = 6 << 20, 1 << 21
LETTERS = 256
_END = np.uint64(0x6A09E667F3BCC909)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?"]] = True

#: What goes between tasks: where to, what it is, from which task or part, and arrays.
_MESSAGE = "part int, kind int, task long, blob binary"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
WORDS, PAIRS, ASKED, ANSWER, WANTED, TABLES, TOKENS, TEXTS, SCORES, FACTS = range(10)
#: Questions for the frequent pairs of a part come as from a part of this number more.
_WANTED = 1 << 40


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token, of the token before it and its letter, and bounds; each text's last token is its end.

    The first token of a text follows an end. The letter is a word's last byte, but for one mark after it.
    """
    data, _ = textnum.raw(texts)
    found, ends, bounds = textnum.words(texts)
    n = len(texts)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    strip = _PUNCTUATION[last] & (ends >= 2)
    if strip.any():
        last = last.copy()
        last[strip] = data[ends[strip] - 2]
    last = np.where((last >= 65) & (last < 91), last + 32, last).astype(np.uint8)
    to = np.arange(len(found)) + np.repeat(np.arange(n), np.diff(bounds))  # places among tokens
    out = np.full(len(found) + n, _END, np.uint64)
    out[to] = found
    letter = np.zeros(len(out), np.uint8)
    letter[to + 1] = last
    before = np.concatenate([[_END], out[:-1]]) if len(out) else out
    return out, before, letter, bounds + np.arange(n + 1)


def _held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_FOLD


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in textnum.by_size(batch, "text", CHUNK):
            yield part, *tokens(part.column("text"))


def _learned(part: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
    """Whether each token is learned from."""
    return np.repeat(np.array([not _held(d) for d in part.column("doc_id").to_pylist()], bool), np.diff(bounds))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, _TYPES, strict=True)], names=["part", "kind", "task", "blob"])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "kind", "task", "blob"])


def _spread(x: np.ndarray, parts) -> np.ndarray:
    """A part for each evenly spread number, ascending with it."""
    return ((x >> np.uint64(32)) * np.asarray(parts, np.uint64) >> np.uint64(32)).astype(np.int64)


def _dealt(h: np.ndarray, parts) -> np.ndarray:
    """A part for each hash."""
    return _spread(textnum.mix(h), parts)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(fresh)


def _cut(part: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Part, begin and end of each part that has any, in ascending parts."""
    b = np.searchsorted(part, np.arange(parts + 1))
    return ((k, int(i), int(j)) for k, (i, j) in enumerate(zip(b[:-1], b[1:], strict=True)) if j > i)


# ---- 1: words


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    seen = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        first = _runs(h[order])
        return h[order][first], np.add.reduceat(c[order], first)

    def send() -> pa.RecordBatch:
        h, c = summed()
        part = _dealt(h, WORD_PARTS)
        order = np.argsort(part, kind="stable")
        h, c, part = h[order], c[order], part[order]
        return _batch([(k, WORDS, 0, packed(h[i:j], c[i:j].astype("<u4"))) for k, i, j in _cut(part, WORD_PARTS)])

    for part, h, _, _, bounds in _chunks(batches):
        seen += len(h)
        h = h[_learned(part, bounds)]
        if len(h):
            held.append(np.unique(h, return_counts=True))
        if sum(len(x[0]) for x in held) > HELD:
            held[:] = [summed()]
            if len(held[0][0]) > HELD // 2:
                yield send()
                held.clear()
    if held:
        yield send()
    if seen:
        yield _batch([(0, FACTS, 0, packed(np.array([seen], np.int64)))])


#: Bins of counts, by twice their binary logarithm.
_BINS = 128


def _bin(c: np.ndarray) -> np.ndarray:
    return np.minimum((2 * np.log2(c)).astype(np.int64), _BINS - 1)


def _threshold(bins: np.ndarray, most: int) -> int:
    """The least count from which on no more than ``most`` dishes are."""
    if bins.sum() <= most:
        return 1
    from_bin = int(np.argmax(bins[::-1].cumsum()[::-1] <= most)) if bins[-1] <= most else _BINS
    least = 1
    while int(_bin(np.array([least]))[0]) < from_bin:  # the least count of the bin
        least = least + 1 if least < 1024 else int(least * 1.0005) + 1
    return least


def _merge_words(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    seen = sum(int(unpacked(b)[0][0]) for b in pdf.loc[pdf["kind"] == FACTS, "blob"])
    blobs = pdf.loc[pdf["kind"] == WORDS, "blob"]
    bins, n, words = np.zeros(_BINS, np.int64), 0, 0
    if len(blobs):
        h, c = (np.concatenate(x) for x in zip(*(unpacked(b) for b in blobs), strict=True))
        order = np.argsort(h)
        first = _runs(h[order])
        h, c = h[order][first], np.add.reduceat(c[order].astype(np.int64), first)
        bins, n, words = np.bincount(_bin(c), minlength=_BINS), int(c.sum()), len(h)
        out.append((int(pdf["part"].iloc[0]), WORDS, 0, packed(h, c)))
    out.append((int(pdf["part"].iloc[0]), FACTS, 0, packed(np.concatenate([[seen, n, words], bins]).astype(np.int64))))
    return _frame(out)


@dataclass(frozen=True)
class Corpus:
    """What all tasks know of the words."""

    seen: int  # tokens of all texts
    n: int  # training tokens
    words: int  # distinct
    parts: int
    common: Common
    split: Index  # very frequent words: the pairs after one are dealt to several parts
    splits: np.ndarray  # how many
    count: np.ndarray  # of split words

    def base(self, c):
        """log10 of the add-a-half share of a word of count c."""
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.words + 1)))

    def place(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A number for each pair, the same for those of a restaurant or of its share in a part, that ascends with the part."""
        at, there = self.split.find(before)
        key = before.copy()
        if there.any():
            key[there] ^= textnum.mix(_dealt(h[there], self.splits[at[there]]).astype(np.uint64) + np.uint64(1))
        return textnum.mix(key)

    def part(self, place: np.ndarray) -> np.ndarray:
        return _spread(place, self.parts)


def _corpus(words: DataFrame) -> Corpus:
    facts = sum((unpacked(r["blob"])[0] for r in _facts(words)), np.zeros(3 + _BINS, np.int64))
    seen, n, kinds = (int(x) for x in facts[:3])
    least = _threshold(facts[3:], COMMON)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                h, c = unpacked(blob)
                yield pa.RecordBatch.from_arrays([pa.array([packed(h[c >= least], c[c >= least])], pa.binary())], names=["blob"])

    rows = words.where(F.col("kind") == WORDS).select("blob").mapInArrow(frequent, "blob binary").collect()  # COMMON words at most
    h, c = (np.concatenate(x) for x in zip(*(unpacked(r["blob"]) for r in rows), strict=True)) if rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.lexsort((h, -c))
    h, c = h[order], c[order]
    parts = max(LEAST_PARTS, -(-seen // PART_TOKENS))
    # a word with more than a quarter of an even part is split; 4 * parts words at most
    splits = np.minimum(-(-c * 4 * parts // max(n, 1)), parts)
    hot = np.flatnonzero(splits > 1)
    hot = hot[np.argsort(h[hot])]
    return Corpus(seen, n, kinds, parts, Common(h), Index(h[hot]), splits[hot], c[hot])


# ---- 2: pairs


def _summed(h: np.ndarray, b: np.ndarray, letter: np.ndarray, c: np.ndarray) -> tuple:
    """Distinct pairs with their summed counts."""
    order = np.argsort(pair_keys(h, b))
    h, b, letter, c = h[order], b[order], letter[order], c[order]
    first = _runs(h, b)
    return h[first], b[first], letter[first], np.add.reduceat(c, first) if len(first) else c


def _pack_pairs(corpus: Corpus, h: np.ndarray, b: np.ndarray, letter: np.ndarray, *more: np.ndarray) -> bytes:
    """Pairs, a run for each word before."""
    first = _runs(b)
    long = np.diff(np.append(first, len(b))).astype("<u4")
    return packed(*corpus.common.short(b[first]), letter[first], long, *corpus.common.short(h), *more)


def _unpack_pairs(corpus: Corpus, blob: bytes) -> tuple:
    """Word, word before and letter of each pair, then the further arrays."""
    bs, b_rest, letter, long, hs, h_rest, *more = unpacked(blob)
    return corpus.common.whole(hs, h_rest), np.repeat(corpus.common.whole(bs, b_rest), long), np.repeat(letter, long), *more


def _by_part(corpus: Corpus, kind: int, task: int, h: np.ndarray, b: np.ndarray, letter: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Messages of pairs to their parts."""
    place = corpus.place(b, h)
    order = np.argsort(place)
    part = corpus.part(place[order])
    h, b, letter, *more = (x[order] for x in (h, b, letter, *more))
    return [(k, kind, task, _pack_pairs(corpus, h[i:j], b[i:j], letter[i:j], *(x[i:j] for x in more))) for k, i, j in _cut(part, corpus.parts)]


def _count_pairs(known):
    """Pairs of all texts with their counts in those learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus: Corpus = known.value
        held: list[tuple] = []

        def send() -> pa.RecordBatch:
            h, b, letter, c = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return _batch(_by_part(corpus, PAIRS, 0, h, b, letter, c.astype("<u4")))

        for part, h, b, letter, bounds in _chunks(batches):
            if len(h):
                held.append((h, b, letter, _learned(part, bounds).astype(np.uint32)))
            if sum(len(x[0]) for x in held) > HELD:
                yield send()
        if held:
            yield send()

    return run


def _merge_pairs(known):
    """One row of pairs for each part, the first questions, in which each pair has one table, and facts:
    bins of counts, pairs seen once and twice, pairs by letter, and those of split restaurants."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corpus: Corpus = known.value
        number = int(pdf["part"].iloc[0])
        h, b, letter, c = _summed(*(np.concatenate(x) for x in zip(*(_unpack_pairs(corpus, x) for x in pdf["blob"]), strict=True)))
        order = np.argsort(corpus.place(b, h))
        h, b, letter, c = h[order], b[order], letter[order], c[order]
        some = c > 0
        facts = np.concatenate([np.bincount(_bin(c[some]), minlength=_BINS), [(c == 1).sum(), (c == 2).sum()], np.bincount(letter[some], minlength=LETTERS)])
        rows = [(number, PAIRS, 0, _pack_pairs(corpus, h, b, letter, c.astype("<u4"))), (number, FACTS, 0, packed(facts.astype(np.int64), *_split(corpus, b, np.minimum(c, 1))))]
        return _frame(rows + _asked(corpus, number, _ask(h, letter), h, letter, np.minimum(c, 1)))

    return run


def _split(corpus: Corpus, b: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which split words have pairs here, and the tables of these."""
    first = _runs(b)
    at, there = corpus.split.find(b[first])
    n = np.add.reduceat(tables, first) if len(first) else tables
    return at[there], n[there]


# ---- 3: restaurants of letters


@dataclass(frozen=True)
class Letters:
    """What tasks need to know of the letters' restaurants and of the grandparent."""

    words: int
    discount: float
    top_discount: float
    customers: np.ndarray  # of each letter
    tables: np.ndarray
    top_customers: float
    top_tables: float

    def top(self, own):
        """Grandparent's probability of a word; own: its customers less the discount of its tables there."""
        base = (TOP_STRENGTH + self.top_discount * self.top_tables) / (self.words + 1)
        return (own + base) / (TOP_STRENGTH + self.top_customers)

    def probability(self, letter, seen, own):
        """Probability of a word after a letter; seen: its customers less the discount of its tables there."""
        back = LETTER_STRENGTH + self.discount * self.tables[letter]
        return (seen + back * self.top(own)) / (LETTER_STRENGTH + self.customers[letter])

    def answered(self, letter, customers, tables, top_customers, top_tables, _count):
        """The probability by an answer."""
        return self.probability(letter, customers - self.discount * tables / 64, top_customers / 64 - self.top_discount * top_tables / 64)


def _ask(h: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a part asks for, in the order of the parts that answer: one pair of each (word, letter); and the place of each pair there."""
    key = textnum.mix(h ^ _END) & ~np.uint64(255) | letter
    order = np.argsort(key)
    first = _runs(key[order])
    place = np.empty(len(h), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    return order[first], place


def _asked(corpus: Corpus, task: int, ask: tuple[np.ndarray, np.ndarray], h: np.ndarray, letter: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """Questions of a part with the customers that it sends."""
    of, place = ask
    h, letter, n = h[of], letter[of], np.bincount(place, tables, len(of)).astype("<u4")
    to = _dealt(h ^ _END, corpus.parts)
    return [(k, ASKED, task, packed(*corpus.common.short(h[i:j]), letter[i:j], n[i:j])) for k, i, j in _cut(to, corpus.parts)]


def _deal_words(known):
    """The counted words, dealt as the letters' restaurants are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus: Corpus = known.value
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                h, c = unpacked(blob)
                to = _dealt(h ^ _END, corpus.parts)
                order = np.argsort(to, kind="stable")
                h, c, to = h[order], c[order], to[order]
                rows = [(k, WORDS, 0, packed(h[i:j], c[i:j].astype("<u4"))) for k, i, j in _cut(to, corpus.parts)]
                for k in range(0, len(rows), 256):
                    yield _batch(rows[k : k + 256])

    return run


def seat_letters(h: np.ndarray, letter: np.ndarray, c: np.ndarray, letters: Letters, last: bool) -> tuple:
    """Mean tables of each dish of the letters' restaurants, in the order of (word, letter), and of the grandparent:
    means of a word's customers there and of its tables; then where words begin, and the word of each dish.

    All of a word's dishes are here; table totals of restaurants are those of the run before, whatever is here."""
    first = _runs(h)
    word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    keys, top_keys = pair_keys(h, letter.astype(np.uint64) + np.uint64(1 << 20)), pair_keys(h[first], np.full(len(first), 1 << 21, np.uint64))
    own = np.bincount(word, minlength=len(first))
    tables_own = np.ones(len(first))
    known, top_known = letters.tables.astype(np.float64), np.array([letters.top_tables])
    fresh = np.full(len(first), 1 / (letters.words + 1))
    for samples in (1, SAMPLES) if last else (1,):  # a first run tells the grandparent's tables
        p = letters.top(own - letters.top_discount * tables_own)
        mean, t = seat_dishes(c, letter.astype(np.int64), known, p[word], keys, LETTER_STRENGTH, letters.discount, samples)
        own = np.bincount(word, t, len(first)).astype(np.int64)
        tables_own, _ = seat_dishes(own, np.zeros(len(first), np.int64), top_known, fresh, top_keys, TOP_STRENGTH, letters.top_discount, samples)
    return mean, np.bincount(word, mean, len(first)), tables_own, first, word


def _answer(known, letters: Letters, last: bool):
    """Answers to what parts ask of the words dealt here: customers and mean tables of a word after a letter, and of the
    word in the grandparent, in 64ths, and the word's count if it is told. And facts: customers and tables in the
    grandparent, dishes with one and two customers in both, and tables by letter."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corpus: Corpus = known.value
        part = int(pdf["part"].iloc[0])
        counted = [unpacked(b) for b in pdf.loc[pdf["kind"] == WORDS, "blob"]]
        words, count = (np.concatenate(x) for x in zip(*counted, strict=True)) if counted else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.argsort(words)
        words, count = words[order], count[order]
        asked = pdf[pdf["kind"] == ASKED].sort_values("task")
        if not len(asked):
            return _frame([])
        got = [(corpus.common.whole(a, b), x, n) for a, b, x, n in map(unpacked, asked["blob"])]
        h, letter, n = (np.concatenate(x) for x in zip(*got, strict=True))
        of, dish = _ask(h, letter)
        h, letter, c = h[of], letter[of], np.bincount(dish, n, len(of)).astype(np.int64)
        mean, top_customers, top_tables, first, word = seat_letters(h, letter, c, letters, last)
        at, there = Index(words).find(h[first])
        counts = np.zeros(len(first), np.uint32)
        counts[there] = count[at[there]]
        ints = lambda x: np.rint(x * 64).astype("<u8")
        columns = (c.astype("<u4"), ints(mean), ints(top_customers)[word], ints(top_tables)[word], counts[word])
        out, at = [], 0
        for task, (asks, _, _) in zip(asked["task"], got, strict=True):
            mine = dish[at : at + len(asks)]
            out.append((int(task) % _WANTED, WANTED if task >= _WANTED else ANSWER, part, packed(*(x[mine] for x in columns))))
            at += len(asks)
        facts = np.concatenate([[top_customers.sum(), top_tables.sum(), (c == 1).sum(), (c == 2).sum(), (top_customers == 1).sum(), ((top_customers > 1) & (top_customers <= 2)).sum()], np.bincount(letter, mean, LETTERS)])
        return _frame([*out, (-1, FACTS, part, packed(facts))])

    return run


def _added(rows: list, long: int) -> np.ndarray:
    return sum((unpacked(r["blob"])[0] for r in rows), np.zeros(long))


def _facts(df: DataFrame) -> list:
    return df.where(F.col("kind") == FACTS).select("part", "blob").collect()


def _share(once: float, twice: float) -> float:
    """A discount by the dishes seen once and twice."""
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once + twice else 0.5


# ---- restaurants of words


@dataclass(frozen=True)
class Words:
    """What tasks need to know of the restaurants of words: the discount, and of split ones the tables in all parts."""

    discount: float
    split: np.ndarray

    def tables(self, corpus: Corpus, before: np.ndarray) -> np.ndarray:
        """Tables of each restaurant that is split, and nan for the others."""
        at, there = corpus.split.find(before)
        return np.where(there, self.split[at], np.nan) if len(self.split) else np.full(len(before), np.nan)


@dataclass(frozen=True)
class Part:
    """The pairs of a part, a run for each restaurant."""

    h: np.ndarray
    before: np.ndarray
    letter: np.ndarray
    c: np.ndarray
    first: np.ndarray  # of restaurants among pairs
    place: np.ndarray  # of pairs among restaurants
    ask: tuple[np.ndarray, np.ndarray]  # what the part asks, and the place of each pair there

    @classmethod
    def of(cls, corpus: Corpus, pdf: pd.DataFrame) -> Part:
        h, b, letter, c = _unpack_pairs(corpus, pdf.loc[pdf["kind"] == PAIRS, "blob"].iloc[0])
        first = _runs(b)
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(b))))
        return cls(h, b, letter, c.astype(np.int64), first, place, _ask(h, letter))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.first)

    def customers(self, corpus: Corpus) -> np.ndarray:
        """Customers of each restaurant, in all parts."""
        at, there = corpus.split.find(self.before[self.first])
        out = self.sums(self.c)
        out[there] = corpus.count[at[there]]
        return out


def _answers(pdf: pd.DataFrame) -> list[np.ndarray]:
    """The answers to a part, in the order of its questions."""
    rows = pdf[pdf["kind"] == ANSWER].sort_values("task")
    return [np.concatenate(x) for x in zip(*map(unpacked, rows["blob"]), strict=True)]


def _run(known, words: Words, letters: Letters, least: int):
    """Sweeps of a part's restaurants given the first answers: mean tables of pairs seen twice or more, in 64ths; the
    next questions, with tables of the last sweep, and those for the frequent pairs; and facts: customers by letter,
    mean tables of split restaurants, and what the scores of its frequent pairs are made of."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corpus: Corpus = known.value
        number = int(pdf["part"].iloc[0])
        part = Part.of(corpus, pdf)
        p = letters.answered(part.letter, *(x[part.ask[1]] for x in _answers(pdf)))
        keys = pair_keys(part.h, part.before)
        mean, t = seat_dishes(part.c, part.place, words.tables(corpus, part.before[part.first]), p, keys, STRENGTH, words.discount)
        rows = [(number, TABLES, number, packed(np.rint(mean[part.c > 1] * 64).astype("<u4")))]
        rows += _asked(corpus, number, part.ask, part.h, part.letter, t)
        at = np.flatnonzero(part.c >= least)
        at = at[np.argsort(part.ask[1][at], kind="stable")]
        if len(at):
            rows += _asked(corpus, number + _WANTED, (at, np.zeros(0, np.int64)), part.h, part.letter, np.zeros(0))
        r = part.place[at]
        split, is_split = corpus.split.find(part.before[at])
        pairs = (keys[at], part.letter[at], part.c[at] - words.discount * mean[at], part.customers(corpus)[r], part.sums(mean)[r], np.where(is_split, split, -1))
        rows.append((number, FACTS, number, packed(np.bincount(part.letter, t, LETTERS), *_split(corpus, part.before, mean), *pairs)))
        return _frame(rows)

    return run


def _probability(c_less, p, customers, tables, discount: float):
    return (c_less + (STRENGTH + discount * tables) * p) / (STRENGTH + customers)


# ---- 4: scores


@dataclass(frozen=True)
class Frequent:
    """Ascending keys of frequent pairs with log10 of their probability and the count of their word."""

    index: Index
    score: np.ndarray
    count: np.ndarray


def _send(known, frequent):
    """Of each text what the frequent pairs say, and of all other tokens the pair and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus: Corpus = known.value
        table: Frequent = frequent.value
        of_base = corpus.base(table.count)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 20
        texts: list[tuple] = []  # doc_id or None, tokens, known, base, score
        rest: list[tuple] = []

        def sent() -> Iterator[pa.RecordBatch]:
            ids = np.array([d or 0 for d, *_ in texts], np.int64)
            null = np.array([d is None for d, *_ in texts], np.uint8)
            whole = [np.array(x, np.float64) for x in zip(*(x[1:] for x in texts), strict=True)]
            yield _batch([(number % corpus.parts, TEXTS, number, packed(ids, null, *whole))])
            rows = _by_part(corpus, TOKENS, number, *(np.concatenate(x) for x in zip(*rest, strict=True)))
            rest.clear()
            for k in range(0, len(rows), 256):
                yield _batch(rows[k : k + 256])

        for part, h, b, letter, bounds in _chunks(batches):
            text = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            at, there = table.index.find(pair_keys(h, b))
            place = at[there]
            sums = [np.bincount(text[there], w, part.num_rows) for w in (np.ones(len(place)), of_base[place], table.score[place])]
            rest.append((h[~there], b[~there], letter[~there], (text[~there] + len(texts)).astype("<u4")))
            texts += zip(part.column("doc_id").to_pylist(), np.diff(bounds).tolist(), *(s.tolist() for s in sums), strict=True)
            if sum(len(x[0]) for x in rest) > HELD or len(texts) > HELD // 8:
                yield from sent()
                texts, number = [], number + 1
        if texts:
            yield from sent()

    return run


def _meet(known, words: Words, letters: Letters):
    """Tokens of a part with its pairs: sums for each text of the words known, the base and the score."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        corpus: Corpus = known.value
        passed = [tuple(r) for r in pdf.loc[pdf["kind"] == TEXTS, ["part", "kind", "task", "blob"]].itertuples(index=False)]
        sent = pdf[pdf["kind"] == TOKENS]
        if not len(sent):
            return _frame(passed)
        part = Part.of(corpus, pdf)
        answers = [x[part.ask[1]] for x in _answers(pdf)]
        p, count = letters.answered(part.letter, *answers), answers[-1]
        mean = np.minimum(part.c, 1).astype(np.float64)
        mean[part.c > 1] = unpacked(pdf.loc[pdf["kind"] == TABLES, "blob"].iloc[0])[0] / 64
        split = words.tables(corpus, part.before[part.first])
        tables = np.where(np.isnan(split), part.sums(mean), split)
        score = np.log10(_probability(part.c - words.discount * mean, p, part.customers(corpus)[part.place], tables[part.place], words.discount))
        base, is_known = corpus.base(count.astype(np.float64)), (count > 0).astype(np.float64)
        keys = pair_keys(part.h, part.before)
        order = np.argsort(keys)
        index = Index(keys[order])
        out = []
        for task, blob in zip(sent["task"], sent["blob"], strict=True):
            h, b, _, i = _unpack_pairs(corpus, blob)
            at = order[index.find(pair_keys(h, b))[0]]
            texts, i = np.unique(i, return_inverse=True)
            sums = [np.bincount(i, x[at], len(texts)) for x in (is_known, base, score)]
            out.append((0, SCORES, int(task), packed(texts, sums[0].astype("<u4"), sums[1], sums[2])))
        return _frame(passed + out)

    return run


_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _together(pdf: pd.DataFrame) -> pd.DataFrame:
    own = unpacked(pdf.loc[pdf["kind"] == TEXTS, "blob"].iloc[0])
    ids, null, n, known, base, score = own[0], own[1].astype(bool), *own[2:]
    known, base, score = known.copy(), base.copy(), score.copy()
    # sums in the order of parts, whatever the order of arrival
    parts = sorted((unpacked(b) for b in pdf.loc[pdf["kind"] == SCORES, "blob"]), key=lambda x: (x[3].tobytes(), x[0].tobytes()))
    for i, k, b, s in parts:
        known[i] += k
        base[i] += b
        score[i] += s
    doc = pd.array(ids, dtype="Int64")
    doc[null] = pd.NA
    return pd.DataFrame({"doc_id": doc, "n_tokens": n.astype(np.int64), "n_known": known.astype(np.int64), "base_score": base, "score": score})


@dataclass(frozen=True)
class Model:
    """A learned model: what all tasks know, and the tables that parts hold."""

    corpus: Corpus
    words: Words
    letters: Letters
    pairs: DataFrame
    answers: DataFrame
    tables: DataFrame
    frequent: Frequent
    kept: tuple[DataFrame, ...]  # the tables that these are parts of


def _split_tables(corpus: Corpus, rows: list) -> np.ndarray:
    """Tables of split restaurants over all parts: of each part that has one its place and number."""
    out = np.zeros(len(corpus.split.keys))
    for r in rows:
        _, at, n, *_ = unpacked(r["blob"])
        np.add.at(out, at, n)
    return out


def learn(docs: DataFrame) -> Model:
    """The model of the rows with doc_id and text that are learned from; it answers for the others' words too."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    of = lambda df, kind: df.where(F.col("kind") == kind)
    words = keep(docs.mapInArrow(_count_words, _MESSAGE).groupBy("part").applyInPandas(_merge_words, _MESSAGE), "words", "kind")
    corpus = _corpus(words)
    known = send(corpus)
    counted = keep(docs.mapInArrow(_count_pairs(known), _MESSAGE).groupBy("part").applyInPandas(_merge_pairs(known), _MESSAGE), "pairs", "kind")
    facts = _facts(counted)
    sums = _added(facts, _BINS + 2 + LETTERS)
    bins, (once, twice), kinds = sums[:_BINS], sums[_BINS : _BINS + 2], sums[_BINS + 2 :]
    pairs = of(counted, PAIRS)
    seats = Words(_share(once, twice), _split_tables(corpus, facts))

    # each pair has one table: the letters' probabilities to begin with
    letters = Letters(corpus.words, FIRST_DISCOUNT, FIRST_DISCOUNT, kinds, np.minimum(kinds, corpus.words) * 0.5, float(min(kinds.sum(), 2 * corpus.words)), float(corpus.words))
    first = keep(of(counted, ASKED).groupBy("part").applyInPandas(_answer(known, letters, False), _MESSAGE), "answers", "kind")
    forget(counted, f"kind={ASKED}")
    sampled = _after(letters, _facts(first), discounts=False)
    letters = _after(letters, _facts(first))

    # sweeps of the words' restaurants, then of the letters'
    least = _threshold(bins.astype(np.int64), FREQUENT)
    ran = keep(pairs.unionByName(of(first, ANSWER)).groupBy("part").applyInPandas(_run(known, seats, sampled, least), _MESSAGE), "tables", "kind")
    forget(first)
    facts = _facts(ran)  # FREQUENT pairs at most
    letters = replace(letters, customers=_added(facts, LETTERS))
    seats = replace(seats, split=_split_tables(corpus, facts))
    asked = of(ran, ASKED).unionByName(of(words, WORDS).mapInArrow(_deal_words(known), _MESSAGE))
    answers = keep(asked.groupBy("part").applyInPandas(_answer(known, letters, True), _MESSAGE), "answers", "kind")
    forget(ran, f"kind={ASKED}")
    forget(words)
    letters = _after(letters, _facts(answers), discounts=False)
    wanted = of(answers, WANTED).select("part", "task", "blob").collect()  # FREQUENT pairs at most
    return Model(corpus, seats, letters, pairs, of(answers, ANSWER), of(ran, TABLES), _frequent(seats, letters, facts, wanted), (counted, answers, ran))


def _after(letters: Letters, rows: list, discounts: bool = True) -> Letters:
    sums = _added(rows, 6 + LETTERS)
    out = replace(letters, tables=sums[6:], top_customers=float(sums[0]), top_tables=float(sums[1]))
    return replace(out, discount=_share(sums[2], sums[3]), top_discount=_share(sums[4], sums[5])) if discounts else out


def _frequent(words: Words, letters: Letters, facts: list, wanted: list) -> Frequent:
    """Scores of the frequent pairs, of what parts told of them and what they were answered."""
    got = [unpacked(r["blob"])[3:] for r in sorted(facts, key=lambda r: r["part"])]
    answered = [unpacked(r["blob"]) for r in sorted(wanted, key=lambda r: (r["part"], r["task"]))]
    if not answered:
        return Frequent(Index(np.zeros(0, np.uint64)), np.zeros(0), np.zeros(0))
    keys, letter, less, customers, tables, split = (np.concatenate(x) for x in zip(*got, strict=True))
    answer = [np.concatenate(x).astype(np.float64) for x in zip(*answered, strict=True)]
    tables = np.where(split >= 0, words.split[split], tables) if len(words.split) else tables
    order = np.argsort(keys)
    score = np.log10(_probability(less, letters.answered(letter, *answer), customers, tables, words.discount))
    return Frequent(Index(keys[order]), score[order], answer[-1][order])


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row.

    score is log10 of the text's probability, perplexity 10 ** (-score / n_tokens). A null text is
    empty and has its end alone; a row without doc_id is learned from; repeated rows count and are
    scored each; without rows there are none; further columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    m = learn(docs)
    send = spark.sparkContext.broadcast
    known = send(m.corpus)
    sent = docs.mapInArrow(_send(known, send(m.frequent)), _MESSAGE)
    there = m.pairs.unionByName(m.answers).unionByName(m.tables)
    met = sent.unionByName(there).groupBy("part").applyInPandas(_meet(known, m.words, m.letters), _MESSAGE)
    out = met.groupBy("task").applyInPandas(_together, _SCORED)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD, F.lit(False))
    return out.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(m.corpus.n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of four fifths of them."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
