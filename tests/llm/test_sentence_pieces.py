import random

import numpy as np
import public_tokenizers
from llm_words import words

from leafgrid.llm import piece_model as pm
from leafgrid.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = pm.PieceModel.load(PATH)
TEXTS = ["", "a", " ", "  x ", "Hello  world\n\tfoo ", "日本語 ☃ ü\x00", "naïve façade " * 20, words(1, 200), "a" * 500, "ééé\n" * 40]


def naive(model, prepared):
    best, back = [0.0] + [float("-inf")] * len(prepared), [0] * (len(prepared) + 1)
    for j in range(1, len(prepared) + 1):
        for i in range(max(0, j - model.longest), j):
            piece = prepared[i:j]
            score = model.scores[model.ids[piece]] if piece in model.ids else model.unknown_score if j == i + 1 else None
            if score is not None and best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, i
    return best[-1]


def score(model, ids_of_pieces):
    return sum(model.scores[model.ids[p]] if p in model.ids else model.unknown_score for p in ids_of_pieces)


def pieces_of(model, prepared):
    """Pieces of a text as a stream commits them; bytes of a character that is none as the character."""
    s = pm.Stream(model)
    out, held = [], b""
    for i in numbers(s.feed(prepared) + s.finish()):
        if model.kinds[i] != pm.BYTE:
            out.append(model.pieces[i])
            continue
        held += model.bytes_of[i]
        try:
            out.append(held.decode())
        except UnicodeDecodeError:
            continue
        held = b""
    return out


def test_best_path():
    for text in TEXTS:
        prepared = MODEL.prepared(text)
        got = pieces_of(MODEL, prepared)
        assert "".join(got) == prepared
        assert abs(score(MODEL, got) - naive(MODEL, prepared)) <= 1e-9 * max(1, abs(naive(MODEL, prepared)))


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


def test_streams_commit_in_a_window_and_agree():
    r = random.Random(3)
    for text in TEXTS:
        prepared, whole = MODEL.prepared(text), MODEL.encode(text).tolist()
        for step in (1, 7, 100):
            s, out, at = pm.Stream(MODEL), [], 0
            while at < len(prepared):
                k = r.randint(1, step)
                out += numbers(s.feed(prepared[at : at + k]))
                at += k
            assert out + numbers(s.finish()) == whole


def test_ordinary_text_commits_within_a_short_window():
    fresh = pm.PieceModel.load(PATH)  # that has no steps in store, so that each is taken
    text = words(5, 3000)
    s = pm.Stream(fresh)
    early = numbers(s.feed(fresh.prepared(text)))
    assert s.commits >= len(set(text.split())) - 1 and s.width <= 4 * fresh.longest
    assert len(early) >= len(fresh.encode(text)) - 2 * fresh.longest  # all but the open window


def test_remembered_steps_change_nothing(monkeypatch):
    text = words(6, 400) + "a" * 300 + " " * 300 + words(7, 50)
    whole = MODEL.encode(text).tolist()
    monkeypatch.setattr(pm, "REMEMBERED", 3)
    fresh = pm.PieceModel.load(PATH)
    assert fresh.encode(text).tolist() == whole
    monkeypatch.setattr(pm, "SHORT", 0)  # no window is short
    assert numbers(pm.Stream(fresh).feed(fresh.prepared(text)))[:300] == whole[:300]


def test_steps_side_by_side_are_those_of_streams():
    r = random.Random(9)
    alphabet = "abcdeéñ日.,-▁▁Zq☃"
    parts = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(3000)})
    parts = [p for x in parts for p in pm._PART.findall(x)] + words(3, 400).replace(" ", "▁ ").split()
    one, two = pm.PieceModel.load(PATH), pm.PieceModel.load(PATH)
    one.prime(parts)
    start = one.state(pm.SPACE)
    assert len(start) > 500
    for part in start:
        want, after = pm.Stream(two)._step(two.state(pm.SPACE), part)
        assert start[part][0] == want and start[part][1].open == after.open
    texts = [words(k, 200) + "☃ x" for k in range(5)] + [None, "", "a"]
    assert [x.tolist() for x in one.encode_all(texts)] == [two.encode(t).tolist() for t in texts]


def test_very_long_runs():
    for text in (" " * 300_000, "a" * 300_001, "\n" * 300_000, "ab \n\t" * 60_000, "語" * 100_000):
        ids = MODEL.encode(text)
        assert MODEL.decode(ids) == text
    assert len(MODEL.encode(" " * 300_000)) == 300_000 // 16 + 1


def test_round_trips():
    for text in TEXTS:
        ids = MODEL.encode(text)
        assert MODEL.decode(ids) == text
        d = pm.Decoder(MODEL)
        assert "".join(d.feed([i]) for i in ids.tolist()) + d.finish() == text


def test_pieces_without_byte_fallback_and_with_inner_spaces():
    m = pm.PieceModel(["<unk>", "a", "b", "ab", "▁", "a▁b"], [0.0, -1, -1, -1.5, -1, -0.5], [2, 1, 1, 1, 1, 1])
    assert m.encode("a b").tolist() == [4, 5]
    assert m.encode("az").tolist() == [4, 1, 0]


def test_tables(odd_docs, no_docs):
    rows = sp.coding_report(odd_docs, PATH).collect()
    assert len(rows) == odd_docs.count() and all(r.round_trip for r in rows)
    coded = sp.encode(odd_docs, PATH)
    back = sorted((str(r.doc_id), r.text) for r in sp.decode(coded, PATH).collect())
    assert back == sorted((str(r.doc_id), (r.text or "").replace("▁", " ")) for r in odd_docs.collect())
    assert sp.coding_report(no_docs, PATH).count() == 0
