"""Steps of a piece stream over many short windows side by side.

The windows are laid out one after the other in arrays. For each place in a window, from
the first on, all windows follow the pieces that begin there at once; sums, back pointers,
survivors, the boundary where their paths meet, and the ids up to it are those of ``Stream``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from leafgrid.llm.messages import Index
from leafgrid.llm.textnum import mix

_CHARACTERS = 0x110000


class Steps:
    """A model's pieces as a numbered tree: node 0 is the beginning of all."""

    def __init__(self, trie: dict, ids: dict[str, int], unknown: float, spelt: Callable[[str], list[int]]) -> None:
        self.unknown, self.spelt = unknown, spelt  # score and ids of a character that is no piece
        scores, found, more, parents, letters, queue = [-np.inf], [-1], [True], [], [], [(trie, "")]
        number = {id(trie): 0}
        for branch, text in queue:
            for c, (score, below) in branch.items():
                parents.append(number[id(branch)])
                letters.append(ord(c))
                scores.append(-np.inf if score is None else score)
                found.append(ids.get(text + c, -1) if score is not None else -1)
                more.append(below is not None)
                if below is not None:
                    number[id(below)] = len(scores) - 1
                    queue.append((below, text + c))
        self.score, self.id, self.more = np.array(scores), np.array(found, np.int64), np.array(more)
        keys = mix(np.array(parents, np.uint64) << np.uint64(21) | np.array(letters, np.uint64))
        order = np.argsort(keys)
        self.child, self.index = order + 1, Index(keys[order])
        self.single = np.zeros(_CHARACTERS, bool)
        self.single[[ord(c) for c, (score, _) in trie.items() if score is not None]] = True

    def take(self, windows: list[str]) -> list[tuple[bytes, int]]:
        """Of each window the ids that it commits, as bytes, and the boundary up to which."""
        if not windows:
            return []
        codes = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        n = np.array([len(w) for w in windows])
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        base = at + np.arange(len(n))  # places are one more than characters
        best, back, piece = np.full(len(codes) + len(n), -1e300), np.zeros(len(codes) + len(n), np.int64), np.zeros(len(codes) + len(n), np.int64)
        best[base] = 0.0
        order = np.argsort(-n, kind="stable")
        ends = np.searchsorted(-n[order], -np.arange(int(n.max()) + 1), side="left")  # windows longer than i are the first ends[i]
        alive: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(int(n.max())):
            w = order[: ends[i]]
            node, here, place = np.zeros(len(w), np.int64), best[base[w] + i], base[w] + i
            own = codes[at[w] + i]
            odd = np.flatnonzero(~self.single[own])
            odd = odd[here[odd] + self.unknown > best[place[odd] + 1]]
            to = place[odd] + 1
            best[to], back[to], piece[to] = here[odd] + self.unknown, i, -1 - own[odd]
            d = 0
            while len(w):
                k, there = self.index.find(mix(node.astype(np.uint64) << np.uint64(21) | codes[at[w] + i + d].astype(np.uint64)))
                w, here, place, node = w[there], here[there], place[there], self.child[k[there]]
                d += 1
                total, to = here + self.score[node], place + d
                better = total > best[to]
                to = to[better]
                best[to], back[to], piece[to] = total[better], i, self.id[node[better]]
                more = self.more[node]
                last = more & (n[w] == i + d)
                if last.any():
                    alive.append((w[last], np.full(int(last.sum()), i)))
                on = more & (n[w] > i + d)
                w, here, place, node = w[on], here[on], place[on], node[on]
        meet = n.copy()
        if alive:
            self._meet(meet, *(np.concatenate(x) for x in zip(*alive, strict=True)), base, back)
        ids, cuts = self._ids(meet, base, back, piece)
        spelt = np.unique(np.searchsorted(cuts, np.flatnonzero(ids < 0), side="right") - 1)
        data, four = ids.astype("<u4").tobytes(), (4 * cuts).tolist()
        out = [(data[four[k] : four[k + 1]], m) for k, m in enumerate(meet.tolist())]
        for k in spelt.tolist():
            whole = [x for i in ids[cuts[k] : cuts[k + 1]].tolist() for x in ([i] if i >= 0 else self.spelt(chr(-1 - i)))]
            out[k] = (np.array(whole, "<u4").tobytes(), out[k][1])
        return out

    @staticmethod
    def _meet(meet: np.ndarray, w: np.ndarray, i: np.ndarray, base: np.ndarray, back: np.ndarray) -> None:
        """Move each window's boundary to where the paths back from it and from its survivors meet, the last survivor first."""
        order = np.lexsort((-i, w))
        w, i = w[order], i[order]
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        rank = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        for r in range(int(rank.max()) + 1):
            own = w[rank == r]
            a, b = meet[own], i[rank == r]
            while (a != b).any():
                far = a > b
                a = np.where(far, back[base[own] + a], a)
                b = np.where(~far & (a != b) & (b > a), back[base[own] + b], b)
            meet[own] = a

    @staticmethod
    def _ids(meet: np.ndarray, base: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all windows up to their boundaries, and where each window's begin."""
        count, place = np.zeros(len(meet), np.int64), meet.copy()
        while (some := np.flatnonzero(place > 0)).size:
            count[some] += 1
            place[some] = back[base[some] + place[some]]
        cuts = np.concatenate([[0], np.cumsum(count)])
        out, to, place = np.zeros(cuts[-1], np.int64), cuts[1:].copy(), meet.copy()
        while (some := np.flatnonzero(place > 0)).size:
            to[some] -= 1
            spot = base[some] + place[some]
            out[to[some]] = piece[spot]
            place[some] = back[spot]
        return out, cuts
