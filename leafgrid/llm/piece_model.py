"""SentencePiece encoding and decoding: Viterbi over pieces, as a stream.

A text is read part by part. Each position keeps the best sum of scores that reaches it and
a pointer back. A later piece can only follow the end, or a position from which the text
so far is the beginning of a longer piece; these positions survive, and all of them lie within
the longest piece. Whenever the paths back from the survivors meet at one boundary, all before it
is settled: its ids are committed and forgotten. On ordinary text that happens at nearly every
space; a run of one letter can keep several alignments open to its end.

What a part commits depends on it and the open window alone, as the sums count from the last
settled boundary. A stream therefore remembers its own steps for short windows: each
window is a state, which maps parts to the ids committed and the next state. Steps that are new
in a batch of texts are taken side by side (``piece_steps``).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import filterfalse

import numpy as np

from leafgrid.llm.piece_steps import Steps

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: How much below the least score a character that no piece covers counts.
PENALTY = 10.0
#: Steps remembered in one worker process, and the longest window and part of one.
REMEMBERED, SHORT = 1_000_000, 64
#: Steps that are taken side by side.
TOGETHER = 100_000
#: Characters of a text that are prepared at once.
SLICE = 1 << 20
#: A window longer than this looks for a boundary only when it has grown by an eighth.
WIDE = 1024


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class State(dict):
    """A short open window: of parts, the committed ids and the state after them."""

    __slots__ = ("open",)

    def __init__(self, open_: str) -> None:
        super().__init__()
        self.open = open_


@dataclass
class PieceModel:
    """Pieces with scores, and how texts are prepared: a space in front, spaces as U+2581."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    prefix: bool = True
    ids: dict[str, int] = field(init=False)
    bytes_of: list[bytes] = field(init=False)
    #: of a character: the score of the piece that ends with it, if one does, and what may follow, if anything may
    trie: dict = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - PENALTY
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self.single = {p for p in self.ids if len(p) == 1}
        self.trie = self._branch(sorted(self.ids), 0)
        self.side_by_side = Steps(self.trie, self.ids, self.unknown_score, self.piece_ids)
        self.states: dict[str, State] = {}
        self.steps = 0

    def _branch(self, pieces: list[str], depth: int) -> dict:
        out = {}
        at = 0
        while at < len(pieces):
            end = at
            while end < len(pieces) and pieces[end][depth] == pieces[at][depth]:
                end += 1
            whole = len(pieces[at]) == depth + 1
            more = pieces[at + whole : end]
            out[pieces[at][depth]] = (self.scores[self.ids[pieces[at]]] if whole else None, self._branch(more, depth + 1) if more else None)
            at = end
        return out

    @classmethod
    def load(cls, path: str) -> PieceModel:
        pieces, scores, kinds, prefix = [], [], [], True
        with open(path, "rb") as f:
            for k, v in _fields(f.read()):
                if k == 1:
                    own = dict(_fields(v))
                    pieces.append(own[1].decode())
                    scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                    kinds.append(own.get(3, NORMAL))
                elif k == 3:
                    prefix = bool(dict(_fields(v)).get(3, 1))
        return cls(pieces, scores, kinds, prefix)

    def prepared(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def restored(self, data: bytes) -> str:
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def piece_ids(self, piece: str) -> list[int]:
        """The id of a piece; of a character that is none, its bytes or the unknown id."""
        if piece in self.ids:
            return [self.ids[piece]]
        if self.byte_ids:
            return [self.byte_ids[b] for b in piece.encode()]
        return [self.unknown]

    def state(self, window: str) -> State:
        if self.steps > REMEMBERED:
            self.states, self.steps = {}, 0
        found = self.states.get(window)
        if found is None:
            found = self.states[window] = State(window)
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, by a stream over it."""
        if not text:
            return np.zeros(0, np.uint32)
        stream = Stream(self)
        out = []
        for at in range(0, len(text), SLICE):
            parts = _PART.findall(self.prepared(text[:SLICE]) if not at else text[at : at + SLICE].replace(" ", SPACE))
            self.prime(parts)
            out.append(stream.feed_parts(parts))
        out.append(stream.finish())
        return np.frombuffer(b"".join(out), "<u4")

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts. Steps after a space that are new here are left open at first, taken side by side, and filled in;
        a text whose open step did not lead back to a space is read again."""
        made: list[tuple[list[str], list[bytes | None], list[int]] | None] = []
        new: set[str] = set()
        start = self.state(SPACE)
        for text in texts:
            if not text or len(text) > SLICE:
                made.append(None)
                continue
            parts, out, holes, stream = _PART.findall(self.prepared(text)), [], [], Stream(self)
            state = stream.state
            for part in parts:
                step = state.get(part)
                if step is None:
                    if state is start:
                        holes.append(len(out))
                        out.append(None)
                        new.add(part)
                        continue
                    step = stream._step(state, part)
                    if step[1] is None:  # a window stays open for long
                        break
                out.append(step[0])
                state = step[1]
            if len(out) == len(parts):
                stream.state = state
                out.append(stream.finish())
            made.append((parts, out, holes))
        self.prime(new)
        return [np.frombuffer(b"".join(m[1]), "<u4") if m and self._filled(*m) else self.encode(text) for text, m in zip(texts, made, strict=True)]

    def _filled(self, parts: list[str], out: list[bytes | None], holes: list[int]) -> bool:
        """Fill in the open steps of a text; False where it must be read again."""
        if len(out) <= len(parts):
            return False
        start = self.state(SPACE)
        for at in holes:
            step = start.get(parts[at])
            if step is None:
                return False
            out[at] = step[0]
            if step[1] is not start:
                if at + 1 < len(parts):
                    return False
                end = Stream(self)  # the last part leaves another window
                end.state = step[1]
                out[-1] = end.finish()
        return True

    def prime(self, parts: Iterable[str]) -> None:
        """Take the steps of parts after a space that are not in store yet."""
        start = self.state(SPACE)
        new = list(set(filterfalse(start.__contains__, parts)))
        if self.steps + len(new) > REMEMBERED:  # what is known goes; what is missing now is taken one by one
            self.states, self.steps = {}, 0
            start = self.state(SPACE)
        if len(new) > REMEMBERED:
            return
        self.steps += len(new)
        for at in range(0, len(new), TOGETHER):
            some = new[at : at + TOGETHER]
            for part, (ids, n) in zip(some, self.side_by_side.take([SPACE + p for p in some]), strict=True):
                if n == len(part) and part[-1] == SPACE:
                    start[part] = (ids, start)
                    continue
                open_ = part[n - 1 :] if n else SPACE + part
                if len(open_) <= SHORT:
                    start[part] = (ids, self.states.get(open_) or State(open_))
                    self.states.setdefault(open_, start[part][1])

    def decode(self, ids: np.ndarray) -> str:
        return self.restored(b"".join(map(self.bytes_of.__getitem__, ids.tolist())))


#: A word and the space after it, as the boundary before a space settles when the space is read.
_PART = re.compile(f"[^{SPACE}]{{1,{SHORT - 16}}}{SPACE}?|{SPACE}{{1,{SHORT}}}")


class Stream:
    """Takes prepared text in parts of any length and gives ids, as bytes of 32-bit numbers, as soon as they are settled."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.state: State | None = model.state("")  # the open window, while it is short
        self.width = 0  # the longest window ever open after a step, and the steps that committed, for tests
        self.commits = 0
        self._load("")

    def _load(self, window: str) -> list[int]:
        """Take up a window as if it had been read since a settled boundary; gives the survivors."""
        self.parts = [window]  # of the window, from the last settled boundary on
        self.tail = window[-self.model.longest :]
        self.best: list[float] = [0.0]  # of each position of the window
        self.back: list[int] = [0]
        self.looked = 0  # length of the window when a boundary was last looked for
        return self._reach(window, window)

    def feed(self, text: str) -> bytes:
        """Ids that this part of the text settles."""
        return self.feed_parts(_PART.findall(text))

    def feed_parts(self, parts: list[str]) -> bytes:
        out = []
        state = self.state
        for part in parts:
            step = state.get(part) if state is not None else None
            if step is None:
                step = self._step(state, part)
            out.append(step[0])
            state = step[1]
        self.state = state
        return b"".join(out)

    def finish(self) -> bytes:
        """Ids of what is left."""
        if self.state is not None:
            self._load(self.state.open)
        out = self._commit(len(self.back) - 1)
        self.state = self.model.state("")
        return out

    def _step(self, state: State | None, part: str) -> tuple[bytes, State | None]:
        """Read a part; remembered where the windows before and after are short."""
        model = self.model
        if state is not None:
            survivors = self._load(state.open + part)
        else:
            self.tail += part
            survivors = self._reach(part, self.tail)
            self.tail = self.tail[-model.longest :]
            self.parts.append(part)
        n = len(self.back) - 1
        ids = b""
        if n < WIDE or n > self.looked * 9 // 8:
            self.looked = n
            ids = self._commit(self._meeting(survivors))
            n = len(self.back) - 1
        self.width = max(self.width, n)
        after = model.state("".join(self.parts)) if n <= SHORT else None
        if state is not None and after is not None:
            state[part] = (ids, after)
            model.steps += 1
        return ids, after

    def _reach(self, part: str, text: str) -> list[int]:
        """Best sums of the positions of a new part; text ends with it and begins a piece's length before. Gives the survivors."""
        best, back, trie, longest, single, unknown = self.best, self.back, self.model.trie, self.model.longest, self.model.single, self.model.unknown_score
        done = len(best) - 1
        n = done + len(part)
        off = n - len(text)  # place of the text in the window
        best += [float("-inf")] * len(part)
        back += [0] * len(part)
        survivors = []
        for i in range(max(0, done - longest + 1), n):
            here, j, node = best[i], i, trie
            for c in text[i - off : i - off + longest]:
                found = node.get(c)
                if found is None:
                    node = None
                    break
                j += 1
                score, node = found
                if score is not None and j > done and here + score > best[j]:
                    best[j] = here + score
                    back[j] = i
                if node is None:
                    break
            if node is not None and j == n:
                survivors.append(i)
            if i >= done and text[i - off] not in single and here + unknown > best[i + 1]:
                best[i + 1] = here + unknown
                back[i + 1] = i
        survivors.append(n)
        return survivors

    def _meeting(self, survivors: list[int]) -> int:
        """The last boundary that the paths back from all survivors share."""
        back = self.back
        at = survivors[-1]
        for other in reversed(survivors[:-1]):
            while at != other:
                if at > other:
                    at = back[at]
                else:
                    other = back[other]
        return at

    def _commit(self, at: int) -> bytes:
        if not at:
            return b""
        self.commits += 1
        window, back, ids = "".join(self.parts), self.back, self.model.ids
        out: list[int] = []
        end = at
        while end:
            begin = back[end]
            found = ids.get(window[begin:end])
            if found is None:
                out += reversed(self.model.piece_ids(window[begin:end]))
            else:
                out.append(found)
            end = begin
        out.reverse()
        base = self.best[at]
        self.parts, self.looked = [window[at:]], 0
        self.tail = self.parts[0][-self.model.longest :]
        # a position that no survivor's path goes through may point before the boundary; nothing follows it
        self.best, self.back = [x - base for x in self.best[at:]], [x - at if x > at else 0 for x in back[at:]]
        return struct.pack(f"<{len(out)}I", *out)


class Decoder:
    """Takes ids in parts and gives text; bytes of an open character wait."""

    def __init__(self, model: PieceModel) -> None:
        import codecs

        self.model = model
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = not model.prefix

    def feed(self, ids: list[int]) -> str:
        return self._trim(self.bytes.decode(b"".join(self.model.bytes_of[i] for i in ids)))

    def finish(self) -> str:
        return self._trim(self.bytes.decode(b"", True))

    def _trim(self, text: str) -> str:
        if not self.begun and text:
            self.begun = True
            return text[1:] if text[0] == " " else text
        return text
