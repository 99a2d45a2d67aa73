"""Arrays in a binary column: byte by byte of all numbers, compressed; and words as short codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pressed(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True)


def released(data: bytes, size: int) -> bytes:
    """The bytes, so many of them, that ``pressed`` was given."""
    return _CODEC.decompress(data, size, asbytes=True) if size else b""


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: how many, their kinds and lengths, then their bytes plane by plane."""
    arrays = tuple(np.ascontiguousarray(x) for x in arrays)
    head = "".join(f"{x.dtype.str[1:]}:{len(x)};" for x in arrays).encode()
    planes = [x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays]
    raw = b"".join(planes)
    return len(head).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + head + pressed(raw)


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``packed``."""
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    raw = released(blob[12 + n :], size)
    out, at = [], 0
    for one in blob[12 : 12 + n].decode().split(";")[:-1]:
        kind, long = one.split(":")
        dtype = np.dtype("<" + kind)
        k = int(long) * dtype.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw[at : at + k], np.uint8).reshape(dtype.itemsize, int(long)).T).view(dtype).reshape(-1))
        at += k
    return out


class Index:
    """Ascending hashes with a table of where those of the same first bits begin: a look-up takes a few reads."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = keys, np.uint64(64 - bits)
        edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.starts = np.append(edges, len(keys)).astype(np.int64)
        self.padded = np.append(keys, np.uint64(0))

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each x is among the keys, and whether it is there."""
        first = (x >> self.shift).astype(np.int64)
        at = self.starts[first]
        n = self.starts[first + 1] - at
        there = (n > 0) & (self.padded[at] == x)
        todo, k = np.flatnonzero(~there & (n > 1)), 1
        while len(todo):
            hit = self.padded[at[todo] + k] == x[todo]
            found = todo[hit]
            at[found] += k
            there[found] = True
            k += 1
            todo = todo[~hit]
            todo = todo[n[todo] > k]
        at[~there] = 0
        return at, there


class Common:
    """The most frequent words, most frequent first: a word is its place here, from 1 on, or 0 and its hash."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.order = np.argsort(keys).astype(np.uint32)
        self.index = Index(keys[self.order])

    def short(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and the hashes of those without one."""
        at, there = self.index.find(h)
        places = np.zeros(len(h), "<u4")
        places[there] = self.order[at[there]] + np.uint32(1)
        return places, h[~there]

    def whole(self, places: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = np.empty(len(places), np.uint64)
        there = places > 0
        out[there] = self.keys[places[there] - np.uint32(1)]
        out[~there] = rest
        return out
