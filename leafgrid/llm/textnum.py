"""Words of many texts at once, as hashes in numpy arrays.

Words are maximal runs of bytes other than \\x20 and \\x09-\\x0D, with A-Z lower-cased.
Arrays are worked on in slices of a few MB, so that long texts cost time, not memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE = 1 << 21

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SALT = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def _space(x: np.ndarray) -> np.ndarray:
    return ((x - np.uint8(9)) < 5) | (x == 32)


def _lowered(x: np.ndarray) -> np.ndarray:
    return x + ((x - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the end of each in the bytes, and bounds: text i has words bounds[i]:bounds[i+1]."""
    data, offsets = raw(texts)
    begins, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _space(data[end - 1 : end])[0]:  # a slice ends after a space or a text
            nxt = np.flatnonzero(_space(data[end : end + SLICE]))
            k = np.searchsorted(offsets, end)
            stop = offsets[k] if k < len(offsets) else len(data)
            end = int(min(end + nxt[0] + 1 if len(nxt) else end + SLICE, stop, len(data)))
            if end == stop:
                break
        b, e, h = _hashed(data[at:end], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at, lower)
        begins.append(b + at)
        ends.append(e + at)
        hashes.append(h)
        at = end
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return found, np.concatenate(ends) if ends else begin, np.searchsorted(begin, offsets)


def _hashed(data: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of each word; cuts: where texts begin."""
    n = len(data)
    solid = ~_space(data)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    first[cuts] = solid[cuts]
    inner = cuts[cuts > 0] - 1
    last[inner] = solid[inner]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _lowered(data) if lower else data
    eights = np.ndarray((n + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    long = end - begin
    found = mix((eights[begin] & _MASK[np.minimum(long, 8)]) + long.astype(np.uint64) * _SALT[0])
    some, k = np.flatnonzero(long > 8), 8
    while len(some):
        part = eights[begin[some] + k] & _MASK[np.minimum(long[some] - k, 8)]
        found[some] = mix((found[some] ^ part) + _SALT[1])
        k += 8
        some = some[long[some] > k]
    return begin, end, found


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of fewer words, one of the whole run; none without words."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out += hashes[i : i + len(out)] * _SALT[i]
    return mix(out + np.uint64(k))


def digests(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a sequence of words, as signed integers."""
    n = len(hashes)
    if not n:
        return 0, 0
    place = mix(np.arange(1, n + 1, dtype=np.uint64))
    a = mix(np.array([(hashes * (place | np.uint64(1))).sum() + np.uint64(n)], np.uint64))
    b = mix(np.array([(mix(hashes + place) * (place >> np.uint64(1) | np.uint64(1))).sum() ^ np.uint64(n)], np.uint64))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def by_size(batch: pa.RecordBatch, column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with few bytes of text, or one row."""
    texts = batch.column(column)
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0)
    at, held = 0, 0
    for i, s in enumerate(sizes):
        if i > at and held + s > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += s
    if at < batch.num_rows:
        yield batch.slice(at)
