"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than space and \\t..\\r, with A-Z lower-cased.
Hashes are 64 bits wide and depend only on the words' bytes, so equal words hash
alike on every executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SHINGLE = 5

_rng = np.random.Generator(np.random.Philox(20240117))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Lookup:
    """Values of distinct 64-bit keys, looked up for whole arrays at once (open addressing, half full at most)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = U64(64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2)))))
        self.slots = np.full(1 << int(U64(64) - self.shift), -1, dtype=np.int64)
        self.values = np.full(len(self.slots), -1, dtype=np.int64)
        self.probes, todo = 0, np.arange(len(keys))
        while len(todo):  # each key goes to the first free slot of its probes
            at = self._slot(keys[todo], self.probes)
            _, first = np.unique(at, return_index=True)
            first = first[self.slots[at[first]] < 0]
            self.slots[at[first]], self.values[at[first]] = keys[todo[first]], values[todo[first]]
            todo, self.probes = np.delete(todo, first), self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys.astype(U64) * _BASE >> self.shift).astype(np.int64) + probe) & (len(self.slots) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key (keys are 0 or more), -1 where there is none."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for probe in range(self.probes):
            at = self._slot(keys[todo], probe)
            held = self.slots[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
        return out


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows end to end, and the offsets of the rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word in order, and for each row the index of its first word (one more entry than rows)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data), dtype=np.int32 if len(data) < 2**31 else np.int64)
    place[starts[0] :] -= np.repeat(starts.astype(place.dtype), lengths)
    power = np.full(int(lengths.max()) + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    terms = _BYTE[_FOLD[data]]
    terms[starts[0] :] *= power[place[starts[0] :]]
    terms[~inside] = 0
    return mix(np.add.reduceat(terms, starts)), first


def shingle_sets(column: pa.Array, stretch: int = 1 << 20) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its five-word shingles; with fewer words, of the whole sequence.

    Rows are worked on in stretches of about ``stretch`` bytes, which bounds the arrays of a batch of long texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets = flat_utf8(column)
    out, begin = [], 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + stretch, side="right")) - 1)
        out.extend(_sets(column.slice(begin, end - begin)))
        begin = end
    return out


def _sets(column: pa.Array) -> list[np.ndarray]:
    hashes, first = word_hashes(*flat_utf8(column))
    count = np.diff(first)
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(SHINGLE):
        rolled[: len(hashes) - k] += hashes[k:] * _PLACE[k]
    rolled = mix(rolled)
    out = []
    for i, n in enumerate(count):
        a = first[i]
        if n >= SHINGLE:
            s = np.sort(rolled[a : a + n - SHINGLE + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([(hashes[a : a + n] * _PLACE[:n]).sum() + U64(n) * _PLACE[SHINGLE]], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
