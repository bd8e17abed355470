"""Words of Arrow text columns as numpy arrays, a whole batch at a time."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_B, _C = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd, so each has an inverse modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16, 0 if have is None else 2 * len(have[0]))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        have = _powers[base] = (out[0], out[1])
    return have


#: Bytes hashed together.
_CHUNK = 1 << 22


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``data[s:e]`` for spans of bytes of any length, disjoint or not.

    The sum of a random-looking number for each byte at its place in the span. Unlike a
    polynomial modulo 2**64 it has no long patterns that cancel out.
    """
    size = (ends - starts).astype(np.int64)
    out = np.zeros(len(size), np.uint64)
    upto = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _CHUNK, "right")))
        n = size[lo:hi]
        offset = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(offset, n)
        byte = data[place + np.repeat(starts[lo:hi], n)]
        terms = mix((place.astype(np.uint64) << np.uint64(8) | byte) + np.uint64(_C))
        filled = np.flatnonzero(n > 0)
        if len(filled):
            out[lo + filled] = np.add.reduceat(terms, offset[filled])
        lo = hi
    return mix(out + size.astype(np.uint64) * np.uint64(_B))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _B) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` for each pair (s, e), from one running sum.

    For runs of hashed words of at most a few hundred: longer ones can cancel out.
    """
    up, down = _power_tables(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    """``data``: bytes of all texts; ``bounds``: where each text begins, and the end of the
    last; ``starts``, ``ends``, ``doc``: byte range and text of each word; ``hash``: of its bytes."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def doc_bounds(self) -> np.ndarray:
        """Index of each text's first word, and the number of all words."""
        return np.searchsorted(self.doc, np.arange(len(self.bounds)), "left")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its rows; a null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(column: pa.Array) -> Words:
    """Runs of bytes that are not space or 0x09-0x0D, never across two rows."""
    data, bounds = text_bytes(column)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = bounds[:-1][bounds[1:] > bounds[:-1]]
    first[filled] = solid[filled]
    closing = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    last[closing] = solid[closing]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    return Words(data, bounds, starts, ends, doc, span_hash(data, starts, ends))


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each ``n``-word gram inside one text, and its hash."""
    at = np.arange(max(0, len(words.doc) - n + 1))
    at = at[words.doc[at] == words.doc[at + n - 1]] if len(at) else at
    return at, range_hash(words.hash, at, at + n, _C)
