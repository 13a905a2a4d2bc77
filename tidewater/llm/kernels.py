"""Array kernels over Arrow string buffers: word spans, word hashes and set signatures.

All of them work on whole blocks of texts at once; no step runs per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in blocks of about this many bytes, so that arrays of eight bytes a byte stay small.
BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on each of the input."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _letters() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=U)
    plain = mix(code * U(0xD6E8FEB86659FD93) + U(1))
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    return plain, lower


PLAIN, LOWER = _letters()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK * 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, U)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of runs of rows with about `limit` bytes; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row]: offsets[end]], offsets[row: end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each text (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(stop) + 1, np.searchsorted(first, offsets, "left")


def running(data: np.ndarray, letters: np.ndarray = PLAIN) -> np.ndarray:
    """Sums over the bytes before each place; `hashed` makes hashes of spans from them."""
    run = np.zeros(len(data) + 1, U)
    np.cumsum(letters[data] * powers(len(data))[0][:-1], out=run[1:])
    return run


def hashed(run: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return mix((run[last] - run[first]) * powers(len(run))[1][first] + (last - first).astype(U))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, letters: np.ndarray = PLAIN) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return hashed(running(data, letters), first, last)


def windows(values: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of `size` values inside one text, and the first of each text."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], n)
    up, _ = powers(size)
    total = np.zeros(len(at), U)
    for k in range(size):
        total += values[at + k] * up[k + 1]
    return mix(total), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and the first of each; a short text is one shingle."""
    start, stop, bounds = word_spans(data, offsets)
    hashes = span_hashes(data, start, stop, LOWER)
    n = np.diff(bounds)
    made, first = windows(hashes, bounds, size)
    short = np.flatnonzero((n > 0) & (n < size))
    parts, counts = [], np.zeros(len(n), np.int64)
    one = {}
    up, _ = powers(size)
    for d in short:
        w = hashes[bounds[d]: bounds[d + 1]]
        one[d] = mix((w * up[1: len(w) + 1]).sum(dtype=U, keepdims=True) + U(len(w)))
    for d in range(len(n)):
        got = one.get(d)
        if got is None:
            got = np.sort(made[first[d]: first[d + 1]])
            if len(got) > 1:
                keep = np.ones(len(got), bool)
                np.not_equal(got[1:], got[:-1], out=keep[1:])
                got = got[keep]
        parts.append(got)
        counts[d] = len(got)
    return np.concatenate(parts) if parts else np.zeros(0, U), np.concatenate([[0], np.cumsum(counts)])


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each run of values modulo 2 ** 64; an empty run is 0."""
    run = np.zeros(len(values) + 1, U)
    np.cumsum(values, out=run[1:])
    return run[bounds[1:]] - run[bounds[:-1]]
