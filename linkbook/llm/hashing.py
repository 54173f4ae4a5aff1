"""Word hashes of Arrow text batches, computed for whole batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are handled in slices of about this many bytes, so temporary arrays stay small; a longer text is a slice.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, to, content[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_hashes(content: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the index of each row's first word (one more at the end)."""
    if len(content) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[content]
    first = np.ones(len(content), bool)
    first[1:] = space[:-1]
    first[offsets[:-1][offsets[:-1] < len(content)]] = True
    starts = np.flatnonzero(first & ~space)
    final = np.ones(len(content), bool)
    final[:-1] = space[1:]
    final[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(final & ~space) + 1
    letters = (_LOWER[content] if lower else content).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(content) + 1, np.uint64)
    np.cumsum(letters * _power(_BASE, len(content)), out=total[1:])
    hashes = scramble((total[ends] - total[starts]) * _power(_INVERSE, len(content))[starts])
    return hashes, np.searchsorted(starts, offsets)


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, by its first word (runs over row ends included)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = total * np.uint64(_BASE) + hashes[i : i + n]
    return scramble(total)
