"""Words of whole texts, found and hashed for many documents at once.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which is also
what ``bytes.split()`` returns.  ``iter_slices`` cuts an Arrow batch into runs of
whole documents of a few MB, so that the working arrays stay small however long
the batch is; a single longer document forms a slice of its own, whose words are
hashed by pieces of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_BASE_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base (0) or of its inverse (1), modulo 2^64."""
    if len(_powers[which]) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, (_BASE, _BASE_INV)[which], dtype=np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of consecutive documents: document i has words offsets[i] to offsets[i+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    first_row: int
    byte_offsets: np.ndarray
    _hash: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            # by pieces of whole words, so that sums and powers stay small however long the text is
            out = np.empty(len(self.starts), np.uint64)
            a = 0
            while a < len(out):
                low = self.starts[a]
                z = max(a + 1, int(np.searchsorted(self.ends, low + SLICE_BYTES, "right")))
                at, to = self.starts[a:z] - low, self.ends[a:z] - low
                n = int(to[-1])
                cum = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE[self.data[low : low + n]] * _power(0, n), out=cum[1:])
                out[a:z] = mix((cum[to] - cum[at]) * _power(1, n + 1)[at] + (to - at).astype(np.uint64))
                a = z
            self._hash = out
        return self._hash

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.offsets))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def iter_slices(column: pa.Array, lower: bool, slice_bytes: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of every row, by slices of whole documents."""
    at, data = text_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(at, at[row] + slice_bytes, "right")) - 1)
        part = data[at[row] : at[stop]]
        if lower:
            part = _LOWER[part]
        yield split_words(part, at[row : stop + 1] - at[row], row)
        row = stop


def split_words(part: np.ndarray, at: np.ndarray, first_row: int = 0) -> Words:
    solid = ~_SPACE[part]
    n = len(part)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return Words(part, starts, ends, np.searchsorted(starts, at), first_row, at)
