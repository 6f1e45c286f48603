"""Vectorised words and word hashes of Arrow text columns, for use inside tasks.

Texts are handled as UTF-8 bytes.  Every byte of a non-ASCII character is 0x80 or more, so a word
pattern that treats all non-ASCII characters alike can be decided byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z and non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Words ``[^\x20\x09-\x0D]+``: whatever stands between white space.
SPACED = np.ones(256, bool)
SPACED[9:14] = SPACED[32] = False

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(32))) * _P
    h = (h ^ (h >> np.uint64(29))) * _Q
    return h ^ (h >> np.uint64(32))


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of slices of a string column; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """The words of several texts: byte starts and ends, and each text's first word in ``bounds``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        inside = kind[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        first = offsets[:-1][offsets[:-1] < len(inside)]
        before[first] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[first[first > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a time."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        lanes = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        left = self.ends - self.starts
        h = left.astype(np.uint64) * _P
        which = np.arange(len(left))
        at = self.starts
        while len(which):
            h[which] = mixed(h[which] ^ (lanes[at] & _MASKS[np.minimum(left, 8)]))
            more = left > 8
            which, at, left = which[more], at[more] + 8, left[more] - 8
        return h

    def text(self, first: int, last: int) -> str:
        """The words ``first`` up to ``last``, joined by blanks."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[first:last], self.ends[first:last])).decode("utf-8", "replace")


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n consecutive words; as many as start in the array and fit in it."""
    size = max(0, len(hashes) - n + 1)
    h = hashes[:size].copy()
    for j in range(1, n):
        h = mixed(h * _Q + hashes[j : j + size])
    return h
