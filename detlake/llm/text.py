"""Words and characters of Arrow text columns as numpy arrays.

The kernels work on the bytes of a whole batch: no Python object is made per
word. Memory follows the piece being worked on (``PIECE`` bytes of text, or one
text if that is longer), never the table. White space is space and the
characters 0x09-0x0D; these bytes never occur inside a longer UTF-8 sequence.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
BLOCK = 1 << 15  # bytes or words whose numbers stay in a core's cache

_BYTES = np.arange(256)
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
NOT_ALNUM = ~_ALNUM
SAME = _BYTES.astype(np.uint8)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_PRIME = 0x9E3779B97F4A7C15 | 1


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the ``n + 1`` offsets of its rows; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``limit`` bytes, or of one row: first, end, bytes, offsets."""
    data, at = buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The entry of every byte in a table of 256 bytes or truth values."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(n, base & (2**64 - 1), np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return table(_PRIME), table(pow(_PRIME, -1, 2**64))


@dataclass
class Words:
    """Words of a run of rows: byte ranges, and where each row's words begin."""

    starts: np.ndarray
    ends: np.ndarray
    row_at: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.row_at) - 1), np.diff(self.row_at))


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators, within each row."""
    inside = ~looked_up(separators, data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    after = np.empty(len(data), bool)
    after[1:] = ~inside[:-1]
    after[:1] = True
    before = np.empty(len(data), bool)
    before[:-1] = ~inside[1:]
    before[-1:] = True
    starts = np.flatnonzero(inside & (after | edge[:-1]))
    ends = np.flatnonzero(inside & (before | edge[1:])) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets, "left"))


def hashes(data: np.ndarray, found: Words, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of every word, by sums of bytes times powers, block by block."""
    out = np.empty(len(found), np.uint64)
    i = 0
    while i < len(found):
        lo = found.starts[i]
        j = max(int(np.searchsorted(found.ends, lo + BLOCK, "right")), i + 1)
        hi = found.ends[j - 1]
        power, inverse = _powers(1 << max(18, int(hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, np.uint64)
        terms = looked_up(fold, data[lo:hi]).astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[:hi - lo]
        np.cumsum(terms, out=sums[1:])
        s, e = found.starts[i:j] - lo, found.ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s])
        i = j
    return out


def runs(values: np.ndarray, row_at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n`` consecutive words within rows, and where each row's runs begin.

    A row with fewer words has none.
    """
    count = np.maximum(np.diff(row_at) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(count)])
    if len(values) < n:
        return np.zeros(0, np.uint64), at
    m = len(values) - n + 1
    h = np.zeros(m, np.uint64)
    for first in range(0, m, BLOCK):
        part = h[first:first + BLOCK]
        for k in range(n):
            part = part * np.uint64(3)
            part += values[first + k:first + k + len(part)]
            part += np.uint64(k + 1)
            part = mix(part)
        h[first:first + BLOCK] = part
    keep = np.repeat(row_at[:-1], count) + np.arange(at[-1]) - np.repeat(at[:-1], count)
    return h[keep], at


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a run of rows and the offsets of its rows among them."""
    raw = data.tobytes()
    parts = [
        np.frombuffer(raw[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
    ]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), at


def add_by_row(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add values to their rows' totals; ``rows`` ascends."""
    if len(rows):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
        out[rows[cut]] += np.add.reduceat(values, cut, axis=0, dtype=out.dtype)
