"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, no loop over rows or words.

A null text has no words, like an empty one. Bytes of 0x80 and above count as letters, so words of any script stay whole.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  glibc alone has it
except (OSError, AttributeError):
    _LIBC = None
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
_VALUES[0] = 0
_BASE = 0x9E3779B97F4A7C15
_UP = np.ones(1, U)
_DOWN = np.ones(1, U)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(n, 2 * len(_UP), 1 << 16)
        for name, base in (("_UP", _BASE), ("_DOWN", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, U)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _UP, _DOWN


def _table(keep: str) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isalnum():
            t[b] = b
        elif keep == "space" and not c.isspace() and b > 32:
            t[b] = b
    if keep == "word":
        t[65:91] += 32
    return t


WORD = _table("word")
"""Lower-cased runs of ASCII letters, digits and non-ASCII bytes."""
SPACED = _table("space")
"""Runs of anything but ASCII white space and control characters, as written."""


@dataclass
class Words:
    start: np.ndarray  # byte offsets into buf
    end: np.ndarray
    hash: np.ndarray  # uint64
    row: np.ndarray  # words of text i: row[i] to row[i + 1]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, size: int = 1 << 20):
    """(first row, bytes, offsets) of runs of rows of about `size` bytes; a longer text is a run of its own.

    After the last one, memory that the allocators hold without need goes back to the system: workers are kept between stages.
    """
    buf, off = text_bytes(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _sums(mapped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(total, down): (total[j] - total[i]) * down[i] is a hash of the mapped bytes i to j, wherever they lie."""
    n = len(mapped)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(_VALUES[mapped] * up[:n], out=total[1:])
    return total, down


def sums(buf: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Running sums for the hashes of parts of words."""
    return _sums(table[buf])


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORD) -> Words:
    """Every word of the texts with a 64-bit hash of its mapped bytes."""
    n = len(buf)
    m = table[buf]
    inside = m != 0
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = off[:-1][off[:-1] < n]
    before[heads] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total, down = _sums(m)
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))
    return Words(start, end, h, np.searchsorted(start, off))


def distinct_per_row(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 42-bit key, count) of the distinct words of each row, sorted by row and key. At most 2**21 rows."""
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    packed = np.sort((w.owner().astype(U) << U(42)) | (w.hash >> U(22)))
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    u = packed[first]
    return (u >> U(42)).astype(np.int64), u & U((1 << 42) - 1), np.diff(np.append(first, len(packed)))
