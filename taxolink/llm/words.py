"""Words and word hashes of Arrow text columns, computed with whole-array NumPy steps.

Text arrives in ``mapInArrow`` batches as one byte buffer plus offsets. Nothing here makes
a Python string per word: word borders come from a byte-class lookup, and the 64-bit hash
of every span ``[start, end)`` comes from prefix sums of ``value[byte] * base**position``
(a polynomial hash modulo 2**64, finished by a bit mixer).

A word is a maximal run of bytes other than space and 0x09-0x0D; those bytes never occur
inside a multi-byte UTF-8 character. Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BLOCK = 1 << 18
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_KEPT: dict = {"owner": None, "free": []}


def enter(owner: str, free: Callable[[], None] | None = None) -> None:
    """Called by an operator's function when a task starts.

    Python workers serve the tasks of many operators. What one keeps between its tasks (``free`` lets go of it) is
    dropped when another's task starts, and unused memory goes back to the system.
    """
    if _KEPT["owner"] != owner:
        for drop in _KEPT["free"]:
            drop()
        _KEPT["owner"], _KEPT["free"] = owner, [free] if free else []
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
            ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` for i < n at least; kept per Python worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _BLOCK + 1)
        both = []
        for b in (_BASE, _INVERSE):
            step = np.full(size, b, dtype=np.uint64)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def text_chunks(batch: pa.RecordBatch, column: str = "text",
                chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of about ``chunk_bytes`` of text: (first row, end row, bytes, offsets).

    A text longer than that is a range of its own; texts are never cut. Offsets have one entry
    more than the range has rows and start at 0.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + chunk_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the number of words before it (one entry more)."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buf]
    first = np.empty(n, dtype=bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edges = offsets[1:-1]
    first[edges[edges < n]] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of ``buf[start:end]`` per span; spans are ascending. ``lower``: A-Z as a-z."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, side="right")))
        part = buf[base:int(ends[j - 1])]
        up, down = _powers(len(part) + 1)
        values = _VALUES[_LOWER[part] if lower else part]
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values * up[:len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes (len(words) - n + 1 of them)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:count].copy()
    for k in range(1, n):
        h = h * np.uint64(_BASE) + words[k:k + count]
    return mix(h)
