"""Byte-level word splitting and hashing of Arrow text columns with numpy.

Used inside ``mapInArrow`` tasks. A record batch is worked through in blocks of
at most ``BLOCK_BYTES`` of UTF-8 (a longer document is a block of its own), so
the memory of a task is bounded by its longest document. Splitting works on
UTF-8 bytes, which is exact because every separator class used here is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = 0xD6E8FEB86659FD93
_64 = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _byte_class(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], dtype=bool)


#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lowered
ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: words ``[^\x20\x09-\x0D]+``
NOT_BLANK = _byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_blocks(column, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks ``(first row, bytes, offsets)`` of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        lo, hi = offsets[first], offsets[last]
        yield first, data[lo:hi], offsets[first: last + 1] - lo
        first = last


def split_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
    """Word start and end positions and each word's row within the block."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    row_starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[row_starts] = inside[row_starts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[row_starts[1:] - 1] = inside[row_starts[1:] - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    table = _powers.get(name)
    if table is None or len(table) < n:
        size = max(n, BLOCK_BYTES + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= 8 * BLOCK_BYTES:
            _powers[name] = table
    return table[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One mixed 64-bit polynomial hash per word, equal for equal bytes."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power_table("down", _BASE_INV, n + 1)[starts])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Mixed hash of words i..i+n-1 for every i up to len-n (by doubling)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total, done, span, power = None, 0, 1, words
    scale, factor, rest = 1, _STEP, n
    while rest:
        if rest & 1:
            part = power[done: done + count] * np.uint64(scale)
            total = part if total is None else total + part
            done += span
            scale = scale * factor & _64
        rest >>= 1
        if rest:
            power = power[: len(power) - span] + power[span:] * np.uint64(factor)
            factor = factor * factor & _64
            span *= 2
    return mix(total)


def same_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether words i..i+n-1 lie in one row, for every i up to len-n."""
    count = len(rows) - n + 1
    if count <= 0:
        return np.zeros(0, bool)
    return rows[:count] == rows[n - 1:]
