"""Word tables of Arrow text batches in numpy: spans, 64-bit word and n-gram hashes, all over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text handled at once; a longer single text is one part of its own.
PART_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_parts(column: pa.Array, limit: int = PART_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for runs of at most ``rows`` rows and about ``limit`` bytes; null texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        end = min(end, start + rows, len(column))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the offsets of each row's words in them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = SPACE[data]
    before, after = np.empty_like(blank), np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    after[-1], after[:-1] = True, blank[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse powers modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, PART_BYTES + 1)
        tables = []
        for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = tables[0], tables[1]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by differences of one running polynomial sum."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes (across rows: the caller knows where they end); len(words) - n + 1 of them."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = _power(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


def within(row_offsets: np.ndarray, n: int) -> np.ndarray:
    """Positions at which ``n`` consecutive elements of one row start."""
    total = int(row_offsets[-1])
    good = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):  # a start less than n before a row's end crosses it
        at = row_offsets[1:] - k
        at = at[(at >= 0) & (at < len(good)) & (at >= row_offsets[:-1])]
        good[at] = False
    return np.flatnonzero(good)


def rows_of(positions: np.ndarray, row_offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(row_offsets, positions, side="right") - 1


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
