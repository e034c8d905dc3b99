"""Statistics of many overlapping ranges of sorted samples, from mergeable states of dyadic panes.

A pane of 2^j samples holds count, means, central moments, the co-moment with time, least and greatest value. Panes are merged
pairwise level by level, and every range takes the panes of its length's binary digits: n log w steps for ranges
of up to w samples however much they overlap, without differences of running sums, so a constant range has deviation 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Elements that are laid out at once where a range has to be looked at itself (medians, thresholds).
EXPANDED = 1 << 18


def _digits(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(pane size, ranges that take a pane of it, where their panes begin) for ascending sizes."""
    length, at, size = hi - lo, lo.copy(), 1
    most = int(length.max(initial=0))
    while size <= most:
        some = np.flatnonzero(length & size)
        yield size, some, at[some]
        at[some] += size
        size *= 2


def reduced(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, merge: Callable, empty: float) -> np.ndarray:
    """``merge`` (maximum, add, ...) over ``values[lo:hi]`` of each range."""
    out, pane = np.full(len(lo), empty, np.float64), values.astype(np.float64)
    for size, some, at in _digits(lo, hi):
        if size > 1:
            half = size // 2
            pane = merge(pane[: len(pane) - half], pane[half:])
        out[some] = merge(out[some], pane[at])
    return out


def moments(v: np.ndarray, t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """n, mean, m2 (sum of squared deviations), t2, vt (the same of time, and the products), min and max of each range."""
    n = np.zeros(len(lo))
    out = {k: np.zeros(len(lo)) for k in ("mean", "t", "m2", "t2", "vt")}
    least, most = np.full(len(lo), np.inf), np.full(len(lo), -np.inf)
    m, mt, q, qt, c, low, high = v, t, np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(v)), v, v
    for size, some, at in _digits(lo, hi):
        if size > 1:
            half = size // 2
            k = len(m) - half
            dv, dt = m[half:] - m[:k], mt[half:] - mt[:k]
            q, qt, c = q[:k] + q[half:] + dv * dv * (half / 2), qt[:k] + qt[half:] + dt * dt * (half / 2), c[:k] + c[half:] + dv * dt * (half / 2)
            m, mt = m[:k] + dv / 2, mt[:k] + dt / 2
            low, high = np.minimum(low[:k], low[half:]), np.maximum(high[:k], high[half:])
        before = n[some]
        share, cross = size / (before + size), before * size / (before + size)
        dv, dt = m[at] - out["mean"][some], mt[at] - out["t"][some]
        for name, pane, between in (("m2", q, dv * dv), ("t2", qt, dt * dt), ("vt", c, dv * dt)):
            out[name][some] += pane[at] + between * cross
        out["mean"][some] += dv * share
        out["t"][some] += dt * share
        n[some] = before + size
        least[some], most[some] = np.minimum(least[some], low[at]), np.maximum(most[some], high[at])
    return {"n": n.astype(np.int64), "min": least, "max": most, **out}


def merged_panes(n: np.ndarray, mean: np.ndarray, m2: np.ndarray, low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> dict[str, np.ndarray]:
    """n, mean, m2, min and max over ranges of panes that are states already (of any counts, also 0)."""

    def joined(a: tuple, b: tuple) -> tuple:
        total = a[0] + b[0]
        share = b[0] / np.maximum(total, 1.0)
        d = b[1] - a[1]
        return total, a[1] + d * share, a[2] + b[2] + d * d * a[0] * share, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])

    size_of = len(lo)
    out = (np.zeros(size_of), np.zeros(size_of), np.zeros(size_of), np.full(size_of, np.inf), np.full(size_of, -np.inf))
    pane = (n.astype(np.float64), mean, m2, low, high)
    for size, some, at in _digits(lo, hi):
        if size > 1:
            half = size // 2
            pane = joined(tuple(x[: len(x) - half] for x in pane), tuple(x[half:] for x in pane))
        new = joined(tuple(x[some] for x in out), tuple(x[at] for x in pane))
        for x, y in zip(out, new, strict=True):
            x[some] = y
    return dict(zip(("n", "mean", "m2", "min", "max"), out, strict=True))


def _laid_out(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(ranges, owner within them, element) of the elements of all ranges, EXPANDED or so at a time."""
    ends, begin = np.cumsum(hi - lo), 0
    while begin < len(lo):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + EXPANDED, side="right")))
        length = (hi - lo)[begin:end]
        owner = np.repeat(np.arange(end - begin), length)
        yield slice(begin, end), owner, np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(lo[begin:end], length)
        begin = end


def count_above(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of each range's values are above its own limit."""
    out = np.zeros(len(lo), np.int64)
    for part, owner, at in _laid_out(lo, hi):
        out[part] = np.bincount(owner, values[at] > limit[part][owner], part.stop - part.start)
    return out


def medians(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Exact median of each range (NaN: empty)."""
    out = np.full(len(lo), np.nan)
    for part, owner, at in _laid_out(lo, hi):
        own = values[at]
        own = own[np.lexsort((own, owner))]
        length = (hi - lo)[part]
        first = np.cumsum(length) - length
        full = np.flatnonzero(length)
        a, b = own[first[full] + (length[full] - 1) // 2], own[first[full] + length[full] // 2]
        out[part.start + full] = a + (b - a) / 2
    return out
