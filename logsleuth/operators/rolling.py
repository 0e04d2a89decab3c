"""Sliding order statistics of one chunk of a series (wide windows of W1).

The values of the window are kept in order: a step inserts and removes one value
by binary search, the median is read off, and the median absolute deviation is
selected from the two ordered runs on either side of the median by another binary
search.  A row so costs about log w steps, whatever the window.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def kth_deviation(ordered: list, m: float, k: int) -> float:
    """The ``k``-th smallest (from 0) of ``|v - m|`` over an ordered list."""
    p = bisect_left(ordered, m)
    lo, hi = max(0, k + 1 - (len(ordered) - p)), min(k + 1, p)
    while lo < hi:  # how many of the k + 1 nearest values lie below m
        t = (lo + hi) // 2
        if m - ordered[p - 1 - t] < ordered[p + k - t] - m:
            lo = t + 1
        else:
            hi = t
    below = m - ordered[p - lo] if lo else 0.0
    above = ordered[p + k - lo] - m if lo <= k else 0.0
    return max(below, above)


def _mad(ordered: list, m: float) -> float:
    n = len(ordered)
    if np.isfinite(m):
        return (kth_deviation(ordered, m, (n - 1) // 2) + kth_deviation(ordered, m, n // 2)) / 2
    dev = np.sort(np.abs(np.asarray(ordered) - m))  # infinite median: NaN sorts last
    return float(dev[(n - 1) // 2] + dev[n // 2]) / 2


def sliding_scores(x: np.ndarray, h: int, first: int, last: int, const: float) -> list:
    """Absolute modified z of rows ``first`` to ``last`` (exclusive) against the rows
    at most ``h`` away; None where the window holds NaN.  MAD 0 falls back to the
    population std, a constant window scores 0."""
    bad = np.concatenate([[0], np.cumsum(np.isnan(x))])
    vals, window, out = x.tolist(), [], []
    start = end = max(0, first - h)
    with np.errstate(all="ignore"):
        for i in range(first, last):
            a, b = max(0, i - h), min(len(vals), i + h + 1)
            for v in vals[end:b]:
                if v == v:
                    insort(window, v)
            for v in vals[start:a]:
                if v == v:
                    del window[bisect_left(window, v)]
            start, end = a, b
            if bad[b] > bad[a]:
                out.append(None)
                continue
            n = len(window)
            m = (window[(n - 1) // 2] + window[n // 2]) / 2
            mad = _mad(window, m)
            if mad != 0:
                out.append(abs(const * (vals[i] - m) / mad))
            elif window[0] == window[-1]:
                out.append(0.0)
            else:
                seg = x[a:b]
                out.append(float(abs(vals[i] - seg.mean()) / seg.std()))
    return out


def score_chunk(h: int, score_col: str, const: float, columns: list):
    """A function of one chunk (Arrow table with ``_pos``, ``_x``, ``_own``) that
    returns its own rows with their scores."""
    def run(chunk: pa.Table) -> pa.Table:
        chunk = chunk.take(pc.sort_indices(chunk, sort_keys=[("_pos", "ascending")]))
        own = np.flatnonzero(chunk.column("_own").to_numpy())
        if not len(own):
            return chunk.slice(0, 0).select(columns).append_column(score_col, pa.array([], pa.float64()))
        first, last = int(own[0]), int(own[-1]) + 1
        scores = sliding_scores(chunk.column("_x").to_numpy(), h, first, last, const)
        rows = chunk.slice(first, last - first).select(columns)
        return rows.append_column(score_col, pa.array(scores, pa.float64()))
    return run
