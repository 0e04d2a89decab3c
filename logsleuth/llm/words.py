"""Word positions and 64-bit word hashes of text batches, vectorised over bytes.

A batch's UTF-8 bytes are scanned with numpy in pieces of ``PIECE`` bytes, so
memory does not grow with the batch or with one very long text beyond 8 bytes
per word.  A word's hash is a mixed polynomial over its bytes modulo 2**64.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# word bytes: everything but the six ASCII white-space characters
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# alphanumeric tokens: ASCII letters and digits and every non-ASCII byte
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

class _Local(dict):
    """A cache that is empty where the functions that use it are shipped to."""

    def __reduce__(self):
        return dict, ()


_POW = _Local()


def _powers(n):
    if _POW.get("n", 0) < n:
        n = max(n, PIECE + 1)
        one = np.ones(1, dtype=np.uint64)
        _POW["n"] = n
        _POW["p"] = np.concatenate([one, np.cumprod(np.full(n, _P))])
        _POW["i"] = np.concatenate([one, np.cumprod(np.full(n, _P_INV))])
    return _POW["p"], _POW["i"]


def mix(x):
    """Finalise 64-bit values (uint64 array) so that every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch_bytes(column):
    """(uint8 data, int64 offsets) of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = pc.fill_null(column, "").cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, off


def _piece(data, bounds, table):
    """Word (start, end, hash) inside one piece; ``bounds`` are text starts in it."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    ok = table[data]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    last = ok.copy()
    last[:-1] &= ~ok[1:]
    cut = bounds[(bounds > 0) & (bounds < n)]
    both = cut[ok[cut] & ok[cut - 1]]
    first[both] = True
    last[both - 1] = True
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    pow_, inv = _powers(n)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pow_[:n], out=pre[1:])
    h = (pre[e] - pre[s]) * inv[s]
    return s, e, mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed_groups(data, offsets, table):
    """Yield ``(lo, hi, counts, hashes)`` for consecutive groups of texts
    ``lo..hi-1``: words per text and the word hashes, in order.

    A text longer than ``PIECE`` is a group of its own and is scanned in pieces
    that end between words (a single word longer than a piece is kept whole).
    """
    n = len(offsets) - 1
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        a, b = int(offsets[lo]), int(offsets[hi])
        if b - a <= PIECE:
            s, _, h = _piece(data[a:b], offsets[lo:hi] - a, table)
            counts = np.diff(np.searchsorted(s, offsets[lo:hi + 1] - a, side="left"))
            yield lo, hi, counts, h
        else:
            parts = []
            while a < b:
                c = min(a + PIECE, b)
                while c < b:  # move the cut to the end of the word it is in
                    gap = np.flatnonzero(~table[data[c:min(c + PIECE, b)]])
                    if len(gap):
                        c += int(gap[0])
                        break
                    c = min(c + PIECE, b)
                parts.append(_piece(data[a:c], np.zeros(0, np.int64), table)[2])
                a = c
            h = np.concatenate(parts)
            yield lo, hi, np.array([len(h)]), h
        lo = hi


def window_hashes(h, size, seed=0):
    """Hash of every window of ``size`` consecutive word hashes (order counts)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = mix(h + np.uint64(seed)) if seed else h
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out *= _P
        out += x[j:j + n]
    return mix(out)
