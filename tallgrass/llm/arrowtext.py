"""Vectorised text primitives over the UTF-8 buffers of Arrow string arrays.

Everything here works on whole batches: a string column is one byte buffer plus offsets, and
tokens, hashes and counts are computed by numpy over that buffer.  No per-row Python runs, and
memory is bounded by slicing a batch into blocks of at most ``BLOCK_BYTES`` (a single longer
text forms its own block and is still processed whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_P = np.uint64(0x100000001B3 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_pow: dict[str, np.ndarray] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 separator, 1 letter or non-ASCII byte, 2 digit
KIND = np.zeros(256, np.uint8)
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[128:] = 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        m = max(n, BLOCK_BYTES + 16)
        with np.errstate(over="ignore"):
            for k, base in (("p", _P), ("i", _PINV)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                _pow[k] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def plain(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null becomes the empty text)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (starting at 0) of a string array without nulls."""
    _, off, dat = col.buffers()
    o = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(dat, np.uint8)[o[0] : o[-1]] if dat is not None and len(o) else np.zeros(0, np.uint8)
    return d, o - o[0]


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row."""
    n = len(col)
    if not n:
        return
    _, o = buffers(col)
    at = 0
    while at < n:
        end = int(np.searchsorted(o, o[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads entropy into the high bits used for table indices."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


class Words:
    """Tokens of a block: start, end (byte positions), row, hash and kind (1 word, 2 number).

    A token is a maximal run of letters (any non-ASCII byte counts as one) or of digits.  ASCII
    letters are lower-cased before hashing.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, *, join_digits: bool = False):
        n = len(data)
        kind = KIND[data]
        if join_digits:
            kind = np.minimum(kind, 1)
        brk = np.empty(n + 1, bool)
        brk[0] = brk[n] = True
        if n > 1:
            brk[1:n] = kind[1:] != kind[:-1]
        brk[off] = True
        cut = np.flatnonzero(brk)
        s, e = cut[:-1], cut[1:]
        keep = kind[s] > 0 if n else np.zeros(0, bool)
        self.start, self.end = s[keep], e[keep]
        self.kind = kind[self.start] if n else np.zeros(0, np.uint8)
        self.rows = len(off) - 1
        self.row = np.searchsorted(off, self.start, side="right") - 1
        self.hash = span_hash(data, self.start, self.end)
        self.data, self.off = data, off
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))
        self.count = np.diff(self.first)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit polynomial hash of each byte span, by prefix sums; equal spans hash alike."""
    if not len(start):
        return np.zeros(0, np.uint64)
    p, inv = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.empty(len(data) + 1, np.uint64)
        c[0] = 0
        np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=c[1:])
        return mix((c[end] - c[start]) * inv[start])


def hash_text(s: str) -> int:
    """The hash :func:`span_hash` gives a single token."""
    d = np.frombuffer(s.encode(), np.uint8)
    return int(span_hash(d, np.array([0]), np.array([len(d)]))[0])


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive token hashes (length ``len(h) - n + 1``)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(g)


class Slots:
    """Numbers of known hashes, by open addressing: a table at most half full, probed onwards."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        at, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.table[at[left]] < 0]
            self.table[at[free]] = free
            left = left[self.table[at[left]] != left]
            at[left] = (at[left] + 1) & (len(self.table) - 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 where it is not known."""
        at = (h >> self.shift).astype(np.int64)
        out = self.table[at]
        left = np.flatnonzero(out >= 0)
        left = left[self.keys[out[left]] != h[left]]
        while len(left):
            at[left] = (at[left] + 1) & (len(self.table) - 1)
            out[left] = self.table[at[left]]
            left = left[out[left] >= 0]
            left = left[self.keys[out[left]] != h[left]]
        return out


def row_sum(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by row."""
    return np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)
