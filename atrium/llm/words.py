"""Words, windows and their hashes over Arrow string columns, as numpy arrays: no Python object per word.

Texts are taken as UTF-8 bytes. Both word classes treat every byte from 0x80 as part of a word, so a multi-byte
character is never cut. Rows are handled in slices of about a megabyte; only a single longer text makes one larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS, LONG_WORD = 1 << 20, 1000, 1 << 12
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, bool)  # [^\x20\x09-\x0D]
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased bytes
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
_R = np.random.RandomState(20240607)
_T = _R.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_P = _R.randint(1, 2**63 - 1, LONG_WORD + 1, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_T2, _P2 = (_R.randint(1, 2**63 - 1, n, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, LONG_WORD + 1))
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Slice:
    """Rows lo to hi of a batch: their bytes, and where each row begins and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def split(self, is_word: np.ndarray) -> Slice:
        """Finds the words: starts, ends; bounds[r] is the first word of row r."""
        w = is_word[self.data]
        n = len(w)
        begin, stop = w.copy(), w.copy()
        begin[1:] &= ~w[:-1]
        stop[:-1] &= ~w[1:]
        full = np.flatnonzero(np.diff(self.offs))
        at = self.offs[full]
        begin[at] = w[at]
        last = self.offs[full + 1] - 1
        stop[last] = w[last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.bounds = np.searchsorted(self.starts, self.offs) if n else np.zeros(self.rows + 1, np.int64)
        return self

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, lower)

    def per_row(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a byte-wise array for each row."""
        c = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=c[1:])
        return c[self.offs[1:]] - c[self.offs[:-1]]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, wide: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: a sum of byte code times place code, mixed; very long spans by blake2b.

    If wide, (2, n): a second hash by other codes, for 128 bits.
    """
    out = np.zeros((1 + wide, len(starts)), U)
    lens = ends - starts
    tables = [(_T[LOWER] if lower else _T, _P), (_T2, _P2)][: 1 + wide]
    short = np.flatnonzero(lens <= LONG_WORD)
    total = np.cumsum(lens[short])
    cut, done = [0], 0
    while cut[-1] < len(short):
        k = int(np.searchsorted(total, done + SLICE_BYTES, "right"))
        k = max(k, cut[-1] + 1)
        cut.append(k)
        done = int(total[k - 1])
    for a, b in zip(cut, cut[1:], strict=False):
        pick = short[a:b]
        n = lens[pick]
        before = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(before, n)
        of = data[place + np.repeat(starts[pick], n)]
        some = n > 0
        for k, (codes, places) in enumerate(tables):
            got = np.zeros(len(pick), U)
            if some.any():
                got[some] = np.add.reduceat(codes[of] * places[place], before[some])
            out[k, pick] = mix(got + n.astype(U) * U(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(lens > LONG_WORD):
        part = data[starts[i] : ends[i]]
        digest = hashlib.blake2b((LOWER[part] if lower else part).tobytes(), digest_size=8 * (1 + wide)).digest()
        out[:, i] = np.frombuffer(digest, "<u8")
    return out if wide else out[0]


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b, lens of each, are the same; about a megabyte is compared at a time."""
    out = np.ones(len(a), bool)
    long = lens > SLICE_BYTES
    for i in np.flatnonzero(long):
        out[i] = np.array_equal(data[a[i] : a[i] + lens[i]], data[b[i] : b[i] + lens[i]])
    pick = np.flatnonzero(~long & (lens > 0))
    block = (np.cumsum(lens[pick]) - 1) // SLICE_BYTES
    for part in np.split(pick, np.flatnonzero(np.diff(block)) + 1):
        if len(part):
            n = lens[part]
            before = np.cumsum(n) - n
            step = np.arange(int(n.sum())) - np.repeat(before, n)
            out[part] = np.logical_and.reduceat(data[step + np.repeat(a[part], n)] == data[step + np.repeat(b[part], n)], before)
    return out


def windows(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words that lie in one row, and the index of each one's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    g = h[:n].copy()
    for j in range(1, k):
        g = g * U(0x9E3779B97F4A7C15) + mix(h[j : n + j] + U(j))
    left = np.repeat(bounds[1:], np.diff(bounds))[:n] - np.arange(n)
    at = np.flatnonzero(left >= k)
    return mix(g[at]), at


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES, max_rows: int = SLICE_ROWS) -> Iterator[Slice]:
    """Cuts a string column (null: empty) into slices of rows."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1
        hi = min(n, lo + max_rows, max(hi, lo + 1))
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def distinct_by_row(rows: np.ndarray, h: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row as 54-bit hashes, sorted by row; rows below 1024. Returns (values, bounds)."""
    assert n_rows <= 1024
    key = (rows.astype(U) << U(54)) | (h >> U(10))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    bounds = np.searchsorted(key, np.arange(n_rows + 1, dtype=U) << U(54)) if n_rows < 1024 else np.append(np.searchsorted(key, np.arange(n_rows, dtype=U) << U(54)), len(key))
    return key & U((1 << 54) - 1), bounds


def verified_distinct(s: Slice, h: np.ndarray) -> np.ndarray:
    """How many different words each row has: hashes sorted within the row, equal neighbours compared byte by byte.

    A row in which two different words share a hash is counted again from its words.
    """
    assert s.rows <= 1024
    row = s.row_of_word()
    key = (row.astype(U) << U(54)) | (h >> U(10))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[same], order[same + 1]
    lens = s.ends - s.starts
    out = s.counts - np.bincount(row[a], minlength=s.rows)
    wrong = lens[a] != lens[b]
    wrong[~wrong] = ~equal_spans(s.data, s.starts[a[~wrong]], s.starts[b[~wrong]], lens[a[~wrong]])
    for r in np.unique(row[a[wrong]]).tolist():
        words = range(s.bounds[r], s.bounds[r + 1])
        out[r] = len({s.data[s.starts[i] : s.ends[i]].tobytes() for i in words})
    return out
