"""Vectorised text features over Arrow string buffers.

All documents of a batch are handled at once as one array of bytes.  A word is a run
of ASCII letters, digits and bytes of non-ASCII characters; ASCII letters are folded to
lower case, others are kept as they are.  Words get 64-bit polynomial hashes, so a
Python string is never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

_FOLD = np.zeros(256, dtype=U64)
for _c in range(256):
    if 48 <= _c <= 57 or 97 <= _c <= 122 or _c >= 128:
        _FOLD[_c] = _c + 1
    elif 65 <= _c <= 90:
        _FOLD[_c] = _c + 33
WORD = _FOLD > 0
_GAP = np.where(WORD, 0, np.arange(256) + 1).astype(U64)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.empty(size, dtype=U64)
        have[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a copy."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 16):
    """Row ranges of at most limit bytes; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n, i + rows)
        yield i, j
        i = j


class Words:
    """The words of some texts: hash, text number, start and end of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        self.raw, self.offsets, self.texts = raw, offsets, len(offsets) - 1
        inside = WORD[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.hash = self._hashes(_FOLD, self.start, self.end)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1

    def _hashes(self, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(self.raw)
        if n == 0:
            return np.zeros(0, U64)
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(table[self.raw] * _power_table(_R, n), out=sums[1:])
        h = (sums[end] - sums[start]) * _power_table(_RINV, n + 1)[start]
        return mix(h + (end - start).astype(U64))

    def gap_hashes(self) -> np.ndarray:
        """A hash of what stands between each word and the next, or the text's end."""
        end = np.empty_like(self.end)
        if len(end):
            end[:-1] = self.start[1:]
            end[-1] = len(self.raw)
            np.minimum(end, self.offsets[self.text + 1], out=end)
        return self._hashes(_GAP, self.end, end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of each run of k words; a text of fewer words is one shingle."""
        n = len(self.hash)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        h = self.hash.copy()
        per_text = np.bincount(self.text, minlength=self.texts)
        begins = np.cumsum(per_text) - per_text
        left = (begins + per_text)[self.text] - np.arange(n)
        for j in range(1, k):
            nxt = np.zeros(n, U64)
            nxt[: n - j] = self.hash[j:]
            nxt[left <= j] = 0
            h = mix(h) * U64(_R) + nxt
        at = np.arange(n) - begins[self.text]
        keep = (left >= k) | (at == 0)
        return self.text[keep], mix(h[keep])


FEATURE_BITS = 44


def multisets(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 44-bit feature, count), sorted, of each distinct feature of each text.

    Text numbers must be below 2**20.
    """
    keys = (text.astype(U64) << U64(FEATURE_BITS)) | (hashes >> U64(64 - FEATURE_BITS))
    keys.sort()
    if len(keys) == 0:
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    new = np.empty(len(keys), dtype=bool)
    new[0] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> U64(FEATURE_BITS)).astype(np.int64), keys & U64((1 << FEATURE_BITS) - 1), counts
