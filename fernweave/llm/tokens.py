"""Word tokens of an Arrow string column as 64-bit hashes, without Python strings.

A word is a maximal run of ASCII letters and digits and of bytes above 127, so letters
of any script belong to words and ASCII punctuation separates them.  Lower-casing is
Unicode-aware (Arrow's kernel).  The hash of a word is the polynomial sum of its bytes
modulo 2**64, put through a mixer; it depends on the word only, on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _WORD[_c] = True
_BLOCK = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n or more, kept for the next batch."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = np.full(size, _P, np.uint64)
        inverse = np.full(size, _P_INV, np.uint64)
        base[0] = inverse[0] = 1
        have = _powers[0] = (np.multiply.accumulate(base), np.multiply.accumulate(inverse))
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0]
    return raw, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def words(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, position of each text's first word and the end), for the texts of a column."""
    column = column.cast(pa.large_string())
    raw, offsets = buffers(pc.utf8_lower(column) if lower else column)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    inside = _WORD[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False  # every text begins a word anew
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:] & before[1:]
    ends = np.flatnonzero(inside & ~after) + 1
    found = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in blocks, so that a very long text needs no more memory than many short ones
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK)))
        low, high = int(starts[at]), int(ends[to - 1])
        power, inverse = _power(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        found[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * inverse[starts[at:to] - low]
        at = to
    found += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(found), np.searchsorted(starts, offsets).astype(np.int64)


def slices(column: pa.Array, most_bytes: int):
    """(start, end) of runs of rows holding about most_bytes of text each; a longer text is a run by itself."""
    _, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield at, min(to, n)
        at = to
