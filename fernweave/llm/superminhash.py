"""SuperMinHash signatures of word shingles (Ertl, 2017), a batch of texts at a time.

Every element has a random permutation of the slots; the slot at rank j gets the value
j + r with r in [0, 1), and the signature keeps the least value per slot.  Ranks of one
element are thus correlated (no two slots share one), which lowers the variance of the
estimate.  Rounds go by rank, over all elements of the batch; a text stops early, when
its largest value is below the next rank, since nothing can lower it any more.
"""

from __future__ import annotations

import numpy as np

from .tokens import mix

SLOTS = 128
_GOLDEN = 0x9E3779B97F4A7C15
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of width words, first run of each text and the end).

    A text of fewer words is one run by itself; a text without words has none.
    """
    counts = np.diff(starts)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    total = int(at[-1])
    if not total:
        return np.zeros(0, np.uint64), at
    first = np.repeat(starts[:-1] - at[:-1], runs) + np.arange(total)
    last = np.repeat(starts[1:], runs)
    found = np.zeros(total, np.uint64)
    for k in range(width):
        here = first + k
        ok = here < last
        word = hashes[np.minimum(here, len(hashes) - 1)]
        found = np.where(ok, mix(found * np.uint64(0xFF51AFD7ED558CCD) + word + np.uint64(k + 1)), found)
    return found, at


def signatures(elements: np.ndarray, starts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The (texts, slots) matrix of least values, as (rank << 48) + r; all ones for a text without elements."""
    texts = len(starts) - 1
    least = np.full(texts * slots, _EMPTY, np.uint64)
    doc = np.repeat(np.arange(texts), np.diff(starts))
    live, order, k0 = elements, None, None
    for rank in range(slots):
        if not len(live):
            break
        draw = mix(live + np.uint64((rank + 1) * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
        pick = rank + (((draw & np.uint64(0xFFFF)) * np.uint64(slots - rank)) >> np.uint64(16)).astype(np.int64)
        if rank == 0:
            slot = k0 = pick
        elif rank == 1:  # after one swap the permutation differs from the identity at 0 and k0 only
            slot = np.where(pick == k0, 0, pick)
        else:
            rows = np.arange(len(live))
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (len(live), 1))
                for j, k in ((0, k0), (1, k1)):
                    moved = order[rows, k]
                    order[rows, k] = order[rows, j]
                    order[rows, j] = moved
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, rank]
        np.minimum.at(least, doc * slots + slot, (draw >> np.uint64(16)) + (np.uint64(rank) << np.uint64(48)))
        worst = least.reshape(texts, slots).max(axis=1)
        open_ = (worst >= np.uint64(rank + 1) << np.uint64(48))[doc]
        if rank == 0:
            k0 = pick[open_]
        elif rank == 1:
            k0, k1 = k0[open_], pick[open_]
        if not open_.all():
            live, doc = live[open_], doc[open_]
            if order is not None:
                order = order[open_]
    return least.reshape(texts, slots)


def bands(matrix: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) of int64: a hash of each group of `rows` slots."""
    texts, slots = matrix.shape
    found = np.zeros((texts, slots // rows), np.uint64)
    for k in range(rows):
        found = mix(found * np.uint64(0xFF51AFD7ED558CCD) + matrix[:, k::rows][:, : slots // rows] + np.uint64(k + 1))
    return found.view(np.int64)
