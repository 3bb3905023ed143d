"""Shingle sets and SuperMinHash signatures, vectorised over documents.

SuperMinHash gives every element a random permutation of the ``m`` signature
places and a random fraction per rank; a place keeps the least ``rank +
fraction`` that falls on it.  The ranks of one element are correlated (a
permutation), which lowers the variance.  Ranks are handled level by level over
all elements of a batch: once every place of a document holds a value of an
earlier level, later levels cannot change it and the document stops.
"""

from __future__ import annotations

import numpy as np

from tidewright.llm.words import GOLDEN, batches, mix, times, word_hashes

SHINGLE = 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 5-word shingle hashes of each text, sorted, and their counts.

    A text of one to four words has one shingle, its whole word sequence; a
    text without words has none.
    """
    words, counts = word_hashes(texts)
    salts = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)
    n = len(words)
    whole = max(n - SHINGLE + 1, 0)
    rolled = np.zeros(whole, np.uint64)
    for k in range(SHINGLE):
        rolled += words[k : k + whole] * salts[k]
    rolled = mix(rolled)
    ends = np.cumsum(counts)
    sets: list[np.ndarray] = []
    for end, c in zip(ends.tolist(), counts.tolist(), strict=True):
        at = end - c
        if c >= SHINGLE:
            s = np.sort(rolled[at : end - SHINGLE + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets.append(s[keep])
        elif c:
            sets.append(mix((words[at:end] * salts[:c]).sum(dtype=np.uint64, keepdims=True) + times(c)))
        else:
            sets.append(rolled[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else rolled[:0]), sizes


def _draw(elements: np.ndarray, level: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A fraction (32 bits) and a place in ``[level, m)`` for each element."""
    x = mix(elements + times(level + 1))
    place = np.uint64(level) + ((x & _LOW) * np.uint64(m - level) >> np.uint64(32))
    return x >> np.uint64(32), place.astype(np.int64)


#: Elements of one pass: bounds the permutations held (one per element of small sets).
PASS_ELEMENTS = 1 << 16


def signatures(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """``len(sizes) x m`` signatures; a row of an empty set is all ones."""
    ends = np.cumsum(sizes)
    parts, at, first = [], 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, at + PASS_ELEMENTS, side="right")))
        end = int(ends[last - 1])
        parts.append(_signatures(elements[at:end], sizes[first:last], m))
        at, first = end, last
    return np.concatenate(parts) if parts else np.empty((0, m), np.uint64)


def _signatures(elements: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    docs = len(sizes)
    sig = np.full(docs * m, _EMPTY, np.uint64)
    owner = np.repeat(np.arange(docs), sizes)
    frac, k0 = _draw(elements, 0, m)
    np.minimum.at(sig, owner * m + k0, frac)
    live = np.flatnonzero(sizes > 0)
    perm = None
    for level in range(1, m):
        # a value of this level is at least `level`; documents whose places all hold less are done
        rows = sig.reshape(docs, m)[live]
        live = live[(rows >= np.uint64(level) << np.uint64(32)).any(axis=1)]
        if not len(live):
            break
        going = np.zeros(docs, bool)
        going[live] = True
        keep = going[owner]
        owner, elements, k0 = owner[keep], elements[keep], k0[keep]
        frac, k = _draw(elements, level, m)
        at = np.arange(len(owner))
        if level == 1:
            spot = np.where(k == k0, 0, k)
            k1 = k
        else:
            if level == 2:
                k1 = k1[keep]
                perm = np.tile(np.arange(m, dtype=np.int16), (len(owner), 1))
                perm[at, 0], perm[at, k0] = perm[at, k0], perm[at, 0]
                held = perm[at, 1].copy()
                perm[at, 1] = perm[at, k1]
                perm[at, k1] = held
            else:
                perm = perm[keep]
            spot = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, level]
            perm[at, level] = spot
        np.minimum.at(sig, owner * m + spot, (np.uint64(level) << np.uint64(32)) | frac)
    return sig.reshape(docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key a band; the band's number is part of the key."""
    part = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * GOLDEN
    for k in range(rows):
        key = mix(key ^ part[:, :, k])
    return key


def signature_bytes(sig: np.ndarray) -> list[bytes]:
    """Each signature at one byte a place: equal places have equal bytes, others do with probability 1/256."""
    small = (mix(sig) & np.uint64(0xFF)).astype(np.uint8)
    return [row.tobytes() for row in small]


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a n b| >= percent * |a u b| for two sorted sets."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


__all__ = ["band_keys", "batches", "jaccard_at_least", "shingle_sets", "signature_bytes", "signatures"]
