"""NumPy kernels shared by the word-based operators.

A *word* here is a maximal run of bytes that are not ASCII white space
(``[^\\x20\\x09-\\x0D]+``) of the UTF-8 text with A-Z lower-cased.  Everything
works on byte buffers, so the cost is a few vector passes per byte and no
Python object exists per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multipliers of public 64-bit mixers.
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: Bytes handled by one vector pass; longer texts are cut at white space.
PIECE_BYTES = 1 << 20


def times(k: int, odd: np.uint64 = GOLDEN) -> np.uint64:
    """``k * odd`` modulo 2^64."""
    return np.uint64(k * int(odd) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x ^= x >> np.uint64(33)
    x *= MIX_2
    x ^= x >> np.uint64(33)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space, mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)


def _pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` in pieces that end before white space, so no word is cut."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, word start offsets) of one buffer."""
    space, values = _tables()
    buf = np.frombuffer(raw, np.uint8)
    gap = space[buf]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    inside = np.flatnonzero(~gap)
    # bytes of words only, each multiplied by a power of its place in its word
    word_at = np.searchsorted(inside, starts)
    lengths = np.diff(np.append(word_at, len(inside)))
    place = np.arange(len(inside)) - np.repeat(word_at, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), MIX_2, np.uint64))
    terms = values[buf[inside]] * powers[place]
    return mix(np.add.reduceat(terms, word_at) + lengths.astype(np.uint64)), starts


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and each text's word count."""
    raws = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    counts = np.zeros(len(raws), np.int64)
    found, k = [], 0
    while k < len(raws):
        if len(raws[k]) > PIECE_BYTES:
            parts = [_hashes(p)[0] for p in _pieces(raws[k])]
            counts[k] = sum(map(len, parts))
            found += parts
            k += 1
            continue
        end, size = k, 0
        while end < len(raws) and size + len(raws[end]) <= PIECE_BYTES:
            size += len(raws[end]) + 1
            end += 1
        hashes, starts = _hashes(b"\n".join(raws[k:end]))
        edges = np.cumsum([len(r) + 1 for r in raws[k:end]])
        counts[k:end] = np.diff(np.searchsorted(starts, edges), prepend=0)
        found.append(hashes)
        k = end
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), counts


def batches(texts: list[str | None], chars: int = 1 << 21) -> Iterator[slice]:
    """Slices of ``texts`` of about ``chars`` characters, one text at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > chars:
            yield slice(at, k)
            at, size = k, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))
