"""Numpy helpers over the UTF-8 bytes of one text, shared by the operators of this subpackage.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. ``bytes.lower`` folds A-Z only.
"""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEGMENT = 1 << 22
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int):
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 14)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = tuple(both)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray):
    """Byte offsets of the first byte of every word and of the byte after it."""
    inside = np.empty(len(raw) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_BLANK[raw], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def _segments(data: bytes):
    """The text in pieces of about 4 MB that end between words, so tables stay small."""
    at = 0
    while len(data) - at > _SEGMENT:
        cut = at + _SEGMENT
        blank = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8, offset=cut)])
        cut = cut + int(blank[0]) if len(blank) else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal spans wherever they stand."""
    powers, inverse = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    body = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: bytes) -> np.ndarray:
    parts = []
    for piece in _segments(data):
        raw = np.frombuffer(piece, np.uint8)
        parts.append(span_hashes(raw, *word_spans(raw)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xF1357AEA2E62A9C5) + hashes[i : i + n]
    return mix(out + np.uint64(width))


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    return np.unique(windows(hashes, min(width, len(hashes))))


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))
