"""One-permutation MinHash with optimal densification.

A set of 64-bit hashes is cut into bins by the top bits, and each bin keeps its smallest
member. An empty bin takes the value of the first filled bin in an order of its own, drawn
once from a fixed seed, so that every filled bin is equally likely and two sets agree on a
bin with a probability equal to their Jaccard similarity (Shrivastava, ICML 2017).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from raingrid.llm import textscan


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(members: np.ndarray, bins: int = 256) -> np.ndarray:
    """Bin values of a sorted, non-empty set of 64-bit hashes; ``bins`` is a power of two."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    place = (members >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    out = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    out[place[first]] = members[first]
    full[place[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _donors(bins)[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return textscan.mix(out)


def packed(sig: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` (1, 2, 4 or 8) of every bin, most significant position first."""
    low = (sig & np.uint64((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    out = np.zeros(len(low) // per, np.uint8)
    for i in range(per):
        out = (out << bits) | low[i::per] if bits < 8 else low
    return out.tobytes()


def unpacked(data: bytes, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    mask = (1 << bits) - 1
    return np.stack([(raw >> (8 - bits * (i + 1))) & mask for i in range(8 // bits)], 1).ravel()


def likeness(a: bytes, b: bytes, bits: int) -> float:
    """Jaccard similarity from packed bins, freed of the chance agreements of ``bits`` bits.

    Two empty fingerprints are alike (1), an empty and a filled one are not (0).
    """
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    chance = 0.5**bits
    agree = float(np.mean(unpacked(a, bits) == unpacked(b, bits)))
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band of ``rows`` bins."""
    block = sig[: bands * rows].reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = textscan.mix(out * np.uint64(0xF1357AEA2E62A9C5) + block[:, i])
    return out
