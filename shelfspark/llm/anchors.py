"""Window anchors: content-defined places that equal byte strings share.

Every window (400 bytes, if not said otherwise) owns one anchor, the least hashed 32-byte gram in it
(the leftmost one on ties). The choice depends on the window's bytes alone, so two equal
windows have equal grams as anchors, at the same distance from their start.
Consecutive windows mostly share their anchor, so a text has about one anchor
for every 185 bytes (half of the grams that a window holds).
"""

from __future__ import annotations

import numpy as np

WINDOW = 400
GRAM = 32
_POSITION_BITS = 24
_BLOCK = 1 << 20  # windows handled at once; bounds the memory for very long texts


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of the gram at each position, by doubling."""
    h = data.astype(np.uint64) + np.uint64(1)
    base, width = np.uint64(0x9E3779B97F4A7C15), 1
    while width < GRAM:
        h = h[:-width] * base + h[width:]
        base, width = base * base, width * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` keys (block-wise prefix and suffix minima)."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n - width + 1], prefix[width - 1:n])


def owned_windows(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first window start, number of windows, anchor's distance from it) of each anchor of a text."""
    found = []
    with np.errstate(over="ignore"):
        for lo in range(0, max(len(data) - window + 1, 0), _BLOCK):
            part = np.frombuffer(data, dtype=np.uint8, count=min(_BLOCK + window - 1, len(data) - lo), offset=lo)
            hashes = _gram_hashes(part)
            low = np.uint64((1 << _POSITION_BITS) - 1)
            least = _sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), window - GRAM + 1)
            owner = (least & low).astype(np.int64)
            first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            count = np.diff(np.concatenate((first, [len(owner)])))
            found.append((hashes[owner[first]].view(np.int64), first + lo, count, owner[first] - first))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found))
