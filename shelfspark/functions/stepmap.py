"""State maps of greedy acceptance: what a chunk of sales makes of any stock.

A sale of q leaves a stock s at s - q where s >= q, else at s. A chunk of sales is hence a map
of {0 .. top} into itself. It is kept as pieces, stretches of stocks that have moved
together: a sale shifts the pieces that cover it, leaves those below it, and cuts in two the pieces
that q lies in. Chunks can so be summarised side by side, before the stock that enters any of
them is known, and applied one after another afterwards, one lookup a chunk.
"""

from __future__ import annotations

import numpy as np

_SCAN = 1 << 16  # sales looked over at once for the next one that some stock covers


def state_map(q: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(first stocks, what becomes of them): the pieces of the map of the sales ``q`` over 0 .. top."""
    starts, images = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    sizes = np.array([top + 1], dtype=np.int64)
    at, look = 0, 256
    while at < len(q):
        most = int((images + sizes).max()) - 1  # the largest stock that is still possible
        if most <= 0:
            break
        block = q[at:at + look]
        hits = np.flatnonzero((block <= most) & (block > 0))
        if not len(hits):
            at, look = at + len(block), min(4 * look, _SCAN)
            continue
        at, look = at + int(hits[0]) + 1, 256
        x = int(block[hits[0]])
        cut = (images < x) & (images + sizes > x)
        images = np.where(images >= x, images - x, images)
        if cut.any():
            keep = x - images[cut]
            starts = np.concatenate((starts, starts[cut] + keep))
            rest = sizes[cut] - keep
            sizes = np.concatenate((np.where(cut, x - images, sizes), rest))
            images = np.concatenate((images, np.zeros(len(rest), dtype=np.int64)))
            order = np.argsort(starts)
            starts, images, sizes = starts[order], images[order], sizes[order]
    return starts, images


def apply_map(starts: np.ndarray, images: np.ndarray, stock: int) -> int:
    """What a map makes of one stock."""
    k = int(np.searchsorted(starts, stock, side="right")) - 1
    return int(images[k]) + stock - int(starts[k])
