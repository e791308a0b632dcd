"""Byte n-grams of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: An odd multiplier of the rolling hash, and one that spreads its bits.
STEP, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def rolled(raw: np.ndarray, sizes: range, bits: int):
    """For each n of ``sizes`` (ascending from 1 at least) the bucket of the n bytes that start at
    each position: ``(n, buckets)`` with ``len(raw) - n + 1`` entries of ``bits`` bits."""
    b = raw.astype(np.uint32)
    h = b + np.uint32(1)
    for n in range(1, sizes.stop):
        if n > 1:
            if len(h) < 2:
                return
            h = h[:-1] * STEP + b[n - 1 :] + np.uint32(n)
        if n in sizes:
            mixed = (h ^ (h >> np.uint32(15))) * SPREAD
            yield n, (mixed >> np.uint32(32 - bits)).astype(np.int32)
