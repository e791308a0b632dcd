"""Words and word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(2024)
#: A random number for each byte, and odd multipliers.
BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PLACE = _RNG.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        return self.up, self.down


def words(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space, A-Z lower-cased), and where each text's words
    start (one entry more than texts)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    edge = np.cumsum([0, *[len(p) + 1 for p in parts]])
    raw = LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    gap = SPACE[raw]
    inside = np.concatenate([[True], gap])
    starts = np.flatnonzero(inside[:-1] & ~gap)
    ends = np.flatnonzero(~inside[1:-1] & gap[1:]) + 1 if len(raw) > 1 else starts
    up, down = powers.upto(len(raw) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE[raw] * up[: len(raw)], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, edge)


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words in order; of fewer words, the whole run as one."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < width:
        return mix((hashes * PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out += hashes[k : n - width + 1 + k] * PLACE[k]
    return mix(out)


def blocks(texts: list, most: int = 1 << 18):
    """Runs of ``texts`` of about ``most`` characters, as (from, to)."""
    at = 0
    while at < len(texts):
        to, held = at, 0
        while to < len(texts) and (to == at or held < most):
            held += len(texts[to] or "")
            to += 1
        yield at, to
        at = to
