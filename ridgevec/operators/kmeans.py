"""Seeded k-means on a bounded sample.

The generator is the 32-bit linear congruential one, so a seed always gives the
same centroids: D-squared weighted seeding, a fixed number of rounds, and a row
drawn anew for a centroid that lost all its rows. Only the sample is clustered
on the driver; every row is then assigned where it lies.
"""

from __future__ import annotations

import numpy as np

#: The generator's multiplier, increment and modulus (fixed values).
MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 1 << 32


class Lcg:
    def __init__(self, seed: int):
        self.state = seed % MODULUS

    def next_state(self) -> int:
        self.state = (self.state * MULTIPLIER + INCREMENT) % MODULUS
        return self.state

    def uniform(self) -> float:
        """In [0, 1)."""
        return self.next_state() / MODULUS

    def symmetric(self) -> float:
        """In [-1, 1)."""
        return self.uniform() * 2 - 1


class Mulberry32:
    """32-bit mixing generator used by the test inputs."""

    def __init__(self, seed: int):
        self.state = seed % MODULUS

    def next_value(self) -> int:
        self.state = (self.state + 0x6D2B79F5) % MODULUS
        t = self.state
        t = ((t ^ (t >> 15)) * (t | 1)) % MODULUS
        t ^= (t + ((t ^ (t >> 7)) * (t | 61)) % MODULUS) % MODULUS
        return (t ^ (t >> 14)) % MODULUS

    def uniform(self) -> float:
        return self.next_value() / MODULUS


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64) - c.astype(np.float64)
    return (d * d).sum(1)


def seeds(x: np.ndarray, nlist: int, rng: Lcg) -> np.ndarray:
    """Rows drawn with chances in proportion to the squared distance to the
    nearest row drawn before."""
    picks = [int(rng.uniform() * len(x))]
    near = squared_distances(x, x[picks[0]])
    while len(picks) < nlist:
        left = rng.uniform() * float(np.cumsum(near)[-1])
        # first row at which the remainder is used up; the first row if none is
        spent = np.flatnonzero(left - np.cumsum(near) <= 0)
        picks.append(int(spent[0]) if len(spent) else 0)
        near = np.minimum(near, squared_distances(x, x[picks[-1]]))
    return x[picks].copy()


def nearest_centroid(x: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    """Index of the nearest centroid by squared distance, ties to the lower;
    distances are compared on 9 decimals so that equal ones are equal."""
    out = np.empty(len(x), np.int64)
    c = c.astype(np.float64)
    cc = (c * c).sum(1)
    for s in range(0, len(x), block):
        b = x[s : s + block].astype(np.float64)
        out[s : s + block] = np.argmin(np.round((b * b).sum(1)[:, None] - 2 * (b @ c.T) + cc[None, :], 9), axis=1)
    return out


def train(x: np.ndarray, nlist: int, iters: int = 20, seed: int = 1234) -> np.ndarray:
    """Centroids (32-bit) after exactly ``iters`` rounds."""
    x = np.ascontiguousarray(x, np.float32)
    if not 0 < nlist <= len(x):
        raise ValueError(f"nlist must be between 1 and {len(x)}")
    rng = Lcg(seed)
    centroids = seeds(x, nlist, rng)
    for _ in range(iters):
        at = nearest_centroid(x, centroids)
        sums = np.zeros((nlist, x.shape[1]), np.float32)
        np.add.at(sums, at, x)
        counts = np.bincount(at, minlength=nlist)
        for j in range(nlist):
            centroids[j] = sums[j] * (1.0 / counts[j]) if counts[j] else x[int(rng.uniform() * len(x))]
    return centroids
