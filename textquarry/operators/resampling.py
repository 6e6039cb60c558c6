"""Resampling with replacement, in place: how often each row is drawn in each sample, without a row or an entry per draw.

The n draws of a sample are split along a binary tree over the rows' places: of the m draws of a node, a binomial number,
found from a hash of the sample and the node, falls on its left half. A task walks down to the places it holds; it
needs nothing of the others, and gives every sample the same counts whoever asks. So sums over samples are made where rows
stand, and merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from ..functions.modular import MERSENNE_61, affine

#: Modulus and multipliers of the hash; fixed, so that SQL can say the same.
P = MERSENNE_61
MULTIPLIERS = (1181783497276652981, 1442695040888963407, 998244353987654321)
#: More draws of a node than these are split so many at a time.
MOST_DRAWS = 1000

def uniforms(samples: np.ndarray, node: int, part: int, seed: int) -> np.ndarray:
    """0 to 1 for each sample, by a hash of it, the node and the part of its draws."""
    x = affine(samples.astype(np.uint64), MULTIPLIERS[0], (node * MULTIPLIERS[1] + part * MULTIPLIERS[2] + seed) % P)
    for shift, a in ((29, MULTIPLIERS[1]), (31, MULTIPLIERS[2])):
        x = affine(x ^ (x >> np.uint64(shift)), a, 1)
        x = np.where(x >= np.uint64(P), x - np.uint64(P), x)
    return x.astype(np.float64) / P


@lru_cache(maxsize=4096)
def _below(m: int, left: int, size: int) -> np.ndarray:
    """Cumulative probabilities of 0 to m - 1 of m draws falling on `left` of `size` places."""
    k = np.arange(m)
    p = left / size
    ratio = (m - k) / (k + 1) * (p / (1 - p))
    return np.cumsum((1 - p) ** m * np.concatenate([[1.0], np.cumprod(ratio)[:-1]]))


def to_left(m: np.ndarray, left: int, size: int, samples: np.ndarray, node: int, seed: int) -> np.ndarray:
    """Of m draws of each sample, how many fall on the left part of a node."""
    out, part = np.zeros(m.size, np.int64), 0
    rest = m.copy()
    while (live := np.flatnonzero(rest > 0)).size:
        now = np.minimum(rest[live], MOST_DRAWS)
        u = uniforms(samples[live], node, part, seed)
        for value in np.unique(now).tolist():
            own = np.flatnonzero(now == value)
            out[live[own]] += np.searchsorted(_below(value, left, size), u[own], "left")
        rest[live] -= now
        part += 1
    return out


def draws(places: np.ndarray, n: int, times: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the places (sorted, distinct, of n), how often it is drawn in each sample."""
    samples = np.arange(times)
    waiting = [(1, 0, n, np.full(times, n, np.int64), 0, places.size)]
    while waiting:
        node, low, size, m, first, last = waiting.pop()
        if first == last:
            continue
        if size == 1:
            yield first, m
            continue
        left = size // 2
        cut = first + int(np.searchsorted(places[first:last], low + left))
        k = to_left(m, left, size, samples, node, seed)
        waiting.append((2 * node + 1, low + left, size - left, m - k, cut, last))
        waiting.append((2 * node, low, left, k, first, cut))
