"""Likelihood of texts under all segmentations of their words into the pieces of an existing vocabulary.

A public vocabulary gives the pieces and the scores that first weigh them; only the weights are learned here, never the
pieces. A word, with the mark of a word's begin before it, is a lattice: its byte positions are nodes, each piece that
stands there is an arc, and a forward recursion in log space sums over all paths. As no piece crosses the begin of a word,
the words' marginals multiply to the text's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: The mark that pieces carry where a word begins.
BEGIN = "▁".encode()
BYTES = 256


@dataclass
class Pieces:
    """A trie of pieces as sorted arrays: from state s, byte b leads to child[k] where edge[k] = 256 * s + b; a state that
    ends a piece has its number in `ends`, others -1. Numbers 0 to 255 are the single bytes, which any text can fall back
    on; number 256 is the end of a text. `weight` has natural logarithms."""

    edge: np.ndarray
    child: np.ndarray
    ends: np.ndarray
    weight: np.ndarray


def trie(pieces: list[bytes], weights: np.ndarray) -> Pieces:
    """Pieces numbered from 257 on; weights has 257 more entries than pieces, of bytes and the end first."""
    known: dict[int, int] = {}
    ends = [-1]
    for number, piece in enumerate(pieces, BYTES + 1):
        state = 0
        for b in piece:
            key = state * BYTES + b
            if key not in known:
                known[key] = len(ends)
                ends.append(-1)
            state = known[key]
        ends[state] = number
    edge = np.array(sorted(known), np.int64)
    child = np.array([known[k] for k in edge.tolist()], np.int64)
    return Pieces(edge, child, np.array(ends, np.int64), np.asarray(weights, np.float64))


def arcs(pieces: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all arcs in words data[offsets[i]:offsets[i + 1]]; single bytes come first."""
    stop = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(data.size)
    made = [(at, at + 1, data.astype(np.int64))]
    state, length = np.zeros(data.size, np.int64), 0
    while at.size and pieces.edge.size:
        key = state * BYTES + data[at + length]
        k = np.minimum(np.searchsorted(pieces.edge, key), pieces.edge.size - 1)
        fits = pieces.edge[k] == key
        at, state = at[fits], pieces.child[k[fits]]
        length += 1
        number = pieces.ends[state]
        done = number >= 0
        made.append((at[done], at[done] + length, number[done]))
        inside = at + length < stop[at]
        at, state = at[inside], state[inside]
    return tuple(np.concatenate(x) for x in zip(*made))


def _sums(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups (runs of equal numbers) and the logarithm of their summed exponentials."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    most = np.maximum.reduceat(values, first)
    owner = np.repeat(np.arange(first.size), np.diff(np.r_[first, group.size]))
    return group[first], most + np.log(np.add.reduceat(np.exp(values - most[owner]), first))


def _steps(place: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of arcs by place in the word, then node, and where each place begins in it."""
    order = np.argsort(place * (int(node.max(initial=0)) + 1) + node)
    return order, np.searchsorted(place[order], np.arange(int(place.max(initial=0)) + 2))


def forward(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, made=None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of each word's marginal, and of each node's; node i + w is byte i of word w, its last one behind it."""
    start, end, piece = arcs(pieces, data, offsets) if made is None else made
    word = np.searchsorted(offsets, start, "right") - 1
    alpha = np.full(data.size + offsets.size - 1, -np.inf)
    alpha[offsets[:-1] + np.arange(offsets.size - 1)] = 0.0
    order, cuts = _steps(end - offsets[word], end + word)
    source, target, weight = (start + word)[order], (end + word)[order], pieces.weight[piece[order]]
    for low, high in zip(cuts[:-1], cuts[1:]):
        if low < high:
            node, value = _sums(alpha[source[low:high]] + weight[low:high], target[low:high])
            alpha[node] = value
    return alpha[offsets[1:] + np.arange(offsets.size - 1)], alpha


def expected(pieces: Pieces, data: np.ndarray, offsets: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """How often each piece is expected in the words, each counted so many times, and their log-likelihood."""
    start, end, piece = made = arcs(pieces, data, offsets)
    total, alpha = forward(pieces, data, offsets, made)
    word = np.searchsorted(offsets, start, "right") - 1
    beta = np.full(alpha.size, -np.inf)
    beta[offsets[1:] + np.arange(offsets.size - 1)] = 0.0
    order, cuts = _steps(offsets[word + 1] - start, start + word)
    source, target, weight = (start + word)[order], (end + word)[order], pieces.weight[piece[order]]
    for low, high in zip(cuts[:-1], cuts[1:]):
        if low < high:
            node, value = _sums(beta[target[low:high]] + weight[low:high], source[low:high])
            beta[node] = value
    share = np.exp(alpha[source] + weight + beta[target] - total[word[order]]) * times[word[order]]
    return np.bincount(piece[order], share, pieces.weight.size), float(total @ times)
