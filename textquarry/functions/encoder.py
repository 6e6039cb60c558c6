"""A deterministic text encoder: signed feature hashing of content terms into unit vectors, the same in any engine."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

from .text import STOPWORDS

#: Dimensions, places that each term adds to, and the count from which a term weighs no more.
SIZE, PLACES, MOST = 64, 4, 3

_stop = frozenset(STOPWORDS)


def terms(text: str) -> list[str]:
    """The content tokens of a text: identifier parts in lower case, longer than a letter and no stop words."""
    apart = re.sub("([A-Z])([A-Z][a-z0-9])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", text))
    return [t for t in map(str.lower, re.findall("[a-zA-Z0-9]+", apart)) if len(t) > 1 and t not in _stop]


def places(term: str) -> list[tuple[int, int]]:
    """(dimension, sign) of a term: of each four hex digits of its md5, the low six bits and the next one."""
    digest = hashlib.md5(term.encode()).hexdigest()
    numbers = [int(digest[4 * j : 4 * j + 4], 16) for j in range(PLACES)]
    return [(x % SIZE, 1 - 2 * (x // SIZE % 2)) for x in numbers]


def encode(texts: list[str]) -> np.ndarray:
    """A unit vector per text; zeros for a text without content terms. Sums are whole numbers until they are normalised."""
    known: dict[str, list[tuple[int, int]]] = {}
    made = np.zeros((len(texts), SIZE))
    for row, text in enumerate(texts):
        for term, n in Counter(terms(text)).items():
            if term not in known:
                known[term] = places(term)
            for at, sign in known[term]:
                made[row, at] += sign * min(n, MOST)
    norm = np.sqrt((made * made).sum(axis=1, keepdims=True))
    return made / np.where(norm > 0, norm, 1)
