"""External induced sorting of suffixes, with the lengths of their common prefixes.

Suffixes of a text over the symbols 1 to 255, with 0 between its strings, are L-type (larger than the next suffix) or
S-type. The leftmost S-type suffixes of their runs are sorted first. A scan in ascending order then induces all L-type
suffixes, a scan in descending order all S-type ones: each suffix met sends its predecessor to the queue of that
predecessor's symbol. Because a scan meets successors in order, a queue per symbol, read first in first out, is the
whole priority queue. The queues carry (position, common prefix with the entry before). The common prefix of two
entries of a queue is one more than the smallest between their successors, taken from a running minimum and a
range-minimum table of the block.

Nothing is held but a budget of entries: the text and its types are files, queues spill to a file of extents beyond the
budget, and the leftmost S-type suffixes are dealt to queues by their symbols, one symbol deeper wherever a queue still
exceeds the budget, before they are sorted in memory.

Order and prefixes are needed to a depth only (the length of a repeat). So the recursion ends after its first level:
the leftmost S-type suffixes are sorted by that depth itself, eight symbols a round, ties alone going on (README says
what a second level would cost).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 17
#: Entries (10 bytes each) that the queues of one sort hold in memory before they spill; a shard of repeats has more.
MEMORY_ENTRIES = 1 << 18
LONGEST = 60_000

Entries = tuple[np.ndarray, np.ndarray]


def scratch() -> tempfile.TemporaryDirectory:
    """A folder for the spills of one task, where Spark's own go; a task that is run again starts with another."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryDirectory(prefix="induced-", dir=folder if os.path.isdir(folder) else None)


class Queues:
    """First-in-first-out queues of (position, prefix) per symbol. Beyond the budget what is in memory goes to the end of
    one file, each queue's part as an extent (offset, entries)."""

    def __init__(self, folder: str, budget: int = MEMORY_ENTRIES):
        self.path, self.budget, self.held, self.spilled = os.path.join(folder, f"queues-{id(self):x}"), budget, 0, 0
        self.parts: list[list[Entries | tuple[int, int]]] = [[] for _ in range(256)]
        self.read = [0] * 256

    def push(self, symbol: int, at: np.ndarray, prefix: np.ndarray) -> None:
        self.parts[symbol].append((at, prefix))
        self.held += at.size
        if self.held > self.budget:
            self.spill()

    def spill(self) -> None:
        with open(self.path, "ab") as out:
            for symbol, parts in enumerate(self.parts):
                read = parts[: self.read[symbol]]
                sides = [self._spilled(side, out) for side in (read, parts[len(read) :])]
                self.parts[symbol], self.read[symbol] = sides[0] + sides[1], len(sides[0])
        self.held = 0

    def _spilled(self, parts: list[Entries | tuple[int, int]], out) -> list[Entries | tuple[int, int]]:
        """parts with those in memory (they follow the others) as one extent."""
        in_memory = [p for p in parts if isinstance(p[0], np.ndarray)]
        if not in_memory:
            return parts
        at, prefix = (np.concatenate([p[k] for p in in_memory]) for k in range(2))
        made = [*parts[: len(parts) - len(in_memory)], (out.tell(), at.size)]
        at.astype(np.int64, copy=False).tofile(out)
        prefix.astype(np.uint16, copy=False).tofile(out)
        self.spilled += at.size
        return made

    def count(self, symbol: int) -> int:
        return sum(p[0].size if isinstance(p[0], np.ndarray) else p[1] for p in self.parts[symbol])

    def fresh(self, symbol: int) -> list[Entries | tuple[int, int]]:
        """The parts of a queue that weren't read before, in order, for blocks()."""
        parts = self.parts[symbol][self.read[symbol] :]
        self.read[symbol] = len(self.parts[symbol])
        return parts

    def _load(self, offset: int, n: int, low: int, high: int) -> Entries:
        return np.fromfile(self.path, np.int64, high - low, offset=offset + 8 * low), np.fromfile(self.path, np.uint16, high - low, offset=offset + 8 * n + 2 * low)

    def blocks(self, parts: list[Entries | tuple[int, int]]) -> Iterator[Entries]:
        """Entries in order, in blocks: extents are read piece by piece, small parts in memory are joined."""
        small: list[Entries] = []
        for part in [*parts, None]:
            if part is not None and isinstance(part[0], np.ndarray):
                small.append(part)
                continue
            yield from _gathered(small)
            small = []
            if part is not None:
                for low in range(0, part[1], BLOCK):
                    yield self._load(*part, low, min(low + BLOCK, part[1]))

    def backward(self, symbol: int) -> Iterator[Entries]:
        """All entries of a queue from the last to the first, in blocks."""
        small: list[Entries] = []
        for part in [*reversed(self.parts[symbol]), None]:
            if part is not None and isinstance(part[0], np.ndarray):
                small.append(part)
                continue
            for at, prefix in reversed(_gathered(small[::-1])):
                yield at[::-1], prefix[::-1]
            small = []
            if part is not None:
                for high in range(part[1], 0, -BLOCK):
                    at, prefix = self._load(*part, max(0, high - BLOCK), high)
                    yield at[::-1], prefix[::-1]

    def clear(self, symbol: int) -> None:
        self.held -= sum(p[0].size for p in self.parts[symbol] if isinstance(p[0], np.ndarray))
        self.parts[symbol], self.read[symbol] = [], 0


def _gathered(parts: list[Entries]) -> list[Entries]:
    """Small parts joined to blocks, large ones cut."""
    if not parts:
        return []
    at, prefix = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return [(at[i : i + BLOCK], prefix[i : i + BLOCK]) for i in range(0, at.size, BLOCK)]


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high] for non-empty ranges, through a table of doubling widths."""
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(low.size, values.dtype)
    table = values
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[low[own]], table[high[own] - (1 << k)])
    return out


class Scan:
    """What a scan remembers between blocks: for each symbol, the smallest prefix since its queue's last entry."""

    def __init__(self, text: np.ndarray, queues: Queues):
        self.text, self.queues = text, queues
        self.least = np.zeros(256, np.uint16)

    def new_bucket(self) -> None:
        self.least[:] = 0

    def induce(self, at: np.ndarray, prefix: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Sends the predecessors of a block of entries to their queues; `prefix` is each entry's common prefix with
        the entry met before it, `wanted` tells which predecessors (positions, symbols) are of the scan's type."""
        before = np.maximum(at - 1, 0)
        symbol = np.asarray(self.text[before])
        sent = np.flatnonzero((at > 0) & wanted(before, symbol))
        order = sent[np.argsort(symbol[sent], kind="stable")]
        if order.size:
            s = symbol[order]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            low = np.concatenate([[0], order[:-1] + 1])
            low[first] = 0
            own = range_minimum(prefix, low, order + 1)
            own[first] = np.minimum(own[first], self.least[s[first]])
            own = np.minimum(own, LONGEST - 1) + np.uint16(1)
            cut = np.flatnonzero(np.append(first, True))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                self.queues.push(int(s[a]), before[order[a:b]], own[a:b])
            last = order[cut[1:] - 1]
            self.least = np.minimum(self.least, prefix.min())
            tail = np.minimum.accumulate(prefix[::-1])[::-1]
            self.least[s[cut[:-1]]] = np.where(last + 1 < prefix.size, tail[np.minimum(last + 1, prefix.size - 1)], LONGEST)
        elif prefix.size:
            self.least = np.minimum(self.least, prefix.min())


def write_types(text: np.ndarray, path: str) -> np.ndarray:
    """A file with 1 for each S-type suffix, made from the end of the text in blocks."""
    n = text.size
    out = np.memmap(path, np.uint8, "w+", shape=(n,))
    following, known = -1, True  # nothing follows the last symbol: any fixed type does for its run
    for high in range(n, 0, -BLOCK):
        low = max(0, high - BLOCK)
        block = np.asarray(text[low:high])
        change = np.flatnonzero(np.append(block[1:] != block[:-1], True))
        ends = np.repeat(change, np.diff(np.concatenate([[-1], change])))
        after = np.append(block[1:], 0).astype(np.int16)
        after[-1] = following
        small = block < after[ends]
        if following < 0 or following == block[-1]:
            small[ends == block.size - 1] = known
        out[low:high] = small
        following, known = int(block[0]), bool(small[0])
    out.flush()
    return np.memmap(path, np.uint8, "r")


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, n = a ^ b, np.zeros(a.size, np.uint16)
    for k in range(1, 9):
        n += (x >> np.uint64(64 - 8 * k)) == 0 if k < 8 else x == 0
    return n


def sort_to_depth(padded: np.ndarray, at: np.ndarray, depth: int) -> Entries:
    """Positions by their suffixes' first `depth` symbols (or a few more), and common prefixes with the one before.
    The text has enough zeros behind it."""
    views = np.lib.stride_tricks.sliding_window_view(padded, 8)
    word = lambda p, r: views[p + 8 * r].copy().view(">u8").ravel().astype(np.uint64)
    if not at.size:
        return at, np.zeros(0, np.uint16)
    key = word(at, 0)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]])
    prefix = np.concatenate([[np.uint16(0)], _equal_bytes(key[1:], key[:-1])]).astype(np.uint16)
    for r in range(1, -(-depth // 8)):
        member = np.flatnonzero(same | np.append(same[1:], False))
        if not member.size:
            break
        group = np.cumsum(~same)[member]
        key = word(at[member], r)
        order = np.lexsort((key, group))
        at[member], key = at[member[order]], key[order]
        inner = np.flatnonzero(same[member])
        prefix[member[inner]] = 8 * r + _equal_bytes(key[inner], key[inner - 1])
        same[member[inner]] = key[inner] == key[inner - 1]
    return at, prefix


def _push_by_symbol(queues: Queues, symbol: np.ndarray, at: np.ndarray) -> None:
    order = np.argsort(symbol, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], symbol[order][1:] != symbol[order][:-1], [True]])) if order.size else np.zeros(1, int)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        queues.push(int(symbol[order[a]]), at[order[a:b]], np.zeros(b - a, np.uint16))


def sorted_queue(padded: np.ndarray, queues: Queues, symbol: int, depth: int, folder: str, budget: int, known: int = 1) -> Iterator[Entries]:
    """The positions of a queue, whose suffixes share their first `known` symbols, by their first `depth` symbols. A queue
    beyond the budget is dealt by the next symbol to further queues, each of them sorted in turn."""
    n = queues.count(symbol)
    if not n:
        return
    if n <= budget or known >= depth:
        if known >= depth:  # equal as far as it matters
            blocks = ((at, np.full(at.size, known, np.uint16)) for at, _ in queues.blocks(queues.fresh(symbol)))
        else:
            at = np.concatenate([at for at, _ in queues.blocks(queues.fresh(symbol))])
            made = sort_to_depth(padded, at, depth)
            blocks = ((made[0][i : i + BLOCK], made[1][i : i + BLOCK].copy()) for i in range(0, n, BLOCK))
        first = True
        for at, prefix in blocks:
            if first:
                prefix[0] = known - 1
            first = False
            yield at, prefix
        return
    deeper = Queues(folder, budget)
    for at, _ in queues.blocks(queues.fresh(symbol)):
        _push_by_symbol(deeper, padded[at + known], at)
    queues.clear(symbol)
    first = True
    for s in range(256):
        for at, prefix in sorted_queue(padded, deeper, s, depth, folder, budget, known + 1):
            if first:
                prefix[0] = known - 1
            first = False
            yield at, prefix
    if os.path.exists(deeper.path):
        os.unlink(deeper.path)


def scan_suffixes(text: np.ndarray, depth: int, budget: int = MEMORY_ENTRIES, told: dict | None = None) -> Iterator[Entries]:
    """All suffixes in descending order, in blocks of (positions, common prefix with the next one met, to the depth).
    `told` gets the number of entries that went to disk as spilled."""
    if not text.size:
        return
    n = text.size
    with scratch() as folder:
        path = os.path.join(folder, "text")
        with open(path, "wb") as out:
            text.tofile(out)
            np.zeros(8 * (-(-depth // 8)) + 16, np.uint8).tofile(out)
        padded = np.memmap(path, np.uint8, "r")
        small = write_types(padded[:n], os.path.join(folder, "types"))

        def run(at: int) -> int:
            """How often the symbol at a position follows itself, as far as it matters."""
            own = padded[at : min(at + depth + 8, n)]
            other = np.flatnonzero(own != own[0])
            return int(other[0]) if other.size else own.size

        leftmost = Queues(folder, budget)
        for low in range(0, n, BLOCK):
            own = small[max(0, low - 1) : min(low + BLOCK, n)]
            at = np.flatnonzero((own[1:] == 1) & (own[:-1] == 0)) + max(0, low - 1) + 1
            _push_by_symbol(leftmost, padded[at], at)
        large = Queues(folder, budget)
        scan = Scan(padded, large)
        for symbol in range(256):
            scan.new_bucket()
            before = None
            # the queue of the symbol grows while it is read: what starts with one more of it comes in a later wave
            while own := large.fresh(symbol):
                for at, prefix in large.blocks(own):
                    scan.induce(at, prefix, lambda p, s: (small[p] == 0) & (s >= symbol))
                    before = int(at[-1])
            for at, prefix in sorted_queue(padded, leftmost, symbol, depth, folder, budget):
                if before is not None:
                    prefix[0] = min(run(before), run(int(at[0])))
                    before = None
                scan.induce(at, prefix, lambda p, s: small[p] == 0)
            leftmost.clear(symbol)
        little = Queues(folder, budget)
        little.push(0, np.array([n - 1]), np.zeros(1, np.uint16))  # the last suffix precedes none
        scan = Scan(padded, little)
        for symbol in range(255, -1, -1):
            scan.new_bucket()
            before = None
            while own := little.fresh(symbol):
                for at, prefix in little.blocks(own):
                    scan.induce(at, prefix, lambda p, s: (small[p] == 1) & (s <= symbol))
                    before = int(at[-1])
                    yield at, prefix
            # the prefixes of L-type entries are with the entry before, in ascending order: shifted for the way back
            carried = None
            for at, prefix in large.backward(symbol):
                shifted = np.empty_like(prefix)
                shifted[1:] = prefix[:-1]
                shifted[0] = carried if carried is not None else 0 if before is None else min(run(before), run(int(at[0])))
                carried = prefix[-1]
                scan.induce(at, shifted, lambda p, s: (small[p] == 1) & (s < symbol))
                yield at, shifted
            little.clear(symbol)
            large.clear(symbol)
        if told is not None:
            told["spilled"] = leftmost.spilled + large.spilled + little.spilled
