"""Blocks of postings: how they are cut from documents, and how many queries are scored against one at a time.

A block holds the posting lists of a range of documents, at most a few million postings, whole in one task. Its first row,
of the empty term, has the documents in the order of their ids, and their lengths; each further row has a term, the places
of the documents that hold it, how often, and the largest count and the smallest length among them; what the term can add to
any score is bounded by the largest of its weights in the block. Rows of a block stay together and in order: they are written by one task
into a file of one row group, which a scan never splits, and are only joined with what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A block is closed behind the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 21
#: Lists that one document in so many holds are looked up by place.
COMMON = 32
#: From so many queries of a block on, they are scored together, up to so many postings and sums at a time; so many documents found
#: are looked up at once.
TOGETHER, TOGETHER_POSTINGS, TOGETHER_SUMS, TOGETHER_FOUND = 16, 1 << 20, 1 << 18, 1 << 18
#: Room for rounding to 6 places and for the order of sums.
SLACK = 2e-6
#: A file of blocks is one row group (its postings are a few bytes each).
ROW_GROUP_BYTES = 1 << 30

SCHEMA = "term string, n int, cf long, max_tf int, min_dl int, at array<int>, tf array<int>, ids array<long>, dl array<int>"
_NAMES = ["term", "n", "cf", "max_tf", "min_dl", "at", "tf", "ids", "dl"]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType, empty_first: bool) -> pa.Array:
    """A list column of the given sizes; with empty_first a null row stands before them."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
    return pa.concat_arrays([pa.nulls(1, pa.list_(kind)), made]) if empty_first else made


def _block(ids: np.ndarray, sizes: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
    """The rows of one block of documents with so many tokens each."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(ids.size, np.int64)
    place[order] = np.arange(ids.size)
    coded = tokens.dictionary_encode()
    by_name = np.asarray(pc.sort_indices(coded.dictionary)).astype(np.int64)
    rank = np.empty(by_name.size, np.int64)
    rank[by_name] = np.arange(by_name.size)
    key, tf = np.unique(rank[np.asarray(coded.indices).astype(np.int64)] * max(1, ids.size) + np.repeat(place, sizes), return_counts=True)
    term, at = np.divmod(key, max(1, ids.size))
    n = np.bincount(term, minlength=by_name.size)
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if n.size else np.zeros(0, np.int64)
    dl = sizes[order]
    over = (lambda f, x: f.reduceat(x, first)) if n.size else (lambda f, x: np.zeros(0, np.int64))
    head = lambda x, kind: pa.concat_arrays([pa.nulls(1, kind), pa.array(x, kind)])
    terms = pa.concat_arrays([pa.array([""], coded.dictionary.type), coded.dictionary.take(pa.array(by_name))])
    alone = lambda x, kind: pa.concat_arrays([pa.array([x], pa.list_(kind)), pa.nulls(n.size, pa.list_(kind))])
    columns = [terms.cast(pa.string()), head(n, pa.int32()), head(over(np.add, tf), pa.int64()), head(over(np.maximum, tf), pa.int32()), head(over(np.minimum, dl[at]), pa.int32())]
    columns += [_lists(at, n, pa.int32(), True), _lists(tf, n, pa.int32(), True), alone(ids[order], pa.int64()), alone(dl, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (doc_id, tokens); null tokens are none. For mapInArrow."""
    held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
    total = 0
    for batch in batches:
        tokens = pc.fill_null(batch.column(1), []) if batch.column(1).null_count else batch.column(1)
        ids, sizes = np.asarray(batch.column(0)).astype(np.int64), np.asarray(pc.list_value_length(tokens)).astype(np.int64)
        ends, low = np.cumsum(sizes), 0
        while low < ids.size:
            # up to the document that fills the block
            before = int(ends[low - 1]) if low else 0
            high = min(ids.size, int(np.searchsorted(ends, before + BLOCK_TOKENS - total)) + 1)
            held.append((ids[low:high], sizes[low:high], tokens.slice(low, high - low).flatten()))
            total += int(ends[high - 1]) - before
            if total >= BLOCK_TOKENS:
                yield _block(*_joined(held))
                held, total = [], 0
            low = high
    if any(ids.size for ids, _, _ in held):
        yield _block(*_joined(held))


def _joined(held: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), pa.concat_arrays([h[2] for h in held])


class Block:
    """A block's rows as far as a set of queries asks for them. Each row may carry the queries that ask for its term and
    what it weighs in them; the first one, marks of the queries: a number, and a document."""

    def __init__(self, parts: list[pa.RecordBatch], avgdl: float, k1: float, b: float):
        rows = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: rows[name].combine_chunks() if isinstance(rows[name], pa.ChunkedArray) else rows[name]
        self.k1 = k1
        self.ids, self.dl = np.asarray(column("ids").flatten()), np.asarray(column("dl").flatten()).astype(np.float64)
        self.norm = k1 * (1 - b + b * self.dl / avgdl) if avgdl else np.zeros(self.dl.size)
        at, tf = column("at"), column("tf")
        self.cuts = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(at), 0)))]).astype(np.int64)
        self.at, self.tf = np.asarray(at.flatten()), np.asarray(tf.flatten()).astype(np.float64)
        asked = column("asked")
        row = np.repeat(np.arange(len(asked)), np.asarray(pc.fill_null(pc.list_value_length(asked), 0)))
        each = asked.flatten()
        query, value, target = np.asarray(each.field(0)), np.asarray(each.field(1)), each.field(2)
        marks = row == 0
        self.mark_query, self.mark_value, self.mark_target = query[marks], value[marks].astype(np.float64), target.filter(pa.array(marks))
        order = np.argsort(query[~marks], kind="stable")
        self.query, self.row, self.weight = query[~marks][order], row[~marks][order], value[~marks][order]
        self._made: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
        self.sums, self.met = np.zeros(self.ids.size), np.zeros(self.ids.size, bool)

    @cached_property
    def marks(self) -> dict[int, tuple[float, int | None]]:
        return dict(zip(self.mark_query.tolist(), zip(self.mark_value.tolist(), self.mark_target.to_pylist())))

    @cached_property
    def starts(self) -> np.ndarray:
        """Where each query's rows begin, and behind the last one's end."""
        edges = np.flatnonzero(self.query[1:] != self.query[:-1]) + 1
        return np.concatenate([[0], edges, [self.query.size]]) if self.query.size else np.zeros(1, np.int64)

    def queries(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Every query that asks for a term of the block, with rows and weights."""
        for low, high in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            yield int(self.query[low]), self.row[low:high], self.weight[low:high]

    @cached_property
    def weights(self) -> np.ndarray:
        """BM25 weights of all postings."""
        return self.tf * (self.k1 + 1) / (self.tf + self.norm[self.at])

    @cached_property
    def bound(self) -> np.ndarray:
        """The largest weight of each row, 0 for one without postings."""
        out, some = np.zeros(self.cuts.size - 1), np.flatnonzero(np.diff(self.cuts))
        if some.size:
            out[some] = np.maximum.reduceat(self.weights, self.cuts[some])
        return out

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that one document in COMMON holds: the place of each row among them (-1: none), and their weights by place,
        0 where there is none; at most 8 * COMMON bytes a posting."""
        size = np.diff(self.cuts)
        rows = np.flatnonzero((COMMON * size >= self.ids.size) & (size > 0))
        number = np.full(size.size, -1)
        number[rows] = np.arange(rows.size)
        made = np.zeros((rows.size, self.ids.size))
        for i, row in enumerate(rows.tolist()):
            at, w = self.list(row)
            made[i, at] = w
        return number, made

    def list(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and BM25 weights of a row's postings."""
        own = slice(self.cuts[row], self.cuts[row + 1])
        return self.at[own], self.weights[own]

    def vector(self, row: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Weights by place, 0 where there is none, and where there are some, of a row that a quarter of the documents hold;
        null for others. Made when first asked for, at most 36 bytes a posting."""
        if row not in self._made:
            at, w = self.list(row)
            made = None
            if 4 * at.size >= self.ids.size:
                made = np.zeros(self.ids.size), np.zeros(self.ids.size, bool)
                made[0][at], made[1][at] = w, True
            self._made[row] = made
        return self._made[row]

    def scores(self, rows: np.ndarray, weights: np.ndarray, least: float = -np.inf, best: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores, rounded to 6 places, of the documents that hold a term of the rows and may reach `least`, or,
        with `best`, what so many of the block have reached so far.

        Rows whose bounds together stay under it can't lift a document alone: they are only looked up for documents met in
        the others, and only while these may still reach it."""
        bounds = np.maximum(weights * self.bound[rows], 0.0)
        order = np.argsort(-bounds, kind="stable")
        rows, weights, bounds = rows[order], weights[order], bounds[order]
        # what rows from i on can add, with room for rounding, and what they can take
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0.0) + 1e-6
        less = np.append(np.cumsum(np.minimum(weights * self.bound[rows], 0.0)[::-1])[::-1], 0.0) if best else None
        walked = 0
        while walked < rows.size and rest[walked] >= least:
            if (whole := self.vector(int(rows[walked]))) is not None:
                self.sums += weights[walked] * whole[0]
                self.met |= whole[1]
            else:
                at, w = self.list(int(rows[walked]))
                self.sums[at] += weights[walked] * w
                self.met[at] = True
            walked += 1
            if best and walked < rows.size and not walked & (walked - 1):  # behind 1, 2, 4, 8, ... rows
                so_far = self.sums[self.met]
                if so_far.size >= best:
                    least = max(least, float(np.partition(so_far, so_far.size - best)[so_far.size - best] + less[walked]))
        found = np.flatnonzero(self.met & (self.sums >= least - rest[walked]))
        sums = self.sums[found]
        self.met[:], self.sums[:] = False, 0.0
        for i in range(walked, rows.size):
            if i > walked:
                may = sums + rest[i] >= least
                found, sums = found[may], sums[may]
            if not found.size:
                break
            if (whole := self.vector(int(rows[i]))) is not None:
                sums += weights[i] * whole[0][found]
                continue
            at, w = self.list(int(rows[i]))
            k = np.minimum(np.searchsorted(at, found), at.size - 1)
            sums += np.where(at[k] == found, weights[i] * w[k], 0.0)
        return found, np.round(sums, 6)


class Best:
    """The k best of every query over all blocks of a task; what they must reach bounds the next block's work."""

    def __init__(self, k: int):
        self.k, self.found = k, {}

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        every = block.query[block.starts[:-1]].tolist()
        none = np.zeros(0), np.zeros(0, np.int64)
        so_far = [self.found.get(q, none)[0] for q in every]
        least = np.array([s[-1] if s.size >= self.k else -np.inf for s in so_far])
        # queries with k documents from earlier blocks are scored together
        known = np.flatnonzero(least > 2 * SLACK)
        known = known if known.size >= TOGETHER else known[:0]
        for i, (at, s) in zip(known.tolist(), reaching(block, known, least[known])):
            if at.size:
                self._merge(every[i], block.ids[at], s)
        for i in np.flatnonzero(least <= 2 * SLACK) if known.size else range(len(every)):
            rows = slice(block.starts[i], block.starts[i + 1])
            at, s = block.scores(block.row[rows], block.weight[rows], least[i], self.k)
            self._merge(every[i], block.ids[at], s)
        return iter(())

    def _merge(self, query: int, own: np.ndarray, s: np.ndarray) -> None:
        scores, ids = self.found.get(query, (np.zeros(0), np.zeros(0, np.int64)))
        if s.size > self.k:  # ties of the k-th stay, the smallest ids among them first
            reach = s >= -np.partition(-s, self.k - 1)[self.k - 1]
            own, s = own[reach], s[reach]
        s, own = np.concatenate([scores, s]), np.concatenate([ids, own])
        order = np.lexsort((own, -s))[: self.k]
        self.found[query] = s[order], own[order]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            query = np.repeat(list(self.found), [s.size for s, _ in self.found.values()])
            yield pairs(query, np.concatenate([i for _, i in self.found.values()]), np.concatenate([s for s, _ in self.found.values()]))


class Every:
    """All scores."""

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for query, rows, weights in block.queries():
            at, s = block.scores(rows, weights)
            yield pairs(np.full(at.size, query), block.ids[at], s)

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class Marked:
    """The scores of the marked documents alone."""

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        target = block.mark_target.drop_null() if block.mark_target.null_count else block.mark_target
        target, asking = np.asarray(target), block.mark_query[np.asarray(block.mark_target.is_valid())]
        place = np.searchsorted(block.ids, target)
        own = np.flatnonzero(place < block.ids.size)
        own = own[block.ids[place[own]] == target[own]]
        every = block.query[block.starts[:-1]]
        for query, target, place in zip(asking[own].tolist(), target[own].tolist(), place[own].tolist()):
            i = int(np.searchsorted(every, query))
            if i >= every.size or every[i] != query:
                continue
            rows, weights = block.row[block.starts[i] : block.starts[i + 1]], block.weight[block.starts[i] : block.starts[i + 1]]
            total, met = 0.0, False
            for row, weight in zip(rows.tolist(), weights.tolist()):
                at = block.at[block.cuts[row] : block.cuts[row + 1]]
                k = int(np.searchsorted(at, place))
                if k < at.size and at[k] == place:
                    tf = block.tf[block.cuts[row] + k]
                    total, met = total + weight * tf * (block.k1 + 1) / (tf + block.norm[place]), True
            if met:
                yield pairs(np.array([query]), np.array([target]), np.round([total], 6))

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class Counts:
    """By query, how many scores are above its mark, equal to it, and positive; one row a query and task."""

    def __init__(self) -> None:
        self.found: dict[int, np.ndarray] = {}

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        for query, rows, weights in block.queries():
            own = block.marks.get(query, (np.nan, None))[0]
            _, s = block.scores(rows, weights)
            counts = np.array([np.count_nonzero(s > own), np.count_nonzero(s == own), np.count_nonzero(s > 0)])
            self.found[query] = self.found.get(query, 0) + counts
        return iter(())

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            made = np.stack(list(self.found.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(self.found), pa.int64()), *(pa.array(made[:, i]) for i in range(3))], names=["query_id", "greater", "equal", "positive"])


class Above:
    """By query, how many scores are above its mark and equal to it; one row a query and task. Only documents that may reach
    the mark are scored, once for all queries of equal weighted terms; queries without a mark have none."""

    def __init__(self) -> None:
        self.found: dict[int, np.ndarray] = {}

    def add(self, block: Block) -> Iterator[pa.RecordBatch]:
        starts, every = block.starts, block.query[block.starts[:-1]]
        order = np.argsort(block.mark_query, kind="stable")
        i = np.searchsorted(block.mark_query[order], every)
        known = np.flatnonzero(i < order.size)
        known = known[block.mark_query[order][i[known]] == every[known]]
        own = np.full(every.size, np.nan)
        own[known] = block.mark_value[order][i[known]]
        # a query whose terms' bounds together stay under its mark has nothing in the block
        most = np.add.reduceat(np.maximum(block.weight * block.bound[block.row], 0.0), starts[:-1]) if every.size else own
        may = np.flatnonzero(most >= own - SLACK)
        # only queries whose terms have one sum of hashes are compared
        mixed = (block.row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ block.weight.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        _, kind, size = np.unique(np.add.reduceat(mixed, starts[:-1])[may] if may.size else mixed[:0], return_inverse=True, return_counts=True)
        groups = [([i], x) for i, x in zip(*(x[size[kind] == 1].tolist() for x in (may, own[may])))]
        alike: dict[tuple[bytes, bytes], list[int]] = {}
        for i in may[size[kind] > 1].tolist():
            alike.setdefault((block.row[starts[i] : starts[i + 1]].tobytes(), block.weight[starts[i] : starts[i + 1]].tobytes()), []).append(i)
        groups += [(a, float(own[a].min())) for a in alike.values()]
        # few queries, or marks that a document without a term reaches, one by one
        many = [(a, least) for a, least in groups if least > 2 * SLACK] if len(groups) >= TOGETHER else []
        for a, least in groups:
            if not many or least <= 2 * SLACK:
                rows = slice(starts[a[0]], starts[a[0] + 1])
                self._count(every, own, a, block.scores(block.row[rows], block.weight[rows], least)[1])
        first = np.array([a[0] for a, _ in many], np.int64)
        single = np.array([len(a) == 1 for a, _ in many], bool)
        for low, high, who, _, s in reached(block, first, np.array([x for _, x in many])):
            mark = own[first[who]]
            greater, equal = (np.bincount(who[x] - low, minlength=high - low) for x in (s > mark, s == mark))
            for i in np.flatnonzero(single[low:high] & (greater + equal > 0)).tolist():
                before = self.found.get(query := int(every[first[low + i]]), (0, 0))
                self.found[query] = before[0] + int(greater[i]), before[1] + int(equal[i])
            for i in (np.flatnonzero(~single[low:high]) + low).tolist():
                self._count(every, own, many[i][0], s[slice(*np.searchsorted(who, [i, i + 1]))])
        return iter(())

    def _count(self, every: np.ndarray, own: np.ndarray, alike: list[int], s: np.ndarray) -> None:
        for i in alike:
            query = int(every[i])
            greater, equal = self.found.get(query, (0, 0))
            self.found[query] = greater + int(np.count_nonzero(s > own[i])), equal + int(np.count_nonzero(s == own[i]))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            greater, equal = zip(*self.found.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(self.found), pa.int64()), pa.array(greater, pa.int64()), pa.array(equal, pa.int64())], names=["query_id", "greater", "equal"])


def reaching(block: Block, asked: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and scores, rounded to 6 places, of the documents that may reach `least` (above 2 * SLACK) in each of the asked queries, by
    their places among the block's queries."""
    for low, high, who, doc, total in reached(block, asked, least):
        edges = np.searchsorted(who, np.arange(low, high + 1))
        for i in range(high - low):
            yield doc[edges[i] : edges[i + 1]], total[edges[i] : edges[i + 1]]


def reached(block: Block, asked: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """What reaching() finds, of many queries in a piece: the first of them, the one behind the last, and for each find the query's number
    among the asked ones, place and score, in the order of queries.

    Of a query's lists, from the rarest on, so many are added up that the rest can't reach `least` by itself, and all that few
    documents hold; documents that may still reach it are looked up in the rest, 1, 2, 4, 8, ... lists at a time. Queries are
    taken together, as many as fill TOGETHER_POSTINGS or TOGETHER_SUMS."""
    size, (number, common), n = np.diff(block.cuts), block.common, block.ids.size
    first, terms = block.starts[asked], block.starts[asked + 1] - block.starts[asked]
    end = np.cumsum(terms)
    begin = end - terms
    query = np.repeat(np.arange(asked.size), terms)
    at = np.repeat(first - begin, terms) + np.arange(query.size)
    at = at[np.argsort(query << 32 | size[block.row[at]])]
    row, weight = block.row[at], block.weight[at]
    sums = np.concatenate([[0.0], np.cumsum(np.maximum(weight * block.bound[row], 0.0))])
    rest = sums[end][query] - sums[:-1]
    scanned = (rest >= least[query] - SLACK) | (number[row] < 0)
    # both hold for the rarest lists of a query, so what is scanned comes first
    scans = np.bincount(query, scanned, minlength=asked.size).astype(np.int64)
    postings = np.bincount(query, np.where(scanned, size[row], 0), minlength=asked.size)
    after = begin + scans
    low = start = 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while low < asked.size:
        fit = int(np.searchsorted(np.cumsum(postings[low : low + max(1, TOGETHER_SUMS // max(1, n))]), TOGETHER_POSTINGS, "right"))
        high = low + max(1, fit)
        own, here = np.arange(low, high), slice(begin[low], end[high - 1])
        chosen = np.flatnonzero(scanned[here]) + begin[low]
        each = size[row[chosen]]
        place = np.repeat(block.cuts[row[chosen]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        key = np.repeat((query[chosen] - low) * n, each) + block.at[place]
        total = np.bincount(key, np.repeat(weight[chosen], each) * block.weights[place], minlength=own.size * n)
        left = sums[end[own]] - sums[after[own]]
        found = np.flatnonzero(total.reshape(own.size, n) >= (least[own] - left - SLACK)[:, None])
        held.append((found // n + low, found % n, total[found]))
        low = high
        if low < asked.size and sum(h[0].size for h in held) < TOGETHER_FOUND:
            continue
        who, doc, total = (np.concatenate(x) for x in zip(*held))
        at, step = after.copy(), 1
        while who.size:
            take = np.minimum(end - at, step)
            most = take[who]
            if not most.any():
                break
            for j in range(int(most.max())):
                some = np.flatnonzero(most > j)
                entry = at[who[some]] + j
                total[some] += weight[entry] * common[number[row[entry]], doc[some]]
            at += take
            may = total + (sums[end] - sums[at])[who] >= least[who] - SLACK
            who, doc, total = who[may], doc[may], total[may]
            step *= 2
        yield start, high, who, doc, np.round(total, 6)
        start, held = high, []


PAIRS = "query_id long, doc_id long, score double"
COUNTS = "query_id long, greater long, equal long, positive long"
ABOVE = "query_id long, greater long, equal long"


def pairs(query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "doc_id", "score"])


def walk(kind: Callable, avgdl: float, k1: float, b: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives whole blocks to a fresh kind() and returns what it makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = kind(), []
        for batch in batches:
            # a block's first row has documents, which the others have not: null, or none
            ids = batch.column(batch.schema.names.index("ids"))
            starts = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(ids), 0))).tolist()
            for low, high in zip([0, *starts], [*starts, batch.num_rows]):
                if low in starts and held:
                    yield from made.add(Block(held, avgdl, k1, b))
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
        if held:
            yield from made.add(Block(held, avgdl, k1, b))
        yield from made.rest()

    return run
