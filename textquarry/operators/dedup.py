"""Exact and near-duplicate removal: keep-first, cross-split purges, MinHash bands with exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.modular import affine
from ..sources import store


def keep_first(docs: DataFrame, key: str = "text", order: str = "doc_id") -> DataFrame:
    """The row of the smallest `order` of each key (keys are compared by value, a null is a key). Partial aggregation
    finds the smallest, so that a key held by a third of all rows sends one row a task."""
    row = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("first"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return docs.groupBy(F.col(key).alias("key")).agg(F.min(row)["row"].alias("row")).select("row.*")


def purge(docs: DataFrame, other: DataFrame, key: str = "text") -> DataFrame:
    """docs whose key is no key of other."""
    return docs.join(other.select(key).distinct(), key, "left_anti")


def split_name(doc_id) -> F.Column:
    """train, val or test by the last digit of the id: 0-7, 8, 9."""
    return F.when(F.pmod(doc_id, F.lit(10)) < 8, "train").when(F.pmod(doc_id, F.lit(10)) == 8, "val").otherwise("test")


def cross_split_purge(docs: DataFrame, key: str = "text") -> DataFrame:
    """train whole; test minus train; val minus train and minus the purged test."""
    part = lambda name: docs.where(F.col("split") == name)
    train = part("train")
    test = purge(part("test"), train, key)
    val = purge(purge(part("val"), train, key), test, key)
    return train.unionByName(test).unionByName(val)


def shingled(docs: DataFrame, n_words: int = 3) -> DataFrame:
    """(doc_id, shingles) of docs (doc_id, text)."""
    words = docs.select("doc_id", tx.lower_words(F.col("text")).alias("w"))
    return words.select("doc_id", tx.shingles(F.col("w"), n_words).alias("shingles"))


def _smallest(h: np.ndarray, starts: np.ndarray, a: int, b: int) -> np.ndarray:
    """Least affine image of each run of hashes."""
    return np.minimum.reduceat(affine(h, a, b), starts).astype(np.int64)


def signatures(docs: DataFrame, n: int = 64, n_words: int = 3) -> DataFrame:
    """(doc_id, n_shingles, sig): n smallest affine images modulo 2^61 - 1 of the shingles' 60-bit hashes; zeros for none.

    Shingles and hashes are made by built-in expressions; their minima, n of them over one array, in an Arrow stage, which
    also keeps Spark from pushing what is done with a signature into the lambdas that make it.
    """
    ab = tx.minhash_coefficients(n)
    hashed = shingled(store.spread(docs.select("doc_id", "text")), n_words)
    hashed = hashed.select("doc_id", F.transform("shingles", tx.hash60).alias("h"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            offsets = np.asarray(column.offsets).astype(np.int64)
            h = np.asarray(column.values).astype(np.uint64)
            size = np.diff(offsets)
            sig = np.zeros((size.size, n), np.int64)
            some = np.flatnonzero(size)
            for k in range(0, some.size, 256):  # so many documents at once
                own = some[k : k + 256]
                low, high = offsets[own[0]], offsets[own[-1] + 1]
                for j, (a, b) in enumerate(ab):
                    sig[own, j] = _smallest(h[low:high], offsets[own] - low, a, b)
            made = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), n).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), made], names=["doc_id", "n_shingles", "sig"])

    return hashed.mapInArrow(sign, "doc_id long, n_shingles long, sig array<long>")


def bands(signed: DataFrame, n_bands: int = 16, rows: int = 4) -> DataFrame:
    """(doc_id, band, key)."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.array_join(F.slice("sig", i * rows + 1, rows), ","))
    return signed.select("doc_id", F.posexplode(cut).alias("band", "key"))


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct pairs (doc_id, other_id) that share a band."""
    return bands(a).join(bands(b).withColumnRenamed("doc_id", "other_id"), ["band", "key"]).select("doc_id", "other_id").distinct()


def near_pairs(a: DataFrame, b: DataFrame, texts_a: DataFrame, texts_b: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, other_id, jaccard) of candidates by signature whose shingle sets reach the threshold; a and b are signed,
    texts_a and texts_b have (doc_id, text). Documents without shingles are near to none. Only texts of candidates are
    cut into shingles, each once."""
    pairs = store.cut(candidates(a.where("n_shingles > 0"), b.where("n_shingles > 0")))
    left = shingled(texts_a.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"))
    right = shingled(texts_b.join(pairs.select(F.col("other_id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    # an explicit cut between shingles and what is done with them: Spark would make them again for every use
    left, right = store.cut(left), store.cut(right.select(F.col("doc_id").alias("other_id"), F.col("shingles").alias("other")))
    joined = pairs.join(left, "doc_id").join(right, "other_id")
    jaccard = F.round(tx.jaccard(F.col("shingles"), F.col("other")), 6).alias("jaccard")
    return joined.select("doc_id", "other_id", jaccard).where(F.col("jaccard") >= threshold)


def hashed(docs: DataFrame, n_words: int = 3) -> DataFrame:
    """(doc_id, shingles) of docs (doc_id, text), a 64-bit hash for each shingle."""
    return shingled(docs, n_words).select("doc_id", F.transform("shingles", lambda x: F.xxhash64(x)).alias("shingles"))


def band_hashes(signed: DataFrame, n_bands: int = 16, rows: int = 4) -> DataFrame:
    """(doc_id, key): a 64-bit hash of each band and its number, a sixth of a band's text."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))
    return signed.select("doc_id", F.explode(cut).alias("key"))


#: A key of more rows is joined by broadcast: there can't be many of them.
HOT = 10_000


def hot_join(rows: DataFrame, one: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """rows joined with one (a row a key); counts (key, n) tells how many rows a key has. Keys of many rows don't go to one
    task: what belongs to them is broadcast."""
    hot = store.cut(counts.where(F.col("n") > HOT).select(key))
    if hot.isEmpty():
        return rows.join(one, key)
    hot = F.broadcast(hot)
    cold = rows.join(hot, key, "left_anti").join(one.join(hot, key, "left_anti"), key)
    return cold.unionByName(rows.join(F.broadcast(one.join(hot, key, "left_semi")), key))


def star_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, other_id, many) of signed a and b: each document of a with the smallest of b of each of its bands, and whether
    a band of the two has more of b."""
    own = band_hashes(a)
    stars = store.cut(band_hashes(b).groupBy("key").agg(F.min("doc_id").alias("other_id"), F.count("*").alias("size")).join(own.select("key").distinct(), "key", "left_semi"))
    counts = own.groupBy("key").agg(F.count("*").alias("n"))
    met = hot_join(own, stars, "key", counts)
    return met.groupBy("doc_id", "other_id").agg(F.max(F.col("size") > 1).alias("many"))


def near_any(a: DataFrame, b: DataFrame, texts_a: DataFrame, texts_b: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id) of the documents of a that are near to one of b, as near_pairs() finds them, without listing pairs.

    First, each document is held against one representative of each of its bands: members of a large group of near copies
    meet one document, not each other. Those it doesn't find that have a band with more documents of b are held against these by
    the rarest of their shingles: two sets that reach the threshold share one among so many of the rarest of each as the
    threshold lets them differ in, and one more. Of equal sets of b one is looked at. Only texts of documents that share a
    band are cut into shingles, of which 64-bit hashes are kept."""
    a, b = a.where("n_shingles > 0"), b.where("n_shingles > 0")
    sets = lambda texts, ids: store.cut(hashed(texts.join(ids, "doc_id", "left_semi")))
    pairs = store.cut(star_pairs(a, b))
    left = sets(texts_a, pairs.select("doc_id").distinct())
    right = sets(texts_b, pairs.select(F.col("other_id").alias("doc_id")).distinct())
    reach = lambda x: F.round(tx.jaccard(F.col("shingles"), F.col("other")), 6) >= x
    other = right.select(F.col("doc_id").alias("other_id"), F.col("shingles").alias("other"))
    met = hot_join(pairs.join(left, "doc_id"), other, "other_id", pairs.groupBy("other_id").agg(F.count("*").alias("n")))
    found = store.cut(met.where(reach(threshold)).select("doc_id").distinct())
    open_ = store.cut(pairs.where("many").select("doc_id").distinct().join(found, "doc_id", "left_anti"))
    if open_.isEmpty():
        return found

    rest = store.cut(left.join(open_, "doc_id", "left_semi").join(a.select("doc_id", "sig"), "doc_id"))
    theirs = store.cut(band_hashes(b).join(band_hashes(rest).select("key").distinct(), "key", "left_semi").select("doc_id").distinct())
    right = sets(texts_b, theirs).join(b.select("doc_id", "sig"), "doc_id")
    one = right.groupBy(F.array_sort("shingles").alias("set"), "sig").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "sig", F.col("set").alias("shingles"))
    one = store.cut(one)
    wanted = rest.select(F.explode("shingles").alias("s")).distinct()
    each = one.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    df = each.groupBy("s").agg(F.count("*").alias("df"))

    def prefix(rows: DataFrame, key: str) -> DataFrame:
        """(key, s) of each row's rarest shingles, as many as may be missing and one more."""
        long = rows.select(F.col("doc_id").alias(key), F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(df, "s", "left")
        rarest = Window.partitionBy(key).orderBy(F.coalesce("df", F.lit(0)), "s")
        return long.withColumn("i", F.row_number().over(rarest)).where(F.col("i") <= F.floor(F.col("n") * (1 - threshold + 1e-6)) + 1).select(key, "n", "s")

    mine, theirs = prefix(rest, "doc_id"), prefix(one, "other_id").join(wanted, "s", "left_semi").withColumnRenamed("n", "m")
    close = (F.col("m") >= F.col("n") * threshold - 1e-3) & (F.col("n") >= F.col("m") * threshold - 1e-3)
    pairs = mine.join(theirs, "s").where(close).select("doc_id", "other_id").distinct()
    banded = F.exists(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("sig", i * 4 + 1, 4) == F.slice("other_sig", i * 4 + 1, 4))
    other = one.select(F.col("doc_id").alias("other_id"), F.col("shingles").alias("other"), F.col("sig").alias("other_sig"))
    more = pairs.join(rest, "doc_id").join(other, "other_id").where(reach(threshold) & banded).select("doc_id").distinct()
    return found.unionByName(more)


def compared(docs: DataFrame, other, n_words: int = 3) -> DataFrame:
    """(doc_id, j): the Jaccard similarity by shingles of each text of docs (doc_id, text) and another expression over its
    row, found where the row stands, from 64-bit hashes."""
    both = docs.select("doc_id", tx.lower_words(F.col("text")).alias("v"), tx.lower_words(other).alias("w"))
    hashes = lambda c: F.transform(tx.shingles(F.col(c), n_words), lambda x: F.xxhash64(x)).alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(np.asarray(c.offsets), np.asarray(c.values)) for c in (batch.column(1), batch.column(2))]
            j = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                a, b = (values[at[i] : at[i + 1]] for at, values in sides)
                shared = np.intersect1d(a, b, assume_unique=True).size
                j[i] = shared / (a.size + b.size - shared) if a.size + b.size else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(j)], names=["doc_id", "j"])

    return both.select("doc_id", hashes("v"), hashes("w")).mapInArrow(run, "doc_id long, j double")


#: So many shingles of queries are broadcast at a time (32 MB); so many are in a block of the corpus.
GROUP_SHINGLES, BLOCK_SHINGLES = 1 << 21, 1 << 21
#: Of the shingles that a block shares with the queries, so many that most documents hold make no pairs: they are looked up for
#: documents met in others.
COMMON = 128
#: So many pairs of postings, or of a query and a document, are counted at once.
PAIRS_AT_ONCE = 1 << 19
#: A sieve has a bit for an eighth of a shingle at least, and so many (128 MB) at most, in segments of so many.
SIEVE_BITS, SEGMENT_BITS = 30, 20

_SETS = "ids array<long>, sizes array<int>, s array<long>, n array<int>, place array<int>"


def sieve(sets: DataFrame, column: str, shingles: int, most: int = SIEVE_BITS) -> Callable[[np.ndarray], np.ndarray]:
    """A function that tells which shingles may be in an array column of sets (all that are, and some others), of which
    there are some `shingles`. Segments of its bits are made by Spark; all together they are bounded."""
    bits = int(min(most, max(SEGMENT_BITS, (8 * shingles).bit_length())))
    shift = np.uint64(64 - bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.asarray(batch.column(0).flatten()).astype(np.int64).view(np.uint64) >> shift).astype(np.int64)
            segment, first = np.unique(at >> SEGMENT_BITS, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array([*first, at.size], pa.int32()), pa.array(at & ((1 << SEGMENT_BITS) - 1), pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(segment), lists], names=["segment", "at"])

    def marked(table: pa.Table) -> pa.Table:
        made = np.zeros(1 << SEGMENT_BITS, bool)
        for chunk in table.column("at").chunks:
            made[np.asarray(chunk.flatten())] = True
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(made, bitorder="little").tobytes()], pa.binary())})

    made = np.zeros(1 << (bits - 3), np.uint8)
    rows = sets.select(column).mapInArrow(places, "segment long, at array<int>").groupBy("segment").applyInArrow(marked, "segment long, bits binary")
    size = 1 << (SEGMENT_BITS - 3)
    for row in rows.collect():
        made[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.bits, np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(made)

    def may(s: np.ndarray) -> np.ndarray:
        at = (s.view(np.uint64) >> shift).astype(np.int64)
        return (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    return may


#: What the hashes of a shingle's words are multiplied by, and what stands for a missing third word.
_MULTIPLIERS, _ALONE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64), np.uint64(0x27D4EB2F165667C5)


def word_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, words) of docs (doc_id, text), a 64-bit hash for each word."""
    words = docs.select("doc_id", tx.lower_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.transform("w", lambda x: F.xxhash64(x)).alias("words"))


def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, shingles) of word_hashes(): 64-bit hashes of the distinct 3-word shingles (of fewer words: the words), made of their
    words' hashes, sorted. For mapInArrow."""
    for batch in batches:
        at, w = np.asarray(batch.column(1).offsets).astype(np.int64), np.asarray(batch.column(1).values).view(np.uint64)
        w, at = w[at[0] : at[-1]], at - at[0]
        size = np.diff(at)
        a, b, c = _MULTIPLIERS
        h = w * a + _ALONE
        if w.size > 2:
            long = np.repeat(size >= 3, size)
            h[:-2] = np.where(long[:-2], w[:-2] * a + w[1:-1] * b + w[2:] * c, h[:-2])
        # the last two words of a document begin no shingle
        n = np.where(size >= 3, size - 2, size)
        taken = _runs(at[:-1], n)
        h, ends = h[taken].view(np.int64), np.cumsum(n)
        for low, high in zip((ends - n).tolist(), ends.tolist()):
            h[low:high].sort()
        first = np.ones(h.size, bool)
        first[1:] = h[1:] != h[:-1]
        first[(ends - n)[n > 0]] = True
        offsets = np.concatenate([[0], np.cumsum(first)])[np.concatenate([[0], ends])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[first]))], names=["doc_id", "shingles"])


def _grouped(rows: DataFrame, shingles: int, may: Callable[[np.ndarray], np.ndarray], words: bool = False) -> DataFrame:
    """Sets of rows (doc_id, shingles), or of word_hashes(), so many shingles at least in a row: ids and sizes of the documents in
    the order of size, their sorted shingles, each once, how many documents hold each, and the places of these. Of shingles, those
    that `may` tells are taken."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in of_words(batches) if words else batches:
            ids, at, values = np.asarray(batch.column(0)), np.asarray(batch.column(1).offsets).astype(np.int64), np.asarray(batch.column(1).values)
            sizes = np.diff(at)
            kept = may(values)
            at, values = np.concatenate([[0], np.cumsum(kept)])[at], values[kept]
            low = 0
            while low < ids.size:
                high = max(low + 1, int(np.searchsorted(at, at[low] + shingles - total, "right")) - 1)
                held.append((ids[low:high], sizes[low:high], np.diff(at[low : high + 1]), values[at[low] : at[high]]))
                total += int(at[high] - at[low])
                low = high
                if total >= shingles or low < ids.size:
                    yield one(held)
                    held, total = [], 0
        if held:
            yield one(held)

    def one(held: list) -> pa.RecordBatch:
        ids, sizes, taken, s = (np.concatenate(x) for x in zip(*held))
        by_size = np.argsort(sizes, kind="stable")
        place = np.empty(ids.size, np.int64)
        place[by_size] = np.arange(ids.size)
        ids, sizes, order = ids[by_size], sizes[by_size], np.argsort(s, kind="stable")
        s, place = s[order], np.repeat(place, taken)[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if s.size else np.zeros(0, np.int64)
        lists = [(ids, pa.int64()), (sizes, pa.int32()), (s[first], pa.int64()), (np.diff(np.append(first, s.size)), pa.int32()), (place, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x, kind)) for x, kind in lists], names=["ids", "sizes", "s", "n", "place"])

    return rows.mapInArrow(pack, _SETS)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run of so many, one behind the other."""
    end = np.cumsum(size)
    return np.repeat(first - (end - size), size) + np.arange(int(end[-1]) if end.size else 0)


class _Sets:
    """Sets of shingles, as _grouped() makes them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, s: np.ndarray, n: np.ndarray, place: np.ndarray):
        self.ids, self.sizes, self.s, self.n, self.place = ids, sizes.astype(np.int64), s, n.astype(np.int64), place
        self.first = np.cumsum(self.n) - self.n

    def shared(self, other: _Sets) -> tuple[np.ndarray, np.ndarray]:
        """Where the shingles that both have stand in each."""
        if self.s.size > other.s.size:
            return other.shared(self)[::-1]
        at = np.searchsorted(other.s, self.s)
        own = np.flatnonzero(at < other.s.size)
        own = own[other.s[at[own]] == self.s[own]]
        return own, at[own]

    def bits(self, k: np.ndarray) -> np.ndarray:
        """A row of 64 bits for each 64 of the given shingles and a column for each set: which it holds."""
        out = np.zeros((-(-k.size // 64), self.ids.size), np.uint64)
        for w in range(out.shape[0]):
            own = k[64 * w : 64 * w + 64]
            holds = np.zeros((self.ids.size, 64), bool)
            holds[self.place[_runs(self.first[own], self.n[own])], np.repeat(np.arange(own.size), self.n[own])] = True
            out[w] = np.packbits(holds, axis=1).view(np.uint64)[:, 0]
        return out


class _Nearest:
    """The nearest document (ties: smallest id) of each of some queries, and how near, over any number of corpus blocks."""

    def __init__(self, queries: _Sets):
        self.queries = queries
        self.best, self.id = np.zeros(queries.ids.size), np.full(queries.ids.size, -1)

    def add(self, block: _Sets) -> None:
        """Documents that share a shingle of few are counted by pairs, and what they share of common ones is added. A document that shares
        common ones only can't be nearer than their share of the query: where that may do, all of the block are looked at."""
        asked, (mine, theirs) = self.queries, self.queries.shared(block)
        common = np.zeros(mine.size, bool)
        common[np.argsort(-block.n[theirs], kind="stable")[:COMMON]] = True
        ours, bits = asked.bits(mine[common]), block.bits(theirs[common])
        mine, theirs = mine[~common], theirs[~common]
        query, k = asked.place[_runs(asked.first[mine], asked.n[mine])].astype(np.int64), np.repeat(theirs, asked.n[mine])
        order = np.argsort(query, kind="stable")
        query, k = query[order], k[order]
        edges = np.append(np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])), query.size) if query.size else np.zeros(1, np.int64)
        before = np.concatenate([[0], np.cumsum(block.n[k])])[edges]
        shift, low = int(block.ids.size).bit_length(), 0
        while low < edges.size - 1:
            # so many queries that a key fits 32 bits
            high = max(low + 1, int(np.searchsorted(before, before[low] + PAIRS_AT_ONCE, "right")) - 1)
            high = min(high, max(low + 1, int(np.searchsorted(query[edges[:-1]], query[edges[low]] + (1 << max(0, 32 - shift)), "left"))))
            own = slice(edges[low], edges[high])
            n = block.n[k[own]]
            key = np.repeat(((query[own] - query[edges[low]]) << shift).astype(np.uint32), n) | block.place[_runs(block.first[k[own]], n)].view(np.uint32)
            key.sort()
            new = np.ones(key.size, bool)
            np.not_equal(key[1:], key[:-1], out=new[1:])
            first = np.flatnonzero(new)
            both, key = np.diff(first, append=key.size), key[first].astype(np.int64)
            q, doc = (key >> shift) + query[edges[low]], key & ((1 << shift) - 1)
            for ask, hold in zip(ours, bits):
                both += np.bitwise_count(ask[q] & hold[doc])
            self._take(block, q, doc, both)
            low = high
        held = np.bitwise_count(ours).sum(axis=0, dtype=np.int64)
        # from so many shingles on a document is too long to be nearer than the best one; documents stand by size
        least = np.maximum(self.best - 1e-6, 1e-9)
        high = np.where(held > 0, np.searchsorted(block.sizes, held * (1 + least) / least - asked.sizes + 1e-3, "right"), 0)
        high[held / np.maximum(1, asked.sizes) < least] = 0
        open_ = np.argsort(high, kind="stable")[np.count_nonzero(high == 0) :]
        high, low = high[open_], 0
        while low < open_.size:
            some = open_[low : low + max(1, PAIRS_AT_ONCE // int(high[min(open_.size, low + 64) - 1]))][:64]
            most = int(high[low + some.size - 1])
            low += some.size
            both = np.zeros((some.size, most), np.int32)
            for ask, hold in zip(ours, bits):
                both += np.bitwise_count(ask[some][:, None] & hold[:most])
            near = both / (asked.sizes[some][:, None] + block.sizes[:most] - both + (both == 0))
            q, doc = np.nonzero((both > 0) & (near >= np.maximum(self.best[some], near.max(axis=1))[:, None] - 1e-6))
            self._take(block, some[q], doc, both[q, doc].astype(np.int64))

    def _take(self, block: _Sets, q: np.ndarray, doc: np.ndarray, both: np.ndarray) -> None:
        """Takes in documents that share so many shingles with queries, in the order of these."""
        if not q.size:
            return
        near = both / (self.queries.sizes[q] + block.sizes[doc] - both)
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        least = np.maximum(np.maximum.reduceat(near, first), self.best[q[first]]) - 1e-6
        some = np.flatnonzero(near >= np.repeat(least, np.diff(np.append(first, q.size))))
        q, doc, both = q[some], doc[some], both[some]
        all_ = self.queries.sizes[q] + block.sizes[doc] - both
        jaccard = (2_000_000 * both + all_) // (2 * all_) / 1e6  # halves go up, as in Spark and SQL
        ids = block.ids[doc]
        order = np.lexsort((ids, -jaccard, q))
        q, jaccard, ids = q[order], jaccard[order], ids[order]
        top = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if q.size else np.zeros(0, np.int64)
        q, jaccard, ids = q[top], jaccard[top], ids[top]
        nearer = (jaccard > self.best[q]) | ((jaccard == self.best[q]) & (jaccard > 0) & (ids < self.id[q]))
        self.best[q[nearer]], self.id[q[nearer]] = jaccard[nearer], ids[nearer]


def nearest_texts(queries: DataFrame, corpus: DataFrame, group: int = GROUP_SHINGLES, block: int = BLOCK_SHINGLES) -> DataFrame:
    """exact_nearest() of queries and corpus (doc_id, text), by 64-bit hashes of their shingles, without a row per pair.

    Shingles that only one side has are left out by sieves first (sizes count them). Then blocks of the corpus meet the queries,
    of which a bounded group at a time is broadcast: shared shingles are counted in the block, and a row a query leaves it. So the
    job takes time by pairs that share a shingle of few, at most by queries times corpus, but its disk and memory don't: the hashes
    of the corpus are written once."""
    count = lambda df, c: int(df.agg(F.coalesce(F.sum(F.size(c)), F.lit(0))).first()[0])
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    sets = store.cut(word_hashes(store.spread(queries)).mapInArrow(of_words, "doc_id long, shingles array<long>"))
    asking = sieve(sets, "shingles", count(sets, "shingles"))
    blocks = store.cut(_grouped(word_hashes(store.spread(corpus)), block, asking, words=True))
    # few blocks a task, since a batch for Python may hold all of them
    blocks = store.cut(blocks.repartition(max(blocks.count(), cores)))
    held = count(blocks, "s")
    asked = sets.repartition(count(sets, "shingles") // (4 * group) + 1)
    asked = store.cut(_grouped(asked, group, sieve(blocks, "s", held)).withColumn("group", F.monotonically_increasing_id()))
    best = F.max_by(F.struct("other_id", "jaccard"), F.struct("jaccard", (-F.col("other_id")).alias("o"))).alias("m")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for i in range(batch.num_rows):
                lists = [np.asarray(batch.column(k)[i].values) for k in range(10)]
                found = found or _Nearest(_Sets(*lists[5:]))
                found.add(_Sets(*lists[:5]))
        if found is not None:
            some = np.flatnonzero(found.id >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (found.queries.ids, found.id, found.best)], names=["doc_id", "other_id", "jaccard"])

    columns = ("ids", "sizes", "s", "n", "place")
    top = None
    for r in asked.select("group").collect():
        own = F.broadcast(asked.where(F.col("group") == r.group).select(*[F.col(c).alias(f"q_{c}") for c in columns]))
        met = blocks.select(*columns).crossJoin(own).mapInArrow(meet, "doc_id long, other_id long, jaccard double")
        part = store.cut(met.groupBy("doc_id").agg(best))
        top = part if top is None else top.unionByName(part)
    alone = queries.select("doc_id")
    if top is None:
        return alone.select("doc_id", F.lit(-1).cast("long").alias("other_id"), F.lit(0.0).alias("jaccard"))
    return alone.join(top, "doc_id", "left").select("doc_id", F.coalesce("m.other_id", F.lit(-1)).alias("other_id"), F.coalesce("m.jaccard", F.lit(0.0)).alias("jaccard"))


#: A shingle of more corpus documents is frequent: no documents are paired by it.
FREQUENT = 1000


def exact_nearest(queries: DataFrame, corpus: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, other_id, jaccard): the most similar corpus document by shingles (ties: smallest id), -1 and 0 if
    none shares one. Both sides have (doc_id, shingles); only shingles of queries are looked at.

    Documents are paired by shared shingles that aren't frequent; how many frequent ones a pair shares is told by the lists
    of these. A document that shares frequent ones only can't be more similar than their share of the query's shingles: where
    that may beat the best found so far, the query is held against the classes of documents of equal frequent shingles, of
    each of which the one of fewest shingles is the most similar."""
    q = store.cut(queries.select("doc_id", F.size("shingles").alias("nq"), F.explode("shingles").alias("s")))
    c = corpus.select(F.col("doc_id").alias("other_id"), F.size("shingles").alias("nc"), F.explode("shingles").alias("s"))
    c = store.cut(c.join(q.select("s").distinct(), "s", "left_semi"))
    hot = store.cut(c.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") > frequent).select("s"))
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    rare = q.join(hot, "s", "left_anti").join(c.join(hot, "s", "left_anti"), "s")
    rare = rare.groupBy("doc_id", "other_id", "nq", "nc").agg(F.count("*").alias("rare"))
    hot_q = store.cut(q.join(hot, "s", "left_semi").groupBy("doc_id", "nq").agg(F.collect_set("s").alias("hq")))
    hot_c = store.cut(c.join(hot, "s", "left_semi").groupBy("other_id", "nc").agg(F.array_sort(F.collect_set("s")).alias("hc")))
    pairs = rare.join(hot_q.select("doc_id", "hq"), "doc_id", "left").join(hot_c.select("other_id", "hc"), "other_id", "left")
    pairs = pairs.withColumn("both", F.col("rare") + F.coalesce(F.size(F.array_intersect("hq", "hc")), F.lit(0)))

    def best(rows: DataFrame) -> DataFrame:
        jaccard = F.round(F.col("both") / (F.col("nq") + F.col("nc") - F.col("both")), 6).alias("jaccard")
        sims = rows.select("doc_id", "other_id", jaccard)
        return sims.groupBy("doc_id").agg(F.max_by(F.struct("other_id", "jaccard"), F.struct("jaccard", (-F.col("other_id")).alias("o"))).alias("m")).select("doc_id", "m.other_id", "m.jaccard")

    found = store.cut(best(pairs))
    open_ = hot_q.join(found.select("doc_id", "jaccard"), "doc_id", "left").where(F.round(F.size("hq") / F.col("nq"), 6) >= F.coalesce("jaccard", F.lit(0.0)))
    classes = hot_c.groupBy("hc").agg(F.min(F.struct("nc", "other_id")).alias("m")).select("m.nc", "m.other_id", F.explode("hc").alias("s"))
    shared = open_.select("doc_id", "nq", F.explode("hq").alias("s")).join(classes, "s")
    shared = shared.groupBy("doc_id", "other_id", "nq", "nc").agg(F.count("*").alias("both"))
    rows = found.unionByName(best(shared))
    top = rows.groupBy("doc_id").agg(F.max_by(F.struct("other_id", "jaccard"), F.struct("jaccard", (-F.col("other_id")).alias("o"))).alias("m"))
    return queries.select("doc_id").join(top, "doc_id", "left").select("doc_id", F.coalesce("m.other_id", F.lit(-1)).alias("other_id"), F.coalesce("m.jaccard", F.lit(0.0)).alias("jaccard"))
