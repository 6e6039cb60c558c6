"""Near-duplicates by SimHash, through an index of positional bytes with count filtering.

A fingerprint is eight bytes, each with its position. Two fingerprints that differ in at most 4 bits share at
least 4 positional bytes, so the guaranteed minimum of the tally is 4 of 8. Postings of one positional byte would
hold a 256th of all fingerprints, and tallying them would make all pairs; so the index holds the combinations of
four positional bytes (70 postings a fingerprint): two fingerprints meet in a posting exactly when their tally
reaches the minimum, so the index itself does the count filtering (README has the figures); the Hamming distance is
then verified.

Only distinct fingerprints enter the index, so copies cost nothing. Postings are shipped as packed arrays by
hashed bucket. A large posting isn't compared pairwise: its members are sent to all values within 2 bits of their
four free bytes; two values within 4 bits have such a value in common, and all that meet at one are within 4 bits,
so a star over each meeting point links exactly what must be linked, in time linear in the posting.
Only a spanning forest of a posting's links leaves the task; components come from iterated contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Positional bytes that two fingerprints within MAX_BITS share at least.
MIN_TALLY = 8 - MAX_BITS
SUBSETS = list(combinations(range(8), MIN_TALLY))
#: Postings up to this size are compared pairwise, in one vectorised step; larger ones by common neighbours.
PAIRWISE = 1024
#: Entries (key and fingerprint) that a bucket holds on average.
BUCKET_ENTRIES = 400_000


def fingerprints(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit SimHash of every text; zero where there is no word."""
    out = np.zeros(len(column), np.uint64)
    lane = np.uint64(0x0101010101010101)
    for row, stop, data, offsets in common.text_blocks(column):
        data = common.LOWER[data]
        starts, ends, first = common.word_spans(data, offsets, common.NONSPACE_BYTE)
        if not starts.size:
            continue
        # words and one space after each
        place = np.cumsum(np.concatenate([[0], ends - starts + 1]))
        owner, at = common.expand(starts, ends)
        packed = np.full(int(place[-1]), 32, np.uint8)
        packed[at - starts[owner] + place[owner]] = data[at]
        n_words = np.diff(first)
        n = np.where(n_words > 0, np.maximum(1, n_words - shingle + 1), 0)
        begin = np.cumsum(n) - n
        doc, word = common.expand(first[:-1], first[:-1] + n)
        last = np.minimum(word + shingle, first[doc + 1])
        text = packed.tobytes()
        h = np.fromiter(map(xxhash.xxh64_intdigest, [text[a:b] for a, b in zip(place[word].tolist(), (place[last] - 1).tolist())], repeat(seed)), np.uint64, word.size)
        # eight byte-wide counters in a word: at most 255 hashes are added before they are widened
        owner, block = common.expand(np.zeros(n.size, np.int64), -(-n // 255))
        cut = begin[owner] + 255 * block
        found = np.zeros(n.size, np.uint64)
        for b in range(8):
            sums = np.add.reduceat((h >> np.uint64(b)) & lane, cut).view(np.uint8).reshape(-1, 8)
            per_doc = np.zeros((n.size, 8), np.int64)
            np.add.at(per_doc, owner, sums.astype(np.int64))
            for j in range(8):
                found |= (2 * per_doc[:, j] > n).astype(np.uint64) << np.uint64(8 * j + b)
        out[row:stop] = found
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def posting_keys(fp: np.ndarray, subset: int) -> np.ndarray:
    """The posting of each fingerprint for a combination of positions: the combination's number above its bytes."""
    key = np.full(fp.size, subset, np.uint64)
    for p in SUBSETS[subset]:
        key = (key << np.uint64(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(255))
    return key


def near_values(free: list[int]) -> np.ndarray:
    """All masks of at most MAX_BITS / 2 bits among the bits of the free byte positions."""
    bits = [1 << (8 * p + b) for p in free for b in range(8)]
    return np.array([sum(c) for r in range(MAX_BITS // 2 + 1) for c in combinations(bits, r)], np.uint64)


def links_by_pairs(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(fp.size, 1)
    near = popcount(fp[i] ^ fp[j]) <= MAX_BITS
    return i[near], j[near]


def links_by_neighbours(fp: np.ndarray, free: list[int], step: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in a posting, by common values within half the distance, in passes."""
    masks = near_values(free)
    passes = -(-fp.size * masks.size // step)
    a, b = [], []
    for k in range(passes):
        values, members = [], []
        for lo in range(0, fp.size, max(1, step // masks.size)):
            part = fp[lo : lo + max(1, step // masks.size)]
            v = (part[:, None] ^ masks[None, :]).ravel()
            mine = common.mix(v) % np.uint64(passes) == k
            values.append(v[mine])
            members.append(np.repeat(np.arange(lo, lo + part.size), masks.size)[mine])
        v, m = np.concatenate(values), np.concatenate(members)
        order = np.argsort(v, kind="stable")
        v, m = v[order], m[order]
        same = np.flatnonzero(v[1:] == v[:-1])
        edges = np.unique(np.stack([m[same], m[same + 1]], axis=1), axis=0)
        a.append(edges[:, 0])
        b.append(edges[:, 1])
    return np.concatenate(a), np.concatenate(b)


def bucket_links(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of all links inside the postings of a bucket."""
    order = np.argsort(keys, kind="stable")
    keys, fp = keys[order], fp[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    size = np.diff(cut)
    left, right = [], []
    twos = cut[:-1][size == 2]
    x = fp[twos] ^ fp[twos + 1]
    near = twos[popcount(x) <= MAX_BITS]
    left.append(fp[near])
    right.append(fp[near + 1])
    for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
        own = fp[at : at + n]
        subset = int(keys[at] >> np.uint64(32))
        i, j = links_by_pairs(own) if n <= PAIRWISE else links_by_neighbours(own, [p for p in range(8) if p not in SUBSETS[subset]])
        left.append(own[i])
        right.append(own[j])
    return forest(np.concatenate(left), np.concatenate(right))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as stars around each component's smallest value."""
    if not a.size:
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = common.components(nodes.size, index[: a.size], index[a.size :])
    rest = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[rest], nodes[label[rest]]


def _pack(columns: list[np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(bucket, kind="stable")
    full, first = np.unique(bucket[order], return_index=True)
    columns = [c[order] for c in columns]
    for b, x, y in zip(full.tolist(), first.tolist(), [*first[1:].tolist(), bucket.size]):
        yield b, [c[x:y].tobytes() for c in columns]


def _binary(rows: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[1][k] for r in rows], pa.binary()) for k in range(2))], names=["bucket", "x", "y"])


def _unpack(batches, name: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), np.uint64) for b in batches for v in b.column(name) if v.is_valid] or [np.zeros(0, np.uint64)])


def links(distinct: DataFrame, n: int) -> DataFrame:
    """(a, b), b < a, of distinct signed fingerprints in column fp: connects all within MAX_BITS."""
    buckets = max(1, -(-n * len(SUBSETS) // BUCKET_ENTRIES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = np.asarray(batch.column(0))[at : at + 20_000].view(np.uint64)
                keys = np.concatenate([posting_keys(fp, s) for s in range(len(SUBSETS))])
                bucket = (common.mix(keys) % np.uint64(buckets)).astype(np.int64)
                yield _binary(list(_pack([keys, np.tile(fp, len(SUBSETS))], bucket)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        a, b = bucket_links(_unpack(own, "x"), _unpack(own, "y"))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    posted = distinct.select("fp").mapInArrow(post, "bucket long, x binary, y binary")
    return posted.groupBy("bucket").applyInArrow(meet, "a long, b long")


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): each task replaces the edges it holds by stars, however they are
    dealt; repeated until all stars agree (no node has two roots and no root has a root)."""

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # contracted as it grows: memory follows the nodes, not the links
            a, b = forest(np.concatenate([a, np.asarray(batch.column(0))]), np.concatenate([b, np.asarray(batch.column(1))]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    edges = common.cut(edges.mapInArrow(star, "a long, b long").distinct())
    while True:
        # every node points at the smallest root it knows; the other roots it knows point there too
        roots = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"), F.count("*").alias("n"))
        heads = edges.select(F.col("b").alias("a")).distinct()
        unsettled = roots.where("n > 1").limit(1).count() or edges.join(heads, "a", "left_semi").limit(1).count()
        if not unsettled:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        low = roots.select("a", "low")
        # large star and small star in one: all known roots of a node link to its smallest one
        linked = edges.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a != b")
        # and a node's root is replaced by its root's root
        up = low.select(F.col("a").alias("b"), F.col("low").alias("top"))
        jumped = linked.join(up, "b", "left").select("a", F.coalesce("top", "b").alias("b"), F.when(F.col("top").isNotNull(), F.col("b")).alias("c"), "top")
        edges = common.cut(jumped.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("c").alias("a"), F.col("top").alias("b")))).alias("e")).select("e.*").where("a is not null and b is not null and a != b").mapInArrow(star, "a long, b long").distinct())


def mark(rows: DataFrame) -> DataFrame:
    """rows, whose last column is the text, with the fingerprint fp (signed) in its place; run once, lineage cut."""
    keep = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(fingerprints(batch.column(len(keep))).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), made], names=[*keep, "fp"])

    return common.cut(rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField("fp", T.LongType())])))


def rooted(marked: DataFrame, low: Column) -> DataFrame:
    """(fp, low, root) of the distinct fingerprints: an aggregate of its rows, and what names its component."""
    distinct = common.cut(marked.groupBy("fp").agg(low.alias("low")))
    tree = contract(links(distinct, distinct.count()))
    return distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, fp signed, component_id) per row of docs.

    Null and empty texts have fingerprint zero and link like any other; very long texts are hashed whole, a block of
    their own; repeated rows stay repeated, ties of a bit (half the shingles) give 0; a null doc_id never names a
    component unless it has no other member; an empty table gives an empty one. Columns are taken by name, so others
    don't matter. Linked are fingerprints within MAX_BITS, transitively.
    """
    marked = mark(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    found = rooted(marked, F.min("doc_id"))
    # cut, so that the join below is between two plain shuffles, of which Spark splits the part of a root with many fingerprints
    named = common.cut(found.groupBy("root").agg(F.min("low").alias("component_id")))
    return marked.join(found.join(named, "root").select("fp", "component_id"), "fp", "left")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group, that of the smallest doc_id (a null one comes last; of several rows with that id,
    one of them), for nulls, long and empty texts as in near_duplicates. docs may have columns of any names; an empty table
    stays empty.

    Rows are told apart by where they stand in their files, so equal ids and rows need no care, and the row that stays
    is found by partial aggregation of ids and places alone."""
    rows = common.identified(docs)
    own = F.col("row")
    marked = mark(rows.select(own[doc_id].alias("doc_id"), "at", own[text].alias("text")))
    found = rooted(marked, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")))
    stay = found.groupBy("root").agg(F.min("low")["at"].alias("at")).select("at")
    return rows.join(stay, "at", "left_semi").select("row.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """The same result by definition, for tests."""
    import re

    prints = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sh = [" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), SEED) for s in sh]
        prints[doc] = sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))
    ids = sorted(prints)
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= MAX_BITS and label[i] < label[j]:
                    label[j], moved = label[i], True
    return {i: (f"{prints[i]:016x}", label[i]) for i in ids}
