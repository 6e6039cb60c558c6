"""Removal of byte strings repeated across documents, by external induced sorting of suffixes.

Every string of `width` bytes (a window) that starts in a document with a smaller id is removed wherever else it
starts. Shards of suffixes must hold equal windows together, whichever documents they stand in: a window goes to the
shard of its minimizer, the smallest hash of its `gram`-byte grams. Consecutive windows with one minimizer travel as
one segment, the bytes they cover. Each shard's segments form one text whose suffixes are sorted by induced sorting;
neighbours with a common prefix of `width` are equal windows, and the smallest document among them keeps its own. The
sort holds a budget of queue entries and blocks of bounded size: a shard's bytes, its segments' ids and masks, the text,
its types and the queues are files, read by blocks or mapped, so that a shard may be larger than memory.

Most text repeats nowhere, so minimizers are counted first: each group of documents sends the distinct ones it holds
(32 bits each, in hashed buckets), and is told which of them another group sent too. Only segments of those, and of
ones repeated inside the group, go on, and equal segments of a group go once, for its smallest document: however many
copies a passage has, its shard receives at most one a group. The groups' texts are shuffled once (the three
passes over them reuse one exchange); what is recomputed is derived from a group's rows in a fixed order.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, induced

WIDTH = 50
GRAM = 24
#: Bytes of text in a group of documents, in a shard if all of it repeats, and for a bucket of minimizers.
GROUP_BYTES = 3 << 20
SHARD_BYTES = 5 << 19
BUCKET_BYTES = 28 << 20
_SPLIT = 32
_NO_ID = np.iinfo(np.int64).max


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte grams, from those of grams of powers of two."""
    h, size, done, out = common._BYTE_VALUE[data], 1, 0, None
    base = 0x9E3779B97F4A7C15 | 1
    while True:
        if k & size:
            if out is None:
                out = h
            else:  # out covers the first `done` bytes, h the next `size`
                n = data.size - done - size + 1
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + h[done : done + n]
            done += size
        if done == k:
            return common.mix(out)
        h = h[: h.size - size] * np.uint64(pow(base, size, 1 << 64)) + h[size:]
        size *= 2


def ranges(sorted_keys: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each key that occurs begins and ends; the cost follows the keys present, not how many there may be."""
    keys, first = np.unique(sorted_keys, return_index=True)
    return dict(zip(keys.tolist(), zip(first.tolist(), [*first[1:].tolist(), sorted_keys.size])))


class Group:
    """The documents of a group in a fixed order, and their segments."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        self.order = np.array(sorted(range(table.num_rows), key=_row_key(table)), np.int64)
        self.ids = np.asarray(table.column("doc_id").combine_chunks().fill_null(_NO_ID).cast(pa.int64()))[self.order] if table.num_rows else np.zeros(0, np.int64)
        texts = table.column("text").combine_chunks().take(pa.array(self.order)) if table.num_rows else pa.array([], pa.string())
        self.data, self.offsets = common.text_views(texts)
        self.data, self.offsets = self.data[self.offsets[0] : self.offsets[-1]], self.offsets - self.offsets[0]
        none = np.zeros(0, np.int64)
        self.start, self.count, self.doc, self.value = none, none, none, np.zeros(0, np.uint64)
        if self.data.size >= width:
            least = common.sliding(rolling(self.data, gram), width - gram + 1, np.minimum)
            sizes = np.diff(self.offsets)
            doc = np.repeat(np.arange(sizes.size), np.maximum(sizes - width + 1, 0))
            at = np.arange(doc.size) + (self.offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(sizes - width + 1, 0))[:-1]]))[doc]
            if doc.size:
                value = least[at]
                new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])])
                first = np.flatnonzero(new)
                length = np.diff(np.append(first, doc.size))
                # segments of at most _SPLIT windows, so that 32 bits tell of each window
                owner, piece = common.expand(np.zeros(first.size, np.int64), -(-length // _SPLIT))
                begin = first[owner] + _SPLIT * piece
                self.count = np.minimum(length[owner] - _SPLIT * piece, _SPLIT)
                self.start, self.doc, self.value = at[begin], doc[begin], value[begin]
        self.width = width

    def minimizers(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers by bucket, their buckets, and whether segments of several documents have them."""
        order = np.lexsort((self.ids[self.doc], self.value))
        v, d = self.value[order], self.ids[self.doc][order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if v.size else np.zeros(0, np.int64)
        last = np.append(first[1:], v.size) - 1 if v.size else first
        v, several = v[first], d[first] != d[last]
        bucket = (common.mix(v) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return v[order], bucket[order], several[order]

    def repeated(self, replies: pa.Table, buckets: int) -> np.ndarray:
        """Indices of the segments whose minimizer occurs in several documents, as far as 32 bits tell."""
        v, bucket, several = self.minimizers(buckets)
        place = ranges(bucket)
        for b, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
            x, y = place[b]
            several[x:y] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
        known = np.sort(v[several])
        if not known.size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(known[np.minimum(np.searchsorted(known, self.value), known.size - 1)] == self.value)

    def distinct(self, own: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the segments `own`: the class of each, and of each class (equal bytes) a segment of its smallest
        document and its shard; classes are in order of shards."""
        start, end = self.start[own], self.start[own] + self.count[own] + self.width - 1
        h = common.span_hashes(self.data, start, end)
        shard = (common.mix(self.value[own] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((self.start[own], self.ids[self.doc[own]], h, shard))
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: order.size]
        kind = np.empty(order.size, np.int64)
        kind[order] = np.cumsum(new) - 1
        head = order[new]
        return kind, own[head], shard[head]


def _row_key(table: pa.Table):
    ids, keys = table.column("doc_id").to_pylist(), table.column("key").to_pylist()
    return lambda i: (ids[i] is None, ids[i] or 0, keys[i] is None, keys[i] or 0)


#: Segments that are handled at once where a shard's are read, pooled or written.
CHUNK = 1 << 15


class Run:
    """Positions of one run of equal windows, in a file beyond a block of them, and the smallest id among them."""

    def __init__(self, path: str):
        self.path, self.held, self.size, self.least = path, [], 0, _NO_ID

    def add(self, at: np.ndarray, least: int) -> None:
        self.held.append(at)
        self.size += at.size
        self.least = min(self.least, least)
        if self.size > induced.BLOCK:
            with open(self.path, "ab") as out:
                for x in self.held:
                    x.astype(np.int64, copy=False).tofile(out)
            self.held, self.size = [], 0

    def end(self) -> Iterator[np.ndarray]:
        if os.path.exists(self.path):
            n = os.path.getsize(self.path) // 8
            for low in range(0, n, induced.BLOCK):
                yield np.fromfile(self.path, np.int64, min(induced.BLOCK, n - low), offset=8 * low)
            os.unlink(self.path)
        yield from self.held
        self.held, self.size, self.least = [], 0, _NO_ID


def shard_masks(text: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray, width: int, budget: int = induced.MEMORY_ENTRIES, masks: np.ndarray | None = None) -> np.ndarray:
    """For each segment, bits of the windows that also start in a segment of a smaller id. `text` holds the segments
    (bytes plus one) with 0 behind each; `start` tells where a segment begins. All of them, and `masks` (zeros), may be
    files mapped into memory."""
    masks = np.zeros(start.size, np.uint32) if masks is None else masks
    segment_of = lambda at: np.searchsorted(start, at, "right") - 1

    def mark(at: np.ndarray, least: np.ndarray | int) -> None:
        segment = segment_of(at)
        own = ids[segment] > least
        np.bitwise_or.at(masks, segment[own], np.uint32(1) << (at[own] - start[segment[own]]).astype(np.uint32))

    with induced.scratch() as folder:
        run = Run(os.path.join(folder, "run"))

        def close() -> None:
            least = run.least
            for at in run.end():
                mark(at, least)

        for at, prefix in induced.scan_suffixes(text, width, budget):
            owner = segment_of(at)
            starts_here = at - start[owner] < count[owner]  # whole windows only
            at, new, own = at[starts_here], np.asarray(prefix)[starts_here] < width, ids[owner[starts_here]]
            if not at.size:
                continue
            first = np.flatnonzero(new)
            # what stands before the first new run goes on with the one that is open
            head = int(first[0]) if first.size else at.size
            if head:
                run.add(at[:head], int(own[:head].min()))
            if first.size:
                close()
                last = int(first[-1])
                if head < last:
                    at_, own_, first = at[head:last], own[head:last], first[:-1] - head
                    least = np.minimum.reduceat(own_, first)
                    mark(at_, np.repeat(least, np.diff(np.append(first, at_.size))))
                run.add(at[last:], int(own[last:].min()))
        close()
    return masks


class Shard:
    """A shard's segments in files: nothing of its size is held in memory. add() takes them as they come; masks() gives the
    bits of each added lot, in their order."""

    def __init__(self, folder: str, width: int, budget: int = induced.MEMORY_ENTRIES):
        self.folder, self.width, self.budget, self.lots = folder, width, budget, []

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def _made(self, name: str, kind: type, n: int) -> np.ndarray:
        return np.memmap(self._path(name), kind, "w+", shape=(n,)) if n else np.zeros(0, kind)

    def _kept(self, name: str, kind: type) -> np.ndarray:
        return np.memmap(self._path(name), kind, "r") if os.path.getsize(self._path(name)) else np.zeros(0, kind)

    def add(self, data: bytes, count: bytes, ids: bytes) -> None:
        for name, blob in (("bytes", data), ("count", count), ("ids", ids)):
            with open(self._path(name), "ab") as out:
                out.write(blob)
        self.lots.append(len(count))

    def _pool(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of equal segments are dealt to files that fit in memory; of each kind the segment of the smallest id is the
        head. Returns each segment's head, counts and ids."""
        data, count, ids = self._kept("bytes", np.uint8), self._kept("count", np.uint8), self._kept("ids", np.int64)
        n = count.size
        parts = max(1, -(-n // (4 * CHUNK)))
        at = 0
        for low in range(0, n, CHUNK):
            size = count[low : low + CHUNK].astype(np.int64) + self.width - 1
            ends = np.cumsum(size)
            h = common.span_hashes(np.asarray(data[at : at + int(ends[-1])]), ends - size, ends)
            at += int(ends[-1])
            rows = np.stack([h.view(np.int64), ids[low : low + CHUNK], np.arange(low, low + h.size)], axis=1)
            part = (h >> np.uint64(40)) % np.uint64(parts)
            for p in np.unique(part).tolist():
                with open(self._path(f"pool-{p}"), "ab") as out:
                    rows[part == p].tofile(out)
        head = self._made("head", np.int64, n)
        for p in range(parts):
            if not os.path.exists(self._path(f"pool-{p}")):
                continue
            rows = np.fromfile(self._path(f"pool-{p}"), np.int64).reshape(-1, 3)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
            first = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            head[rows[:, 2]] = np.repeat(rows[first, 2], np.diff(np.append(first, len(rows))))
            os.unlink(self._path(f"pool-{p}"))
        return head, count, ids

    def _write_text(self, head: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The heads' bytes, each plus one, with 0 behind every segment; where they begin, their counts and ids. Returns the
        number of each head among the heads."""
        data, rank = self._kept("bytes", np.uint8), self._made("rank", np.int64, head.size)
        at = position = known = 0
        outs = {name: open(self._path(name), "wb") for name in ("text", "start", "head_count", "head_ids")}
        try:
            for low in range(0, head.size, CHUNK):
                own = np.asarray(head[low : low + CHUNK]) == np.arange(low, min(low + CHUNK, head.size))
                size = count[low : low + CHUNK].astype(np.int64) + self.width - 1
                begin = np.cumsum(size) - size
                chunk = np.asarray(data[at : at + int(size.sum())])
                at += chunk.size
                rank[low : low + CHUNK] = known + np.cumsum(own) - own
                known += int(own.sum())
                pooled = size[own]
                owner, place = common.expand(begin[own], begin[own] + pooled)
                joined = np.zeros(owner.size + pooled.size, np.uint8)
                joined[np.arange(owner.size) + owner] = chunk[place] + np.uint8(1)
                joined.tofile(outs["text"])
                (position + np.cumsum(pooled + 1) - pooled - 1).tofile(outs["start"])
                position += joined.size
                np.asarray(count[low : low + CHUNK])[own].astype(np.int64).tofile(outs["head_count"])
                np.asarray(ids[low : low + CHUNK])[own].tofile(outs["head_ids"])
        finally:
            for out in outs.values():
                out.close()
        return rank

    def masks(self) -> Iterator[bytes | None]:
        """A blob of 32 bits per segment for each lot; None for one that loses nothing."""
        head, count, ids = self._pool()
        rank = self._write_text(head, count, ids)
        start, own = self._kept("start", np.int64), self._kept("head_ids", np.int64)
        bits = shard_masks(self._kept("text", np.uint8), start, self._kept("head_count", np.int64), own, self.width, self.budget, self._made("masks", np.uint32, start.size))
        low = 0
        for n in self.lots:
            heads = np.asarray(rank[np.asarray(head[low : low + n])])
            made = np.where(ids[low : low + n] > own[heads], np.uint32(0xFFFFFFFF), bits[heads])
            yield made.tobytes() if made.any() else None
            low += n


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (flat starts and ends of the maximal removed runs) and kept
    (the remaining bytes, which need not be whole characters).

    doc_id must be integral. Null text counts as empty. A null id comes after all others, and rows with the same id
    (repeated rows too, ties, or several nulls) take nothing from each other. Texts shorter than `width` lose nothing; a very
    long text forms a group of its own, which must fit in a task's memory (some 50 times its bytes). An empty table gives
    an empty one. Columns are taken by name, so others don't matter.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, shards, buckets = (int(total // size) + 1 for size in (GROUP_BYTES, SHARD_BYTES, BUCKET_BYTES))
    slim = slim.withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(groups)))

    def send(table: pa.Table) -> pa.Table:
        g = Group(table, width, gram)
        v, bucket, _ = g.minimizers(buckets)
        place = ranges(bucket)
        short = (common.mix(v ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
        part = table.column("part")[0].as_py()
        return pa.table({"part": pa.array([part] * len(place), pa.int64()), "bucket": pa.array(list(place), pa.int64()), "x": pa.array([short[a:b].tobytes() for a, b in place.values()], pa.binary())})

    def tell(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint32) for x in table.column("x").to_pylist()]
        every = np.sort(np.concatenate(blobs))
        twice = every[1:][every[1:] == every[:-1]]
        bits = []
        for blob in blobs:
            hit = twice[np.minimum(np.searchsorted(twice, blob), twice.size - 1)] == blob if twice.size else np.zeros(blob.size, bool)
            bits.append(np.packbits(hit).tobytes() if hit.any() else None)
        made = pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
        return made.filter(pc.is_valid(made.column("bits")))

    def ship(table: pa.Table, replies: pa.Table) -> pa.Table:
        empty = pa.table({"part": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "bytes": pa.array([], pa.binary()), "count": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
        if not table.num_rows:
            return empty
        g = Group(table, width, gram)
        own = g.repeated(replies, buckets)
        if not own.size:
            return empty
        _, head, shard = g.distinct(own, shards)
        raw, place = g.data.tobytes(), ranges(shard)
        full, rows = list(place), [head[a:b] for a, b in place.values()]
        part = table.column("part")[0].as_py()
        return pa.table({
            "part": pa.array([part] * len(full), pa.int64()), "shard": pa.array(full, pa.int64()),
            "bytes": pa.array([b"".join(raw[a : a + n + width - 1] for a, n in zip(g.start[r].tolist(), g.count[r].tolist())) for r in rows], pa.binary()),
            "count": pa.array([g.count[r].astype(np.uint8).tobytes() for r in rows], pa.binary()), "ids": pa.array([g.ids[g.doc[r]].tobytes() for r in rows], pa.binary()),
        })

    def sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard, each goes to the files of its shard as it comes."""
        with contextlib.ExitStack() as stack:
            number, parts, shard = None, [], None
            for batch in batches:
                columns = [batch.column(batch.schema.names.index(c)) for c in ("shard", "part", "bytes", "count", "ids")]
                for own, part, data, count, ids in zip(*columns):
                    if own.as_py() != number:
                        if shard is not None:
                            yield from sorted_shard(number, parts, shard)
                            stack.close()
                        number, parts = own.as_py(), []
                        shard = Shard(stack.enter_context(induced.scratch()), width)
                    parts.append(part.as_py())
                    shard.add(data.as_buffer(), count.as_buffer(), ids.as_buffer())
            if shard is not None:
                yield from sorted_shard(number, parts, shard)

    def sorted_shard(number: int, parts: list[int], shard: Shard) -> Iterator[pa.RecordBatch]:
        for part, blob in zip(parts, shard.masks()):
            if blob is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "masks"])

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        g = Group(table, width, gram)
        lost = np.zeros(g.data.size + 1, np.int64)
        replies = told.filter(pc.is_valid(told.column("bits")))
        own = g.repeated(replies, buckets)
        if own.size:
            kind, head, shard = g.distinct(own, shards)
            mask = np.zeros(head.size, np.uint32)
            place = ranges(shard)
            masks = told.filter(pc.is_valid(told.column("masks")))
            for s, blob in zip(masks.column("bucket").to_pylist(), masks.column("masks").to_pylist()):
                mask[slice(*place[s])] = np.frombuffer(blob, np.uint32)
            # what a smaller document of the group holds too is removed whole
            later = g.ids[g.doc[own]] > g.ids[g.doc[head]][kind]
            bits = np.where(later, np.uint32(0xFFFFFFFF), mask[kind])
            some = np.flatnonzero(bits)
            which, window = common.expand(np.zeros(some.size, np.int64), g.count[own[some]])
            gone = (bits[some][which] >> window.astype(np.uint32)) & np.uint32(1) == 1
            at = g.start[own[some]][which][gone] + window[gone]
            np.add.at(lost, at, 1)
            np.add.at(lost, at + width, -1)
        away = np.cumsum(lost[:-1]) > 0
        # runs of removed bytes end with their document
        before = np.concatenate([[False], away[:-1]])[: away.size]
        after = np.append(away[1:], False)[: away.size]
        inner = g.offsets[(g.offsets > 0) & (g.offsets < away.size)]
        before[inner] = False
        after[inner - 1] = False
        starts, ends = np.flatnonzero(away & ~before), np.flatnonzero(away & ~after) + 1
        cut = np.searchsorted(starts, g.offsets)
        kept, kept_at = g.data[~away].tobytes(), np.concatenate([[0], np.cumsum(~away)])[g.offsets].tolist()
        spans = [np.stack([starts[a:b], ends[a:b]], axis=1).ravel() - o for a, b, o in zip(cut[:-1], cut[1:], g.offsets)]
        ids = table.column("doc_id").combine_chunks().take(pa.array(g.order)) if table.num_rows else pa.array([], pa.int64())
        return pa.table({"doc_id": ids, "n_bytes": pa.array(np.diff(g.offsets)), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array([kept[a:b] for a, b in zip(kept_at[:-1], kept_at[1:])], pa.binary())})

    replies = slim.groupBy("part").applyInArrow(send, "part long, bucket long, x binary").groupBy("bucket").applyInArrow(tell, "part long, bucket long, bits binary")
    sent = slim.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(ship, "part long, shard long, bytes binary, count binary, ids binary")
    # as by groupBy, but rows of a shard stream in instead of arriving as one table
    dealt = sent.repartition("shard").sortWithinPartitions("shard", "part")
    masks = dealt.mapInArrow(sort_shards, "part long, shard long, masks binary")
    told = replies.select("part", "bucket", "bits", F.lit(None).cast("binary").alias("masks")).unionByName(masks.select("part", F.col("shard").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "masks"))
    return slim.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(remove, "doc_id long, n_bytes long, spans array<long>, kept binary")


def op7_repeats(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of all documents."""
    made = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], width: int = WIDTH) -> dict[int, tuple[int, int, int, bytes]]:
    """n_bytes, n_removed, n_spans and kept bytes by a dictionary of all windows, for tests."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, t in texts:
        for a in range(len(t) - width + 1):
            w = t[a : a + width]
            least[w] = min(i, least.get(w, i))
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - width + 1):
            if least[t[a : a + width]] < i:
                gone[a : a + width] = True
        edges = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
        out[i] = (len(t), int(gone.sum()), edges, bytes(np.frombuffer(t, np.uint8)[~gone].tolist()))
    return out


SQL = {
    "op7_repeats": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM n, unnest(range(0, n - 49)) AS r(i) WHERE n >= 50),
f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE doc_id > low),
isl AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k
        FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY doc_id, k),
edge AS (SELECT doc_id, 0 AS a FROM n UNION ALL SELECT doc_id, b FROM span), stop AS (SELECT doc_id, a AS b FROM span UNION ALL SELECT doc_id, n FROM n),
piece AS (SELECT x.doc_id, x.a, y.b FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM edge) x
          JOIN (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k FROM stop) y ON x.doc_id = y.doc_id AND x.k = y.k),
kept AS (SELECT n.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM piece JOIN n USING (doc_id) GROUP BY n.doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
}
