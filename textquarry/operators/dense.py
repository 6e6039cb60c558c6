"""Dense retrieval: inner products of a query set with all vectors, block by block, and exact top k.

Vectors travel as blocks of some thousand rows, which Spark lays out: nothing passes the driver. Where the blocks of the
queries are few enough to be broadcast (their bytes are counted), each task meets them with its own part of the corpus.
Otherwise the corpus is dealt into chunks that fit a task, and the blocks of the queries are sent to every chunk: a chunk
is held, query blocks stream past it. Either way the corpus is scanned once, and with `keep` no more than so many rows of
a query leave a task or chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store
from .bm25 import top_k

#: Rows of a block of vectors.
BLOCK_ROWS = 2048
#: Query vectors of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of corpus vectors in a chunk.
CHUNK_BYTES = 64 << 20

_BLOCK = "ids array<long>, v array<double>, label array<long>"
_OUT = "query_id long, doc_id long, score double"


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of rows (id, v, label): ids, all values of their vectors, and labels."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                whole = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(kind))
                yield pa.RecordBatch.from_arrays([whole(part.column(0), pa.int64()), whole(part.column(1).flatten(), pa.float64()), whole(part.column(2), pa.int64())], names=["ids", "v", "label"])

    return rows.mapInArrow(pack, _BLOCK)


class Block:
    def __init__(self, ids: pa.Array, v: pa.Array, label: pa.Array):
        self.ids, self.label = (np.asarray(x.values) if hasattr(x, "values") else np.asarray(x) for x in (ids, label))
        self.v = np.asarray(v.values).reshape(self.ids.size, -1)


def _products(queries: Block, corpus: Block, other_label: bool) -> np.ndarray:
    s = np.round(queries.v @ corpus.v.T, 6)
    if other_label:
        s[queries.label[:, None] == corpus.label[None, :]] = -np.inf
    return s


def _rows(ids: np.ndarray, q: np.ndarray, doc: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(doc), pa.array(s)], names=["query_id", "doc_id", "score"])


class Best:
    """The `keep` best of each query of a block by score, ties by id, over any number of corpus blocks."""

    def __init__(self, queries: Block, keep: int):
        self.queries, self.keep = queries, keep
        self.q = self.doc = np.zeros(0, np.int64)
        self.s = np.zeros(0)

    def add(self, corpus: Block, other_label: bool) -> None:
        s = _products(self.queries, corpus, other_label)
        least = np.full(s.shape[0], -np.inf)
        if s.shape[1] > self.keep:
            least = -np.partition(-s, self.keep - 1, axis=1)[:, self.keep - 1]
        full = np.flatnonzero(np.bincount(self.q, minlength=s.shape[0]) == self.keep)
        if full.size:  # rows are in order: the last of a query is its worst
            least[full] = np.maximum(least[full], self.s[np.searchsorted(self.q, full, "right") - 1])
        q, at = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        q, doc, score = np.concatenate([self.q, q]), np.concatenate([self.doc, corpus.ids[at]]), np.concatenate([self.s, s[q, at]])
        order = np.lexsort((doc, -score, q))
        q, doc, score = q[order], doc[order], score[order]
        inside = np.arange(q.size) - np.searchsorted(q, q) < self.keep
        self.q, self.doc, self.s = q[inside], doc[inside], score[inside]

    def rows(self) -> pa.RecordBatch:
        return _rows(self.queries.ids, self.q, self.doc, self.s)


def _every(queries: Block, corpus: Block, other_label: bool) -> pa.RecordBatch:
    s = _products(queries, corpus, other_label)
    q, at = np.nonzero(s > -np.inf)
    return _rows(queries.ids, q, corpus.ids[at], s[q, at])


def _blocks(batch: pa.RecordBatch, prefix: str = "") -> Iterator[Block]:
    columns = [batch.column(batch.schema.names.index(prefix + c)) for c in ("ids", "v", "label")]
    for i in range(batch.num_rows):
        yield Block(*(c[i] for c in columns))


def scores(queries: DataFrame, corpus: DataFrame, keep: int | None = None, other_label: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, doc_id, score) of queries (query_id, v) with corpus (doc_id, v), unit vectors of one length. With `keep`, only
    each query's `keep` best of a task or chunk: all it takes for an exact top k. With `other_label`, both have an
    integer label, and only pairs of different labels count (null differs from none). Null vectors are left out."""
    label = F.col("label").cast("long").alias("label") if other_label else F.lit(0).cast("long").alias("label")
    if other_label:
        queries, corpus = queries.where("label is not null"), corpus.where("label is not null")
    vectors = lambda df, key: packed(df.where("v is not null").select(F.col(key).cast("long"), F.col("v").cast("array<double>"), label))
    asked = store.cut(vectors(queries, "query_id").withColumn("block", F.monotonically_increasing_id()))
    size = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)) * 8).first()[0]
    if size <= broadcast_bytes:
        # one row of all query blocks' numbers a block of the corpus: a stated query set against all rows
        numbers = F.lit([r.block for r in asked.select("block").collect()]).cast("array<long>")
        met = vectors(corpus, "doc_id").withColumn("block", F.explode(numbers))
        own = asked.select("block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "v", "label")])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Best] = {}
            for batch in batches:
                for number, docs, asking in zip(batch.column(batch.schema.names.index("block")).to_pylist(), _blocks(batch), _blocks(batch, "q_")):
                    if keep is None:
                        yield _every(asking, docs, other_label)
                    else:
                        held.setdefault(number, Best(asking, keep)).add(docs, other_label)
            for best in held.values():
                yield best.rows()

        return met.join(F.broadcast(own), "block").mapInArrow(meet, _OUT)
    blocks = vectors(corpus, "doc_id").withColumn("block", F.lit(-1).cast("long"))
    all_bytes = corpus.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)) * 8).first()[0]
    chunks = max(corpus.sparkSession.sparkContext.defaultParallelism, -(-all_bytes // CHUNK_BYTES))
    dealt = blocks.withColumn("chunk", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(chunks)))
    sent = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []
        for batch in batches:
            for number, block, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _blocks(batch)):
                if number != chunk:
                    chunk, held = number, []
                if block < 0:
                    held.append(row)
                elif keep is None:
                    for docs in held:
                        yield _every(row, docs, other_label)
                else:
                    best = Best(row, keep)
                    for docs in held:
                        best.add(docs, other_label)
                    yield best.rows()

    columns = ["chunk", "block", "ids", "v", "label"]
    laid = dealt.select(columns).unionByName(sent.select(columns)).repartition(chunks, "chunk").sortWithinPartitions("chunk", "block")
    return laid.mapInArrow(stream, _OUT)


def search(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    return top_k(scores(queries, corpus, keep=k), k)
