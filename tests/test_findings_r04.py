"""What the findings of the fourth round ask for: less work for the same results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textquarry.operators import dedup

RNG = np.random.default_rng(12)


def _sets(docs: dict[int, set[int]]) -> dedup._Sets:
    ids = sorted(docs, key=lambda d: (len(docs[d]), d))
    rows = sorted((s, place) for place, d in enumerate(ids) for s in docs[d])
    s, n = np.unique(np.array([r[0] for r in rows], np.int64), return_counts=True)
    return dedup._Sets(np.array(ids), np.array([len(docs[d]) for d in ids]), s, n, np.array([r[1] for r in rows], np.int32))


@pytest.mark.parametrize("common, pairs", [(0, 1 << 21), (3, 50), (128, 1), (70, 7)])
def test_nearest_sets_of_a_block_together(monkeypatch, common, pairs):
    """Whatever is common, and however many pairs are counted at once, over two blocks, with ties, sets of nothing, and sets that share
    more than fits 32 bits in the rounding."""
    monkeypatch.setattr(dedup, "COMMON", common)
    monkeypatch.setattr(dedup, "PAIRS_AT_ONCE", pairs)
    made = {d: {int(x) for x in np.minimum(RNG.zipf(1.3, d % 37), 300)} for d in range(240)}
    made |= {240 + i: set(range(1000 + i, 4000)) for i in range(4)} | {244: {7000}, 245: {1}, 246: {1}}
    queries = {d: s for d, s in made.items() if d % 4 == 1 or d in (240, 244)}
    blocks = [{d: s for d, s in made.items() if d not in queries and d % 2 == k} for k in (1, 0)]
    want = {}
    for d, s in queries.items():
        near = [(-((2_000_000 * len(s & t) + len(s | t)) // (2 * len(s | t))) / 1e6, o) for b in blocks for o, t in b.items() if s & t]
        want[d] = min(near) if near else (0.0, -1)
    found = dedup._Nearest(_sets(queries))
    for b in blocks:
        found.add(_sets(b))
    assert {int(d): (-float(j), int(o)) for d, j, o in zip(found.queries.ids, found.best, found.id)} == want


def test_shingles_of_one_side_are_sieved(spark):
    """Blocks hold the shingles that the queries may have, and sizes count all."""
    a, b = (spark.createDataFrame([(i, t) for i in range(5)], "doc_id long, text string") for t in ("p q r s", f"p q r {' '.join(map(str, range(400)))}"))
    asked = dedup.word_hashes(a).mapInArrow(dedup.of_words, "doc_id long, shingles array<long>")
    blocks = dedup._grouped(dedup.word_hashes(b), 1 << 20, dedup.sieve(asked, "shingles", 10), words=True)
    row = blocks.agg(F.sum(F.size("place")).alias("taken"), F.min(F.array_min("sizes")).alias("size")).first()
    assert 5 <= row.taken < 20 and row.size == 401


def test_hashes_of_shingles_are_those_of_their_words():
    """As many distinct ones as the shingles, the same for the same ones, whatever stands before or behind them."""
    texts = [["a", "b", "c", "a", "b", "c"], [], ["a"], ["a", "b"], ["b", "c", "a"], ["a", "a"]]
    number = {"a": 11, "b": -(1 << 62), "c": 77}
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([[5, 5, 5], *[[number[w] for w in t] for t in texts]], pa.list_(pa.int64()))], names=["doc_id", "words"])
    rows = [set(r["shingles"]) for r in next(dedup.of_words(iter([batch.slice(1)]))).to_pylist()]
    assert [len(r) for r in rows] == [3, 0, 1, 2, 1, 1] and rows[4] < rows[0] and rows[2] == rows[5] < rows[3] and not rows[0] & rows[3]


def _block(queries: int):
    """A block of 400 documents over 300 terms, and queries of 20 terms, every third of them like the one before."""
    from textquarry.operators import blocks as bk

    tokens = [[f"t{int(x):03}" for x in np.minimum(RNG.zipf(1.3, 60), 300)] for _ in range(400)]
    rows = next(bk.cut(iter([pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(tokens, pa.list_(pa.string()))], names=["doc_id", "tokens"])])))
    asked: list[list[dict]] = [[] for _ in range(rows.num_rows)]
    terms = []
    for q in range(queries):
        terms = terms if q % 3 == 2 else RNG.choice(np.arange(1, rows.num_rows), 20, replace=False).tolist()
        asked[0].append({"query_id": q, "value": 6.0 + q % 5, "target": None})
        for row in terms:
            asked[row].append({"query_id": q, "value": 0.5 + row % 7, "target": None})
    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("value", pa.float64()), ("target", pa.int64())]))
    return bk, bk.Block(pa.Table.from_batches([rows]).append_column("asked", pa.array(asked, kind)).combine_chunks().to_batches(), 60.0, 1.5, 0.75)


@pytest.mark.parametrize("found", [1, 1 << 18])
def test_finds_of_many_pieces_are_looked_up_at_once(monkeypatch, found):
    """A piece of queries has many times what is added up at a time, and counts are those of single queries."""
    bk, block = _block(90)
    monkeypatch.setattr(bk, "TOGETHER_SUMS", 800)
    monkeypatch.setattr(bk, "TOGETHER_FOUND", found)
    which, least = np.arange(90), np.full(90, 6.0)
    pieces = list(bk.reached(block, which, least))
    assert [p[0] for p in pieces] + [90] == [0] + [p[1] for p in pieces] and (len(pieces) == 1) == (found > 1)
    above = bk.Above()
    list(above.add(block))
    for q in range(90):
        part = slice(block.starts[q], block.starts[q + 1])
        _, s = block.scores(block.row[part], block.weight[part])
        assert above.found.get(q, (0, 0)) == (np.count_nonzero(s > 6.0 + q % 5), np.count_nonzero(s == 6.0 + q % 5))
    assert any(above.found.values())
