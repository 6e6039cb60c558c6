"""Blocks of postings against plain loops: every bound, tie and block border must leave the results as they are."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.operators import blocks as bk
from textquarry.operators import bm25, ranking

RNG = np.random.default_rng(5)
WORDS = [f"w{int(i)}" for i in np.minimum(RNG.zipf(1.3, 4000), 60)]
# every third text twice, so that scores tie across blocks
TEXTS = [" ".join(WORDS[i : i + 3 + i % 11]) for i in range(0, 900, 3)]
TEXTS = TEXTS + TEXTS[::3] + ["", None]
QUERIES = {q: WORDS[q * 7 : q * 7 + 1 + q % 9] + (["none"] if q % 4 == 0 else []) for q in range(40)}


def loops(k1=1.5, b=0.75):
    tokens = [t.split() if t else [] for t in TEXTS]
    avgdl = sum(map(len, tokens)) / len(tokens)
    df = Counter(w for t in tokens for w in set(t))
    scores = defaultdict(dict)
    for q, words in QUERIES.items():
        for d, t in enumerate(tokens):
            tf = Counter(t)
            if any(w in tf for w in words):
                idf = lambda w: math.log((len(tokens) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                scores[q][d] = round(sum(idf(w) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avgdl)) for w in words if w in tf), 6)
    return scores


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(5, "doc_id")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id long, tokens array<string>")


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "own")
    bm25.write(docs, path, tokenizer=tx.lower_words)
    return bm25.Index.load(docs.sparkSession, path)


def test_top_k_and_all_scores(index, queries):
    want = loops()
    got = defaultdict(dict)
    for r in bm25.scores(queries, index).collect():
        got[r.query_id][r.doc_id] = r.score
    assert {q: set(s) for q, s in got.items()} == {q: set(s) for q, s in want.items()}
    assert all(math.isclose(got[q][d], s, abs_tol=2e-6) for q in want for d, s in want[q].items())
    for k in (1, 3, 10):
        top = defaultdict(list)
        for r in bm25.best(queries, index, k).orderBy("query_id", "rank").collect():
            top[r.query_id].append((r.doc_id, r.score))
        lookup = defaultdict(list)
        for r in bm25.lookups(queries, index, k).orderBy("query_id", "rank").collect():
            lookup[r.query_id].append((r.doc_id, r.score))
        own = {q: sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k] for q, s in got.items()}
        assert top == own and lookup == own


def test_tasks_return_k_rows_and_shuffle_no_pairs(index, queries):
    plan = bm25.best(queries, index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    made = bm25.walked(bm25.weighted_terms(queries, index), index, lambda: bk.Best(3), bk.PAIRS)
    per_task = made.groupBy("query_id", F.spark_partition_id().alias("t")).count().agg(F.max("count")).first()[0]
    assert per_task == 3


def test_ranks_are_counted_in_blocks(spark, index, queries):
    truth = spark.createDataFrame([(q, 5 * q) for q in QUERIES], "query_id long, doc_id long")
    weighted = bm25.weighted_terms(queries, index)
    own = bm25.pair_scores(weighted, index, truth)
    scored = bm25.scores(queries, index)
    want = {(r.query_id, r.score) for r in scored.join(truth, ["query_id", "doc_id"]).collect()}
    assert {(r.query_id, r.score) for r in own.collect()} == want
    for options in ({}, {"max_candidates": 20}, {"zero_policy": "ties", "n_docs": len(TEXTS)}):
        by_block = ranking.ranks_of(bm25.counts(weighted, index, truth.join(own, ["query_id", "doc_id"], "left")), truth, **options)
        rows = lambda df: sorted((r.query_id, r["rank"] and round(r["rank"], 9)) for r in df.collect())
        assert rows(by_block) == rows(ranking.harmonic_ranks(scored, truth, **options))


def test_groups_of_queries(index, queries, monkeypatch):
    want = bm25.best(queries, index, 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(bm25, "BROADCAST_TERMS", 20)
    assert bm25.best(queries, index, 4).orderBy("query_id", "rank").collect() == want


def test_many_blocks_in_one_task(monkeypatch):
    """Bounds carried from block to block drop nothing."""
    monkeypatch.setattr(bk, "BLOCK_TOKENS", 60)
    tokens = [t.split() if t else [] for t in TEXTS]
    order = RNG.permutation(len(tokens)).tolist()
    batches = [pa.RecordBatch.from_arrays([pa.array(order[i : i + 7]), pa.array([tokens[d] for d in order[i : i + 7]], pa.list_(pa.string()))], names=["doc_id", "tokens"]) for i in range(0, len(order), 7)]
    rows = pa.Table.from_batches(bk.cut(iter(batches))).to_pylist()
    assert sum(r["ids"] is not None for r in rows) > 20
    df = Counter(w for t in tokens for w in set(t))
    entries = defaultdict(list)
    for q, words in QUERIES.items():
        for w, n in Counter(words).items():
            if w in df:
                entries[w].append({"query_id": q, "value": n * math.log((len(tokens) - df[w] + 0.5) / (df[w] + 0.5) + 1), "target": None})
    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("value", pa.float64()), ("target", pa.int64())]))
    met = [r | {"asked": entries.get(r["term"], [])} for r in rows if r["term"] in entries or r["term"] == ""]
    types = {"max_tf": pa.int32(), "min_dl": pa.int32(), "at": pa.list_(pa.int32()), "tf": pa.list_(pa.int32()), "ids": pa.list_(pa.int64()), "dl": pa.list_(pa.int32()), "asked": kind}
    table = pa.table({"term": [r["term"] for r in met]} | {c: pa.array([r[c] for r in met], t) for c, t in types.items()})
    avgdl = sum(map(len, tokens)) / len(tokens)
    want = loops()
    for size in (5, 1000):
        out = pa.Table.from_batches(bk.walk(lambda: bk.Best(5), avgdl, 1.5, 0.75)(iter(table.to_batches(max_chunksize=size)))).to_pylist()
        got = defaultdict(list)
        for r in out:
            got[r["query_id"]].append((r["doc_id"], r["score"]))
        for q, s in want.items():
            own = sorted(s.items(), key=lambda x: (-x[1], x[0]))[:5]
            assert [d for d, _ in got[q]] == [d for d, _ in own] and np.allclose([x for _, x in got[q]], [x for _, x in own], atol=2e-6)


def test_files_of_blocks_are_never_split(docs, tmp_path):
    bm25.write(docs, str(tmp_path / "own"), tokenizer=tx.lower_words)
    files = list((tmp_path / "own" / "blocks").glob("*.parquet"))
    assert files and all(pq.ParquetFile(f).metadata.num_row_groups <= 1 for f in files)


def test_a_search_reads_the_buckets_of_its_terms(spark, index):
    found = bm25.search("w2 w9", index, 5, tx.lower_words)
    wanted = {r.b for r in spark.createDataFrame([("w2",), ("w9",)], "t string").select(bm25.bucket(F.col("t")).alias("b")).collect()}
    scan = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "bucket" in x]
    assert scan and all(f"bucket#" in x and "PartitionFilters" in x for x in scan)
    read = index.lookup.where(F.col("bucket").isin(sorted(wanted)))
    assert 0 < len(read.inputFiles()) <= len(index.lookup.inputFiles())
    best = bm25.best(spark.createDataFrame([(0, ["w2", "w9"])], "query_id long, tokens array<string>"), index, 5)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [tuple(r) for r in best.orderBy("rank").collect()]
    began = time.time()
    bm25.search("w5 w7 w1", index, 5, tx.lower_words).collect()
    assert time.time() - began < 5  # a warm search takes some tenths of a second; the rest is room for a busy machine


def test_long_ties(spark):
    pairs = [(0, 1), (3, 64), (3, 65), (10, 1000), (0, 70), (12345, 54321)]
    got = spark.createDataFrame(pairs, "g long, e long").select(ranking.expected_rr(F.col("g"), F.col("e")).alias("x")).collect()
    assert all(math.isclose(r.x, sum(1 / i for i in range(g + 1, g + e + 1)) / e, rel_tol=1e-11) for r, (g, e) in zip(got, pairs))
    assert spark.range(1).select(ranking.expected_rr(F.lit(5), F.lit(10**12)).alias("x")).first().x > 0
