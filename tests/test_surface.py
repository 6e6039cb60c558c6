"""Searches, hooks, sinks and tokenizers against plain Python."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import bpe
from textquarry.functions import text as tx
from textquarry.functions import vectors as vx
from textquarry.operators import bm25, dense, ranking, search
from textquarry.sources import io, store
from textquarry.streaming import index_upkeep

TEXTS = ["red apple pie", "green apple", "blue sky over red hills", "sky and sea", "sea of green", ""]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def encoder():
    """A toy encoder: counts of letters, of length 1. Made in a function, so that workers get it by value."""

    def letters(texts):
        made = np.array([[t.count(chr(97 + i)) for i in range(26)] for t in texts], float).reshape(len(texts), 26) + 0.01
        return made / np.linalg.norm(made, axis=1, keepdims=True)

    return letters


def test_search_modes(spark, docs):
    letters = encoder()
    queries = spark.createDataFrame([(0, "red sky"), (1, "green apple")], "query_id long, text string")
    index = bm25.build(docs, tokenizer=tx.lower_words)
    words = queries.select("query_id", tx.lower_words(F.col("text")).alias("tokens"))
    corpus, vectors = search.encoded(docs, "doc_id", letters), search.encoded(queries, "query_id", letters)
    run = lambda mode, k=2: {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in search.search(mode, k, index, words, corpus, vectors).collect()}
    q, c = letters(["red sky", "green apple"]).astype(np.float32).astype(float), letters(TEXTS).astype(np.float32).astype(float)
    s = np.round(q @ c.T, 6)
    best = {(i, r + 1): (int(d), s[i, d]) for i in range(2) for r, d in enumerate(sorted(range(6), key=lambda d: (-s[i, d], d))[:2])}
    got = run("dense")
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in best.items()} and all(math.isclose(got[k][1], best[k][1], abs_tol=1e-5) for k in best)
    assert run("bm25")[1, 1][0] == 1 and run("bm25")[0, 1][0] == 2
    for mode in ("hybrid", "hybrid_rrf", "hybrid_convex"):
        assert run(mode)[1, 1][0] == 1 and len(run(mode, 3)) == 6
    order = {i: sorted(range(6), key=lambda d: (-s[i, d], d)) for i in range(2)}
    lists = {i: [r.doc_id for r in bm25.top_k(bm25.scores(words, index), 10).where(f"query_id = {i}").orderBy("rank").collect()] for i in range(2)}
    rrf = {(i, d): round(1 / (61 + order[i].index(d)) + (1 / (61 + lists[i].index(d)) if d in lists[i] else 0), 9) for i in range(2) for d in range(6)}
    want = {(i, r + 1): (d, rrf[i, d]) for i in range(2) for r, d in enumerate(sorted(range(6), key=lambda d: (-rrf[i, d], d))[:2])}
    assert run("hybrid") == want
    shown = search.presented(search.search("bm25", 1, index, words), queries, docs).where("query_id = 1").first()
    assert (shown.snippet, shown.jaccard) == ("green apple", 1.0)
    for wrong in (("x", 2), ("dense", 0)):
        with pytest.raises(ValueError):
            run(*wrong)
    with pytest.raises(ValueError):
        search.search("hybrid", 2, index, words)


def test_dense_top_k_with_ties(spark):
    v = [[1.0, 0.0]] * 30 + [[0.0, 1.0]] * 3
    corpus = spark.createDataFrame(list(enumerate(v)), "doc_id long, v array<float>").repartition(3)
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, v array<float>")
    got = {(r.query_id, r["rank"]): r.doc_id for r in dense.search(queries, corpus, 5).collect()}
    assert [got[0, r] for r in range(1, 6)] == [0, 1, 2, 3, 4] and [got[1, r] for r in range(1, 6)] == [30, 31, 32, 0, 1]


def test_dense_blocks_laid_out_in_chunks(spark):
    """Query blocks that are sent to chunks give what broadcast ones give: with ties, labels, and without a cut."""
    r = np.random.default_rng(3)
    v = np.round(r.normal(size=(500, 4)), 1)
    rows = [(i, v[i].tolist(), int(i % 3)) if i % 50 else (i, None, None) for i in range(500)]
    corpus = spark.createDataFrame(rows, "doc_id long, v array<double>, label int").repartition(7)
    queries = corpus.where("doc_id < 60").withColumnRenamed("doc_id", "query_id")
    for options in ({"keep": 3}, {"keep": 5, "other_label": True}, {"keep": None}):
        k = options["keep"] or 1000
        rows = lambda limit, options=options, k=k: sorted(map(tuple, bm25.top_k(dense.scores(queries, corpus, broadcast_bytes=limit, **options), k).collect()))
        assert rows(0) == rows(1 << 20) and len(rows(0)) == 58 * min(k, 490)
    assert "BatchEvalPython" not in dense.scores(queries, corpus, 3)._jdf.queryExecution().executedPlan().toString()


def test_any_metric_can_be_resampled(spark):
    ranks = spark.createDataFrame([(i, float(i % 4 + 1) if i % 5 else None) for i in range(20)], "query_id long, rank double")
    mrr = lambda r: float(np.mean(np.where(r >= 1, 1 / r, 0)))
    got = ranking.bootstrap_metric(ranks, mrr, 60).first()
    assert tuple(got) == tuple(ranking.bootstrap(ranks, 60).where("metric = 'mrr'").first()[1:])
    assert tuple(ranking.bootstrap_metric(ranks.where("false"), mrr, 5).first()) == (0.0, 0.0)


def test_sinks_and_sources(spark, docs, tmp_path):
    docs.repartition(2).write.option("compression", "gzip").json(f"{tmp_path}/lines")
    assert sorted(map(tuple, io.read_jsonl(spark, f"{tmp_path}/lines", docs.schema.simpleString()[7:-1].replace(":", " ")).collect())) == sorted(map(tuple, docs.collect()))
    io.write_splits(docs.withColumn("split", F.when(F.col("doc_id") < 4, "train").otherwise("test")), f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits/split=test").count() == 2
    report = spark.createDataFrame([("a", 0.5, 0.4, 0.6, 0.25)], "arm string, mrr double, mrr_low double, mrr_high double, `Recall@1` double")
    io.write_report(report, f"{tmp_path}/report")
    assert io.read_report(spark, f"{tmp_path}/report").first().mrr == 0.5
    assert [r.text for r in io.table_lines(report, ["arm"]).orderBy("line").collect()][2:] == ["| MRR          | 0.5000 | [0.4000, 0.6000] |", "| RECALL@1     | 0.2500 | - |"]
    assert {r.metric for r in io.metric_rows(report, ["arm"]).collect()} == {"mrr", "mrr_low", "mrr_high", "Recall_at_1"}
    with open(f"{tmp_path}/file.bin", "wb") as f:
        f.write(bytes(range(256)) * 999)
    assert io.file_digests(spark, f"{tmp_path}/file.bin").first().sha256 == hashlib.sha256(bytes(range(256)) * 999).hexdigest()
    assert io.project(docs, ["text", "none"]).columns == ["text"]


@pytest.mark.skipif(not os.path.isfile("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary")
def test_tokenizer(spark, docs):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    rows = {r.doc_id: r for r in bpe.encode(docs, path, 4, "text").collect()}
    for i, text in enumerate(TEXTS):
        ids = bpe.vocabulary(path).encode("<TEXT> " + text, add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids) and rows[i].ids == (ids + [0] * 4)[:4] and rows[i].mask == [1] * min(4, len(ids)) + [0] * max(0, 4 - len(ids))
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, path, 64), path).collect()}
    assert back == dict(enumerate(TEXTS))
    for wrong in ({"modality": "x"}, {"size": 0}):
        with pytest.raises(ValueError):
            bpe.encode(docs, path, **wrong)


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "s array<array<float>>, m array<int>")
    got = df.select(vx.masked_mean(F.col("s"), F.col("m")).alias("mean"), vx.first_position(F.col("s")).alias("first")).collect()
    assert got[0].mean == [2.0, 4.0] and got[0].first == [1.0, 2.0] and got[1].mean == [0.0, 0.0]


def test_postings_from_a_stream(spark, docs, tmp_path):
    docs.where("doc_id < 3").write.parquet(f"{tmp_path}/in")
    start = lambda: index_upkeep.keep_index(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    start().awaitTermination()
    docs.where("doc_id >= 3").write.mode("append").parquet(f"{tmp_path}/in")
    start().awaitTermination()
    want = sorted(map(tuple, bm25.term_freq(bm25.tokenized(docs)).collect()))
    assert sorted(tuple(r) for r in index_upkeep.read_postings(spark, f"{tmp_path}/out").select("doc_id", "term", "tf", "dl").collect()) == want
    whole = bm25.build(docs)
    kept = index_upkeep.read_index(spark, f"{tmp_path}/out")
    assert (kept.n, kept.avgdl) == (whole.n, whole.avgdl)
    assert sorted(map(tuple, kept.vocab.select("term", "df").collect())) == sorted(map(tuple, whole.vocab.select("term", "df").collect()))
    assert bm25.search("red sky", kept, 3).collect() == bm25.search("red sky", whole, 3).collect()
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string")
    counted = index_upkeep.windowed_counts(events.withColumn("ts", F.to_timestamp("ts"))).collect()
    assert sorted((r.event_type, r.n) for r in counted) == [("a", 2), ("b", 1)]
    assert store.finished(spark, f"{tmp_path}/in")
