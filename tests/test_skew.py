"""Joins of similar sets, and fills, where one group holds a third of all rows or more."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions.modular import MERSENNE_61, affine
from textquarry.operators import dedup, mining, ranking, resampling

BOILER = " ".join(f"boiler{i}" for i in range(12))
SIDE = " ".join(f"side{i}" for i in range(9))


def texts(n):
    r = np.random.default_rng(7)
    made = []
    for i in range(n):
        own = " ".join(f"x{int(w)}" for w in r.integers(0, 40, 3 + i % 9))
        made.append(f"{BOILER} {own}" if i % 3 == 0 else f"{BOILER} {SIDE}" if i % 31 == 0 else f"{SIDE} {own} {BOILER}" if i % 17 == 0 else own if i % 5 else BOILER)
    return [*made, "", None]


def sets(rows):
    out = {}
    for i, t in enumerate(rows):
        w = (t or "").lower().split()
        out[i] = {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else set(w)
    return out


def jaccard(a, b):
    return round(len(a & b) / len(a | b), 6) if a | b else 0.0


def test_nearest_without_frequent_shingles(spark):
    rows = texts(240)
    own = sets(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sh = dedup.shingled(docs)
    for frequent in (5, 40, 10_000):
        got = {r.doc_id: (r.other_id, r.jaccard) for r in dedup.exact_nearest(sh.where("doc_id % 4 = 1"), sh.where("doc_id % 4 != 1"), frequent).collect()}
        for q in range(1, len(rows), 4):
            best = max(((jaccard(own[q], own[d]), -d) for d in own if d % 4 != 1 and own[q] & own[d]), default=(0.0, 1))
            assert got[q] == (-best[1], best[0]), (q, frequent)


def test_a_band_of_many_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [f"{base} tail{i}" if i % 3 == 0 else f"{base} {' '.join(f'far{i}x{j}' for j in range(8 + i % 5))}" if i % 3 == 1 else " ".join(f"o{i}y{j}" for j in range(30)) for i in range(150)]
    own = sets(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sig = dedup.signatures(docs)
    a, b = "doc_id % 5 = 4", "doc_id % 5 < 4"
    want = {r.doc_id for r in dedup.near_pairs(sig.where(a), sig.where(b), docs.where(a), docs.where(b)).collect()}
    assert {r.doc_id for r in dedup.near_any(sig.where(a), sig.where(b), docs.where(a), docs.where(b)).collect()} == want
    assert want and all(any(jaccard(own[i], own[j]) >= 0.85 for j in own if j % 5 < 4) for i in want)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, MERSENNE_61 - 1), st.integers(0, MERSENNE_61 - 1), st.lists(st.integers(0, MERSENNE_61 - 1), min_size=1, max_size=20))
def test_affine_images(a, b, h):
    got = affine(np.array(h, np.uint64), a, b)
    assert got.tolist() == [(a * x + b) % MERSENNE_61 for x in h]


def test_a_fill_ends_where_few_may_be_taken(spark):
    """Of 200,000 documents, all but 4 share the target's question."""
    n = 200_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when((F.col("id") % 50_000 == 7), F.col("id").cast("string")).otherwise("q").alias("query_text"), F.lit(None).cast("string").alias("skeleton"), F.array(F.col("id")).alias("sig"))
    truth = spark.createDataFrame([(0, 0), (1, 1)], "query_id long, target long")
    none = spark.createDataFrame([(0, 50_007, 1)], "query_id long, doc_id long, place long")
    began = time.time()
    got = mining.filled(none, truth, rows, 7).collect()
    assert time.time() - began < 90
    assert {q: {r.doc_id for r in got if r.query_id == q} for q in (0, 1)} == {q: {7, 50_007, 100_007, 150_007} for q in (0, 1)}
    assert sorted(r.neg_pos for r in got) == [1, 1, 2, 2, 3, 3, 4, 4] and [r.doc_id for r in got if r.query_id == 0 and r.neg_pos == 1] == [50_007]


def test_every_sample_draws_as_many_rows_as_there_are():
    for n, times in ((1, 5), (2, 400), (37, 300), (1500, 40)):
        counts = np.zeros((n, times), np.int64)
        for i, m in resampling.draws(np.arange(n), n, times, 42):
            counts[i] += m
        assert (counts.sum(axis=0) == n).all() and counts.min() >= 0
        # a task that holds some of the places gives them the same counts
        some = np.arange(0, n, 3)
        for i, m in resampling.draws(some, n, times, 42):
            assert (m == counts[some[i]]).all()
    # counts of a place over samples are binomial: their mean and variance are near 1
    assert abs(counts.mean() - 1) < 1e-12 and abs(counts.var() - 1) < 0.05
    u = resampling.uniforms(np.arange(20_000), 5, 0, 42)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[1:], u[:-1])[0, 1]) < 0.03
    assert abs(np.corrcoef(u, resampling.uniforms(np.arange(20_000), 10, 0, 42))[0, 1]) < 0.03


def test_intervals_do_not_depend_on_partitions(spark):
    rows = [(i, float(i % 7 + 1) if i % 4 else None) for i in range(90)]
    made = [tuple(map(tuple, ranking.bootstrap(spark.createDataFrame(rows, "query_id long, rank double").repartition(p), 200).orderBy("metric").collect())) for p in (1, 6)]
    assert made[0] == made[1]
    low, high = next((r[1], r[2]) for r in made[0] if r[0] == "mrr")
    true = float(np.mean([1 / r if r else 0 for _, r in rows]))
    assert low < true < high and high - low < 0.3
