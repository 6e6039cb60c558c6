"""Ranks under ties, retrieval metrics, resampled confidence intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store
from . import resampling
from .numbering import numbered


def upper_bound(n: Column, level: float = 0.95) -> Column:
    """The rate that none of n trials showing an event still allows at a level (the rule of three); 1 for no trial."""
    return F.when(n > 0, 1 - F.pow(F.lit(1 - level), 1.0 / n)).otherwise(1.0)


#: Targets are broadcast up to so many; more are joined by shuffle.
BROADCAST_TARGETS = 400_000


def tie_counts(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, greater, equal) of the target's score among a query's; targets without a score are left out. Scored is run
    twice; where scores come from an index, bm25.counts() makes no row per score."""
    target = scored.join(truth, ["query_id", "doc_id"]).where("score > 0").select("query_id", F.col("score").alias("own"))
    target = F.broadcast(target) if truth.count() <= BROADCAST_TARGETS else target
    greater, equal = (F.sum(c.cast("long")) for c in (F.col("score") > F.col("own"), F.col("score") == F.col("own")))
    return scored.join(target, "query_id").groupBy("query_id").agg(greater.alias("greater"), equal.alias("equal"))


#: Ties of up to so many places are added up one by one; sums over longer ones come from an asymptotic series.
SHORT_TIE = 64


def harmonic_number(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, by its asymptotic series: for n from 16 on, exact to some 1e-13."""
    x = n.cast("double")
    return F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)


def expected_rr(greater: Column, equal: Column) -> Column:
    """Mean of 1 / rank over the places that a tie may fall on."""
    short = lambda n: F.aggregate(F.sequence(greater + 1, greater + n), F.lit(0.0), lambda s, i: s + 1.0 / i)
    first = greater + F.lit(SHORT_TIE)
    long = short(F.lit(SHORT_TIE)) + harmonic_number(greater + equal) - harmonic_number(first)
    return F.when(equal <= SHORT_TIE, short(F.least(equal, F.lit(SHORT_TIE)))).otherwise(long) / equal


def harmonic_ranks(scored: DataFrame, truth: DataFrame, max_candidates: int | None = None, zero_policy: str = "unretrieved", n_docs: int | None = None) -> DataFrame:
    """(query_id, rank) of truth (query_id, doc_id) among scored (query_id, doc_id, score); see ranks_of()."""
    counts = tie_counts(scored, truth)
    if zero_policy == "ties":
        positive = scored.where("score > 0").groupBy("query_id").agg(F.count("*").alias("positive"))
        counts = counts.join(positive, "query_id", "full_outer")
    return ranks_of(counts, truth, max_candidates, zero_policy, n_docs)


def ranks_of(counts: DataFrame, truth: DataFrame, max_candidates: int | None = None, zero_policy: str = "unretrieved", n_docs: int | None = None) -> DataFrame:
    """(query_id, rank) of truth (query_id, doc_id) from counts (query_id, greater, equal, positive) of its score: the inverse
    of the expected reciprocal rank, null if unretrieved or beyond max_candidates. A target without a score (equal is null or
    0) is unretrieved, or, with zero_policy "ties", one of all documents of the n_docs that the query doesn't score, on the
    places behind those it does."""
    if zero_policy not in ("unretrieved", "ties") or (zero_policy == "ties" and n_docs is None):
        raise ValueError("zero_policy is unretrieved, or ties with n_docs")
    if max_candidates is not None and max_candidates < 1:
        raise ValueError("max_candidates must be at least 1")
    found = truth.select("query_id").join(counts, "query_id", "left")
    met = F.coalesce("equal", F.lit(0)) > 0
    greater, equal = F.when(met, F.col("greater")), F.when(met, F.col("equal"))
    if zero_policy == "ties":
        positive = F.coalesce("positive", F.lit(0))
        greater, equal = F.coalesce(greater, positive), F.coalesce(equal, F.lit(n_docs) - positive)
    ranks = found.select("query_id", greater.alias("greater"), equal.alias("equal"))
    ranks = ranks.select("query_id", (1.0 / expected_rr(F.col("greater"), F.col("equal"))).alias("rank"))
    return ranks if max_candidates is None else ranks.withColumn("rank", F.when(F.col("rank") <= max_candidates, F.col("rank")))


def expected_recall(scored: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the places a target's tie may fall on that are among the first k; 0 if unretrieved."""
    if k < 1:
        raise ValueError("k must be at least 1")
    inside = F.greatest(F.least(F.lit(k) - F.col("greater"), F.col("equal")), F.lit(0)) / F.col("equal")
    return truth.select("query_id").join(tie_counts(scored, truth), "query_id", "left").select("query_id", F.coalesce(inside, F.lit(0.0)).alias("recall"))


def optimistic_ranks(scored: DataFrame, truth: DataFrame) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    return scored.withColumn("rank", F.rank().over(best).cast("long")).join(truth, ["query_id", "doc_id"]).select("query_id", "rank")


def reciprocal(rank: Column) -> Column:
    return F.when((rank >= 1) & ~F.isnan(rank) & (rank < float("inf")), 1.0 / rank).otherwise(0.0)


def recall(rank: Column, k: int) -> Column:
    if k < 1:
        raise ValueError("k must be at least 1")
    return F.when((rank >= 1) & (rank <= k), 1.0).otherwise(0.0)


def ndcg(rank: Column, k: int) -> Column:
    return F.when((rank >= 1) & (rank <= k), 1.0 / F.log2(rank + 1)).otherwise(0.0) if k >= 1 else recall(rank, k)


def suite(rank: Column, ks: tuple[int, ...] = (1, 5, 10)) -> list[tuple[str, Column]]:
    return [("mrr", reciprocal(rank)), *((f"recall_{k}", recall(rank, k)) for k in ks), *((f"ndcg_{k}", ndcg(rank, k)) for k in ks)]


def metrics(ranks: DataFrame, by: list[str] | None = None, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row (a group) of all metrics of ranks, 0 where there are none; unretrieved ranks are null."""
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(name) for name, c in suite(F.col("rank"), ks)])


def _numbered(ranks: DataFrame) -> tuple[DataFrame, int]:
    """ranks with the place of each row in the order of query_id, and their number."""
    rows = store.cut(numbered(ranks, "query_id", "row"))
    return rows, rows.count()


def resamples(ranks: DataFrame, times: int, seed: int = 42) -> DataFrame:
    """ranks with replacement, `times` times, as (b, times a row was drawn, columns of ranks): a row per row that a sample
    holds. Where sums will do, sample_means() makes none."""
    rows, n = _numbered(ranks)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.asarray(batch.column(0)))
            for i, m in resampling.draws(places, n, times, seed):
                b = np.flatnonzero(m)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(m[b]), pa.array(np.full(b.size, places[i]))], names=["b", "times", "row"])

    return rows.select("row").mapInArrow(draw, "b long, times long, row long").join(rows, "row")


def sample_means(ranks: DataFrame, values: dict[str, Column], times: int, seed: int = 42) -> DataFrame:
    """(b, a mean of each of the values): means over `times` samples of ranks with replacement. Each task returns a row per
    sample, whatever the number of rows."""
    rows, n = _numbered(ranks)
    names = list(values)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_ = np.zeros((times, len(names))), False
        for batch in batches:
            place = np.asarray(batch.column(0))
            order = np.argsort(place)
            own = np.stack([np.asarray(batch.column(i + 1)) for i in range(len(names))], axis=1)[order]
            for i, m in resampling.draws(place[order], n, times, seed):
                sums += m[:, None] * own[i]
                any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(times)), *(pa.array(sums[:, i]) for i in range(len(names)))], names=["b", *names])

    made = rows.select("row", *[c.cast("double").alias(x) for x, c in values.items()]).mapInArrow(draw, "b long, " + ", ".join(f"{x} double" for x in names))
    return made.groupBy("b").agg(*[(F.sum(x) / max(1, n)).alias(x) for x in names])


def bootstrap(ranks: DataFrame, times: int = 1000, level: float = 0.95, seed: int = 42, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(metric, low, high): percentile intervals of all metrics, from one set of samples; (0, 0) without ranks."""
    names = [name for name, _ in suite(F.col("rank"), ks)]
    means = sample_means(ranks, dict(suite(F.col("rank"), ks)), times, seed)
    long = means.unpivot(["b"], names, "metric", "value")
    edge = (1 - level) / 2
    found = long.groupBy("metric").agg(F.percentile("value", F.lit(edge)).alias("low"), F.percentile("value", F.lit(1 - edge)).alias("high"))
    every = ranks.sparkSession.createDataFrame([(m,) for m in names], "metric string")
    return every.join(found, "metric", "left").select("metric", F.round(F.coalesce("low", F.lit(0.0)), 6).alias("low"), F.round(F.coalesce("high", F.lit(0.0)), 6).alias("high"))


def bootstrap_metric(ranks: DataFrame, metric_fn, times: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(low, high): percentile interval of any function from an array of ranks (NaN: unretrieved) to a number, over the
    same samples as bootstrap(); (0, 0) without ranks."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"value": [float(metric_fn(frame["rank"].to_numpy(dtype=float)))]})

    values = resamples(ranks, times, seed).select("b", F.explode(F.array_repeat("rank", F.col("times").cast("int"))).alias("rank")).groupBy("b").applyInPandas(one, "value double")
    edge = (1 - level) / 2
    return values.agg(F.round(F.coalesce(F.percentile("value", F.lit(edge)), F.lit(0.0)), 6).alias("low"), F.round(F.coalesce(F.percentile("value", F.lit(1 - edge)), F.lit(0.0)), 6).alias("high"))


def paired_bootstrap(a: DataFrame, b: DataFrame, times: int = 2000, level: float = 0.95, seed: int = 42, margin: float = 0.03) -> DataFrame:
    """One row: mean difference of reciprocal rank and of recall@1 (a minus b), interval, two-sided p, and decisions."""
    both = a.select("query_id", F.col("rank").alias("ra")).join(b.select("query_id", F.col("rank").alias("rb")), "query_id")
    drr, dr1 = reciprocal(F.col("ra")) - reciprocal(F.col("rb")), recall(F.col("ra"), 1) - recall(F.col("rb"), 1)
    mean = both.agg(F.round(F.avg(drr), 6).alias("delta_rr"), F.round(F.avg(dr1), 6).alias("delta_r1"))
    edge = (1 - level) / 2
    means = sample_means(both, {"d": drr}, times, seed).select(F.round("d", 9).alias("d"))
    ci = means.agg(F.round(F.percentile("d", F.lit(edge)), 6).alias("low"), F.round(F.percentile("d", F.lit(1 - edge)), 6).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))).alias("p"))
    return mean.crossJoin(ci).withColumns({"equivalent": F.col("low") >= -margin, "significant": (F.col("low") > 0) | (F.col("high") < 0)})
