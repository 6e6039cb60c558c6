"""Fusion of two ranked lists (query_id, doc_id, score, rank)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("query_id", "doc_id", F.col("score").alias("score_a"), F.col("rank").alias("rank_a"))
    right = b.select("query_id", "doc_id", F.col("score").alias("score_b"), F.col("rank").alias("rank_b"))
    return left.join(right, ["query_id", "doc_id"], "full_outer")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def rrf(a: DataFrame, b: DataFrame, k: int, constant: int = 60, missing_rank: int | None = None) -> DataFrame:
    """Reciprocal rank fusion. A list without the document adds 0, or as if it had missing_rank there."""
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0 if missing_rank is None else 1.0 / (constant + missing_rank)))
    return ranked(merged(a, b).select("query_id", "doc_id", F.round(part("rank_a") + part("rank_b"), 9).alias("score")), k)


def min_max(pooled: DataFrame, name: str) -> DataFrame:
    """Column `name` scaled to 0..1 within each query; a missing score is the pool's smallest."""
    own = Window.partitionBy("query_id")
    low, high = F.min(name).over(own), F.max(name).over(own)
    return pooled.withColumn(name, F.coalesce((F.col(name) - low) / (high - low + 1e-9), F.lit(0.0)))


def convex(a: DataFrame, b: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """alpha times a plus the rest times b, both scaled within the query's pool; keeps both parts."""
    pooled = min_max(min_max(merged(a, b), "score_a"), "score_b")
    made = pooled.select("query_id", "doc_id", F.round("score_a", 9).alias("norm_a"), F.round("score_b", 9).alias("norm_b"), F.round(alpha * F.col("score_a") + (1 - alpha) * F.col("score_b"), 9).alias("score"))
    return ranked(made, k)
