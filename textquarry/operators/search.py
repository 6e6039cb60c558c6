"""Search of many queries by vectors, by words, or by both, and the seams for an encoder and a metric of one's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import bm25, dense, fusion

MODES = ("dense", "bm25", "hybrid", "hybrid_rrf", "hybrid_convex")


def encoded(rows: DataFrame, key: str, encode_fn: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """(key, v) of rows by any function from a list of texts to a matrix; it runs where the rows are, a batch at a time,
    and null texts are encoded as empty ones."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = np.asarray(encode_fn(frame.iloc[:, 1].fillna("").tolist()), np.float64) if len(frame) else np.zeros((0, 1))
            yield pd.DataFrame({"key": frame.iloc[:, 0], "v": list(made)})

    return rows.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInPandas(run, "key long, v array<double>").withColumnRenamed("key", key)


def search(mode: str, k: int, index: bm25.Index | None = None, words: DataFrame | None = None, corpus: DataFrame | None = None, vectors: DataFrame | None = None, alpha: float = 0.7, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best of every query. Words (query_id, tokens) are looked up in a BM25 index,
    vectors (query_id, v) in a corpus (doc_id, v). "hybrid" fuses the 5 k best of both by reciprocal ranks, a list without a
    document adding nothing; "hybrid_rrf" the 50 or 5 k best, such a list counting as ten places behind its end;
    "hybrid_convex" adds alpha times the vectors' score to the rest of the words', both scaled within the query's pool."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if mode != "dense" and (index is None or words is None):
        raise ValueError(f"{mode} needs an index and words")
    if mode != "bm25" and (corpus is None or vectors is None):
        raise ValueError(f"{mode} needs a corpus of vectors and query vectors")
    pool = k if mode in ("dense", "bm25") else 5 * k if mode == "hybrid" else max(50, 5 * k)
    by_vector = dense.search(vectors, corpus, pool) if mode != "bm25" else None
    by_words = bm25.best(words, index, pool) if mode != "dense" else None
    if mode == "dense":
        return by_vector
    if mode == "bm25":
        return by_words
    if mode == "hybrid_convex":
        return fusion.convex(by_vector, by_words, k, alpha).select("query_id", "doc_id", "score", "rank")
    return fusion.rrf(by_vector, by_words, k, constant, pool + 10 if mode == "hybrid_rrf" else None)


def presented(found: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """found with what a reader is shown: a snippet of the document and its Jaccard similarity to the query by words."""
    both = found.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(docs.select("doc_id", "text"), "doc_id")
    a, b = (F.array_distinct(tx.lower_words(F.col(c))) for c in ("query", "text"))
    return both.select("query_id", "rank", "doc_id", "score", tx.snippet(F.col("text")).alias("snippet"), F.round(tx.jaccard(a, b), 6).alias("jaccard"))
