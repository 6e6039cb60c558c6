"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed in vectorised passes over the bytes of whole texts. Training bins each statistic by its
quantiles in a bounded sample of labelled rows and grows complete trees of fixed depth level by level from gradient
histograms. A model is a set of flat arrays (feature and threshold by tree and node, value by tree and leaf), walked
for a whole batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The fit reads about this many labelled rows, chosen by hash.
SAMPLE_ROWS = 12_000

#: Texts whose byte counts are taken at once.
ENTROPY_ROWS = 512

_CLASS = {"upper": (65, 91), "lower": (97, 123), "digit": (48, 58), "wide": (128, 256)}
FEATURES = (
    "log_bytes", "upper", "lower", "digit", "wide", "blank", "newline", "bang", "stop", "comma", "angle", "at_slash", "other_punct",
    "log_words", "word_length", "long_words", "capital_words", "upper_words", "distinct_words", "common_word", "repeated_pairs",
    "log_lines", "line_length", "line_length_spread", "distinct_lines", "closed_lines", "entropy",
)


def _per(owner: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, values, minlength=n)[:n].astype(np.float64)


def _distinct(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each owner, and the count of its most frequent one."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (h[1:] != h[:-1])])) if o.size else np.zeros(0, np.int64)
    most = np.zeros(n)
    if new.size:
        np.maximum.at(most, o[new], np.diff(np.append(new, o.size)))
    return _per(o[new], n), most


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, FEATURES) of each text; null counts as empty."""
    out = np.zeros((len(column), len(FEATURES)))
    for row, stop, data, offsets in common.text_blocks(column):
        n = offsets.size - 1
        size = np.diff(offsets).astype(np.float64)
        some = np.maximum(size, 1)
        sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        f = {"log_bytes": np.log1p(size), "entropy": np.zeros(n)}
        for name, (a, b) in _CLASS.items():
            f[name] = sums((data >= a) & (data < b)) / some
        punct = np.zeros(256, bool)
        punct[33:48] = punct[58:65] = punct[91:97] = punct[123:127] = True
        for name, chars in (("blank", b" \t\r"), ("newline", b"\n"), ("bang", b"!?"), ("stop", b"."), ("comma", b",;:"), ("angle", b"<>{}[]()=|"), ("at_slash", b"@/\\_")):
            table = np.zeros(256, bool)
            table[list(chars)] = True
            punct &= ~table
            f[name] = sums(table[data]) / some
        f["other_punct"] = sums(punct[data]) / some
        starts, ends, first = common.word_spans(data, offsets, common.NONSPACE_BYTE)
        words = np.diff(first)
        owner = np.repeat(np.arange(n), words)
        some_words = np.maximum(words, 1)
        length = (ends - starts).astype(np.float64)
        capital = (data[starts] >= 65) & (data[starts] < 91)
        upper = capital & (length > 2) & (data[np.minimum(starts + 1, data.size - 1)] < 91) & (data[np.minimum(starts + 1, data.size - 1)] >= 65)
        h = common.span_hashes(common.LOWER[data], starts, ends)
        distinct, most = _distinct(owner, h, n)
        pairs, inside = common.gram_hashes(h, 2), owner[1:] == owner[:-1]
        distinct_pairs, _ = _distinct(owner[1:][inside], pairs[inside], n)
        f |= {
            "log_words": np.log1p(words), "word_length": _per(owner, n, length) / some_words, "long_words": _per(owner, n, (length > 14).astype(float)) / some_words,
            "capital_words": _per(owner, n, capital.astype(float)) / some_words, "upper_words": _per(owner, n, upper.astype(float)) / some_words, "distinct_words": distinct / some_words,
            "common_word": most / some_words, "repeated_pairs": 1 - distinct_pairs / np.maximum(words - 1, 1),
        }
        in_line = np.ones(256, bool)
        in_line[10] = False
        starts, ends, first = common.word_spans(data, offsets, in_line)
        lines = np.diff(first)
        owner = np.repeat(np.arange(n), lines)
        some_lines = np.maximum(lines, 1)
        length = (ends - starts).astype(np.float64)
        mean = _per(owner, n, length) / some_lines
        closed = np.zeros(256, bool)
        closed[list(b".!?:;\"'")] = True
        distinct, _ = _distinct(owner, common.span_hashes(data, starts, ends), n)
        f |= {"log_lines": np.log1p(lines), "line_length": mean, "line_length_spread": np.sqrt(_per(owner, n, (length - mean[owner]) ** 2) / some_lines), "distinct_lines": distinct / some_lines, "closed_lines": _per(owner, n, closed[data[ends - 1]].astype(float)) / some_lines}
        for i in range(0, n, ENTROPY_ROWS):  # a table of byte counts for so many texts at once
            own = offsets[i : i + ENTROPY_ROWS + 1]
            place = np.repeat(np.arange(own.size - 1) * 256, np.diff(own))
            p = np.bincount(place + data[own[0] : own[-1]], minlength=256 * (own.size - 1)).reshape(-1, 256) / some[i : i + own.size - 1, None]
            f["entropy"][i : i + own.size - 1] = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
        out[row:stop] = np.stack([f[name] for name in FEATURES], axis=1)
    return out


class Trees:
    """Flat arrays of complete trees: node i has children 2i + 1 and 2i + 2."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.threshold, self.leaf, self.base = feature, threshold, leaf, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(x.shape[0]), np.full(x.shape[0], self.base)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for t in range(self.feature.shape[0]):
            at = np.zeros(x.shape[0], np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
            total += self.leaf[t, at - (self.leaf.shape[1] - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, l2: float = 1.0, least: int = 8) -> Trees:
    """Newton boosting of the logistic loss. One class alone, or no rows, gives its smoothed rate (0.5 without rows)."""
    nodes, leaves = (1 << depth) - 1, 1 << depth
    share = (y.sum() + 0.5) / (y.size + 1)
    base = float(np.log(share / (1 - share)))
    if not y.size or y.min() == y.max():
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), base)
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(n_features)])
    raw = np.full(y.size, base)
    all_feature, all_threshold, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        at = np.zeros(y.size, np.int64)
        for level in range(depth):
            width = 1 << level
            local = at - (width - 1)
            best = np.full(width, 1e-6)
            for j in range(n_features):
                slot = local * bins + binned[j]
                shape = (width, bins)
                sg, sh, sn = (np.cumsum(np.bincount(slot, v, width * bins).reshape(shape), axis=1) for v in (g, h, None))
                tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain[(sn < least) | (tn - sn < least)] = 0
                cut = gain[:, : len(edges[j])].argmax(axis=1) if len(edges[j]) else None
                if cut is None:
                    continue
                top = gain[np.arange(width), cut]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                feature[width - 1 + better], threshold[width - 1 + better] = j, edges[j][cut[better]]
            at = 2 * at + 1 + (x[np.arange(y.size), feature[at]] > threshold[at])
        local = at - nodes
        leaf = -rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + l2)
        raw += leaf[local]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return Trees(np.stack(all_feature), np.stack(all_threshold), np.stack(all_leaf), base)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Learns from about sample_rows labelled rows (twice as many where ids repeat), by hash, that may be learned from. Labels
    of null, or for no document, are left out; a doc_id with several labels counts with each."""
    usable = labels.select(F.col("doc_id").alias("i"), F.col(target).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & common.not_held_out("i"))
    n = usable.count()
    usable = usable.where(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(1, n))) + 1)
    # the sample's ids are bounded by sample_rows: they may be broadcast; ids that many rows have are thinned out by row
    rows = common.identified(docs.select(F.col("doc_id").alias("i"), "text")).select("row.i", "row.text", "at").join(F.broadcast(usable), "i")
    met = rows.select("i").count()
    if met > 2 * sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("i", "at.place"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / met) + 1)
    rows = rows.drop("at")

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        x = statistics(batch.column(batch.schema.names.index("text")))
        return [pa.array(list(x), pa.list_(pa.float64()))]

    made = common.append_columns(rows, [T.StructField("x", T.ArrayType(T.DoubleType()))], compute).select("i", "y", "x").collect()
    made.sort(key=lambda r: (r.i, r.y, r.x))
    x = np.array([r.x for r in made]).reshape(-1, len(FEATURES))
    return train(x, np.array([r.y for r in made], np.float64))


def score(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score of every whole text (null: of the empty text; a very long one is a block of its own); rows are
    scored one by one, so repeated rows, ties and empty tables need no care; other columns pass through, but for one
    of the new one's name, which it replaces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return common.append_columns(docs, [T.StructField(name, T.DoubleType())], lambda batch: [pa.array(shared.value.score(statistics(batch.column(batch.schema.names.index(text)))))])


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs whose score is at least `least`, with the columns of docs, whatever their names."""
    name = common.free_name(docs.columns, "quality_score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) >= least).drop(name)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return made.select("doc_id", (~common.not_held_out("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
