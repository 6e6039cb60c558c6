"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its hashed byte n-grams (n = 2, 3, 4 over lower-cased letters, everything
else read as a blank, so that n-grams see word borders). Logits are linear in that mean, so for prediction the
embedding and the softmax weights fold into one score row per bucket: a prediction sums rows, in one pass over the
whole text. Confidence is calibrated by a temperature fitted on rows that training did not see, and predictions
below a confidence whose accepted error stays under a target are rejected (reported beside the prediction).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZES = (2, 3, 4)
BUCKET_BITS = 16
DIM = 16
#: The fit reads a sample of about this many rows of each language, chosen by hash.
SAMPLE_PER_LANG = 700
#: Languages share so many characters: where they want more, those that want most shrink to one equal number.
SAMPLE_CHARS = 24_000_000
#: Of each language at least about so many rows are read (all, if it has no more), whatever characters they hold.
LEAST_PER_LANG = 20
#: So many languages are learned at most.
LEARNED_LANGS = 2_000

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_MULTIPLIER = {2: 2654435761, 3: 2246822519, 4: 3266489917}


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sizes, bytes) buckets of the n-grams starting at each byte; those that leave their text get the last,
    empty bucket."""
    letters = _LETTER[data].astype(np.uint32)
    out = np.full((len(SIZES), data.size), 1 << BUCKET_BITS, np.uint32)
    ends = offsets[1:]
    value, reach = letters.copy(), 1
    for row, n in enumerate(SIZES):
        while reach < n:
            value[:-reach] |= letters[reach:] << np.uint32(8 * reach)
            reach += 1
        out[row] = ((value * np.uint32(_MULTIPLIER[n])) ^ (value >> np.uint32(15))) * np.uint32(2654435769) >> np.uint32(32 - BUCKET_BITS)
        for back in range(1, n):
            at = ends - back
            out[row, at[at >= 0]] = 1 << BUCKET_BITS
    return out


class Model:
    """Folded scores per bucket (with `weight`: embeddings still to be multiplied by it, for more languages than DIM),
    temperature and rejection threshold; langs in code point order."""

    def __init__(self, langs: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0, weight: np.ndarray | None = None):
        self.langs, self.scores, self.bias, self.temperature, self.threshold, self.weight = langs, scores, bias, temperature, threshold, weight

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), self.scores.shape[1]))
        for row, stop, data, offsets in common.text_blocks(column, 1 << 19):
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            if not full.size:
                continue
            total = np.zeros((full.size, self.scores.shape[1]))
            for buckets in ngram_buckets(data, offsets):
                total += np.add.reduceat(self.scores[buckets], offsets[:-1][full], axis=0, dtype=np.float64)
            out[row + full] = total / np.maximum(1, sum(np.maximum(0, sizes[full] - n + 1) for n in SIZES))[:, None]
        return (out if self.weight is None else out @ self.weight) + self.bias

    def probabilities(self, column: pa.Array) -> np.ndarray:
        z = self.logits(column) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def has_letter(column: pa.Array) -> np.ndarray:
    """False for null texts and those without a letter."""
    out = np.zeros(len(column), bool)
    for row, _, data, offsets in common.text_blocks(column):
        ascii_letters = np.concatenate([[0], np.cumsum((_LETTER[data] != 32) & (data < 128))])
        wide = np.concatenate([[0], np.cumsum(data >= 128)])
        out[row : row + offsets.size - 1] = np.diff(ascii_letters[offsets]) > 0
        for i in np.flatnonzero(~out[row : row + offsets.size - 1] & (np.diff(wide[offsets]) > 0)):
            out[row + i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 2.0, seed: int = 7, target_error: float = 0.005) -> Model | None:
    """SGD over single texts; a fifth of the rows, held apart, calibrates. None without rows."""
    langs = sorted(set(labels))
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    y = np.array([number[x] for x in labels])
    rng = np.random.Generator(np.random.PCG64(seed))
    embedding = rng.normal(0, 0.1, ((1 << BUCKET_BITS) + 1, DIM))
    embedding[-1] = 0
    weight, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        b, n = np.unique(ngram_buckets(data, np.array([0, data.size])), return_counts=True)
        real = b < 1 << BUCKET_BITS
        bags.append((b[real], n[real] / max(1, n[real].sum())))
    order = rng.permutation(len(texts))
    apart, learn = order[: len(order) // 5], order[len(order) // 5 :]
    learned = np.isin(y[apart], y[learn])  # languages that are wholly held apart would never be predicted
    apart, learn = apart[learned], np.concatenate([learn, apart[~learned]])
    steps = 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            b, share = bags[i]
            step = rate * (1 - steps / (epochs * len(learn)))
            steps += 1
            mean = share @ embedding[b]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weight @ p
            weight -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            embedding[b] -= step * 8 * share[:, None] * back
    if len(langs) <= DIM:
        model = Model(langs, (embedding @ weight).astype(np.float32), bias)
    else:
        model = Model(langs, embedding.astype(np.float32), bias, weight=weight)
    if apart.size >= 20:
        z = model.logits(pa.array([texts[i] for i in apart]))
        own = np.arange(apart.size)

        def loss(t: float) -> float:
            s = z / t
            return float(np.mean(np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[own, y[apart]]))

        model.temperature = min(np.geomspace(0.05, 10, 80), key=loss)
        p = model.probabilities(pa.array([texts[i] for i in apart]))
        sure, right = p.max(axis=1), p.argmax(axis=1) == y[apart]
        rank = np.argsort(-sure)
        error = np.cumsum(~right[rank]) / np.arange(1, rank.size + 1)
        fine = np.flatnonzero(error <= target_error)
        model.threshold = float(sure[rank[fine[-1]]]) if fine.size else 1.0
    return model


def shares(counts: list[tuple[int, int]]) -> list[float]:
    """The share of rows to read of each language (rows, characters): SAMPLE_PER_LANG rows or, for those that want most
    where all want more than SAMPLE_CHARS, the rows of one equal number of characters."""
    share = [min(1.0, SAMPLE_PER_LANG / n) for n, _ in counts]
    wanted = [x * max(1, chars) for x, (_, chars) in zip(share, counts)]
    left, level = float(SAMPLE_CHARS), float("inf")
    for k, w in enumerate(sorted(wanted)):
        if w * (len(wanted) - k) > left:
            level = left / (len(wanted) - k)
            break
        left -= w
    return [x * min(1.0, level / w) for x, w in zip(share, wanted)]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Trains on a bounded sample, chosen by hash of a row's id and place in its file, of rows that may be learned from and have an id, text
    and lang. Of more than LEARNED_LANGS languages the commonest are learned (then by name)."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = common.identified(chosen).select("row.doc_id", "row.text", "row.lang", "at")
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & common.not_held_out("doc_id"))
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    counts = by_lang.orderBy(F.desc("n"), "lang").limit(LEARNED_LANGS).collect()
    if not counts:
        return None
    counts.sort(key=lambda r: r.lang)
    below = [(r.lang, int(1_000_000 * min(1.0, max(share, LEAST_PER_LANG / r.n))) + 1) for r, share in zip(counts, shares([(r.n, r.chars) for r in counts]))]
    known = F.broadcast(rows.sparkSession.createDataFrame(below, "lang string, below long"))
    sample = rows.join(known, "lang").where(F.pmod(F.xxhash64("doc_id", "at.place"), F.lit(1_000_000)) < F.col("below")).select("doc_id", "text", "lang").collect()
    sample.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.text, r.lang))
    return train([r.text for r in sample], [r.lang for r in sample])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted. `und` with score 0 where the text is null or has no letter, or where
    nothing was learned; a very long text is summed whole, as a block of its own; of equally likely languages the first by
    code points; empty tables give empty results; repeated rows are predicted one by one; other columns pass through, but
    for any of these three names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        model, column = shared.value, batch.column(batch.schema.names.index(text))
        if model is None:
            n = len(column)
            return [pa.array(["und"] * n), pa.array([0.0] * n), pa.array([False] * n)]
        p = model.probabilities(column)
        told = has_letter(column)
        best = p.argmax(axis=1)
        score = np.where(told, p[np.arange(len(best)), best], 0.0)
        names = np.array([*model.langs, "und"], dtype=object)[np.where(told, best, len(model.langs))]
        return [pa.array(names, pa.string()), pa.array(score), pa.array(told & (score >= model.threshold))]

    return common.append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())], compute)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    made = predict(docs.select("doc_id", "text"), fit(docs))
    return made.select("doc_id", (~common.not_held_out("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


SQL: dict[str, str] = {}
