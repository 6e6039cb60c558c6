"""Benchmark decontamination by winnowing.

Every document and every benchmark item is cut into words; the hashes of k-word grams are winnowed: of each
window of w consecutive grams the smallest hash is kept. With k + w - 1 = 13, any 13 words that a document and
an item share contain one whole window in both, so both keep the same hash of it: no shared span of 13 words
is missed. Fingerprints that meet are extended word by word to both sides, and runs of at least 13 words count.
Items of fewer words are found by their whole sequence (a window of one gram as long as the item).

A benchmark of at most one block of bounded size is broadcast as an index, and the documents' rows pass by it without
a shuffle. A larger one is joined: fingerprints of documents and items meet in a shuffle, and each document that shares
one with an item is compared with that item alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 13
GRAM = 5
#: Characters of benchmark text in one broadcast block (some 60 MB of index).
BLOCK_CHARS = 8_000_000


class Index:
    """Winnowed fingerprints of a block of items; items with the same words share one entry."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        groups: dict[bytes, int] = {}
        self.ids: list[list[str]] = []
        words: list[np.ndarray] = []
        for item_id, text in items:
            data = common.LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = common.word_spans(data, np.array([0, data.size]), common.ALNUM_BYTE)
            if not starts.size:
                continue
            hashes = common.span_hashes(data, starts, ends)
            at = groups.setdefault(hashes.tobytes(), len(words))
            if at == len(words):
                words.append(hashes)
                self.ids.append([])
            self.ids[at].append(str(item_id))
        sizes = np.array([w.size for w in words], np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes
        self.item = np.repeat(np.arange(sizes.size), sizes)
        keys, at = winnow(self.words, self.item, gram, window - gram + 1)
        long = sizes[self.item[at]] >= window
        order = np.argsort(keys[long], kind="stable")
        self.keys, self.at = keys[long][order], at[long][order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(sizes[sizes < window]):
            own = np.flatnonzero(sizes == n)
            h = np.array([common.gram_hashes(words[i], int(n))[0] for i in own], np.uint64)
            order = np.argsort(h)
            self.short[int(n)] = (h[order], own[order])


def winnow(words: np.ndarray, owner: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the k-grams that are the smallest of some window of w; grams across owners never count."""
    grams = common.gram_hashes(words, k)
    if not grams.size:
        return grams, np.zeros(0, np.int64)
    inside = owner[: grams.size] == owner[k - 1 :]
    grams = np.where(inside, grams, np.uint64((1 << 64) - 1))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), common.sliding(grams, w, np.minimum) if grams.size >= w else np.zeros(0, np.uint64), np.zeros(w - 1, np.uint64)])
    if grams.size < w:
        kept = np.zeros(grams.size, bool)
    else:
        kept = common.sliding(padded, w, np.maximum) == grams
    at = np.flatnonzero(kept & inside)
    return grams[at], at


def extend(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many further words agree from (p, q) in the direction of step, at most room."""
    n = np.zeros(p.size, np.int64)
    live, t = np.flatnonzero(room > 0), 1
    while live.size:
        live = live[doc[p[live] + step * t] == item[q[live] + step * t]]
        n[live] = t
        t += 1
        live = live[room[live] >= t]
    return n


def lookup(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (index into values, index into sorted_keys) of equal keys."""
    if not sorted_keys.size or not values.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.searchsorted(sorted_keys, values, "left")
    near = np.flatnonzero(sorted_keys[np.minimum(low, sorted_keys.size - 1)] == values)
    owner, at = common.expand(low[near], np.searchsorted(sorted_keys, values[near], "right"))
    return near[owner], at


def scan(data: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of documents: words of each, first word of each (plus total), hit flags of all words, and
    (document, item) pairs with an occurring window."""
    data = common.LOWER[data]
    starts, ends, first = common.word_spans(data, offsets, common.ALNUM_BYTE)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n_words.size), n_words)
    words = common.span_hashes(data, starts, ends)
    mark = np.zeros(words.size + 1, np.int64)
    pairs = []

    def found(begin: np.ndarray, length, item: np.ndarray) -> None:
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + length, -1)
        pairs.append(np.stack([owner[begin], item], axis=1))

    if index.keys.size:
        keys, at = winnow(words, owner, index.gram, index.window - index.gram + 1)
        near, k = lookup(index.keys, keys)
        p, q = at[near], index.at[k]
        if p.size:
            left = extend(words, index.words, p, q, np.minimum(p - first[owner[p]], q - index.first[index.item[q]]), -1)
            runs = np.unique(np.stack([p - left, q - left], axis=1), axis=0)
            p, q = runs[:, 0], runs[:, 1]
            room = np.minimum(first[owner[p] + 1] - p, index.last[index.item[q]] - q) - 1
            length = extend(words, index.words, p, q, room, 1) + 1
            same = words[p] == index.words[q]
            real = same & (length >= index.window)
            found(p[real], length[real], index.item[q[real]])
    for n, (keys, item) in index.short.items():
        grams = common.gram_hashes(words, n)
        near, k = lookup(keys, grams)
        inside = owner[near] == owner[near + n - 1] if near.size else np.zeros(0, bool)
        found(near[inside], n, item[k[inside]])
    all_pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return n_words, first, np.cumsum(mark[:-1]) > 0, all_pairs


_KIND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.LongType()))])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64()))])


def runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of set flags, flat."""
    return np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))).tolist()


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, block_chars: int = BLOCK_CHARS, name: str = "contamination") -> DataFrame:
    """docs with a struct column `name`: n_words, n_hit, items (ids, sorted as strings), spans (hit runs of words).

    Null text has no words, very long texts are read whole; repeated rows are judged one by one, so ties don't arise;
    items with null text are left out, a null item id reads 'None', rows with one item id are one item; an empty benchmark
    hits nothing, empty documents give an empty table. Other columns pass through; one named like the new one is replaced.
    """
    items = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("words")).where(F.col("words").isNotNull())
    items = items.select(F.coalesce("id", F.lit("None")).alias("id"), "words")
    if (items.agg(F.sum(F.length("words"))).first()[0] or 0) > block_chars:
        return annotate_joined(docs, items, text, window, gram, name)
    shared = docs.sparkSession.sparkContext.broadcast(Index([(r.id, r.words) for r in items.toLocalIterator()], window, gram))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        index, column = shared.value, batch.column(batch.schema.names.index(text))
        out: list[dict] = []
        for _, _, data, offsets in common.text_blocks(column):
            n_words, first, hit, pairs = scan(data, offsets, index)
            cuts = np.searchsorted(pairs[:, 0], np.arange(n_words.size + 1))
            for d in range(n_words.size):
                found = sorted({x for i in pairs[cuts[d] : cuts[d + 1], 1] for x in index.ids[i]}) if cuts[d] < cuts[d + 1] else []
                own = hit[first[d] : first[d + 1]]
                out.append({"n_words": int(n_words[d]), "n_hit": int(own.sum()) if found else 0, "items": found, "spans": runs(own) if found else []})
        return [pa.array(out, _ARROW)]

    return common.append_columns(docs, [T.StructField(name, _KIND)], compute)


def _tagged(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of grams of n words, apart from those of other lengths."""
    return common.mix(h ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _keys(text: bytes | None, window: int, gram: int, lengths: list[int] | None) -> np.ndarray:
    """What a text and an item that hits it share. Of an item (lengths None): its fingerprints, or, if it is short, the
    hash of its words; of a document: its fingerprints, and the hashes of its grams of the lengths of short items."""
    data = common.LOWER[np.frombuffer(text or b"", np.uint8)]
    starts, ends, _ = common.word_spans(data, np.array([0, data.size]), common.ALNUM_BYTE)
    if not starts.size:
        return np.zeros(0, np.int64)
    words = common.span_hashes(data, starts, ends)
    own = [words.size] if lengths is None and words.size < window else lengths or []
    made = [_tagged(common.gram_hashes(words, n), n) for n in own]
    if lengths is not None or words.size >= window:
        made.append(winnow(words, np.zeros(words.size, np.int64), gram, window - gram + 1)[0])
    return np.unique(np.concatenate(made)).view(np.int64) if made else np.zeros(0, np.int64)


def _keyed(rows: DataFrame, window: int, gram: int, lengths: list[int] | None) -> DataFrame:
    """(key, at) of rows (at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                keys = _keys(text.as_buffer().to_pybytes() if text.is_valid else None, window, gram, lengths)
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(np.full(keys.size, i)))], names=["key", "at"])

    return rows.mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), rows.schema["at"]]))


def _windows(rows: DataFrame, window: int, gram: int, lengths: list[int] | None) -> DataFrame:
    """(at, start, words) of the windows of rows (at, text, keys), the words lower-cased and set apart by spaces. Of an item
    (lengths None) all of them; of a document those whose fingerprint is one of keys, and its grams of the lengths of short
    items whose hash is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, keys) in enumerate(zip(batch.column(1), batch.column(2))):
                data = common.LOWER[np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8)]
                starts, ends, _ = common.word_spans(data, np.array([0, data.size]), common.ALNUM_BYTE)
                own, words, made = np.asarray(keys.values) if lengths is not None else None, common.span_hashes(data, starts, ends) if starts.size else np.zeros(0, np.uint64), []
                for n in {window, *lengths} if lengths is not None else {min(window, starts.size)} - {0}:
                    if own is None:
                        at = np.arange(starts.size - n + 1)
                    elif n == window:
                        grams = common.gram_hashes(words, gram)
                        if grams.size < window - gram + 1:
                            continue
                        at = np.flatnonzero(np.isin(common.sliding(grams, window - gram + 1, np.minimum).view(np.int64), own))
                    else:
                        at = np.flatnonzero(np.isin(_tagged(common.gram_hashes(words, n), n).view(np.int64), own))
                    made += [(int(k), b" ".join(data[x:y].tobytes() for x, y in zip(starts[k : k + n], ends[k : k + n])).decode()) for k in at]
                if made:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(made), i))), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], names=["at", "start", "words"])

    return rows.select("at", "text", "keys").mapInArrow(run, T.StructType([rows.schema["at"], T.StructField("start", T.LongType()), T.StructField("words", T.StringType())]))


def annotate_joined(docs: DataFrame, items: DataFrame, text: str, window: int = WINDOW, gram: int = GRAM, name: str = "contamination") -> DataFrame:
    """As annotate, for items (id, words) of any number. A shuffled join tells which of a document's fingerprints some item
    has; windows of these alone are then joined, word by word, with the distinct windows of all items. Either join has one
    row a key on the items' side, so a gram of many documents and many items makes no pairs of them; only the items that
    are listed for a document are put beside it."""
    lengths = [r.n for r in items.select(F.regexp_count("words", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("n")).where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()]
    rows = common.identified(docs)
    sources = rows.select("at", F.col("row")[text].alias("text"))
    known = common.cut(items.distinct())
    fingerprints = _keyed(known.select("id", "words").toDF("at", "words"), window, gram, None).select("key").distinct()
    keys = _keyed(sources, window, gram, lengths).join(fingerprints, "key").groupBy("at").agg(F.collect_set("key").alias("keys"))
    found = common.cut(_windows(sources.join(keys, "at"), window, gram, lengths))
    items_windows = common.cut(_windows(known.select(F.col("id").alias("at"), F.col("words").alias("text"), F.lit(None).cast("array<long>").alias("keys")), window, gram, None).select(F.col("at").alias("id"), "words").distinct())
    hit = found.join(items_windows.select("words").distinct(), "words").groupBy("at").agg(F.collect_set(F.struct("start", (F.length("words") - F.length(F.replace("words", F.lit(" "))) + 1).cast("long").alias("n"))).alias("hits"))
    listed = found.select("at", "words").distinct().join(items_windows, "words").groupBy("at").agg(F.array_sort(F.collect_set("id")).alias("items"))
    joined = rows.join(hit, "at", "left").join(listed, "at", "left").select("row", "items", "hits")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text)
            out = []
            for document, items, hits in zip(pc.if_else(batch.column(0).is_valid(), texts, None), batch.column(1), batch.column(2)):
                data = common.LOWER[np.frombuffer(document.as_buffer(), np.uint8)] if document.is_valid else np.zeros(0, np.uint8)
                starts, _, _ = common.word_spans(data, np.array([0, data.size]), common.ALNUM_BYTE)
                own = np.zeros(starts.size, bool)
                for h in hits.as_py() or ():
                    own[h["start"] : h["start"] + h["n"]] = True
                out.append({"n_words": int(starts.size), "n_hit": int(own.sum()), "items": items.as_py() or [], "spans": runs(own)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ARROW)], names=["row", "hit"])

    made = joined.mapInArrow(settle, T.StructType([joined.schema["row"], T.StructField("hit", _KIND)]))
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != name.lower()], F.col("hit").alias(name))


def contaminated(n_hit, n_words, ratio: int = 20):
    """The contract's rule: some word is hit, and at least one in `ratio` words is."""
    return (n_hit > 0) & (ratio * n_hit >= n_words)


def items_digest(items):
    return F.sha2(F.array_join(items, ","), 256)


def remove_contaminated(docs: DataFrame, items: DataFrame, ratio: int = 20, **options) -> DataFrame:
    """docs without contaminated rows, with the columns of docs, whatever their names; other cases as in annotate."""
    name = common.free_name(docs.columns, "contamination")
    made = annotate(docs, items, name=name, **options)
    c = F.col(name)
    return made.where(~contaminated(c["n_hit"], c["n_words"], ratio)).drop(name)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = annotate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    c = F.col("contamination")
    return made.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), items_digest(c["items"]).alias("items_sha256"), contaminated(c["n_hit"], c["n_words"]).alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """The same result by comparing every window with every position; for tests."""
    import re

    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), s or ""))
    words, hit, ids = cut(text), set(), []
    for item_id, item in items:
        own = cut(item)
        n = min(window, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        at = [i for i in range(len(words) - n + 1) if n and tuple(words[i : i + n]) in grams]
        hit.update(j for i in at for j in range(i, i + n))
        ids += [str(item_id)] * bool(at)
    return len(words), len(hit), sorted(set(ids))


SQL = {
    "op1_decontamination": r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
dg AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
m AS (SELECT dg.doc_id, dg.i, dg.n, bw.item_id FROM dg JOIN bw ON bw.n = dg.n AND bw.g = dg.g),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
