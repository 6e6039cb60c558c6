"""Language-model scores: subword lattices over an existing vocabulary, learned word counts, a hidden class per text.

A text's classes are the commonest languages of the texts learned from, and one for all others. Given a class, words are
drawn one by one, an end last. A word's lattice has an arc for each vocabulary piece that stands in it (see lattice.py),
and one for the whole word, weighed by its count; the score of a text is the logarithm of its probability, summed over all
segmentations of all words and over the classes. Piece weights begin with the vocabulary's scores and are adapted to the
counted words by expectation maximisation over the lattices; the pieces stay as they are.

Words are counted where texts stand and shuffled as counts. To score, the commonest words are shipped to all tasks (their
number is bounded), so that only other words are joined with their counts.

Defined results: a null text is an empty one, whose only token is the end. Rows are scored one by one, so repeated rows,
ties and null ids (which may be learned from) need no care; texts of any length are read in blocks; without rows to learn
from all counts are 0 and only the vocabulary's scores count; an empty table gives an empty result; of other columns only
the language is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, lattice

#: A public SentencePiece model; read by the driver alone.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: So many of the commonest words, at most, are shipped to all tasks (some 30 MB).
SHIPPED_WORDS = 300_000
#: The commonest languages make classes of their own.
MAX_CLASSES = 8
#: Rounds of expectation maximisation, and how many pieces the vocabulary's own scores count as in it.
ROUNDS = 2
PRIOR_PIECES = 1000.0
#: Bytes of text whose words are counted together.
COUNT_BYTES = 1 << 22
#: Words whose lattices are built together.
LATTICE_WORDS = 4096
#: Natural logarithms of a text's words are added up in millionths, so that no order of adding matters.
UNIT = 1_000_000


def held_out(id_column: str) -> Column:
    """True for rows that aren't learned from: crc32(id as text) mod 7 is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def vocabulary(path: str = VOCABULARY, scores: str = "rank") -> lattice.Pieces:
    """The lower-case pieces of a SentencePiece model. Scores are natural logarithms ("log"), or, as in a BPE model, minus the
    rank ("rank"), which weighs a piece by 1 / (1 + rank). Bytes weigh as much as the rarest piece, the end as 1 in 20."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(model.get_piece_size()):
        piece, score = model.id_to_piece(i), model.get_score(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) or score < -1e8:
            continue
        if piece == "".join(c.lower() if "A" <= c <= "Z" else c for c in piece):
            pieces.append(piece.encode())
            weights.append(np.exp(score) if scores == "log" else 1 / (1 - min(0.0, score)))
    weight = np.array([min(weights)] * (lattice.BYTES + 1) + weights)
    weight[lattice.BYTES] = (weight.sum() - weight[lattice.BYTES]) / 19
    return lattice.trie(pieces, np.log(weight / weight.sum()))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of a block, and the document of each."""
    low = common.LOWER[data]
    starts, ends, first = common.word_spans(low, offsets, common.NONSPACE_BYTE)
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    made = pa.LargeStringArray.from_buffers(starts.size, pa.py_buffer(at.tobytes()), pa.py_buffer(low[common.NONSPACE_BYTE[low]].tobytes()))
    return made, np.repeat(np.arange(offsets.size - 1), np.diff(first))


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of words with the begin mark before each."""
    marked = pc.binary_join_element_wise(pa.scalar(lattice.BEGIN, pa.large_binary()), words.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(marked.buffers()[1], np.int64, len(marked) + 1, marked.offset * 8)
    data = np.frombuffer(marked.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(marked) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def marginals(pieces: lattice.Pieces, words: pa.Array) -> np.ndarray:
    """Natural logarithm of each word's probability over its segmentations into pieces."""
    out = np.empty(len(words))
    for low in range(0, len(words), LATTICE_WORDS):
        data, offsets = _bytes(words.slice(low, LATTICE_WORDS))
        out[low : low + offsets.size - 1] = lattice.forward(pieces, data, offsets)[0]
    return out


@dataclass
class Model:
    """words: a folder of Parquet (word, c, cs: counts by class). n: tokens learned from; v: distinct ones; ends: texts by
    class; tokens and types: by class."""

    words: str
    pieces: lattice.Pieces
    classes: list[str]
    n: int
    v: int
    ends: np.ndarray
    tokens: np.ndarray
    types: np.ndarray

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def logs(self, c: np.ndarray, cs: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """Natural logarithms, in millionths, of words' probabilities by class (a row a word): counts of the class, backed off
        to all counts, backed off to the lattice of pieces, each as far as new words were met there (Witten-Bell)."""
        t, types = max(1, self.v), np.maximum(1, self.types)
        log_all = np.logaddexp(np.log(np.maximum(c, 1e-300)), np.log(t) + sub) - np.log(self.n + t)
        mixed = np.logaddexp(np.log(np.maximum(cs, 1e-300)), np.log(types) + log_all[:, None]) - np.log(self.tokens + types)
        return np.rint(mixed * UNIT).astype(np.int64)


def _class_of(classes: list[str]) -> Column:
    """A column lang as the number of its class; the last class has all others and null."""
    place = F.array_position(F.array(*[F.lit(x) for x in classes]), F.col("lang")) - 1 if classes else F.lit(None).cast("long")
    return F.coalesce(F.when(place >= 0, place), F.lit(len(classes)).cast("long")).cast("int")


def fit(docs: DataFrame, folder: str, path: str = VOCABULARY, scores: str = "rank", rounds: int = ROUNDS) -> Model:
    """Learns from all rows of docs (text, lang); counted words go to `folder`."""
    spark = docs.sparkSession
    by_lang = docs.where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))
    classes = [r.lang for r in by_lang.orderBy(F.desc("n"), "lang").limit(MAX_CLASSES).collect()]
    k = len(classes) + 1
    ends = np.zeros(k, np.int64)
    for r in docs.groupBy(_class_of(classes).alias("k")).agg(F.count("*").alias("n")).collect():
        ends[r.k] = r.n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(1)).astype(np.int64)
            for first, last, data, offsets in common.text_blocks(batch.column(0), COUNT_BYTES):
                words, doc = words_of(data, offsets)
                coded = words.dictionary_encode()
                key, n = np.unique(np.asarray(coded.indices).astype(np.int64) * k + own[first:last][doc], return_counts=True)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key // k)).cast(pa.string()), pa.array((key % k).astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "k", "n"])

    counted = docs.select("text", _class_of(classes).alias("k")).mapInArrow(count, "word string, k int, n long")
    sums = counted.groupBy("word").agg(F.sum("n").alias("c"), *[F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(k)])
    sums.select("word", "c", F.array(*[f"c{i}" for i in range(k)]).alias("cs")).write.parquet(folder)
    words = spark.read.parquet(folder)
    per = [f(F.get("cs", F.lit(i))) for i in range(k) for f in (F.sum, lambda x: F.sum((x > 0).cast("long")))]
    total = words.agg(F.sum("c"), F.count("*"), *per).first()
    found = np.array([x or 0 for x in total], np.int64)
    pieces = vocabulary(path, scores)
    n_ends = int(ends.sum())
    for _ in range(rounds if found[1] else 0):
        pieces = adapted(words, pieces, n_ends)
    return Model(folder, pieces, classes, int(found[0]) + n_ends, int(found[1]) + (n_ends > 0), ends, found[2::2] + ends, found[3::2] + (ends > 0))


def adapted(words: DataFrame, pieces: lattice.Pieces, n_ends: int) -> lattice.Pieces:
    """One round of expectation maximisation over counted words (word, c). Tasks return a number per piece at most."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.weight.size)
        for batch in batches:
            c = np.asarray(batch.column(1)).astype(np.float64)
            for low in range(0, len(c), LATTICE_WORDS):
                data, offsets = _bytes(batch.column(0).slice(low, LATTICE_WORDS))
                total += lattice.expected(shared.value, data, offsets, c[low : low + LATTICE_WORDS])[0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "n"])

    total = np.zeros(pieces.weight.size)
    for r in words.select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        total[r.piece] = r.n
    total[lattice.BYTES] = n_ends
    total += PRIOR_PIECES * np.exp(pieces.weight)
    # rounded, since sums of tasks differ in their last digits from run to run
    return lattice.Pieces(pieces.edge, pieces.child, pieces.ends, np.round(np.log(total / total.sum()), 9))


def commonest(words: DataFrame, most: int = SHIPPED_WORDS) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words, counts and counts by class of the commonest words: all from a count on that at most `most` words reach."""
    step = F.floor(F.log2("c") * 8)
    known, least = 0, None
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():
        known += r.n
        if known > most:
            break
        least = r.c
    table = words.where(F.col("c") >= least).orderBy("word").toArrow() if least is not None else None
    if table is None or not table.num_rows:
        return pa.array([], pa.large_string()), np.zeros(0), np.zeros((0, 1))
    table = table.combine_chunks()
    return table["word"].combine_chunks().cast(pa.large_string()), np.asarray(table["c"], np.float64), np.asarray(pc.list_flatten(table["cs"]), np.float64).reshape(table.num_rows, -1)


def score(docs: DataFrame, model: Model, folder: str) -> DataFrame:
    """(doc_id, flag, n_tokens, n_known, base_score, score) of docs (doc_id, flag, text), a row for each; `folder` gets what
    is looked up."""
    spark = docs.sparkSession
    k = model.ends.size
    names = [f"s{i}" for i in range(k)]
    sums = ", ".join(f"{n} long" for n in names)
    top, c, cs = commonest(spark.read.parquet(model.words))
    logs = model.logs(c, cs, marginals(model.pieces, top)) if len(top) else np.zeros((0, k), np.int64)
    shared = spark.sparkContext.broadcast((model, top, model.base(c), logs))
    n_ends = float(model.ends.sum())
    end_base = float(model.base(np.array(n_ends)))
    end_logs = model.logs(np.array([n_ends]), model.ends[None, :].astype(float), model.pieces.weight[[lattice.BYTES]])[0]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, top, base, logs = shared.value
        for batch in batches:
            for first, last, data, offsets in common.text_blocks(batch.column(3), COUNT_BYTES):
                words, doc = words_of(data, offsets)
                coded = words.dictionary_encode()
                known = pc.fill_null(pc.index_in(coded.dictionary, top), -1) if len(top) else pa.array(np.full(len(coded.dictionary), -1))
                code = np.asarray(coded.indices).astype(np.int64)
                place = np.asarray(known).astype(np.int64)[code]
                met = place >= 0
                n = last - first
                made = [np.bincount(doc, minlength=n) + 1, np.bincount(doc[met], minlength=n) + (n_ends > 0)]
                made += [np.bincount(doc[met], base[place[met]], n) + end_base]
                # exact: below 2^53 millionths
                made += [np.bincount(doc[met], logs[place[met], i], n).astype(np.int64) + end_logs[i] for i in range(k)]
                rid, ids, flag = (batch.column(i).slice(first, n) for i in range(3))
                none = pa.nulls(n, pa.string())
                yield pa.RecordBatch.from_arrays([rid, ids, flag, none, *map(pa.array, made)], names=given)
                pair, times = np.unique(doc[~met] * len(coded.dictionary) + code[~met], return_counts=True)
                if pair.size:
                    at = pa.array(pair // len(coded.dictionary))
                    rest = coded.dictionary.take(pa.array(pair % len(coded.dictionary))).cast(pa.string())
                    empty = [pa.nulls(pair.size, t) for t in (pa.int64(), pa.float64(), *[pa.int64()] * k)]
                    yield pa.RecordBatch.from_arrays([rid.take(at), pa.nulls(pair.size, ids.type), pa.nulls(pair.size, pa.bool_()), rest, pa.array(times.astype(np.int64)), *empty], names=given)

    given = ["rid", "doc_id", "flag", "word", "n", "n_known", "base", *names]
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "flag", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered.mapInArrow(look_up, f"rid long, doc_id {kind}, flag boolean, word string, n long, n_known long, base double, {sums}").write.parquet(folder)
    made = spark.read.parquet(folder)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value[0]
        for batch in batches:
            coded = batch.column(1).cast(pa.large_string()).dictionary_encode()
            sub = marginals(model.pieces, coded.dictionary)[np.asarray(coded.indices)] if batch.num_rows else np.zeros(0)
            n, c = np.asarray(batch.column(2)), np.asarray(pc.fill_null(batch.column(3), 0)).astype(np.float64)
            counts = batch.column(4)
            cs = np.zeros((batch.num_rows, k))
            cs[np.asarray(counts.is_valid())] = np.asarray(counts.flatten()).reshape(-1, k)
            logs = model.logs(c, cs, sub) * n[:, None]
            own = [pa.array(np.where(c > 0, n, 0)), pa.array(model.base(c) * n), *(pa.array(logs[:, i]) for i in range(k))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own], names=["rid", "n_known", "base", *names])

    rest = made.where("word is not null").select("rid", "word", "n").join(spark.read.parquet(model.words), "word", "left")
    rest = rest.select("rid", "word", "n", "c", "cs").mapInArrow(add, f"rid long, n_known long, base double, {sums}")
    whole = made.where("word is null").drop("word").unionByName(rest, allowMissingColumns=True)
    summed = whole.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("flag").alias("flag"), F.max("n").alias("n_tokens"), *[F.sum(x).alias(x) for x in ("n_known", "base", *names)])
    share = np.log(np.maximum(model.ends, 1e-300) / max(1, model.ends.sum())) if model.ends.sum() else np.zeros(k) - np.log(k)
    parts = F.array(*[F.col(n) / UNIT + F.lit(float(p)) for n, p in zip(names, share)])
    most = F.array_max(parts)
    total = most + F.log(F.aggregate(F.transform(parts, lambda x: F.exp(x - most)), F.lit(0.0), lambda a, x: a + x))
    return summed.select("doc_id", "flag", "n_tokens", "n_known", F.round("base", 10).alias("base_score"), (total / float(np.log(10))).alias("score"))


def op12_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out("doc_id").alias("flag"))
    with common.scratch(spark) as folder:
        model = fit(docs.where(~F.col("flag")), f"{folder}/words")
        made = score(docs.select("doc_id", "flag", "text"), model, f"{folder}/looked_up")
        columns = made.select("doc_id", F.col("flag").alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
        return common.cut(columns)
