"""BM25: an index on disk, both IDF variants, and scores of many queries at once, without a row per query and document.

An index has its postings twice. `blocks` holds them by ranges of documents (see blocks.py): a batch of queries is joined to
them by term and scored block by block, so that a task returns the k best of each query, or counts, and nothing is
shuffled by pairs. `lookup` holds them by hash of the term, each bucket in a folder of its own: a single search reads only
the buckets of its terms. Blocks are made where documents stand, without a shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier_tokens
from ..sources import store
from . import blocks as bk

K1, B = 1.5, 0.75
#: Up to so many weighted query terms (some 50 MB) are broadcast at once; more make another scan of the blocks.
BROADCAST_TERMS = 1_000_000


#: Buckets of the lookup table; a bucket's lists of up to so many blocks are written by one task.
BUCKETS, LOOKUP_BLOCKS = 32, 256


@dataclass
class Index:
    """blocks (see blocks.py), vocab(term, df, idf), n documents and their mean length; path: the folder of
    lookup(bucket, term, n, ids, tf, dl), if it was written."""

    blocks: DataFrame
    vocab: DataFrame
    n: int
    avgdl: float
    path: str | None = None
    stats: Stats | None = None
    method: str = "robertson"

    @cached_property
    def lookup(self) -> DataFrame | None:
        """Its folders are listed when it is first asked for, once for all searches."""
        return None if self.path is None else self.blocks.sparkSession.read.schema(LOOKUP).parquet(self.path)

    @staticmethod
    def load(spark, path: str, method: str = "robertson") -> Index:
        """"atire" (or "rank_bm25") puts a quarter of the mean raw IDF where the raw one is negative; any other method is
        Robertson's. Raises FileNotFoundError where no index was written."""
        if not store.finished(spark, f"{path}/stats"):
            raise FileNotFoundError(f"no index in {path}: write one first")
        stats = Stats(*spark.read.parquet(f"{path}/stats").select("n", "avgdl", "mean_raw").first())
        vocab = spark.read.parquet(f"{path}/vocab").select("term", "df").withColumn("idf", idf(stats, method))
        lookup = f"{path}/lookup" if store.finished(spark, f"{path}/lookup") else None
        return Index(spark.read.schema(bk.SCHEMA).parquet(f"{path}/blocks"), vocab, stats.n, stats.avgdl, lookup, stats, method)

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, dl), a row each."""
        lists = lookup_rows(self.blocks).select("term", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p"))
        return lists.select("term", F.col("p.ids").alias("doc_id"), F.col("p.tf").cast("long").alias("tf"), F.col("p.dl").cast("long").alias("dl"))


LOOKUP = "bucket int, term string, n int, ids array<long>, tf array<int>, dl array<int>"


class Stats(NamedTuple):
    n: int
    avgdl: float
    mean_raw: float | None


def idf(stats: Stats, method: str) -> Column:
    """The IDF of a column df."""
    n, df = F.lit(stats.n), F.col("df")
    if method not in ("atire", "rank_bm25"):
        return robertson(n, df)
    return F.when(raw_idf(n, df) < 0, F.lit(0.25 * (stats.mean_raw or 0.0))).otherwise(raw_idf(n, df))


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer=identifier_tokens) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), tokenizer(F.col(text)).alias("tokens"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    return tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("avgdl"))


def term_freq(tokens: DataFrame) -> DataFrame:
    """(doc_id, term, tf, dl) of documents (doc_id, tokens), a row each: nothing is shuffled, as a document's sorted tokens
    hold all that its counts need."""
    ordered = tokens.select("doc_id", F.sort_array("tokens").alias("s"))
    n = F.size("s")
    # where a run of equal tokens begins, and behind the last one
    starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get("s", i) != F.get("s", i - 1)))
    cut = ordered.select("doc_id", "s", F.when(n > 0, starts).otherwise(F.array().cast("array<int>")).alias("at"))
    runs = F.transform(F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))), lambda a, k: F.struct(F.get("s", a).alias("term"), (F.get("at", k + 1) - a).cast("long").alias("tf")))
    # an outer explode: Spark would filter on the array before it, and make it twice
    made = cut.select("doc_id", F.size("s").cast("long").alias("dl"), F.explode_outer(runs).alias("r"))
    return made.where("r is not null").select("doc_id", "r.term", "r.tf", "dl")


def robertson(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def raw_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def block_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer=identifier_tokens) -> DataFrame:
    """The rows of blocks of docs, whose ids are numbers."""
    return tokenized(docs, doc_id, text, tokenizer).select(F.col("doc_id").cast("long"), "tokens").mapInArrow(bk.cut, bk.SCHEMA)


def write_blocks(rows: DataFrame, path: str) -> None:
    rows.write.option("parquet.block.size", bk.ROW_GROUP_BYTES).parquet(path)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def full_lists(blocks: DataFrame) -> DataFrame:
    """blocks with empty lists for null ones: an Arrow writer goes over all null lists before a row again to tell the size of its
    batch, and all but the first row of a block have no documents."""
    return blocks.withColumns({c: F.coalesce(c, F.array().cast(blocks.schema[c].dataType)) for c in ("at", "tf", "ids", "dl")})


def lookup_rows(blocks: DataFrame) -> DataFrame:
    """(bucket, term, n, ids, tf, dl, range) of blocks: each list with the ids and lengths of its documents; range tells
    blocks apart, for dealing them out."""

    def resolve(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        number, ids, dl = TaskContext.get().partitionId() << 20, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.names.index(name))
            starts = np.flatnonzero(np.asarray(pc.list_value_length(column("ids")))).tolist()
            for low, high in zip([0, *starts], [*starts, batch.num_rows]):
                if low in starts and high > low:
                    number += 1
                    ids, dl = (np.asarray(column(c).slice(low, 1).flatten()).astype(np.int64) for c in ("ids", "dl"))
                    low += 1
                if high <= low:
                    continue
                at = column("at").slice(low, high - low)
                sizes = pa.array(np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(at)))]).astype(np.int32))
                place = np.asarray(at.flatten())
                lists = [pa.ListArray.from_arrays(sizes, x) for x in (pa.array(ids[place]), column("tf").slice(low, high - low).flatten(), pa.array(dl[place], pa.int32()))]
                yield pa.RecordBatch.from_arrays([column("term").slice(low, high - low), column("n").slice(low, high - low), *lists, pa.array(np.full(high - low, number))], names=["term", "n", "ids", "tf", "dl", "range"])

    made = full_lists(blocks).select("term", "n", "at", "tf", "ids", "dl").mapInArrow(resolve, "term string, n int, ids array<long>, tf array<int>, dl array<int>, range long")
    return made.select(bucket(F.col("term")).alias("bucket"), "term", "n", "ids", "tf", "dl", "range")


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer=identifier_tokens, lookup: bool = True) -> None:
    """Writes the index of docs to a folder, with or without the lookup table for single searches; an empty corpus gives an
    empty index."""
    spark = docs.sparkSession
    docs = docs.select(doc_id, text)
    write_blocks(block_rows(store.spread(docs), doc_id, text, tokenizer), f"{path}/blocks")
    blocks = spark.read.schema(bk.SCHEMA).parquet(f"{path}/blocks")
    if lookup:
        write_lookup(blocks, f"{path}/lookup")
    write_vocab(blocks, path)


def write_lookup(blocks: DataFrame, path: str) -> None:
    # lists of a bucket are dealt to tasks by their blocks, so that a term of every document is written by many
    shares = blocks.where("term = ''").count() // LOOKUP_BLOCKS + 1
    rows = lookup_rows(blocks).repartition("bucket", F.pmod(F.xxhash64("range"), F.lit(shares))).sortWithinPartitions("bucket", "term").drop("range")
    rows.write.partitionBy("bucket").option("parquet.block.size", 4 << 20).parquet(path)


def write_vocab(blocks: DataFrame, path: str) -> None:
    """The terms of blocks with their frequencies, and what IDF and weights need of all documents."""
    spark = blocks.sparkSession
    blocks.where("term != ''").groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")).write.parquet(f"{path}/vocab")
    n = blocks.where("term = ''").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    sums = spark.read.parquet(f"{path}/vocab").agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("all"), F.round(F.avg(raw_idf(F.lit(n), F.col("df"))), 9).alias("mean_raw"))
    avgdl = F.coalesce(F.col("all") / F.nullif(F.lit(n), F.lit(0)), F.lit(0.0))
    sums.select(F.lit(n).cast("long").alias("n"), avgdl.alias("avgdl"), "mean_raw").coalesce(1).write.parquet(f"{path}/stats")


def build(docs: DataFrame, method: str = "robertson", doc_id: str = "doc_id", text: str = "text", tokenizer=identifier_tokens) -> Index:
    """An index of its own, in the shared folder."""
    spark = docs.sparkSession
    path = f"{store.shared_folder(spark)}/index-{uuid.uuid4().hex}"
    write(docs, path, doc_id, text, tokenizer)
    return Index.load(spark, path, method)


def weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, tokens)."""
    exploded = queries.select("query_id", F.explode_outer("tokens").alias("term")).where("term is not null")
    return exploded.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def weighted_terms(queries: DataFrame, index: Index) -> DataFrame:
    """(term, query_id, qw) of queries (query_id, tokens): what each term weighs in its query; run once."""
    met = query_terms(queries).join(index.vocab.select("term", "idf"), "term")
    return store.cut(met.select("term", "query_id", (F.col("qtf") * F.col("idf")).alias("qw")))


def _asked(weighted: DataFrame, marks: DataFrame | None) -> list[DataFrame]:
    """(term, asked) of weighted terms and marks (query_id, mark, target), in groups of queries of a bounded size, each of
    which can be broadcast; the empty term, of which a block's documents are the row, is always asked for."""
    spark = weighted.sparkSession
    groups = max(1, -(-weighted.count() // BROADCAST_TERMS))
    entry = lambda value, target: F.struct(F.col("query_id").cast("long").alias("query_id"), value.cast("double").alias("value"), target.cast("long").alias("target"))
    rows = weighted.select("query_id", "term", entry(F.col("qw"), F.lit(None)).alias("e"))
    if marks is not None:
        rows = rows.unionByName(marks.select("query_id", F.lit("").alias("term"), entry(F.col("mark"), F.col("target")).alias("e")))
    none = spark.range(1).select(F.lit("").alias("term"), F.lit(None).cast(rows.schema["e"].dataType).alias("e"))
    parts = [rows.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g) if groups > 1 else rows for g in range(groups)]
    # no list is longer than its group, which is bounded
    return [p.select("term", "e").unionByName(none).groupBy("term").agg(F.collect_list("e").alias("asked")) for p in parts]


def walked(weighted: DataFrame, index: Index, kind, schema: str, marks: DataFrame | None = None, k1: float = K1, b: float = B, tasks: int | None = None) -> DataFrame:
    """What kind() makes of all blocks of the index, for all queries: a scan of the blocks per bounded group of queries, by up to
    so many tasks."""
    blocks = full_lists(index.blocks) if tasks is None else full_lists(index.blocks).coalesce(tasks)
    out = None
    for asked in _asked(weighted, marks):
        met = blocks.select("term", "max_tf", "min_dl", "at", "tf", "ids", "dl").join(F.broadcast(asked), "term")
        part = met.mapInArrow(bk.walk(kind, index.avgdl, k1, b), schema)
        out = part if out is None else out.unionAll(part)
    return out


def scores(queries: DataFrame | None, index: Index, k1: float = K1, b: float = B, weighted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with queries (query_id, tokens), or with weighted terms
    made of them. Repeated query terms add again; scores are rounded to 6 places, so that equal documents tie."""
    return walked(weighted_terms(queries, index) if weighted is None else weighted, index, bk.Every, bk.PAIRS, None, k1, b)


def best(queries: DataFrame | None, index: Index, k: int, k1: float = K1, b: float = B, weighted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): top_k(scores(...), k), of which no task makes more than its own k best."""
    weighted = weighted_terms(queries, index) if weighted is None else weighted
    # the k best of a task's first blocks spare it work in the others, and each task returns k rows: few tasks, whatever the size
    tasks = 2 * index.blocks.sparkSession.sparkContext.defaultParallelism
    return top_k(walked(weighted, index, lambda: bk.Best(k), bk.PAIRS, None, k1, b, tasks), k)


def pair_scores(weighted: DataFrame, index: Index, pairs: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """The scores of given pairs (query_id, doc_id), one a query, alone."""
    marks = pairs.select("query_id", F.lit(None).alias("mark"), F.col("doc_id").alias("target"))
    return walked(weighted, index, bk.Marked, bk.PAIRS, marks, k1, b)


def own_scores(weighted: DataFrame, index: Index, tokens: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, doc_id, score) of documents (doc_id, tokens) of the index, each for the query of its own id: pair_scores() without
    a scan of the index, where the documents are at hand."""
    met = term_freq(tokens).withColumn("query_id", F.col("doc_id")).join(weighted, ["query_id", "term"])
    part = F.col("qw") * weight(F.col("tf"), F.col("dl"), F.lit(index.avgdl), k1, b)
    return met.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def counts(weighted: DataFrame, index: Index, own: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, greater, equal, positive): how many of a query's scores are above own (query_id, score), equal to it, and
    above 0; null scores count nothing above or equal."""
    marks = own.select("query_id", F.coalesce("score", F.lit(float("nan"))).alias("mark"), F.lit(None).alias("target"))
    made = walked(weighted, index, bk.Counts, bk.COUNTS, marks, k1, b)
    return made.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("greater", "equal", "positive")])


def above(weighted: DataFrame, index: Index, own: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, greater, equal) as counts() has them, of queries with a score alone: only documents that may reach it are
    scored."""
    marks = own.where("score is not null").select("query_id", F.col("score").alias("mark"), F.lit(None).alias("target"))
    made = walked(weighted.join(marks.select("query_id"), "query_id", "left_semi"), index, bk.Above, bk.ABOVE, marks, k1, b)
    return made.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("greater", "equal")])


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties by doc_id, ranked from 1."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _summed(lists: DataFrame, index: Index, k1: float, b: float) -> DataFrame:
    """Scores of the lists (query_id, qw, ids, tf, dl) of few queries: one row per document met."""
    each = lists.select("query_id", "qw", F.explode(F.arrays_zip("ids", "tf", "dl")).alias("p"))
    part = F.col("qw") * weight(F.col("p.tf"), F.col("p.dl"), F.lit(index.avgdl), k1, b)
    return each.groupBy("query_id", F.col("p.ids").alias("doc_id")).agg(F.round(F.sum(part), 6).alias("score"))


def search(text: str, index: Index, k: int = 10, tokenizer=identifier_tokens, k1: float = K1, b: float = B) -> DataFrame:
    """Top k of one query string, from the buckets of its terms alone: one small job finds the terms' frequencies, the
    result is another."""
    spark = index.blocks.sparkSession
    one = spark.range(1).select(F.col("id").alias("query_id"), tokenizer(F.lit(text)).alias("tokens"))
    if index.lookup is None:
        return best(one, index, k, k1, b)
    terms = query_terms(one).select("term", "qtf", bucket(F.col("term")).alias("bucket")).collect()
    met = index.lookup.where(F.col("bucket").isin(sorted({r.bucket for r in terms})) & F.col("term").isin([r.term for r in terms]))
    df = {r.term: r.df for r in met.groupBy("term").agg(F.sum("n").alias("df")).collect()}
    weights = spark.createDataFrame([(r.term, r.qtf, df[r.term]) for r in terms if r.term in df], "term string, qtf long, df long")
    weights = weights.select("term", (F.col("qtf") * idf(index.stats, index.method)).alias("qw"))
    lists = met.select("term", "ids", "tf", "dl").join(F.broadcast(weights), "term").withColumn("query_id", F.lit(0).cast("long"))
    found = _summed(lists, index, k1, b).orderBy(F.desc("score"), "doc_id").limit(k)
    return top_k(found, k)


def lookups(queries: DataFrame, index: Index, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """Top k of a few short queries (query_id, tokens), from the lookup table: which buckets are read follows the terms, at run
    time. For many queries best() makes fewer rows."""
    wanted = weighted_terms(queries, index).withColumn("bucket", bucket(F.col("term")))
    return top_k(_summed(index.lookup.join(F.broadcast(wanted), ["bucket", "term"]), index, k1, b), k)


def prune_terms(queries: DataFrame, vocab: DataFrame, least_idf: float = 1.0, most: int = 8) -> DataFrame:
    """(query_id, term, idf, place) of each query's rarest terms with an IDF of at least least_idf."""
    terms = query_terms(queries).select("query_id", "term").join(vocab.select("term", "idf"), "term")
    rarest = Window.partitionBy("query_id").orderBy(F.desc(F.round("idf", 9)), "term")
    return terms.where(F.col("idf") >= least_idf).withColumn("place", F.row_number().over(rarest).cast("long")).where(F.col("place") <= most)
