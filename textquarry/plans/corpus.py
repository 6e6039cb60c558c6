"""Scans, cleaning, deduplication and length statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bm25, dedup, ranking
from ..sources import io, store
from .base import BENCH, METRICS, PAIRED, SHINGLES, STOP, TOK, WS, bench_queries, docs, index, index_sql, paired_ranks, paired_sql, ranks_sql, scores_sql, table

Q: dict = {}
JUNK = ("todo", "none", "pass", "fixme")


def words(c: str = "text"):
    return F.size(tx.space_words(F.col(c)))


Q["scan_documents"] = (
    lambda s, d: table(s, d, "documents").select("doc_id", "lang", "source", "n_chars", F.length("text").cast("long").alias("len")),
    "SELECT doc_id, lang, source, n_chars, length(text)::BIGINT AS len FROM documents")
Q["scan_pruned"] = (lambda s, d: table(s, d, "documents").select("doc_id", "source"), "SELECT doc_id, source FROM documents")
Q["union_sources"] = (
    lambda s, d: docs(s, d).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest")).unionByName(table(s, d, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"))),
    "SELECT 'documents' AS origin, doc_id AS id, md5(text) AS digest FROM documents UNION ALL SELECT 'benchmark', item_id, md5(text) FROM benchmark",
)
_pieces = ", ',', ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))
Q["table_digest"] = (lambda s, d: io.table_digest(docs(s, d)), f"""SELECT count(*) AS n, sha256(concat({_pieces})) AS digest
FROM (SELECT sha256(coalesce('v' || doc_id::VARCHAR, 'n') || '|' || coalesce('v' || text, 'n')) AS h FROM documents)""")
BOILERPLATE = ("blog.", ".html")


def excluding(column: str, parts: tuple[str, ...]):
    """True for rows whose column has none of the parts in any case; a null column is kept."""
    found = F.lit(False)
    for part in parts:
        found = found | F.lower(F.col(column)).contains(part)
    return ~F.coalesce(found, F.lit(False))


Q["filter_boilerplate"] = (
    lambda s, d: table(s, d, "pages").where(excluding("url", BOILERPLATE)).select("page_id", "url"),
    "SELECT page_id, url FROM pages WHERE NOT coalesce(contains(lower(url), 'blog.') OR contains(lower(url), '.html'), false)",
)
Q["project_if_exists"] = (
    lambda s, d: io.project(table(s, d, "documents"), ["doc_id", "func_name", "lang", "path"]),
    "SELECT doc_id, lang FROM documents",
)
Q["filter_min_words"] = (
    lambda s, d: docs(s, d).where((words() >= 3) & ~F.lower(F.trim("text")).isin(*JUNK)).select("doc_id", words().cast("long").alias("n_words")),
    f"""SELECT doc_id, len({WS('text')})::BIGINT AS n_words
FROM documents WHERE len({WS('text')}) >= 3 AND lower(trim(text)) NOT IN ('todo', 'none', 'pass', 'fixme')""")
Q["filter_len_band"] = (
    lambda s, d: docs(s, d).where(words().between(10, 2048)).select("doc_id"),
    f"SELECT doc_id FROM documents WHERE len({WS('text')}) BETWEEN 10 AND 2048")


def reason():
    """The first filter that a row fails; null if none. First copies are told by a window over the survivors' texts."""
    return F.when(F.col("text").isNull(), "null").when(words() < 10, "short").when(words() > 2048, "long").when(F.lower("source").contains("src1"), "source")


def _reasoned(s, d):
    return table(s, d, "documents").select("doc_id", "text", "source", "lang", reason().alias("reason"))


_REASON = f"""CASE WHEN text IS NULL THEN 'null' WHEN len({WS('text')}) < 10 THEN 'short' WHEN len({WS('text')}) > 2048
THEN 'long' WHEN lower(source) LIKE '%src1%' THEN 'source' END"""


def clean_pipeline(s, d):
    kept = dedup.keep_first(_reasoned(s, d).where("reason is null").withColumnRenamed("text", "code"), "code")
    return kept.select("doc_id", F.md5(F.col("code").cast("binary")).alias("digest"), "source")


def drop_stats(s, d):
    r = _reasoned(s, d).withColumn("copy", F.row_number().over(Window.partitionBy("reason", "text").orderBy("doc_id")))
    why = F.when(F.col("reason").isNull() & (F.col("copy") > 1), "duplicate").otherwise(F.coalesce("reason", F.lit("kept")))
    return r.groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


_COPY = f"""(SELECT doc_id, source, text, reason, row_number() OVER (PARTITION BY reason, text ORDER BY doc_id) AS c
FROM (SELECT doc_id, source, text, {_REASON} AS reason FROM documents))"""
Q["clean_pipeline"] = (clean_pipeline, f"SELECT doc_id, md5(text) AS digest, source FROM {_COPY} WHERE reason IS NULL AND c = 1")
Q["drop_stats"] = (drop_stats, f"""SELECT CASE WHEN reason IS NULL AND c > 1 THEN 'duplicate'
ELSE coalesce(reason, 'kept') END AS reason, count(*) AS n FROM {_COPY} GROUP BY 1""")
Q["exact_dedup"] = (lambda s, d: dedup.keep_first(docs(s, d)).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")


def _split(s, d):
    return docs(s, d).withColumn("split", dedup.split_name(F.col("doc_id")))


Q["exact_cross_dedup"] = (
    lambda s, d: dedup.purge(_split(s, d).where("split = 'test'"), _split(s, d).where("split = 'train'")).select("doc_id"),
    """SELECT doc_id
FROM documents t WHERE doc_id % 10 = 9 AND NOT EXISTS (SELECT 1 FROM documents r WHERE r.doc_id % 10 < 8 AND r.text = t.text)""")
Q["cross_split_purge"] = (
    lambda s, d: dedup.cross_split_purge(_split(s, d)).select("doc_id", "split"),
    """WITH tr AS (SELECT doc_id, text FROM documents WHERE doc_id % 10 < 8), te AS (SELECT doc_id, text FROM documents t
WHERE doc_id % 10 = 9 AND text NOT IN (SELECT text FROM tr)) SELECT doc_id, 'train' AS split FROM tr UNION ALL
SELECT doc_id, 'test' FROM te UNION ALL SELECT doc_id, 'val' FROM documents WHERE doc_id % 10 = 8
AND text NOT IN (SELECT text FROM tr) AND text NOT IN (SELECT text FROM te)""",
)
Q["join_dedup_build"] = (
    lambda s, d: table(s, d, "documents").select("doc_id", "text", "lang").join(dedup.keep_first(table(s, d, "documents").select("doc_id", "text", "lang").withColumn("key", F.concat_ws("|", "lang", "text")), "key").select("text", "lang", F.col("doc_id").alias("first_id")), ["text", "lang"]).select("doc_id", "first_id"),
    "SELECT doc_id, first_id FROM documents JOIN (SELECT text, lang, min(doc_id) AS first_id FROM documents GROUP BY text, lang) USING (text, lang)",
)
Q["kept_vs_dropped"] = (
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select(F.lit("kept").alias("side"), "n_chars").unionByName(table(s, d, "documents").join(table(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_anti").select(F.lit("dropped").alias("side"), "n_chars")).groupBy("side").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars")),
    """SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'kept'
ELSE 'dropped' END AS side, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY 1""",
)
Q["duplicate_stats"] = (
    lambda s, d: docs(s, d).agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct"), F.round(100.0 * (F.count("*") - F.countDistinct("text")) / F.count("*"), 6).alias("duplicate_pct")),
    """SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, round(100.0::DOUBLE * (count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_pct
FROM documents""")
Q["top_sources"] = (
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10),
    "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
_P = (10, 25, 50, 75, 90, 95, 99)


def length_distribution(s, d):
    n = docs(s, d).select(words().cast("double").alias("n"))
    cuts = n.agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("std"), F.min("n").alias("least"), F.max("n").alias("most"), F.percentile("n", F.array(*[F.lit(p / 100) for p in _P])).alias("p"))
    return cuts.select("mean", "std", "least", "most", *[F.round(F.col("p")[i], 6).alias(f"p{p}") for i, p in enumerate(_P)])


Q["length_distribution"] = (length_distribution, "SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n) AS least, max(n) AS most, " + ", ".join(f"round(quantile_cont(n, {p / 100}), 6) AS p{p}" for p in _P) + f" FROM (SELECT len({WS('text')})::DOUBLE AS n FROM documents)")
Q["length_coverage"] = (
    lambda s, d: docs(s, d).select(words().alias("n")).agg(*[F.avg((F.col("n") <= k).cast("double")).alias(f"c{k}") for k in (128, 256, 384, 512)]).unpivot([], [f"c{k}" for k in (128, 256, 384, 512)], "most", "share").select(F.substring("most", 2, 9).cast("long").alias("most"), F.round(100 * F.col("share"), 6).alias("pct")),
    f"""SELECT k::BIGINT AS most, round(100 * avg((n <= k)::INT::DOUBLE), 6) AS pct FROM (SELECT len({WS('text')}) AS n
FROM documents), unnest([128, 256, 384, 512]) AS r(k) GROUP BY k""",
)


def _joined(expr):
    return F.array_join(expr, " ")


Q["tokenize_code"] = (
    lambda s, d: docs(s, d).select("doc_id", F.md5(_joined(tx.identifier_tokens(F.col("text"))).cast("binary")).alias("digest"), F.size(tx.identifier_tokens(F.col("text"))).cast("long").alias("n")),
    f"""SELECT doc_id, md5(array_to_string(w, ' ')) AS digest, len(w)::BIGINT AS n
FROM (SELECT doc_id, {TOK('text')} AS w FROM documents)""")
Q["tokenize_text"] = (
    lambda s, d: table(s, d, "benchmark").select("item_id", _joined(tx.identifier_tokens(F.col("text"))).alias("tokens")),
    f"SELECT item_id, array_to_string({TOK('text')}, ' ') AS tokens FROM benchmark")
Q["tokens_nonstop"] = (
    lambda s, d: table(s, d, "benchmark").select("item_id", _joined(tx.content_tokens(tx.identifier_tokens(F.col("text")))).alias("tokens")),
    f"""SELECT item_id, array_to_string(list_filter({TOK('text')}, lambda t: length(t) > 1
AND t NOT IN {STOP}), ' ') AS tokens FROM benchmark""")
Q["shingles"] = (
    lambda s, d: docs(s, d).select("doc_id", tx.lower_words(F.col("text")).alias("w")).select("doc_id", tx.shingles(F.col("w")).alias("g")).select("doc_id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|").cast("binary")).alias("digest")),
    f"""SELECT doc_id, len(g)::BIGINT AS n, md5(array_to_string(list_sort(g), '|')) AS digest
FROM (SELECT doc_id, {SHINGLES('w')} AS g FROM (SELECT doc_id, {WS('lower(text)')} AS w FROM documents))""")
HITS = 10


def _hits(s, d):
    """The benchmark texts with the texts of their 10 best documents."""
    found = bm25.best(bench_queries(s, d), index(s, d), HITS).select(F.col("query_id").alias("item_id"), "doc_id")
    items = table(s, d, "benchmark").select("item_id", F.col("text").alias("query"))
    return found.join(items, "item_id").join(docs(s, d), "doc_id")


def _pairs(s, d, f):
    """The distinct words of each benchmark text (a) and of each of its hits (b)."""
    return _hits(s, d).select("item_id", "doc_id", F.array_distinct(f(F.col("query"))).alias("a"), F.array_distinct(f(F.col("text"))).alias("b"))


_HITS = f"""{BENCH}, {index_sql()}, {scores_sql()}, hits AS (SELECT query_id AS item_id, doc_id FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sc) WHERE place <= {HITS})"""


def _PAIRS(a: str, b: str) -> str:
    return f"""WITH {_HITS}, pairs AS (SELECT h.item_id, h.doc_id, list_distinct({a}) AS a, list_distinct({b}) AS b
  FROM hits h JOIN benchmark q ON q.item_id = h.item_id JOIN documents d ON d.doc_id = h.doc_id)"""


_J = "coalesce(len(list_intersect(a, b))::DOUBLE / nullif(len(a) + len(b) - len(list_intersect(a, b)), 0), 0)"
_WORDS = _PAIRS(WS("lower(q.text)"), WS("lower(d.text)"))
Q["jaccard_pairs"] = (
    lambda s, d: _pairs(s, d, tx.lower_words).select("item_id", "doc_id", F.round(tx.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard")),
    f"{_WORDS} SELECT item_id, doc_id, round({_J}, 6) AS jaccard FROM pairs",
)


def badge(jaccard):
    return F.when(jaccard <= 0, "zero").when(jaccard <= 0.15, "low").otherwise("high")


Q["jaccard_badge"] = (
    lambda s, d: _pairs(s, d, tx.lower_words).select("item_id", "doc_id", badge(tx.jaccard(F.col("a"), F.col("b"))).alias("badge")),
    f"{_WORDS} SELECT item_id, doc_id, CASE WHEN {_J} <= 0 THEN 'zero' WHEN {_J} <= 0.15 THEN 'low' ELSE 'high' END AS badge FROM pairs",
)


def _AW(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1)"


Q["token_attribution"] = (
    lambda s, d: _pairs(s, d, tx.letter_words).select("item_id", "doc_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), " ").alias("shared")),
    f"""{_PAIRS(_AW('q.text'), _AW('d.text'))}
SELECT item_id, doc_id, coalesce(array_to_string(list_sort(list_intersect(a, b)), ' '), '') AS shared FROM pairs""",
)
Q["truncate_seq"] = (
    lambda s, d: docs(s, d).select("doc_id", _joined(F.slice(tx.space_words(F.col("text")), 1, 16)).alias("head")),
    f"SELECT doc_id, array_to_string(({WS('text')})[1:16], ' ') AS head FROM documents")
Q["pad_truncate"] = (
    lambda s, d: docs(s, d).select("doc_id", tx.pad_truncate(F.transform(tx.space_words(F.col("text")), lambda w: F.length(w).cast("long")), 32).alias("ids")).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.size(F.filter("ids", lambda x: x > 0)).cast("long").alias("mask")),
    f"""SELECT doc_id, array_to_string(ids, ',') AS ids, len(list_filter(ids, lambda x: x > 0))::BIGINT AS mask
FROM (SELECT doc_id, (list_transform({WS('text')}, lambda w: length(w)) || list_transform(range(32), lambda i: 0))[1:32] AS ids
FROM documents)""",
)
Q["result_snippet"] = (lambda s, d: docs(s, d).select("doc_id", tx.snippet(F.col("text")).alias("snippet")), """SELECT doc_id,
CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS snippet
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""")


# sinks, and what is read back from them
def jsonl_scan(s, d):
    """Documents written as gzipped JSON lines into several files, and read from them."""
    with store.scratch(s) as at:
        docs(s, d).repartition(3).write.option("compression", "gzip").json(at)
        return store.cut(io.read_jsonl(s, at, "doc_id long, text string").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")))


Q["jsonl_scan"] = (jsonl_scan, "SELECT doc_id, md5(text) AS digest FROM documents")


def split_sink(s, d):
    """Documents written as a Parquet folder for each split, and read from them."""
    with store.scratch(s) as at:
        io.write_splits(_split(s, d), at)
        return store.cut(s.read.parquet(at).select("doc_id", F.col("split").cast("string").alias("split"), F.length("text").cast("long").alias("n")))


Q["split_sink"] = (split_sink, """SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val'
ELSE 'test' END AS split, length(text)::BIGINT AS n FROM documents""")


def _report(s, d):
    names = {"mrr": "MRR", "recall_1": "Recall@1", "recall_10": "Recall@10"}
    found = ranking.metrics(paired_ranks(s, d))
    return found.select(F.lit("bm25").alias("arm"), *[F.col(a).alias(b) for a, b in names.items()])


_REPORT = f"WITH {PAIRED}, {paired_sql()}, {ranks_sql()}, m AS (SELECT {METRICS} FROM rk)"


def report_sink(s, d):
    """A report written as JSON, and read back."""
    with store.scratch(s) as at:
        io.write_report(_report(s, d), at)
        return store.cut(io.read_report(s, at).select("arm", F.col("MRR").alias("mrr"), F.col("`Recall@10`").alias("recall_10")))


Q["report_sink"] = (report_sink, f"{_REPORT} SELECT 'bm25' AS arm, mrr, recall_10 FROM m")
Q["tracker_rows"] = (
    lambda s, d: io.metric_rows(_report(s, d), ["arm"]),
    f"""{_REPORT} SELECT 'bm25' AS arm, x.metric, x.value
FROM m, LATERAL (VALUES ('MRR', mrr), ('Recall_at_1', recall_1), ('Recall_at_10', recall_10)) AS x(metric, value)""",
)


def metric_table(s, d):
    """The report as the lines of a Markdown table, numbered."""
    return io.table_lines(_report(s, d), ["arm"])


Q["metric_table"] = (
    metric_table,
    f"""{_REPORT} SELECT * FROM (SELECT 0::BIGINT AS line, '| Metric | Score |' AS text UNION ALL SELECT 1, '| :--- | :---: |'
UNION ALL SELECT 2, printf('| %-12s | %.4f |', 'MRR', mrr) FROM m UNION ALL SELECT 3, printf('| %-12s | %.4f |', 'RECALL@1', recall_1) FROM m
UNION ALL SELECT 4, printf('| %-12s | %.4f |', 'RECALL@10', recall_10) FROM m)""",
)


def skip_processed(s, d):
    """Documents of which a results table, appended to as they are done, doesn't tell yet."""
    with store.scratch(s) as at:
        docs(s, d).where("doc_id % 3 = 0").select("doc_id", F.length("text").alias("n")).write.parquet(at)
        io.new_only(docs(s, d).where("doc_id % 3 = 1"), s.read.parquet(at), ["doc_id"]).select("doc_id", F.length("text").alias("n")).write.mode("append").parquet(at)
        return store.cut(io.new_only(docs(s, d), s.read.parquet(at), ["doc_id"]).select("doc_id"))


Q["skip_processed"] = (skip_processed, "SELECT doc_id FROM documents WHERE doc_id % 3 = 2")


def index_reload(s, d):
    """The kept index, as read from its files: documents, their mean length, terms, postings and the sum of all IDFs."""
    own = index(s, d)
    return own.vocab.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.round(F.sum("idf"), 4).alias("idf")).select(F.lit(own.n).alias("n"), F.round(F.lit(own.avgdl), 6).alias("avgdl"), "n_terms", "n_postings", "idf")


Q["index_reload"] = (index_reload, f"""WITH {index_sql()}
SELECT any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl, count(*) AS n_terms, sum(df)::BIGINT AS n_postings, round(sum(idf), 4) AS idf
FROM vocab, st""")
Q["file_digests"] = (
    lambda s, d: io.file_digests(s, f"{d}/documents.parquet").select(F.substring_index("path", "/", -1).alias("file"), "sha256"),
    None)
