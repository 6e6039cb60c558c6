"""BM25, ranks, metrics, strata, fusion and diagnostics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encoder
from ..functions import text as tx
from ..operators import bm25, dense, fusion, numbering, ranking, search
from ..sources import store
from .base import BENCH, CONTENT, METRICS, PAIRED, SQL_BODY, TOK, WS, bench_queries, body, docs, encoded_docs, index, index_sql, paired_counts, paired_queries, paired_ranks, paired_sql, ranks_sql, scores_sql, table, truth

Q: dict = {}


def _tokens(s, d):
    return bm25.tokenized(docs(s, d))


def _round(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


Q["corpus_stats"] = (
    lambda s, d: _round(bm25.corpus_stats(_tokens(s, d)), "avgdl"),
    f"WITH {index_sql()} SELECT n, round(avgdl, 6) AS avgdl FROM st")
Q["term_freq"] = (lambda s, d: bm25.term_freq(_tokens(s, d)), f"WITH {index_sql()} SELECT doc_id, term, tf, dl::BIGINT AS dl FROM tf")
Q["doc_freq"] = (lambda s, d: index(s, d).vocab.select("term", "df"), f"WITH {index_sql()} SELECT term, df FROM df")
for _m in ("robertson", "atire"):
    Q[f"idf_{_m}"] = (lambda s, d, m=_m: _round(index(s, d, m).vocab.select("term", "idf"), "idf"), f"WITH {index_sql(_m)} SELECT term, round(idf, 6) AS idf FROM vocab")


def _bench_scores(s, d, method="robertson"):
    return bm25.scores(bench_queries(s, d), index(s, d, method))


Q["bm25_scores"] = (_bench_scores, f"WITH {BENCH}, {index_sql()}, {scores_sql()} SELECT * FROM sc")
_TOP = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"
Q["topk_bm25"] = (lambda s, d: bm25.best(bench_queries(s, d), index(s, d), 10), f"""WITH {BENCH}, {index_sql()}, {scores_sql()} SELECT *
FROM (SELECT *, {_TOP} AS rank FROM sc) WHERE rank <= 10""")
Q["topk_lookup"] = (lambda s, d: bm25.lookups(bench_queries(s, d), index(s, d, lookup=True), 10), Q["topk_bm25"][1])
Q["query_term_prune"] = (
    lambda s, d: _round(bm25.prune_terms(bench_queries(s, d), index(s, d).vocab), "idf"),
    f"""WITH {BENCH}, {index_sql()} SELECT query_id, term, round(idf, 6) AS idf, place
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(idf, 9) DESC, term) AS place
FROM (SELECT DISTINCT query_id, unnest({TOK('query')}) AS term FROM qs) JOIN vocab USING (term) WHERE idf >= 1)
WHERE place <= 8""",
)
Q["variant_parity"] = (
    lambda s, d: _bench_scores(s, d).withColumnRenamed("score", "a").join(_bench_scores(s, d, "atire").withColumnRenamed("score", "b"), ["query_id", "doc_id"]).agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mean_diff"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 5).alias("max_diff")),
    f"""WITH {BENCH}, {paired_sql()}, {paired_sql('atire', p='a_')}
SELECT count(*) AS n, round(corr(x.score, y.score), 6) AS pearson, round(avg(abs(x.score - y.score)), 6) AS mean_diff, round(max(abs(x.score - y.score)), 5) AS max_diff
FROM sc x JOIN a_sc y USING (query_id, doc_id)""",
)


def ranks(s, d, method="robertson", tokenizer="identifiers", part="text"):
    return paired_ranks(s, d, method, tokenizer, part)


def _arms(s, d):
    out = None
    for name, r in (("atire", ranks(s, d, "atire")), ("robertson", ranks(s, d)), ("spaces", ranks(s, d, "robertson", "words"))):
        m = ranking.metrics(r).withColumn("arm", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("arm", "mrr", "recall_10")


def _lower_ws(x):
    return WS(f"lower({x})")


_ARMS = f"""{PAIRED}, {paired_sql()}, {ranks_sql()}, {paired_sql('atire', p='a_')}, {ranks_sql('a_')}, {paired_sql('robertson', _lower_ws, 'w_')}, {ranks_sql('w_')},
arms AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS arm, mrr, recall_10 FROM (SELECT {METRICS} FROM {p}rk)" for n, p in (("atire", "a_"), ("robertson", ""), ("spaces", "w_"))) + ")"
Q["leaderboard"] = (
    lambda s, d: _arms(s, d).withColumn("place", F.row_number().over(Window.orderBy(F.desc("mrr"), "arm")).cast("long")),
    f"WITH {_ARMS} SELECT *, row_number() OVER (ORDER BY mrr DESC, arm) AS place FROM arms")
Q["best_variant"] = (
    lambda s, d: _arms(s, d).where("arm != 'spaces'").orderBy(F.desc("mrr"), "arm").limit(1).select("arm", "mrr"),
    f"WITH {_ARMS} SELECT arm, mrr FROM arms WHERE arm != 'spaces' ORDER BY mrr DESC, arm LIMIT 1")
_R = f"{PAIRED}, {paired_sql()}, {ranks_sql()}"
Q["harmonic_table"] = (
    lambda s, d: paired_counts(s, d).where("equal > 0").select("query_id", "greater", "equal", F.round(F.col("equal") * ranking.expected_rr(F.col("greater"), F.col("equal")), 6).alias("h")),
    f"""WITH {_R} SELECT query_id, g::BIGINT AS greater, e::BIGINT AS equal, round(sum(1.0::DOUBLE / (g + i)), 6) AS h
FROM ties, unnest(range(1, e::BIGINT + 1)) AS r(i) GROUP BY query_id, g, e""",
)
Q["harmonic_ranks"] = (lambda s, d: _round(ranks(s, d), "rank"), f"WITH {_R} SELECT query_id, round(rank, 6) AS rank FROM rk")
Q["optimistic_ranks"] = (lambda s, d: paired_counts(s, d).where("equal > 0").select("query_id", (F.col("greater") + 1).alias("rank")), f"""WITH {_R}
SELECT query_id, rank FROM (SELECT query_id, doc_id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM sc)
WHERE doc_id = query_id""")
Q["metrics_all"] = (lambda s, d: ranking.metrics(ranks(s, d)), f"WITH {_R} SELECT count(*) AS n, {METRICS} FROM rk")


def strata(s, d):
    """(query_id, coverage, overlap_bin): the IDF-weighted share of a query's content tokens that its document has behind
    the first line, which is the query. IDF comes from train documents (presence only); terms unseen there count as of
    no document, and repeated tokens each time."""
    train = docs(s, d).where("doc_id % 10 < 8")
    content = lambda text: tx.content_tokens(tx.identifier_tokens(text))
    terms = train.select("doc_id", F.array_distinct(content(F.col("text"))).alias("terms"))
    presence = terms.select(F.explode_outer("terms").alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    n = train.count()
    own = docs(s, d).where("doc_id % 20 = 0")
    pairs = own.select(F.col("doc_id").alias("query_id"), content(F.substring_index("text", "\n", 1)).alias("q"), F.array_distinct(tx.identifier_tokens(body())).alias("body"))
    # whether a token is met is told where the document stands; only tokens travel
    marked = pairs.select("query_id", F.transform("q", lambda t: F.struct(t.alias("term"), F.array_contains("body", t).alias("hit"))).alias("q"))
    q = marked.select("query_id", F.explode_outer("q").alias("t")).select("query_id", "t.term", "t.hit")
    joined = q.join(presence, "term", "left")
    idf = bm25.robertson(F.lit(n), F.coalesce("df", F.lit(0)))
    share = F.sum(F.when(F.col("hit"), idf)) / F.sum(F.when(F.col("term").isNotNull(), idf))
    cov = joined.groupBy("query_id").agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("coverage"))
    return cov.select("query_id", "coverage", bin_of(F.col("coverage")).alias("overlap_bin"))


def bin_of(coverage):
    return F.when(coverage <= 1e-9, "Zero").when(coverage <= 0.30, "Low").otherwise("High")


_IDF = "ln((n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1)"
_STRATA = f"""pres AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({CONTENT('text')})) AS term FROM documents WHERE doc_id % 10 < 8) GROUP BY term),
trn AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 < 8), qterm AS (SELECT query_id, unnest({CONTENT('query')}) AS term FROM qs),
body AS (SELECT doc_id AS query_id, {TOK(SQL_BODY)} AS body FROM documents WHERE doc_id % 20 = 0),
cov AS (SELECT qs.query_id, round(coalesce(sum(CASE WHEN list_contains(body, term) THEN {_IDF} END) / sum(CASE WHEN term IS NOT NULL THEN {_IDF} END), 0), 6) AS coverage
  FROM qs LEFT JOIN qterm USING (query_id) LEFT JOIN pres USING (term) JOIN body ON body.query_id = qs.query_id, trn GROUP BY qs.query_id),
strata AS (SELECT query_id, coverage, CASE WHEN coverage <= 1e-9 THEN 'Zero' WHEN coverage <= 0.30 THEN 'Low' ELSE 'High' END AS overlap_bin FROM cov)"""
Q["overlap_stratify"] = (strata, f"WITH {PAIRED}, {_STRATA} SELECT * FROM strata")


CUTOFF = 1000


def body_ranks(s, d):
    """Ranks of the paired queries over documents without their first lines, none beyond the first 1000 places."""
    return paired_ranks(s, d, "atire", part="body", max_candidates=CUTOFF)


def ranked_strata(s, d):
    return strata(s, d).join(body_ranks(s, d), "query_id")


def _body_tok(x: str) -> str:
    return TOK(SQL_BODY) if x == "text" else TOK(x)


_BR = f"""{PAIRED}, {paired_sql('atire', _body_tok, 'b_')}, {ranks_sql('b_').replace('b_rk AS', 'b_all AS')},
rk AS (SELECT query_id, CASE WHEN rank <= {CUTOFF} THEN rank END AS rank FROM b_all)"""
_RS = f"WITH {_BR}, {_STRATA}, rs AS (SELECT * FROM strata JOIN rk USING (query_id))"
Q["rank_join_strata"] = (
    lambda s, d: _round(ranked_strata(s, d), "rank"),
    f"{_RS} SELECT query_id, coverage, overlap_bin, round(rank, 6) AS rank FROM rs")
Q["metrics_by_stratum"] = (
    lambda s, d: ranking.metrics(ranked_strata(s, d), ["overlap_bin"]).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6)),
    f"""{_RS}
SELECT overlap_bin, count(*) AS n, {METRICS}, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM rs
GROUP BY overlap_bin""")
Q["metrics_rollup"] = (
    lambda s, d: ranked_strata(s, d).rollup("overlap_bin").agg(F.count("*").alias("n"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(m) for m, c in ranking.suite(F.col("rank"))]).withColumn("overlap_bin", F.coalesce("overlap_bin", F.lit("Overall"))),
    f"""{_RS}
SELECT coalesce(overlap_bin, 'Overall') AS overlap_bin, count(*) AS n, {METRICS} FROM rs GROUP BY ROLLUP (overlap_bin)""")
Q["pilot_gate"] = (
    lambda s, d: ranked_strata(s, d).agg(F.round(F.avg(ranking.reciprocal(F.col("rank"))), 6).alias("mrr"), F.round(F.coalesce(F.avg(F.when(F.col("overlap_bin") == "Low", ranking.reciprocal(F.col("rank")))), F.lit(0.0)), 6).alias("low_mrr")).withColumn("passed", (F.col("mrr") >= 0.75 * 0.5214) | (F.col("low_mrr") > 0.2489)),
    f"""{_RS}, g AS (SELECT round(avg(CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank
ELSE 0 END), 6) AS mrr, round(coalesce(avg(CASE WHEN overlap_bin = 'Low' THEN CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank
ELSE 0 END END), 0), 6) AS low_mrr FROM rs)
SELECT mrr, low_mrr, mrr >= 0.75::DOUBLE * 0.5214::DOUBLE OR low_mrr > 0.2489 AS passed FROM g""",
)
# First words of under-specified queries.
GENERIC = ("get", "set", "return", "update", "check", "create", "initialize", "reset", "clear")


def failures(s, d, beyond: float = 10):
    """Strata of the queries that are found behind place `beyond`, or not at all."""
    return ranked_strata(s, d).where((F.col("rank") > beyond) | F.col("rank").isNull())


def error_rubric(s, d):
    """Failed queries by cause: C for thin ones, A for generic short ones, B for the rest; their share in percent, and
    whether B's is at least 50. All failures are looked at, not a sample."""
    own = docs(s, d).select(F.col("doc_id").alias("query_id"), F.trim(body(), F.lit(" \n\t\r")).alias("body"))
    failed = failures(s, d).join(paired_queries(s, d), "query_id").join(own, "query_id")
    w = tx.lower_words(F.col("query"))
    thin = (F.size(w) < 4) | F.lower("query").contains("todo") | (F.size(F.split("body", "\n")) <= 2)
    generic = (F.size(w) <= 6) & F.get(w, F.lit(0)).isin(*GENERIC) & (F.col("coverage") <= 0.10)
    cause = F.when(thin, "C").when(generic, "A").otherwise("B")
    counts = failed.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    # three rows at most
    share = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4)
    return counts.withColumn("share", share).withColumn("gate", F.when(F.col("cause") == "B", F.col("share") >= 50))


_GENERIC = "(" + ", ".join(f"'{w}'" for w in GENERIC) + ")"
Q["error_rubric"] = (
    error_rubric,
    f"""{_RS}, f AS (SELECT {WS('lower(query)')} AS w, query, trim({SQL_BODY}, ' ' || chr(10) || chr(9) || chr(13)) AS body, coverage
  FROM rs JOIN qs USING (query_id) JOIN documents ON doc_id = query_id WHERE rank IS NULL OR rank > 10),
c AS (SELECT CASE WHEN len(w) < 4 OR lower(query) LIKE '%todo%' OR len(string_split(body, chr(10))) <= 2 THEN 'C'
  WHEN len(w) <= 6 AND w[1] IN {_GENERIC} AND coverage <= 0.10 THEN 'A' ELSE 'B' END AS cause FROM f),
g AS (SELECT cause, count(*) AS n, round(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM c GROUP BY cause)
SELECT *, CASE WHEN cause = 'B' THEN share >= 50 END AS gate FROM g""",
)


def worst_failures(s, d, n: int = 3):
    """The n queries that are found last, behind place 50; those never found count as last of all."""
    place = F.coalesce("rank", F.lit(float("inf")))
    failed = failures(s, d, 50).select("query_id", F.round("rank", 6).alias("rank"), place.alias("place"))
    return failed.orderBy(F.desc("place"), "query_id").limit(n).select("query_id", "rank")


Q["worst_failures"] = (
    worst_failures,
    f"""{_RS} SELECT query_id, round(rank, 6) AS rank FROM rs WHERE rank IS NULL OR rank > 50
ORDER BY coalesce(rank, 'inf'::DOUBLE) DESC, query_id LIMIT 3""",
)


def contains_ngram(q, c, n=8):
    """A contiguous n-gram of q in c; shorter queries of at least n / 2 tokens wholly among c's tokens."""
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    long = (F.size(q) >= n) & (F.size(c) >= n)
    return F.coalesce(F.when(long, F.arrays_overlap(grams(F.when(long, q)), grams(F.when(long, c)))).when((F.size(q) >= n // 2) & (F.size(q) < n), F.size(F.array_except(q, c)) == 0), F.lit(False))


def overlap_pairs(s, d):
    """(query_id, q, body, null_body): each paired query's content tokens, all tokens of its document behind the first line,
    and those of another query's document: the next one by id, the first for the last. Numbers come from the ids'
    order in range partitions, so nothing is gathered."""
    base = docs(s, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), tx.content_tokens(tx.identifier_tokens(F.substring_index("text", "\n", 1))).alias("q"), tx.identifier_tokens(body()).alias("body"))
    own = store.cut(numbering.numbered(base, "query_id", "i"))
    n = own.count()
    other = own.select(F.col("i").alias("j"), F.col("body").alias("null_body"))
    return own.withColumn("j", (F.col("i") + 1) % F.lit(max(n, 1))).join(other, "j").select("query_id", "q", "body", "null_body")


_GR = lambda w: f"list_transform(range(1, len({w}) - 6), lambda i: array_to_string({w}[i:i + 7], ' '))"
_HIT = lambda c: f"""coalesce(CASE WHEN len(q) >= 8 AND len({c}) >= 8 THEN list_has_any({_GR('q')}, {_GR(c)})
WHEN len(q) >= 4 AND len(q) < 8 THEN list_has_all({c}, q) END, false)"""  # noqa: E731
_OV = f"""ov AS (SELECT *, lead(body, 1, NULL) OVER (ORDER BY query_id) AS nx, first_value(body) OVER (ORDER BY query_id) AS fb, row_number() OVER (ORDER BY query_id DESC) AS rn
FROM (SELECT doc_id AS query_id, {CONTENT('split_part(text, chr(10), 1)')} AS q, {TOK(SQL_BODY)} AS body FROM documents
WHERE doc_id % 20 = 0)), ovp AS (SELECT query_id, q, body, CASE WHEN rn = 1 THEN fb ELSE nx END AS null_body FROM ov)"""
Q["overlap_diagnostic"] = (
    lambda s, d: overlap_pairs(s, d).agg(F.count("*").alias("n"), F.round(F.avg(contains_ngram(F.col("q"), F.col("body")).cast("double")), 6).alias("true_rate"), F.round(F.avg(contains_ngram(F.col("q"), F.col("null_body")).cast("double")), 6).alias("null_rate")),
    f"""WITH {_OV}
SELECT count(*) AS n, round(avg({_HIT('body')}::INT::DOUBLE), 6) AS true_rate, round(avg({_HIT('null_body')}::INT::DOUBLE), 6) AS null_rate
FROM ovp""",
)


def matched_tokens(q, c, n=8):
    """The tokens of a hit as in contains_ngram: the first n-gram of q that c has, or all of a shorter q; null for none."""
    grams = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    long = (F.size(q) >= n) & (F.size(c) >= n)
    shared = F.filter(grams(F.when(long, q)), lambda g: F.array_contains(grams(F.when(long, c)), g))
    return F.when(long & (F.size(shared) > 0), F.split(F.get(shared, F.lit(0)), " ")).when((F.size(q) >= n // 2) & (F.size(q) < n) & (F.size(F.array_except(q, c)) == 0), q)


# Marks of links, and tokens that stand in them.
LINKS, LINK_TOKENS = ("http", "cloud.google", "github"), ("https", "docs", "reference", "cloud")


def match_categories(s, d):
    """Where the matched tokens of the hits among the paired queries stand in what follows the first line: in its first line
    (the first three tokens, as substrings), in a link, behind the last # (one of the first two), or elsewhere."""
    texts = docs(s, d).select(F.col("doc_id").alias("query_id"), F.regexp_replace(body(), "^\n", "").alias("text"))
    hits = overlap_pairs(s, d).select("query_id", matched_tokens(F.col("q"), F.col("body")).alias("t")).where("t is not null")
    found, text = hits.join(texts, "query_id"), F.col("text")
    first = F.lower(F.substring_index(text, "\n", 1))
    linked = F.lower(text).contains(LINKS[0]) | F.lower(text).contains(LINKS[1]) | F.lower(text).contains(LINKS[2])
    cat = (
        F.when(F.forall(F.slice("t", 1, 3), lambda x: first.contains(x)), "signature_or_param")
        .when(linked & F.exists("t", lambda x: x.isin(*LINK_TOKENS)), "api_or_url")
        .when(text.contains("#") & F.exists(F.slice("t", 1, 2), lambda x: F.substring_index(text, "#", -1).contains(x)), "inline_comment")
        .otherwise("body_statements")
    )
    return found.groupBy(cat.alias("category")).agg(F.count("*").alias("n"))


_MT = f"""CASE WHEN len(q) >= 8 AND len(body) >= 8 AND list_has_any({_GR('q')}, {_GR('body')}) THEN string_split(list_filter({_GR('q')}, lambda g: list_contains({_GR('body')}, g))[1], ' ')
  WHEN len(q) >= 4 AND len(q) < 8 AND list_has_all(body, q) THEN q END"""
Q["match_categories"] = (
    match_categories,
    f"""WITH {_OV}, h AS (SELECT query_id, {_MT} AS t FROM ovp), x AS (SELECT t, regexp_replace({SQL_BODY}, '^\n', '') AS c FROM h JOIN documents ON doc_id = query_id WHERE t IS NOT NULL)
SELECT CASE WHEN len(list_filter(t[1:3], lambda y: NOT contains(lower(split_part(c, chr(10), 1)), y))) = 0 THEN 'signature_or_param'
  WHEN (contains(lower(c), 'http') OR contains(lower(c), 'cloud.google') OR contains(lower(c), 'github')) AND list_has_any(t, ['https', 'docs', 'reference', 'cloud']) THEN 'api_or_url'
  WHEN contains(c, '#') AND len(list_filter(t[1:2], lambda y: contains(split_part(c, '#', -1), y))) > 0 THEN 'inline_comment' ELSE 'body_statements' END AS category, count(*) AS n
FROM x GROUP BY 1""",
)
Q["hits_vs_nonhits"] = (
    lambda s, d: ranking.metrics(overlap_pairs(s, d).select("query_id", contains_ngram(F.col("q"), F.col("body")).alias("hit")).join(ranks(s, d), "query_id"), ["hit"]),
    f"""WITH {_R}, {_OV} SELECT hit, count(*) AS n, {METRICS} FROM (SELECT query_id, {_HIT('body')} AS hit FROM ovp)
JOIN rk USING (query_id) GROUP BY hit""",
)


Q["leakage_delta"] = (
    lambda s, d: ranking.metrics(ranks(s, d)).select(F.lit("with").alias("corpus"), "mrr").unionByName(ranking.metrics(ranks(s, d, part="body")).select(F.lit("without").alias("corpus"), "mrr")),
    f"""WITH {_R}, {paired_sql('robertson', _body_tok, 'b_')}, {ranks_sql('b_')} SELECT 'with' AS corpus, mrr
FROM (SELECT {METRICS} FROM rk) UNION ALL SELECT 'without', mrr FROM (SELECT {METRICS} FROM b_rk)""",
)

# fusion: BM25 over identifier tokens (a) with BM25 over lower-cased words (b)
POOL = 50


def _lists(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), tx.lower_words(F.col("text")).alias("tokens"))
    return bm25.best(bench_queries(s, d), index(s, d), POOL), bm25.best(q, index(s, d, tokenizer="words"), POOL)


_L = f"""{BENCH}, {paired_sql()}, {paired_sql('robertson', _lower_ws, 'w_')}, la AS (SELECT * FROM (SELECT *, {_TOP} AS rank
FROM sc) WHERE rank <= {POOL}), lb AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM w_sc) WHERE rank <= {POOL}),
m AS (SELECT query_id, doc_id, la.score AS sa, la.rank AS ra, lb.score AS sb, lb.rank AS rb FROM la FULL
JOIN lb USING (query_id, doc_id))"""
_RRF = f"""WITH {_L},
f AS (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / ({{k}} + ra), {{miss}}) + coalesce(1.0::DOUBLE / ({{k}} + rb), {{miss}}), 9) AS score
FROM m) SELECT * FROM (SELECT *, {_TOP} AS rank FROM f) WHERE rank <= 10"""
Q["rrf_fusion"] = (lambda s, d: fusion.rrf(*_lists(s, d), 10), _RRF.format(k=60, miss="0.0::DOUBLE"))
Q["rrf_fusion_imputed"] = (
    lambda s, d: fusion.rrf(*_lists(s, d), 10, 20, POOL + 10),
    _RRF.format(k=20, miss=f"1.0::DOUBLE / {20 + POOL + 10}"))
_N = lambda c: f"coalesce(({c} - min({c}) OVER (PARTITION BY query_id)) / (max({c}) OVER (PARTITION BY query_id) - min({c}) OVER (PARTITION BY query_id) + 1e-9), 0)"
_CX = f"""WITH {_L}, z AS (SELECT query_id, doc_id, {_N('sa')} AS na, {_N('sb')} AS nb FROM m),
f AS (SELECT query_id, doc_id, round(na, 9) AS norm_a, round(nb, 9) AS norm_b, round(0.7::DOUBLE * na + (1 - 0.7::DOUBLE) * nb, 9) AS score
FROM z), x AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM f) WHERE rank <= {{}})"""
Q["convex_fusion"] = (lambda s, d: fusion.convex(*_lists(s, d), 10), _CX.format(10) + " SELECT * FROM x")
Q["score_decomposition"] = (
    lambda s, d: fusion.convex(*_lists(s, d), 10).select("query_id", "doc_id", F.round(F.coalesce(100 * 0.7 * F.col("norm_a") / F.nullif("score", F.lit(0.0)), F.lit(0.0)), 4).alias("pct_a")),
    _CX.format(10) + """ SELECT query_id, doc_id, round(coalesce(100 * 0.7::DOUBLE * norm_a / nullif(score, 0), 0), 4) AS pct_a
FROM x""")
_QUAD = lambda a, b: [("both", a & b), ("only_a", a & ~b), ("only_b", ~a & b), ("neither", ~a & ~b)]
Q["discordance_quadrants"] = (
    lambda s, d: fusion.convex(*_lists(s, d), 1000).agg(*[F.sum(c.cast("long")).alias(n) for n, c in _QUAD(F.col("norm_a") >= 0.5, F.col("norm_b") >= 0.5)]),
    _CX.format(1000) + " SELECT " + ", ".join(f"""sum(({'' if x else 'NOT '}norm_a >= 0.5
AND {'' if y else 'NOT '}norm_b >= 0.5)::INT)::BIGINT AS {n}""" for n, x, y in (("both", 1, 1), ("only_a", 1, 0), ("only_b", 0, 1), ("neither", 0, 0))) + " FROM x")
_RR = "CASE WHEN {p}rk.rank >= 1 THEN 1.0::DOUBLE / {p}rk.rank ELSE 0 END"
Q["oracle_bound"] = (
    lambda s, d: ranks(s, d).withColumnRenamed("rank", "x").join(ranks(s, d, "robertson", "words").withColumnRenamed("rank", "y"), "query_id").select(F.round(ranking.reciprocal(F.col("x")), 9).alias("a"), F.round(ranking.reciprocal(F.col("y")), 9).alias("b")).agg(F.round(F.avg(F.greatest("a", "b")), 6).alias("best_mrr"), *[F.sum(c.cast("long")).alias(n) for n, c in (("wins", F.col("a") > F.col("b")), ("losses", F.col("a") < F.col("b")), ("ties", F.col("a") == F.col("b")))]),
    f"""WITH {_R}, {paired_sql('robertson', _lower_ws, 'w_')}, {ranks_sql('w_')}
SELECT round(avg(greatest(a, b)), 6) AS best_mrr, sum((a > b)::INT)::BIGINT AS wins, sum((a < b)::INT)::BIGINT AS losses, sum((a = b)::INT)::BIGINT AS ties
FROM (SELECT round({_RR.format(p='')}, 9) AS a, round({_RR.format(p='w_')}, 9) AS b FROM rk JOIN w_rk USING (query_id))""",
)


# words with vectors: BM25 over identifier tokens and the hashing encoder, over all documents
def hybrid(s, d, mode: str, k: int = 10):
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    vectors = search.encoded(asked, "query_id", encoder.encode)
    return search.search(mode, k, index(s, d), bench_queries(s, d), encoded_docs(s, d), vectors).select("query_id", "doc_id", "score", "rank")


_E = f"""tx AS (SELECT 'd' AS kind, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
ht AS (SELECT kind, id, term, count(*) AS tf FROM (SELECT kind, id, unnest({CONTENT('t')}) AS term FROM tx) GROUP BY kind, id, term),
hp AS (SELECT kind, id, tf, ('0x' || substr(md5(term), 4 * j + 1, 4))::BIGINT AS h FROM ht, unnest(range({encoder.PLACES})) AS r(j)),
hv AS (SELECT kind, id, h % {encoder.SIZE} AS dim, sum((1 - 2 * (h // {encoder.SIZE} % 2)) * least(tf, {encoder.MOST}))::DOUBLE AS x FROM hp GROUP BY kind, id, dim),
hn AS (SELECT kind, id, sqrt(sum(x * x)) AS norm FROM hv GROUP BY kind, id),
dp AS (SELECT a.id AS query_id, b.id AS doc_id, sum(a.x * b.x) AS p FROM hv a JOIN hv b USING (dim) WHERE a.kind = 'q' AND b.kind = 'd' GROUP BY a.id, b.id),
de AS (SELECT q.id AS query_id, c.id AS doc_id, round(coalesce(p / nullif(x.norm * y.norm, 0), 0), 6) AS score
  FROM tx q JOIN tx c ON q.kind = 'q' AND c.kind = 'd' LEFT JOIN dp ON dp.query_id = q.id AND dp.doc_id = c.id
  LEFT JOIN hn x ON x.kind = 'q' AND x.id = q.id LEFT JOIN hn y ON y.kind = 'd' AND y.id = c.id)"""
_DENSE = f"SELECT * FROM (SELECT *, {_TOP} AS rank FROM de)"
_H = f"""WITH {BENCH}, {paired_sql()}, {_E}, la AS ({_DENSE} WHERE rank <= {POOL}), lb AS (SELECT * FROM (SELECT *, {_TOP} AS rank FROM sc) WHERE rank <= {POOL}),
m AS (SELECT query_id, doc_id, la.score AS sa, la.rank AS ra, lb.score AS sb, lb.rank AS rb FROM la FULL JOIN lb USING (query_id, doc_id))"""
_HRRF = f"""{_H},
f AS (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + ra), {{miss}}) + coalesce(1.0::DOUBLE / (60 + rb), {{miss}}), 9) AS score
FROM m) SELECT * FROM (SELECT *, {_TOP} AS rank FROM f) WHERE rank <= 10"""
Q["dense_documents"] = (lambda s, d: hybrid(s, d, "dense"), f"WITH {_E} {_DENSE} WHERE rank <= 10")
Q["hybrid_documents"] = (lambda s, d: hybrid(s, d, "hybrid"), _HRRF.format(miss="0.0::DOUBLE"))
Q["hybrid_rrf_documents"] = (lambda s, d: hybrid(s, d, "hybrid_rrf"), _HRRF.format(miss=f"1.0::DOUBLE / {60 + POOL + 10}"))
Q["hybrid_convex_documents"] = (
    lambda s, d: hybrid(s, d, "hybrid_convex"),
    f"""{_H}, z AS (SELECT query_id, doc_id, {_N('sa')} AS na, {_N('sb')} AS nb FROM m),
f AS (SELECT query_id, doc_id, round(0.7::DOUBLE * na + (1 - 0.7::DOUBLE) * nb, 9) AS score FROM z)
SELECT * FROM (SELECT *, {_TOP} AS rank FROM f) WHERE rank <= 10""",
)


def searched_results(s, d):
    """What a reader is shown of a hybrid search: snippets, and how many words query and document share."""
    asked = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.presented(hybrid(s, d, "hybrid_rrf"), asked, docs(s, d)).select("query_id", "rank", "doc_id", "snippet", "jaccard")


_SET = lambda x: f"list_distinct({WS(f'lower({x})')})"
_BOTHSETS = f"len(list_intersect({_SET('b.text')}, {_SET('t.text')}))"
Q["search_results"] = (
    searched_results,
    f"""{_HRRF.format(miss=f"1.0::DOUBLE / {60 + POOL + 10}").replace(") SELECT * FROM (SELECT", "), rs AS (SELECT * FROM (SELECT")})
SELECT query_id, rank, rs.doc_id, CASE WHEN length(t.text) > 120 THEN substr(replace(t.text, chr(10), ' '), 1, 120) || '...' ELSE replace(t.text, chr(10), ' ') END AS snippet,
  round(coalesce({_BOTHSETS}::DOUBLE / nullif(len({_SET('b.text')}) + len({_SET('t.text')}) - {_BOTHSETS}, 0), 0), 6) AS jaccard
FROM rs JOIN benchmark b ON b.item_id = query_id JOIN documents t ON t.doc_id = rs.doc_id""",
)
