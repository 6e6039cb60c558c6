"""Near-duplicates by MinHash, resampling, hard-negative mining, and functions over source code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bpe, code_ast
from ..functions import text as tx
from ..operators import bm25, dedup, dense, mining, ranking, resampling
from ..sources import store
from .base import HASH, PAIRED, SHINGLES, TOK, WS, docs, index, index_sql, paired_best, paired_queries, paired_sql, ranks_sql, signed, table, truth
from .dense import _ALL, vectors
from .retrieval import ranks

Q: dict = {}
_H60 = "('0x' || substr(md5(s), 1, 15))::BIGINT"
_AB = tx.minhash_coefficients(64)


def sig_sql(p: str = "", text: str = "text") -> str:
    """CTEs sh(doc_id, g) and sg(doc_id, sig), with a prefix p, of an expression over documents."""
    return f"""{p}sh AS (SELECT doc_id, {SHINGLES('w')} AS g FROM (SELECT doc_id, {WS(f'lower({text})')} AS w FROM documents)),
{p}hs AS (SELECT DISTINCT doc_id, {_H60} AS h FROM (SELECT doc_id, unnest(g) AS s FROM {p}sh)),
{p}co(i, a, b) AS (VALUES {', '.join(f'({i}, {a}::HUGEINT, {b}::HUGEINT)' for i, (a, b) in enumerate(_AB))}),
{p}sg AS (SELECT doc_id, list(m ORDER BY i) AS sig FROM (SELECT doc_id, i, min((a * h + b) % 2305843009213693951)::BIGINT AS m FROM {p}hs, {p}co GROUP BY doc_id, i) GROUP BY doc_id)"""


_SIG = sig_sql()
_BANDS = "bd AS (SELECT doc_id, k::INT AS band, array_to_string(sig[k * 4 + 1:k * 4 + 4], ',') AS key FROM sg, unnest(range(16)) AS r(k))"
TRAIN, TEST = "doc_id % 10 < 8", "doc_id % 10 = 9"


def _joined(sig):
    return F.array_join(F.transform(sig, lambda x: x.cast("string")), ",")


Q["minhash_signature"] = (
    lambda s, d: dedup.signatures(docs(s, d)).where("n_shingles > 0").select("doc_id", _joined("sig").alias("sig")),
    f"WITH {_SIG} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sg",
)
Q["lsh_bands"] = (lambda s, d: dedup.bands(signed(s, d).where("n_shingles > 0")), f"WITH {_SIG}, {_BANDS} SELECT * FROM bd")


def _agreement(s, d):
    """(doc_id, other_id, agree): each document against the smallest one of each of its bands."""
    sig = signed(s, d).where("n_shingles > 0")
    pairs = store.cut(dedup.star_pairs(sig, sig).where("doc_id != other_id").select("doc_id", "other_id"))
    other = sig.select(F.col("doc_id").alias("other_id"), F.col("sig").alias("other"))
    met = dedup.hot_join(pairs.join(sig.select("doc_id", "sig"), "doc_id"), other, "other_id", pairs.groupBy("other_id").agg(F.count("*").alias("n")))
    return met.select("doc_id", "other_id", mining.agreement(F.col("sig"), F.col("other")).cast("long").alias("agree"))


Q["minhash_agreement"] = (
    _agreement,
    f"""WITH {_SIG}, {_BANDS}, pr AS (SELECT DISTINCT doc_id, other_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, key) AS other_id FROM bd) WHERE doc_id != other_id)
SELECT pr.doc_id, other_id, len(list_filter(list_zip(a.sig, b.sig), lambda p: p[1] = p[2]))::BIGINT AS agree
FROM pr JOIN sg a ON a.doc_id = pr.doc_id JOIN sg b ON b.doc_id = other_id""",
)


def minhash_cross_dedup(s, d, threshold: float = 0.85):
    """Test documents without a train document whose shingles reach the threshold among those sharing a band."""
    test, train = (docs(s, d).where(part) for part in (TEST, TRAIN))
    sig = signed(s, d)
    near = dedup.near_any(sig.where(TEST), sig.where(TRAIN), test, train, threshold)
    return test.select("doc_id").join(near, "doc_id", "left_anti")


Q["minhash_cross_dedup"] = (
    minhash_cross_dedup,
    f"""WITH {_SIG}, {_BANDS},
cand AS (SELECT DISTINCT x.doc_id, y.doc_id AS o FROM bd x JOIN bd y USING (band, key) WHERE x.doc_id % 10 = 9 AND y.doc_id % 10 < 8),
near AS (SELECT DISTINCT c.doc_id FROM cand c JOIN sh a ON a.doc_id = c.doc_id JOIN sh b ON b.doc_id = c.o
  WHERE round(len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) >= 0.85)
SELECT doc_id FROM documents WHERE doc_id % 10 = 9 AND doc_id NOT IN (SELECT doc_id FROM near)""",
)


def minhash_split_purge(s, d, threshold: float = 0.85):
    """(doc_id, split) without near-duplicates across splits: train whole; test without what is near to train; val without
    what is near to train, then to the test documents that stay."""
    sig, val = signed(s, d), "doc_id % 10 = 8"
    train, test, later = (docs(s, d).where(part) for part in (TRAIN, TEST, val))
    kept = store.cut(test.select("doc_id").join(dedup.near_any(sig.where(TEST), sig.where(TRAIN), test, train, threshold), "doc_id", "left_anti"))
    left = store.cut(later.select("doc_id").join(dedup.near_any(sig.where(val), sig.where(TRAIN), later, train, threshold), "doc_id", "left_anti"))
    only = lambda df, ids: df.join(ids, "doc_id", "left_semi")
    again = dedup.near_any(only(sig, left), only(sig, kept), only(later, left), only(test, kept), threshold)
    parts = ((train, "train"), (kept, "test"), (left.join(again, "doc_id", "left_anti"), "val"))
    first, second, third = (df.select("doc_id", F.lit(name).alias("split")) for df, name in parts)
    return first.unionByName(second).unionByName(third)


_NEAR = "round(len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) >= 0.85"
Q["minhash_split_purge"] = (
    minhash_split_purge,
    f"""WITH {_SIG}, {_BANDS}, cand AS (SELECT DISTINCT x.doc_id, y.doc_id AS o FROM bd x JOIN bd y USING (band, key) WHERE x.doc_id % 10 >= 8 AND y.doc_id % 10 != 8 AND x.doc_id != y.doc_id),
nr AS (SELECT c.doc_id, c.o FROM cand c JOIN sh a ON a.doc_id = c.doc_id JOIN sh b ON b.doc_id = c.o WHERE {_NEAR}),
te AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 9 AND doc_id NOT IN (SELECT doc_id FROM nr WHERE o % 10 < 8)),
va AS (SELECT doc_id FROM documents WHERE doc_id % 10 = 8 AND doc_id NOT IN (SELECT doc_id FROM nr WHERE o % 10 < 8)
  AND doc_id NOT IN (SELECT doc_id FROM nr WHERE o IN (SELECT doc_id FROM te)))
SELECT doc_id, 'train' AS split FROM documents WHERE doc_id % 10 < 8 UNION ALL SELECT doc_id, 'test' FROM te UNION ALL SELECT doc_id, 'val' FROM va""",
)


def nearest(s, d):
    return store.cut(dedup.nearest_texts(docs(s, d).where(TEST), docs(s, d).where(TRAIN)))


_NN = f"""WITH sh AS (SELECT doc_id, {SHINGLES('w')} AS g FROM (SELECT doc_id, {WS('lower(text)')} AS w FROM documents)),
ex AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sh),
jp AS (SELECT a.doc_id, b.doc_id AS other_id, round(count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard
  FROM ex a JOIN ex b USING (s) WHERE a.doc_id % 10 = 9 AND b.doc_id % 10 < 8 GROUP BY a.doc_id, b.doc_id),
nn AS (SELECT sh.doc_id, coalesce(other_id, -1) AS other_id, coalesce(jaccard, 0) AS jaccard
  FROM sh LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, other_id) AS r FROM jp) WHERE r = 1) b
  ON b.doc_id = sh.doc_id WHERE sh.doc_id % 10 = 9)"""
Q["exact_nn_jaccard"] = (nearest, f"{_NN} SELECT * FROM nn")
Q["rule_of_three"] = (
    lambda s, d: nearest(s, d).agg(F.count("*").alias("n"), F.sum((F.col("jaccard") >= 0.85).cast("long")).alias("n_near")).select("n", "n_near", F.round(ranking.upper_bound(F.col("n")), 9).alias("bound")),
    f"""{_NN}
SELECT count(*) AS n, sum((jaccard >= 0.85)::INT)::BIGINT AS n_near, round(1 - pow(0.05::DOUBLE, 1.0::DOUBLE / count(*)), 9) AS bound
FROM nn""",
)


def jaccard_histogram(s, d):
    """Ten equal bins, the last one closed; empty bins stay."""
    counts = nearest(s, d).groupBy(F.least(F.floor(F.col("jaccard") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))
    return s.range(10).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


Q["jaccard_histogram"] = (jaccard_histogram, f"""{_NN} SELECT b AS bin, count(doc_id) AS n FROM range(10) AS r(b) LEFT
JOIN nn ON least(floor(jaccard * 10), 9) = b GROUP BY b""")
ADDED = " added words at the end"


def dedup_positive_control(s, d):
    """Copies of train documents of at least 25 shingles with words added: how many of those at 0.85 are found."""
    texts = docs(s, d).where(TRAIN)
    sig = signed(s, d).where(TRAIN).where("n_shingles >= 25")
    texts = texts.join(sig.select("doc_id"), "doc_id", "left_semi")
    changed = texts.select("doc_id", F.concat("text", F.lit(ADDED)).alias("text"))
    pairs = dedup.compared(texts, F.concat("text", F.lit(ADDED))).where("j >= 0.85").select("doc_id")
    found = dedup.near_any(store.cut(dedup.signatures(changed)), sig, changed, texts)
    return pairs.join(found.withColumn("hit", F.lit(1)), "doc_id", "left").agg(F.count("*").alias("n"), F.count("hit").alias("found"))


_BOTH = "len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))"
_CUT = """SELECT doc_id, k::INT AS band, array_to_string(sig[k * 4 + 1:k * 4 + 4], ',') AS key FROM {}
JOIN big USING (doc_id), unnest(range(16)) AS r(k)"""
Q["dedup_positive_control"] = (
    dedup_positive_control,
    f"""WITH {_SIG}, {sig_sql('c', f"(text || '{ADDED}')")}, big AS (SELECT doc_id FROM sh WHERE len(g) >= 25 AND doc_id % 10 < 8),
bd AS ({_CUT.format('sg')}), cb AS ({_CUT.format('csg')}), met AS (SELECT DISTINCT cb.doc_id, bd.doc_id AS o FROM cb JOIN bd USING (band, key)),
near AS (SELECT DISTINCT met.doc_id FROM met JOIN csh x ON x.doc_id = met.doc_id JOIN sh y ON y.doc_id = met.o WHERE round({_BOTH}, 6) >= 0.85),
own AS (SELECT x.doc_id FROM csh x JOIN sh y ON x.doc_id = y.doc_id JOIN big ON big.doc_id = x.doc_id WHERE {_BOTH} >= 0.85)
SELECT count(*) AS n, count(near.doc_id) AS found FROM own LEFT JOIN near ON near.doc_id = own.doc_id""",
)

# resampling
Q["seeded_sample"] = (
    lambda s, d: docs(s, d).select("doc_id", tx.unit_hash(F.lit(42), F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(100).select("doc_id"),
    f"SELECT doc_id FROM documents ORDER BY {HASH('42', 'doc_id')}, doc_id LIMIT 100")
TIMES, PAIRED_TIMES = 1000, 2000
_R = f"{PAIRED}, {paired_sql()}, {ranks_sql()}"
# the tree of draws, for up to resampling.MOST_DRAWS rows: its splits' cumulative probabilities cl, its nodes tr
_M = resampling.MULTIPLIERS
_MIX = lambda x, shift, a: f"((xor(({x})::BIGINT, ({x})::BIGINT >> {shift})::HUGEINT * {a} + 1) % {resampling.P})"
_H0 = f"((b::HUGEINT * {_M[0]} + (node::HUGEINT * {_M[1]} + 42) % {resampling.P}) % {resampling.P})"
_DRAW = f"""nr AS (SELECT *, row_number() OVER (ORDER BY query_id) - 1 AS row FROM {{src}}),
nn AS (SELECT count(*) AS n FROM nr), sz(size) AS (SELECT n FROM nn UNION SELECT unnest([size // 2, size - size // 2]) FROM sz WHERE size > 1),
cd AS (SELECT size, m, k, exp(lgamma(m + 1) - CASE WHEN k > 0 THEN lgamma(k + 1) ELSE 0 END - lgamma(m - k + 1) + k * ln((size // 2) / size) + (m - k) * ln(1 - (size // 2) / size)) AS p
  FROM sz, nn, unnest(range(1, n + 1)) AS r(m), unnest(range(m)) AS q(k) WHERE size > 1),
cl AS (SELECT size, m, list(c ORDER BY k) AS c FROM (SELECT size, m, k, sum(p) OVER (PARTITION BY size, m ORDER BY k) AS c FROM cd) GROUP BY size, m
  UNION ALL SELECT size, 0, []::DOUBLE[] FROM sz WHERE size > 1),
tr(b, node, low, size, m) AS (SELECT b, 1::BIGINT, 0::BIGINT, n, n FROM range({{times}}) AS x(b), nn WHERE n > 0 UNION ALL
  SELECT b, 2 * node + side, low + side * (size // 2), CASE WHEN side = 0 THEN size // 2 ELSE size - size // 2 END, CASE WHEN side = 0 THEN k ELSE m - k END
  FROM (SELECT b, node, low, tr.size, tr.m, side, len(list_filter(c, lambda x: x < u)) AS k
    FROM (SELECT *, {_MIX(_MIX(_H0, 29, _M[1]), 31, _M[2])}::DOUBLE / {resampling.P} AS u FROM tr WHERE size > 1) tr JOIN cl ON cl.size = tr.size AND cl.m = tr.m, (VALUES (0), (1)) AS s(side))),
dr AS (SELECT b, low AS row, m FROM tr WHERE size = 1 AND m > 0), bs AS (SELECT b, {{aggs}} FROM dr JOIN nr USING (row) GROUP BY b)"""
_EXPR = {"mrr": "CASE WHEN rank >= 1 THEN 1.0::DOUBLE / rank ELSE 0 END"} | {f"recall_{k}": f"CASE WHEN rank >= 1 AND rank <= {k} THEN 1.0::DOUBLE ELSE 0 END" for k in (1, 5, 10)} | {f"ndcg_{k}": f"CASE WHEN rank >= 1 AND rank <= {k} THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END" for k in (1, 5, 10)}
_CI = "round(quantile_cont({0}, 0.025), 6) AS low, round(quantile_cont({0}, 0.975), 6) AS high"
_SUITE = f"WITH RECURSIVE {_R}, " + _DRAW.format(times=TIMES, src="rk", aggs=", ".join(f"sum(m * ({e})) / sum(m) AS {m}" for m, e in _EXPR.items()))
Q["bootstrap_mrr_ci"] = (
    lambda s, d: ranking.bootstrap(ranks(s, d), TIMES).where("metric = 'mrr'").select("low", "high"),
    f"{_SUITE} SELECT {_CI.format('mrr')} FROM bs")
Q["bootstrap_suite"] = (
    lambda s, d: ranking.bootstrap(ranks(s, d), TIMES),
    f"{_SUITE} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_CI.format(m)} FROM bs" for m in _EXPR))
_e = lambda m, c: _EXPR[m].replace("rank", c)
Q["paired_bootstrap"] = (
    lambda s, d: ranking.paired_bootstrap(ranks(s, d, "atire"), ranks(s, d, "robertson", "words"), PAIRED_TIMES),
    f"""WITH RECURSIVE {_R.replace('rk AS', 'unused AS')}, {paired_sql('atire', p='a_')}, {ranks_sql('a_')}, {paired_sql('robertson', lambda x: WS(f'lower({x})'), 'w_')}, {ranks_sql('w_')},
pairs AS (SELECT query_id, a_rk.rank AS ra, w_rk.rank AS rb FROM a_rk JOIN w_rk USING (query_id)), """
    + _DRAW.format(times=PAIRED_TIMES, src="pairs", aggs=f"round(sum(m * (({_e('mrr', 'ra')}) - ({_e('mrr', 'rb')}))) / sum(m), 9) AS dd")
    + f""",
mn AS (SELECT round(avg(({_e('mrr', 'ra')}) - ({_e('mrr', 'rb')})), 6) AS delta_rr, round(avg(({_e('recall_1', 'ra')}) - ({_e('recall_1', 'rb')})), 6) AS delta_r1
FROM pairs),
ci AS (SELECT {_CI.format('dd')}, least(1.0::DOUBLE, 2 * least(avg((dd <= 0)::INT::DOUBLE), avg((dd >= 0)::INT::DOUBLE))) AS p
FROM bs) SELECT *, low >= -0.03 AS equivalent, low > 0 OR high < 0 AS significant FROM mn, ci""",
)

# source code made of the documents, since the tables hold prose: a function whose docstring is the first line, with a
# statement per line, of a kind that the line's length decides; of seven documents one is a method, one has its docstring
# before a semicolon, one nothing but a docstring, one none, one is broken, one blank
_STATEMENTS = ("    total += {}\n", "    if total > {}:\n        total -= 1\n", "    for i in range({}):\n        total += i\n")
_HEAD = "def shape(words, start=0, step=1):\n"
_BEGIN = "    total = start * 2 + step\n"


def codes(s, d):
    """(doc_id, code) of all documents."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    doc = F.regexp_replace(F.get(lines, F.lit(0)), "[^A-Za-z0-9 ]", "")
    filled = lambda i, x: F.concat(F.lit(_STATEMENTS[i].split("{}")[0]), F.length(x), F.lit(_STATEMENTS[i].split("{}")[1]))
    statement = lambda x: F.when(F.length(x) % 3 == 0, filled(0, x)).when(F.length(x) % 3 == 1, filled(1, x)).otherwise(filled(2, x))
    body = F.concat(F.lit(_BEGIN), F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), statement), ""), F.lit("    return total\n"))
    head, quoted = F.lit(_HEAD), F.concat(F.lit('    """'), doc, F.lit('"""\n'))
    plain = F.concat(head, quoted, body)
    kind = F.pmod("doc_id", F.lit(7))
    code = (
        F.when(kind == 0, plain)
        .when(kind == 1, F.concat(F.lit("    "), F.regexp_replace(F.rtrim(plain, F.lit("\n")), "\n", "\n    "), F.lit("\n")))
        .when(kind == 2, F.concat(head, F.lit('    "'), doc, F.lit('"; '), F.ltrim(body)))
        .when(kind == 3, F.concat(head, quoted))
        .when(kind == 4, F.concat(head, body))
        .when(kind == 5, F.concat(F.lit("def (:\n"), body))
        .otherwise(F.lit("  "))
    )
    return docs(s, d).select("doc_id", code.alias("code"))


def skeletons(s, d):
    """(doc_id, skeleton) of the documents' code without docstrings; null where it can't be parsed."""
    made = store.spread(codes(s, d)).withColumn("r", code_ast.strip_docstrings("code"))
    return made.select("doc_id", code_ast.skeleton_hashes("r.stripped").alias("skeleton"))


def _SQL_TEXT(x: str) -> str:
    return "'" + x.replace("\n", "' || chr(10) || '") + "'"


_ONE = " ".join(f"WHEN length(x) % 3 = {i} THEN {_SQL_TEXT(t.split('{}')[0])} || length(x)::VARCHAR || {_SQL_TEXT(t.split('{}')[1])}" for i, t in enumerate(_STATEMENTS))
_STATUS = "CASE WHEN kind IN (0, 1, 2, 4) THEN 'success' WHEN kind = 3 THEN 'syntax_error_after_strip' WHEN kind = 5 THEN 'parse_error' ELSE 'empty_input' END"
_CODE = f"""cl AS (SELECT doc_id, doc_id % 7 AS kind, string_split(coalesce(text, ''), chr(10))[2:] AS ls FROM documents),
cd AS (SELECT doc_id, kind, {_SQL_TEXT(_HEAD)} AS head, {_SQL_TEXT(_BEGIN)} || array_to_string(list_transform(ls, lambda x: CASE {_ONE} END), '') || {_SQL_TEXT('    return total' + chr(10))} AS body,
  array_to_string(list_transform(ls, lambda x: (length(x) % 3)::VARCHAR), '') AS shape FROM cl)"""

# mining
K, POOL, SIMPLE = 7, 100, 50


def prints(s, d):
    """The kept prints (doc_id, query_text, skeleton, sig) of all documents, trusted only with a row per document."""
    base = docs(s, d).select("doc_id", F.substring_index("text", "\n", 1).alias("query_text"))
    made = base.join(skeletons(s, d), "doc_id").join(signed(s, d).select("doc_id", "sig"), "doc_id")
    made_from = f"{store.files_digest(s, f'{d}/documents.parquet')}|{_STATEMENTS}|{_HEAD}|{_BEGIN}"
    return s.read.parquet(store.kept(s, "prints", made_from, lambda at: made.write.parquet(at), base.count()))


def _pool(s, d):
    own = index(s, d, "atire")
    q = paired_queries(s, d).select("query_id", tx.identifier_tokens(F.col("query")).alias("tokens"))
    kept = bm25.prune_terms(q, own.vocab).groupBy("query_id").agg(F.collect_list("term").alias("tokens"))
    return bm25.best(kept, own, POOL)


def _truth(s, d):
    return truth(s, d).select("query_id", F.col("doc_id").alias("target"))


def judged(s, d):
    return mining.judged(_pool(s, d), _truth(s, d), prints(s, d), POOL)


_JUDGED = f"""WITH {PAIRED}, {_CODE}, {index_sql('atire')}, {_SIG},
pt AS (SELECT query_id, term, 1 AS qtf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(idf, 9) DESC, term) AS place
  FROM (SELECT DISTINCT query_id, unnest({TOK("query")}) AS term FROM qs) JOIN vocab USING (term) WHERE idf >= 1) WHERE place <= 8),
sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM tf JOIN vocab USING (term) JOIN pt USING (term), st GROUP BY query_id, doc_id),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sc) WHERE place <= {POOL}),
pr AS (SELECT d.doc_id, split_part(text, chr(10), 1) AS q, CASE WHEN kind IN (0, 1, 2, 4) THEN shape END AS k,
  coalesce(sig, list_transform(range(64), lambda i: 0)) AS sig FROM documents d JOIN cd USING (doc_id) LEFT JOIN sg USING (doc_id))"""
_TIER = """CASE WHEN c.doc_id = t.doc_id THEN 'self' WHEN c.q = t.q THEN 'query_text' WHEN c.k = t.k THEN 'skeleton'
  WHEN len(list_filter(list_zip(c.sig, t.sig), lambda x: x[1] = x[2])) >= 45 THEN 'signature' END"""
_JUDGED += f""",
jd AS (SELECT p.query_id, p.doc_id, p.place, {_TIER} AS tier FROM pool p JOIN pr c ON c.doc_id = p.doc_id JOIN pr t ON t.doc_id = p.query_id)"""
def _filled(kept: str, k: int, where: str) -> str:
    """CTEs up to ng(query_id, neg_pos, doc_id), from kept(query_id, doc_id, place)."""
    fresh = f"NOT EXISTS (SELECT 1 FROM kp WHERE kp.query_id = dw.query_id AND kp.doc_id = nd.doc_id AND neg_pos <= {k})"
    return f"""kp AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS neg_pos FROM ({kept})),
hv AS (SELECT qs.query_id, count(kp.doc_id) AS have FROM qs LEFT JOIN kp ON kp.query_id = qs.query_id AND neg_pos <= {k} GROUP BY qs.query_id HAVING count(kp.doc_id) < {k}),
nd AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
dw AS (SELECT query_id, have, j, floor({HASH('42', 'query_id', 'j')} * (SELECT count(*) FROM documents))::BIGINT AS pos FROM hv, range({mining.DRAWS[-1]}) AS r(j)),
fl AS (SELECT dw.query_id, any_value(have) AS have, nd.doc_id, min(j) AS j FROM dw JOIN nd USING (pos) {where} AND {fresh} GROUP BY dw.query_id, nd.doc_id),
h2 AS (SELECT query_id, any_value(hv.have) + count(fl.doc_id) AS have FROM hv LEFT JOIN fl USING (query_id) GROUP BY query_id HAVING any_value(hv.have) + count(fl.doc_id) < {k}),
rs AS (SELECT dw.query_id, have, nd.doc_id FROM h2 dw JOIN nd ON true {where} AND {fresh} AND NOT EXISTS (SELECT 1 FROM fl WHERE fl.query_id = dw.query_id AND fl.doc_id = nd.doc_id)),
ng AS (SELECT query_id, neg_pos, doc_id FROM kp WHERE neg_pos <= {k}
  UNION ALL SELECT query_id, have + row_number() OVER (PARTITION BY query_id ORDER BY j), doc_id FROM fl QUALIFY have + row_number() OVER (PARTITION BY query_id ORDER BY j) <= {k}
  UNION ALL SELECT query_id, have + row_number() OVER (PARTITION BY query_id ORDER BY {HASH('42', 'query_id', 'doc_id')}, doc_id), doc_id FROM rs
    QUALIFY have + row_number() OVER (PARTITION BY query_id ORDER BY {HASH('42', 'query_id', 'doc_id')}, doc_id) <= {k})"""


_NEG = _filled("SELECT query_id, doc_id, place FROM jd WHERE tier IS NULL", K, f"JOIN pr c ON c.doc_id = nd.doc_id JOIN pr t ON t.doc_id = dw.query_id WHERE {_TIER} IS NULL")


def mine(s, d):
    """The BM25 miner: 7 of the pool of 100 that no tier excludes, else fillers from the whole corpus."""
    made = mining.negatives(judged(s, d), _truth(s, d), prints(s, d), K)
    return mining.checked(store.cut(made), _truth(s, d), docs(s, d))


Q["mine_bm25_negatives"] = (mine, f"{_JUDGED}, {_NEG} SELECT * FROM ng")
Q["mining_drop_counts"] = (
    lambda s, d: judged(s, d).groupBy(F.coalesce("tier", F.lit("kept")).alias("tier")).agg(F.count("*").alias("n")),
    f"{_JUDGED} SELECT coalesce(tier, 'kept') AS tier, count(*) AS n FROM jd GROUP BY 1",
)


def mine_simple(s, d):
    """The 50 best by BM25 but the own document, then fillers that need only be others."""
    ranked = bm25.top_k(paired_best(s, d, SIMPLE + 1).drop("rank").where("doc_id != query_id"), SIMPLE).select("query_id", "doc_id", F.col("rank").alias("place"))
    return mining.filled(ranked, _truth(s, d), prints(s, d), SIMPLE, judge=False)


Q["mine_simple_negatives"] = (
    mine_simple,
    f"WITH {_R}, "
    + _filled("""SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place
FROM sc WHERE doc_id != query_id""", SIMPLE, "WHERE nd.doc_id != dw.query_id")
    + " SELECT * FROM ng",
)


def mine_dense(s, d):
    """The 7 best of all vectors of another label (so never the own one), checked."""
    v = vectors(s, d)
    own = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "v", "label")
    made = bm25.top_k(dense.scores(own, v, keep=K, other_label=True), K).select("query_id", F.col("rank").alias("neg_pos"), "doc_id")
    return mining.checked(store.cut(made), own.select("query_id", F.col("query_id").alias("target")), v)


Q["mine_dense_negatives"] = (
    mine_dense,
    f"""WITH a AS ({_ALL.format(6)}) SELECT query_id, neg_pos, doc_id FROM (
SELECT a.query_id, a.doc_id, row_number() OVER (PARTITION BY a.query_id ORDER BY score DESC, a.doc_id) AS neg_pos
FROM a JOIN embeddings x ON x.vec_id = a.doc_id JOIN embeddings y ON y.vec_id = a.query_id WHERE x.label != y.label) WHERE neg_pos <= {K}""",
)
Q["gather_negatives"] = (
    lambda s, d: mining.gather(mine(s, d), docs(s, d)).select("query_id", _joined("ids").alias("ids"), F.md5(F.array_join("texts", "|").cast("binary")).alias("digest")),
    f"""{_JUDGED}, {_NEG} SELECT query_id, string_agg(ng.doc_id::VARCHAR, ',' ORDER BY neg_pos) AS ids, md5(string_agg(text, '|' ORDER BY neg_pos)) AS digest
FROM ng JOIN documents d ON d.doc_id = ng.doc_id GROUP BY query_id""",
)

def stripped(s, d):
    return codes(s, d).withColumn("r", code_ast.strip_docstrings("code")).select("doc_id", "r.stripped", "r.status")


_ST = f"WITH {_CODE}, st AS (SELECT doc_id, CASE WHEN kind IN (0, 1, 2, 4) THEN head || body END AS stripped, {_STATUS} AS status, shape FROM cd)"
Q["ast_strip"] = (stripped, f"{_ST} SELECT doc_id, stripped, status FROM st")
Q["ast_keep_success"] = (lambda s, d: stripped(s, d).where("status = 'success'"), f"{_ST} SELECT doc_id, stripped, status FROM st WHERE status = 'success'")
Q["ast_status_counts"] = (lambda s, d: stripped(s, d).groupBy("status").agg(F.count("*").alias("n")), f"{_ST} SELECT status, count(*) AS n FROM st GROUP BY status")


def skeleton_groups(s, d):
    """(doc_id, first): the smallest document of the same skeleton, found with partial sums by skeleton."""
    own = store.cut(skeletons(s, d).where("skeleton is not null"))
    first = own.groupBy("skeleton").agg(F.min("doc_id").alias("first"))
    return own.join(first, "skeleton").select("doc_id", "first")


Q["ast_skeleton"] = (skeleton_groups, f"{_ST} SELECT doc_id, min(doc_id) OVER (PARTITION BY shape) AS first FROM st WHERE status = 'success'")

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def bpe_encode(s, d, path: str = VOCABULARY, size: int = 256):
    """doc_id, ids and mask (padded or cut to `size`) and n_tokens of all texts, prefixed as text."""
    return bpe.encode(docs(s, d), path, size, modality="text")


def bpe_decode(s, d, path: str = VOCABULARY):
    """doc_id and whether the text comes back, byte for byte, from all its ids."""
    made = bpe.decode(bpe.encode(docs(s, d), path, None, modality="code"), path)
    back = F.expr("substring(decoded, 8)")
    return made.join(docs(s, d), "doc_id").select("doc_id", back.eqNullSafe(F.coalesce("text", F.lit(""))).alias("same"))


Q["bpe_encode"] = (bpe_encode, None)
Q["bpe_decode"] = (bpe_decode, "SELECT doc_id, true AS same FROM documents")
