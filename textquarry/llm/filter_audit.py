"""Audit of five quality filters: what each removes, alone and behind the others, in every order they may stand in.

Words are exploded, counted by (document, word), then by document; flags that need no words join them, and a document
becomes a mask of the filters it fails. Per part of the corpus, counts of the 32 masks tell everything about all 120
orders, so nothing of the size of the corpus is left where orders begin.

Defined results: a null text is an empty one; null parts are the part "". Rows are told apart by file and place, so
repeated rows and null or repeated ids count one by one. A row without an id is never a copy, and none is a copy of it;
rows of one id and one text aren't copies of each other. A row has a label if any of its id's labels has it. A very long
text must fit in a task, as it does where it is read; parts without documents have no rows, an empty table has none.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LETTERS = "ABCDE"
MASKS = 1 << len(LETTERS)
_WORD_GAPS = r"[\x20\x09-\x0D]+"


def word_totals(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, words, distinct_words) of texts (key, text); those without words are left out. Texts are dealt by their key
    first: then words are counted, by (key, word) and by key, where they are exploded."""
    words = texts.repartition(*key).select(*key, F.explode(F.split("text", _WORD_GAPS)).alias("word")).where("word != ''")
    per_word = words.groupBy(*key, "word").agg(F.count("*").alias("n"))
    return per_word.groupBy(*key).agg(F.sum("n").alias("words"), F.count("*").alias("distinct_words"))


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, words, distinct_words, good, toxic, mask) of every row of docs (doc_id, text, a part). Bit i of mask:
    the row fails filter LETTERS[i], by under 200 words (A), under half of them distinct (B), over 3 % capitals (C), a
    character of #$%&*| (D), or the text of a smaller id (E)."""
    own = common.identified(docs)
    key = ["file", "place"]
    text = F.coalesce("row.text", F.lit(""))
    base = own.select(F.xxhash64("at.file").alias("file"), F.col("at.place").alias("place"), F.col("row.doc_id").alias("doc_id"), F.col(f"row.`{part}`").alias("part"), text.alias("text"))
    totals = word_totals(base.select(*key, "text"), key)

    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    flags = base.select(*key, "doc_id", F.coalesce("part", F.lit("")).alias("part"), (100 * capitals.cast("long") > 3 * F.length("text").cast("long")).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    # the first row of each text is looked up by its own id and text, not by the text, which many rows may have
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    other = flags.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")

    words, distinct = (F.coalesce(c, F.lit(0)) for c in ("words", "distinct_words"))
    fails = [words < 200, 100 * distinct < 50 * words, F.col("c"), F.col("d"), F.col("doc_id").isNotNull() & F.col("first").isNull()]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    made = other.join(totals, key, "left")
    return made.select("doc_id", "part", words.alias("words"), distinct.alias("distinct_words"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), mask.cast("int").alias("mask"))


def counted(masked: DataFrame) -> DataFrame:
    """(part, n, good, toxic): by part, arrays of how many rows have each of the 32 masks."""
    columns = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.count_if((F.col("mask") == m) & c).alias(f"{name}_{m}") for name, c in columns.items() for m in range(MASKS)]
    return masked.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{name}_{m}" for m in range(MASKS)]).alias(name) for name in columns])


def _total(counts: str, condition) -> Column:
    """Sum of counts over the masks m of which condition(m) holds."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(condition(m), F.get(counts, m)).otherwise(0))


def orders(counts: DataFrame) -> DataFrame:
    """Of counts (part, n, good, toxic), a row per part, order of the filters and step."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = counts.select("*", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bits = lambda text: sum((F.when(F.contains(text, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(LETTERS)), F.lit(0))
    steps = steps.withColumns({"bit": bits(letter), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})
    fails, earlier = lambda m: m.bitwiseAND(F.col("bit")) != 0, lambda m: m.bitwiseAND(F.col("before")) != 0
    n_orders = len(list(permutations(LETTERS)))
    # of the orders of the filters that a row fails, each filter is first in an equal share
    shares = F.aggregate(F.sequence(F.lit(1), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda a, m: a + F.when(fails(m), F.get("n", m) * (n_orders / F.bit_count(m)).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step",
        _total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        _total("n", lambda m: fails(m) & ~earlier(m)).alias("removed"),
        _total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.get("n", F.col("bit")).alias("unique_fails"),
        _total("good", lambda m: fails(m) & ~earlier(m)).alias("good_lost"),
        _total("toxic", lambda m: fails(m) & ~earlier(m)).alias("toxic_lost"),
        shares.alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return orders(counted(masks(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))))


_PERMS = " JOIN ".join(f"unnest(['A', 'B', 'C', 'D', 'E']) AS t{i}({x})" + ("" if i == 0 else " ON " + " AND ".join(f"{x} != {y}" for y in "vwxyz"[:i])) for i, x in enumerate("vwxyz"))
_SUM = "coalesce(sum(CASE WHEN {} THEN {} END), 0)::BIGINT"
SQL = {
    "op11_filter_audit": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
lb AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS m FROM w LEFT JOIN lb USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
o AS (SELECT v || w || x || y || z AS filter_order FROM {_PERMS}),
s AS (SELECT filter_order, step::INT AS step, (1 << (instr('ABCDE', filter_order[step]) - 1)::INT) AS bit,
  list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1)::INT))::BIGINT AS b
  FROM o, unnest(range(1, 6)) AS r(step)),
a AS (SELECT g.*, filter_order, step, m & bit != 0 AS fails, m & coalesce(b, 0) != 0 AS earlier, m = bit AS alone FROM g, s)
SELECT part, filter_order, step, {_SUM.format('NOT fails AND NOT earlier', 'n')} AS kept, {_SUM.format('fails AND NOT earlier', 'n')} AS removed,
{_SUM.format('fails AND earlier', 'n')} AS redundant, {_SUM.format('alone', 'n')} AS unique_fails, {_SUM.format('fails AND NOT earlier', 'good')} AS good_lost,
{_SUM.format('fails AND NOT earlier', 'toxic')} AS toxic_lost, {_SUM.format('fails', 'n * (120 // bit_count(m))')} AS shapley
FROM a GROUP BY part, filter_order, step"""
}
