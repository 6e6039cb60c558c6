"""Hard-negative mining: candidates by score, exclusion in tiers, and a fill drawn from the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unit_hash
from ..sources import store
from .numbering import numbered

#: Draws of a fill: the second round goes on behind the first. Of a query that still misses some after them, few documents
#: can be taken: these are listed.
DRAWS = (32, 288)
#: Draws, and the queries whose documents are listed at once, are broadcast up to so many; more draws are joined by shuffle.
BROADCAST_DRAWS = 400_000
LISTED_QUERIES = 10_000


def agreement(a: Column, b: Column) -> Column:
    """Equal places of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda t: t))


def tier(least_agreement: int = 45) -> Column:
    """What excludes a candidate (doc_id, query_text, skeleton, sig) of a target (target, q1, k1, s1): self, the same query
    text, the same skeleton (null: none), or signatures that agree in at least least_agreement places; else null."""
    return (
        F.when(F.col("doc_id") == F.col("target"), "self")
        .when(F.col("query_text") == F.col("q1"), "query_text")
        .when(F.col("skeleton") == F.col("k1"), "skeleton")
        .when(agreement(F.col("sig"), F.col("s1")) >= least_agreement, "signature")
    )


def targets(truth: DataFrame, prints: DataFrame) -> DataFrame:
    """truth (query_id, target) with the prints of the targets."""
    own = prints.select(F.col("doc_id").alias("target"), F.col("query_text").alias("q1"), F.col("skeleton").alias("k1"), F.col("sig").alias("s1"))
    return truth.join(own, "target")


def judged(scored: DataFrame, truth: DataFrame, prints: DataFrame, pool: int, least_agreement: int = 45) -> DataFrame:
    """Each query's pool of best candidates with the tier that excludes them (null: none). truth is (query_id, target);
    prints has (doc_id, query_text, skeleton, sig)."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    pooled = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= pool)
    joined = pooled.join(targets(truth, prints), "query_id").join(prints, "doc_id")
    return joined.select("query_id", "doc_id", "score", "place", tier(least_agreement).alias("tier"))


def fill(short: DataFrame, taken: DataFrame, prints: DataFrame, seed: int = 42, judge: bool = True) -> DataFrame:
    """(query_id, doc_id, place) of fillers for short (query_id, target, missing), in the order of place, from all documents of
    prints; at least as many as are missing, or all there are. As a candidate, a filler must pass the tiers (with
    judge; without, only not be the target), and it must not be in taken (query_id, doc_id).

    The j-th draw of a query is the document at place floor(hash(seed, query, j) * n). Where the draws don't do, because
    nearly all documents are excluded, the ones that aren't are listed in one scan, in the order of hash(seed, query, doc).
    """
    own = store.cut(targets(short.select("query_id", "target"), prints).join(short.select("query_id", "missing"), "query_id"))
    out = own.select("query_id", F.col("target").alias("doc_id"), F.lit(0.0).alias("place")).where("false")
    if not own.limit(1).count():
        return out
    excluded = tier().isNotNull() if judge else F.col("doc_id") == F.col("target")
    # only ids are numbered; what the tiers need is looked up for the documents drawn
    places = store.cut(numbered(prints.select("doc_id"), "doc_id", "at"))
    n, low = places.count(), 0
    for high in DRAWS:
        rows = own.select("query_id", F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long"))).alias("draw"))
        rows = rows.withColumn("at", F.floor(unit_hash(F.lit(seed), F.col("query_id"), F.col("draw")) * F.lit(n)).cast("long"))
        drawn = rows.groupBy("query_id", "at").agg(F.min("draw").alias("draw")).join(places, "at").join(taken, ["query_id", "doc_id"], "left_anti")
        drawn = store.cut(drawn.join(out, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "draw"))
        side = F.broadcast(drawn) if drawn.count() <= BROADCAST_DRAWS else drawn
        met = prints.join(side, "doc_id").join(own.select("query_id", "target", "q1", "k1", "s1"), "query_id").where(~excluded)
        out = store.cut(out.unionByName(met.select("query_id", "doc_id", F.col("draw").cast("double").alias("place"))))
        found = out.groupBy("query_id").agg(F.count("*").alias("found"))
        own = store.cut(own.drop("found").join(found, "query_id", "left").where(F.coalesce("found", F.lit(0)) < F.col("missing")))
        left, low = own.count(), high
        if not left:
            return out
    groups = -(-left // LISTED_QUERIES)
    for g in range(groups):
        # a stated, bounded set of queries against all rows; of each query and task no more leave than are missing
        asking = own.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        met = prints.join(F.broadcast(asking), ~excluded).select("query_id", "doc_id", F.col("missing") - F.coalesce("found", F.lit(0)))
        met = met.toDF("query_id", "doc_id", "missing").join(taken.unionByName(out.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_anti")
        order = unit_hash(F.lit(seed), F.col("query_id"), F.col("doc_id"))
        first = Window.partitionBy("query_id").orderBy("order", "doc_id")
        met = met.withColumn("order", order).withColumn("i", F.row_number().over(first)).where(F.col("i") <= F.col("missing"))
        out = out.unionByName(met.select("query_id", "doc_id", (F.lit(DRAWS[-1]) + F.col("i")).cast("double").alias("place")))
    return store.cut(out)


def filled(ranked: DataFrame, truth: DataFrame, prints: DataFrame, k: int, seed: int = 42, judge: bool = True) -> DataFrame:
    """(query_id, neg_pos, doc_id): the k best of ranked (query_id, doc_id, place), then fillers in the order they are drawn.
    Fewer than k come back only where fewer documents may be taken; nothing is repeated."""
    best = Window.partitionBy("query_id").orderBy("place")
    kept = store.cut(ranked.withColumn("neg_pos", F.row_number().over(best).cast("long")).where(F.col("neg_pos") <= k).select("query_id", "neg_pos", "doc_id"))
    have = kept.groupBy("query_id").agg(F.count("*").alias("have"))
    missing = F.lit(k) - F.coalesce("have", F.lit(0))
    short = truth.join(have, "query_id", "left").select("query_id", "target", missing.alias("missing")).where("missing > 0")
    more = fill(short, kept.select("query_id", "doc_id"), prints, seed, judge).join(short.select("query_id", "missing"), "query_id")
    drawn = Window.partitionBy("query_id").orderBy("place")
    more = more.withColumn("i", F.row_number().over(drawn)).where(F.col("i") <= F.col("missing"))
    return kept.unionByName(more.select("query_id", (F.lit(k) - F.col("missing") + F.col("i")).cast("long").alias("neg_pos"), "doc_id"))


def negatives(judgement: DataFrame, truth: DataFrame, prints: DataFrame, k: int = 7, seed: int = 42) -> DataFrame:
    """(query_id, neg_pos, doc_id): the k best candidates that no tier excludes, then fillers that none excludes."""
    return filled(judgement.where("tier is null").select("query_id", "doc_id", "place"), truth, prints, k, seed)


def checked(mined: DataFrame, truth: DataFrame, corpus: DataFrame) -> DataFrame:
    """mined, or ValueError where a query has itself, an unknown document, or one document twice as a negative."""
    wrong = mined.join(truth, "query_id", "left").where("target is null or doc_id = target").select("query_id", "doc_id")
    wrong = wrong.unionByName(mined.join(corpus.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id"))
    wrong = wrong.unionByName(mined.groupBy("query_id", "doc_id").count().where("count > 1").select("query_id", "doc_id"))
    bad = wrong.limit(5).collect()
    if bad:
        raise ValueError(f"negatives that can't be: {bad}")
    return mined


def gather(mined: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, ids, texts): each query's negatives in order."""
    joined = mined.join(docs.select("doc_id", "text"), "doc_id")
    rows = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("neg_pos", "doc_id", "text"))).alias("r"))
    return rows.select("query_id", F.col("r.doc_id").alias("ids"), F.col("r.text").alias("texts"))
