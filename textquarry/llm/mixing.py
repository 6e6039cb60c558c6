"""Mixing sources to target weights along a time-varying curriculum.

Each source has a target number of words and a schedule: a piecewise linear density over training time 0 to 1. The
density is integrated; a document's place in its source's cumulative demand is inverted through that integral to a
position in time, and documents are range-sorted by position. All of it is DataFrame expressions: places come from
prefix sums in two levels (sums of hashed bins, then a window inside each bin), so that a source holding most rows
is spread over as many tasks as it has bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating; null is the last source.
WEIGHTS = (5, 2, 1)
#: The mix holds so many times all words, and no source more than CAP times its own.
SHARE = 1.5
CAP = 2
#: Density by weight's place: heavy sources fade, light ones grow. Knots are (time, density before normalising).
CURRICULUM = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Rows of a bin, on average; bins are hash prefixes of up to 16 bits.
BIN_ROWS = 200
#: Words of a range of positions, on average: some 10 MB of text.
PART_WORDS = 1_500_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def inverse(schedule: tuple[tuple[float, float], ...], u: Column) -> Column:
    """Time at which the integral of the density, as a share of its whole, reaches u."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule[:-1], schedule[1:]):
        pieces.append((area, t0, t1, w0, w1))
        area += (w0 + w1) / 2 * (t1 - t0)
    out = F.lit(1.0)
    for start, t0, t1, w0, w1 in reversed(pieces):
        slope = (w1 - w0) / (t1 - t0)
        left = u * F.lit(area) - F.lit(start)
        root = (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * left, F.lit(0.0))) - F.lit(w0)) / F.lit(slope) if slope else left / F.lit(w0)
        end = start + (w0 + w1) / 2 * (t1 - t0)
        out = F.when(u <= F.lit(end / area), F.lit(t0) + root).otherwise(out)
    return out


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, place, target) of the sources in `sized` (source, size).

    Water-filling in closed form: in order of size over weight, a source is full while its cap is at most its share
    of what those before it leave; the first that isn't full sets the level of all that follow.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    place = F.pmod(rank, F.lit(len(weights)))
    per = per.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("place") + 1).cast("long"))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum(cap * F.col("source_size")).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - full) / left)
    needs = (cap * F.col("source_size")) / F.col("weight")
    per = per.withColumn("level", F.max(F.when(needs > F.col("level"), F.col("level"))).over(everything))
    wanted = F.round(F.least((cap * F.col("source_size")).cast("double"), F.coalesce(F.col("weight") * F.col("level"), (cap * F.col("source_size")).cast("double"))), 6)
    return per.select("source", "source_size", "place", wanted.alias("target"))


def mix(docs: DataFrame, size: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(row, size, source_size, target, copies, before) for every row of docs; `row` is a struct of its columns, so
    no name clashes. A source is read in hash order as often as its target asks: a document is taken once for each
    round in which its middle lies before the target, at most `cap` times.

    Null text has size 0, very long texts are sizes like others; null sources form one source; repeated rows are taken
    one by one and ties of the hash go by id and size (which of equal rows is taken more often makes no difference); rows with
    a null id are spread by their text; empty tables give empty results.
    """
    unnamed = F.xxhash64(*[F.col(c) for c in (source, text) if c in docs.columns]).cast("string")
    order = F.md5(F.coalesce(F.col(doc_id).cast("string"), unnamed).cast("binary"))
    # hash prefixes shared by tasks: the number of bins follows the number of rows
    n = docs.count()
    bits = min(16, max(0, (n // BIN_ROWS).bit_length()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), F.col(source).alias("source"), (words(F.col(text)) if size is None else size).alias("size"), order.alias("hash"))
    rows = rows.withColumn("bin", F.shiftright(F.conv(F.substring("hash", 1, 4), 16, 10).cast("int"), 16 - bits))
    cells = common.cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")))
    by_bin = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select("source", "bin", F.coalesce(F.sum("size").over(by_bin), F.lit(0)).alias("base"))
    goal = targets(cells.select("source", "size"), weights, share, cap)
    known = base.join(goal, base.source.eqNullSafe(goal.source)).select(base.source.alias("s"), F.col("bin").alias("b"), "base", "source_size", "place", "target")
    known = common.cut(known)
    joined = rows.join(known, rows.source.eqNullSafe(known.s) & (rows.bin == known.b))
    inside = Window.partitionBy("s", "b").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = joined.withColumn("before", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    copies = sum((((2 * (e * F.col("source_size") + F.col("before")) + F.col("size")) < 2 * F.col("target")).cast("int") for e in range(cap)), F.lit(0))
    return joined.select("row", "size", "source_size", "target", "place", copies.alias("copies"), "before")


def position(round_number: Column, curriculum=CURRICULUM) -> Column:
    """Training position, 0 to 1, of a document's copy in a round (0, 1, ...)."""
    u = F.least((F.col("before") + round_number * F.col("source_size") + F.col("size") / 2) / F.col("target"), F.lit(1.0))
    out = F.lit(None).cast("double")
    for k, schedule in enumerate(curriculum):
        out = F.when(F.col("place") % len(curriculum) == k, inverse(schedule, u)).otherwise(out)
    return out


def mixed_rows(docs: DataFrame, curriculum=CURRICULUM, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as it is taken (words or not), range-sorted by position; its columns only.

    Places are found for sizes and hashes alone; then texts are shuffled twice, to meet their places and into ranges. The
    ranges are cut on the places, so no text is sampled. Rows are told apart by where they stand in their files (a frame
    that isn't read from files is written to the shared folder first), so equal rows and null ids need no care.
    """
    rows = common.identified(docs)
    own = F.col("row")
    slim = common.cut(rows.select("at", own[doc_id].alias("doc_id"), own[source].alias("source"), words(own[text]).alias("n"), F.xxhash64(own[text]).alias("text")))
    taken = mix(slim, F.col("n"), **options).where("copies > 0")
    taken = taken.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    taken = taken.select(F.col("row.at").alias("at"), position(F.col("round"), curriculum).alias("position"), "size")
    volume = slim.agg(F.sum("n")).first()[0] or 0
    parts = int(volume * SHARE // PART_WORDS) + 1
    taken = common.cut(taken.repartitionByRange(parts, "position").select("at", "position", F.spark_partition_id().alias("part")))
    joined = rows.join(taken, "at")
    return joined.repartitionById(parts, "part").sortWithinPartitions("position", "at").select("row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and the first position (null if nothing is taken) of all documents,
    range-sorted by that position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # of the text its hash is enough: it spreads rows without an id
    slim = common.cut(docs.select("doc_id", "source", words(F.col("text")).alias("n"), F.xxhash64("text").alias("text")))
    made = mix(slim, F.col("n"))
    made = made.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.when((F.col("copies") > 0) & (F.col("size") > 0), F.round(position(F.lit(0)), 6)).alias("position"))
    # ids split the range of the documents that aren't taken; cut, since ranges are found by a run of their own
    return common.cut(made).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


SQL = {
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][place + 1] AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
g AS (SELECT source, source_size, place, round(least(2.0::DOUBLE * source_size, coalesce(weight * max(CASE WHEN 2.0::DOUBLE * source_size / weight > level THEN level END) OVER (), 2.0::DOUBLE * source_size)), 6) AS target FROM l),
p AS (SELECT doc_id, size, source_size, target, place, (sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (2 * before + size < 2 * target)::INT + (2 * (source_size + before) + size < 2 * target)::INT AS copies, least((before + size / 2.0::DOUBLE) / target, 1.0::DOUBLE) AS u FROM p)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 AND size > 0 THEN round(CASE place
         WHEN 0 THEN 0.0::DOUBLE + (sqrt(greatest(2.25::DOUBLE + -2.0::DOUBLE * u, 0)) - 1.5::DOUBLE) / -1.0::DOUBLE
         WHEN 1 THEN CASE WHEN u <= 0.5 THEN u ELSE 0.5::DOUBLE + (u - 0.5::DOUBLE) END
         ELSE CASE WHEN u <= 0.375 THEN 0.0::DOUBLE + (sqrt(greatest(0.25::DOUBLE + 2.0::DOUBLE * u, 0)) - 0.5::DOUBLE) / 1.0::DOUBLE
                   ELSE 0.5::DOUBLE + (sqrt(greatest(1.0::DOUBLE + 2.0::DOUBLE * (u - 0.375::DOUBLE), 0)) - 1.0::DOUBLE) / 1.0::DOUBLE END END, 6) END AS position
FROM c""",
}
