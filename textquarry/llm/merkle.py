"""Merkle trees over a dataset: a tree per group of rows, a tree over the groups' roots, and a proof for every row.

Leaves get places by range partitions, so a group of any size is spread. A level is one window: nodes are partitioned by
group and parent, and an ordered list over the whole frame of at most FANOUT nodes gives both what the parent hashes and
each node's siblings; one row per parent goes on to the next level. Proofs are handed down the levels, from the root to
the leaves, by equal joins on (group, parent). Each level is written to a folder, a third of the one below.

Defined results: fields of any type are hashed as their UTF-8 text, null as "-"; equal rows are leaves of equal hashes
side by side; null ids come first, null groups are a group and come first; rows of one id stand in the order of their
hashes; a text of any length is hashed where it stands; an empty table gives an empty result and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FANOUT = 3
#: Levels of up to so many nodes (each some 2 KB of proof) are broadcast where proofs are handed down.
BROADCAST_NODES = 4096


def field(value: Column) -> Column:
    """A value as hashed: its bytes, a colon and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256 of a string."""
    return F.sha2(parts.cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(c) for c in fields]))


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


@dataclass
class Tree:
    """leaves: (group, place, n, hash, and what came with them). levels: the nodes of each level (group, place, parent, n, hash,
    before, after: the siblings' hashes on either side), of which those with n = 1 are roots. groups: (group, n)."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame


def placed(leaves: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """leaves (group, doc_id, hash, ...) with their place in their group and its size n; and (group, n). A task counts its own
    range; what stands before it in a group is added."""
    leaves.repartitionByRange("group", "doc_id", "hash").sortWithinPartitions("group", "doc_id", "hash").withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{folder}/leaves")
    spark = leaves.sparkSession
    rows = spark.read.parquet(f"{folder}/leaves").withColumn("range", F.shiftright("at", 33))
    # as many rows as ranges and groups
    runs = rows.groupBy("group", "range").agg(F.min("at").alias("first"), F.count("*").alias("own"))
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("group")
    runs.select("group", "range", (F.col("first") - F.coalesce(F.sum("own").over(earlier), F.lit(0))).alias("shift"), F.sum("own").over(whole).alias("n")).write.parquet(f"{folder}/runs")
    runs = spark.read.parquet(f"{folder}/runs")
    made = rows.join(runs, ["group", "range"]).withColumn("place", F.col("at") - F.col("shift")).drop("at", "range", "shift")
    return made, runs.groupBy("group").agg(F.first("n").alias("n"))


def tree(leaves: DataFrame, groups: DataFrame, folder: str, fanout: int = FANOUT) -> Tree:
    """Levels of leaves (group, place, n, hash, ...), written to `folder`."""
    spark = leaves.sparkSession
    nodes = leaves.select("group", "place", "n", F.unhex("hash").alias("hash"))
    levels: list[DataFrame] = []
    most = groups.agg(F.max("n")).first()[0] or 0
    while most:
        siblings = Window.partitionBy("group", "parent").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        run = nodes.withColumn("parent", F.floor(F.col("place") / fanout).cast("long")).withColumn("run", F.collect_list("hash").over(siblings))
        at = (F.col("place") % fanout).cast("int")
        joined = lambda part: F.aggregate(part, F.lit(b""), lambda a, x: F.concat(a, x))
        after = F.slice("run", at + 2, F.greatest(F.size("run") - at - 1, F.lit(0)))
        level = run.select("group", "place", "parent", "n", "hash", joined(F.slice("run", F.lit(1), at)).alias("before"), joined(after).alias("after"))
        level.write.parquet(f"{folder}/level-{len(levels)}")
        level = spark.read.parquet(f"{folder}/level-{len(levels)}")
        levels.append(level)
        # one row per parent: its first node's
        parents = level.where((F.col("n") > 1) & (F.col("place") % fanout == 0))
        nodes = parents.select("group", F.col("parent").alias("place"), F.ceil(F.col("n") / fanout).alias("n"), F.unhex(digest(_hex(F.concat("before", "hash", "after")))).alias("hash"))
        most = -(-most // fanout) if most > 1 else 0
    return Tree(leaves, levels, groups)


def roots(made: Tree) -> DataFrame:
    """(group, root): the one node that is left of each group."""
    out = None
    for level in made.levels:
        own = level.where("n = 1").select("group", _hex(F.col("hash")).alias("root"))
        out = own if out is None else out.unionAll(own)
    return made.groups.select("group", F.lit(None).cast("string").alias("root")).limit(0) if out is None else out


def proofs(made: Tree) -> DataFrame:
    """(group, place, steps): for every leaf, from its own level up, the siblings before and after it."""
    steps, size = None, None
    nodes = [made.groups.agg(F.sum("n")).first()[0] or 0] if made.levels else []
    for _ in made.levels[1:]:
        nodes.append(-(-nodes[-1] // FANOUT) + 1)
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    for k in range(len(made.levels) - 1, -1, -1):
        level = made.levels[k]
        # a root's own level has nothing beside it
        own = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(none)
        level = level.select("group", "place", "parent", own.alias("own"))
        if steps is None:
            steps = level.select("group", "place", F.col("own").alias("steps"))
        else:
            above = steps.select("group", F.col("place").alias("parent"), "steps")
            above = F.broadcast(above) if size <= BROADCAST_NODES else above
            steps = level.join(above, ["group", "parent"], "left").select("group", "place", F.concat("own", F.coalesce("steps", none)).alias("steps"))
        size = nodes[k] + made.groups.count() if k == len(made.levels) - 1 else nodes[k]
    return steps


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf's hash and its siblings make."""
    return F.aggregate(steps, leaf, lambda a, s: digest(F.concat(_hex(s["before"]), a, _hex(s["after"]))))


def proof_digest(steps: Column) -> Column:
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), ""))


def manifest(rows: DataFrame, folder: str) -> DataFrame:
    """rows (group, doc_id, hash, ...) with subroot, root and steps: the siblings from the leaf to the root. The folder keeps
    all levels: the manifest of the dataset."""
    leaves, groups = placed(rows, f"{folder}/rows")
    groups.write.parquet(f"{folder}/groups")
    groups = rows.sparkSession.read.parquet(f"{folder}/groups")
    own = tree(leaves, groups, f"{folder}/tree")
    subroots = roots(own).select(F.col("group").alias("doc_id"), F.col("root").alias("hash"), F.lit("").alias("group"))
    tops, all_groups = placed(subroots, f"{folder}/roots")
    top = tree(tops, all_groups, f"{folder}/top")
    upper = proofs(top)
    if upper is None:
        return rows.withColumns({"subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string"), "steps": F.array().cast("array<struct<before:binary,after:binary>>")}).limit(0)
    root = roots(top).first().root
    by_group = tops.select("place", F.col("doc_id").alias("group"), F.col("hash").alias("subroot")).join(upper.select("place", F.col("steps").alias("upper")), "place").drop("place")
    by_group.write.parquet(f"{folder}/subroots")
    by_group = rows.sparkSession.read.parquet(f"{folder}/subroots")
    by_group = F.broadcast(by_group) if groups.count() <= BROADCAST_NODES else by_group
    joined = leaves.join(proofs(own), ["group", "place"]).join(by_group, "group")
    return joined.select(*rows.columns, "subroot", F.lit(root).alias("root"), F.concat("steps", "upper").alias("steps"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = lambda text: [*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), text]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    # null groups first: every other group has a letter before it
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    leaf = leaf_hash(fields(F.col("text")))
    cut = leaf_hash(fields(F.replace("text", F.lit("\n"))))
    rows = docs.select(group.alias("group"), "doc_id", leaf.alias("hash"), F.when(tampered, F.unhex(cut)).alias("tampered"))
    with common.scratch(spark) as folder:
        made = manifest(rows, folder)
        folded = fold(F.coalesce(_hex(F.col("tampered")), F.col("hash")), F.col("steps"))
        made = made.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
        return common.cut(made.withColumn("verified", F.col("folded_root") == F.col("root")))


_F = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_F(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, source: str) -> str:
    """CTEs of the nodes of all levels, name(k, g, n, i, h), from source(g, n, i, h)."""
    return f"""{name}(k, g, n, i, h) AS (SELECT 0, g, n, i, h FROM {source} UNION ALL
SELECT k + 1, g, (n + 2) // 3, i // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, g, n, i // 3)"""


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""
_BESIDE = """SELECT {0} AS tree, k, g, i, n, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {1} WINDOW w AS (PARTITION BY k, g, i // 3 ORDER BY i)"""
SQL = {
    "op13_merkle": f"""WITH RECURSIVE lf AS (SELECT doc_id, coalesce('s' || source, '') AS g, {_LEAF('text')} AS h,
  CASE WHEN {_CRC} % 2 = 0 THEN {_LEAF("replace(text, chr(10), '')")} END AS t FROM documents),
pl AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM lf),
{_levels('lo', 'pl')}, sr AS (SELECT g AS own, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lo WHERE n = 1),
tp AS (SELECT '' AS g, n, i, subroot AS h FROM sr), {_levels('up', 'tp')}, nb AS ({_BESIDE.format(0, 'lo')} UNION ALL {_BESIDE.format(1, 'up')}),
pf(doc_id, g, leaf, tree, k, i, n, cur, proof) AS (SELECT doc_id, g, h, 0, 0, i, n, coalesce(t, h), '' FROM pl UNION ALL
  SELECT doc_id, pf.g, leaf, CASE WHEN pf.n > 1 THEN pf.tree ELSE 1 END, CASE WHEN pf.n > 1 THEN pf.k + 1 ELSE 0 END, CASE WHEN pf.n > 1 THEN pf.i // 3 ELSE sr.i END,
    CASE WHEN pf.n > 1 THEN (pf.n + 2) // 3 ELSE sr.n END, CASE WHEN pf.n > 1 THEN sha256(before || cur || after) ELSE cur END, CASE WHEN pf.n > 1 THEN proof || before || after ELSE proof END
  FROM pf JOIN sr ON sr.own = pf.g JOIN nb ON nb.tree = pf.tree AND nb.k = pf.k AND nb.i = pf.i AND nb.g = CASE WHEN pf.tree = 0 THEN pf.g ELSE '' END WHERE pf.tree = 0 OR pf.n > 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM up WHERE n = 1) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT h FROM up WHERE n = 1) AS verified
FROM pf JOIN sr ON sr.own = pf.g WHERE pf.tree = 1 AND pf.n = 1"""
}
