"""A training corpus from raw documents: quality, near-duplicates, decontamination, mixing, sharding.

STAGES lists the stages; run() applies them, each written as Parquet into the shared folder and read again. Each stage
takes rows with nulls in any column, empty and very long texts, ties, repeated rows, columns of any further names, and
empty tables; what it makes of them is said where its operator is defined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import common, decontamination, mixing, quality, sharding, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, scores at 0.5 or more. Null texts
    are scored as empty ones; without usable labels all stay; equal texts share their fate; an empty table stays empty."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of the smallest doc_id (null last). Null, empty and blank texts form
    one component; of repeated rows one stays; an empty table stays empty."""
    return simhash.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark. Null and empty texts are clean; repeated rows are judged one
    by one; an empty table stays empty."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, range-sorted into part files by their place in the curriculum. Null
    sources are one source; texts without words are taken like others; an empty table stays empty."""
    return mixing.mixed_rows(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str, root: str | None = None) -> DataFrame:
    """All rows, read from a compacted shard store (at root, else at a place of its own in the shared folder) that keeps the
    order of the files of docs. shard_arrival tells a row's arrival, shard_place (sortable) its place in that order; either
    has an underscore more where docs has its name. The store is the caller's, as is its deletion."""
    root = root or f"{common.checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    return sharding.shard_table(docs, name="shard_arrival", place_name="shard_place", root=root)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

#: The classifier and the fingerprints have no SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The rows of the last stage. If a stage fails, the error names a folder; given that, run() goes on behind the last
    finished stage. Once all are finished, only what the last one made stays: a sharding stage's store, in
    `folder`/<its name>, with its manifest and shards of the target size, of which the rows are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{common.checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        try:
            docs = _stored(spark, stage, docs, sf_dir, at) if stage is write_shards else _written(spark, stage, docs, sf_dir, at)
        except Exception as error:
            raise RuntimeError(f"stage {name} failed; run(spark, sf_dir, {folder!r}) goes on with it") from error
    for name, _ in STAGES[:-1]:
        common.delete(spark, f"{folder}/{name}")
    return docs


def _written(spark: SparkSession, stage, docs: DataFrame, sf_dir: str, at: str) -> DataFrame:
    if not common.finished(spark, at):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def _stored(spark: SparkSession, stage, docs: DataFrame, sf_dir: str, at: str) -> DataFrame:
    if common.finished(spark, at):
        kept = sharding.ShardStore(spark, at, ordered=True).read()
        if kept is not None:
            return kept
    common.delete(spark, at)  # what a failed run left
    made = stage(spark, docs, sf_dir, at)
    common.mark_finished(spark, at)
    return made
