"""Extension: keeps an index up to date from a stream of documents, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as bk
from ..operators import bm25


def keep_index(docs: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each batch's blocks of postings under its batch id; a batch that is run again overwrites
    its own folder, so retries add nothing twice. docs is a streaming frame of (doc_id, text)."""

    def add(batch: DataFrame, batch_id: int) -> None:
        bm25.block_rows(batch).write.mode("overwrite").option("parquet.block.size", bk.ROW_GROUP_BYTES).parquet(f"{path}/blocks/batch={batch_id}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_blocks(spark, path: str) -> DataFrame:
    return spark.read.schema(f"{bk.SCHEMA}, batch long").parquet(f"{path}/blocks").drop("batch")


def read_postings(spark, path: str) -> DataFrame:
    blocks = read_blocks(spark, path)
    return bm25.Index(blocks, blocks, 0, 0.0).postings


def read_index(spark, path: str, method: str = "robertson") -> bm25.Index:
    """The index of all batches so far: document frequencies and the mean length are summed from their blocks."""
    blocks = read_blocks(spark, path)
    vocab = blocks.where("term != ''").groupBy("term").agg(F.sum("n").alias("df"))
    n = blocks.where("term = ''").agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    total = blocks.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
    raw = vocab.agg(F.round(F.avg(bm25.raw_idf(F.lit(n), F.col("df"))), 9).alias("m")).first().m
    stats = bm25.Stats(n, total / n if n else 0.0, raw)
    return bm25.Index(blocks, vocab.withColumn("idf", bm25.idf(stats, method)), stats.n, stats.avgdl, None, stats, method)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark; for streaming or static frames."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
