"""Sources, sinks and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_jsonl(spark, paths: str | list[str], schema: str) -> DataFrame:
    """JSON lines, gzipped or not, from any number of files; the schema is given, so files are read once."""
    return spark.read.schema(schema).json(paths)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One Parquet folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def read_report(spark, path: str) -> DataFrame:
    return spark.read.json(path)


def new_only(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys a results table doesn't hold yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def metric_rows(report: DataFrame, keys: list[str]) -> DataFrame:
    """A wide report as (keys, metric, value); @ in names becomes _at_."""
    names = [c for c in report.columns if c not in keys]
    return report.unpivot(keys, names, "metric", "value").withColumn("metric", F.replace(F.col("metric"), F.lit("@"), F.lit("_at_")))


def table_lines(report: DataFrame, keys: list[str]) -> DataFrame:
    """(line, text): a report's metrics, in the order of its columns, as the lines of a Markdown table. A metric named
    x_low beside x and x_high is shown as its interval."""
    names = [c for c in report.columns if c not in keys]
    whole = [n for n in names if not (n.endswith(("_low", "_high")) and n.rsplit("_", 1)[0] in names)]
    with_interval = any(f"{n}_low" in names for n in whole)
    head = ["| Metric | Score |" + " 95% interval |" * with_interval, "| :--- | :---: |" + " :---: |" * with_interval]
    lines = [F.lit(h) for h in head]
    for n in whole:
        if f"{n}_low" in names and f"{n}_high" in names:
            lines.append(F.format_string("| %-12s | %.4f | [%.4f, %.4f] |", F.lit(n.upper()), F.col(f"`{n}`"), F.col(f"`{n}_low`"), F.col(f"`{n}_high`")))
        else:
            lines.append(F.format_string("| %-12s | %.4f |" + " - |" * with_interval, F.lit(n.upper()), F.col(f"`{n}`")))
    return report.select(F.posexplode(F.array(*lines)).alias("line", "text")).select(F.col("line").cast("long").alias("line"), "text")


def project(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that df has, in the order wanted."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def row_digest(df: DataFrame):
    """sha256 of a row's columns in name order; nulls are told from empty strings."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n")) for c in sorted(df.columns)]), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """(n, digest) that doesn't depend on the order of rows: sums of four 32-bit pieces of the rows' digests (equal
    rows count each) put together. Sums are aggregated where rows stand; nothing is sorted or gathered."""
    h = df.select(row_digest(df).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return h.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *pieces), 256).alias("digest"))


def file_digests(spark, path: str) -> DataFrame:
    """(path, sha256) of the files in a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
