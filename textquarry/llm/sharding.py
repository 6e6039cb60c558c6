"""Size-tiered compaction of shards under a versioned manifest, by DataFrame operations only.

Arrivals are appended as small immutable Parquet shards, as many as the tasks that write them. Compaction reads the
manifest, groups shards of a similar size (one tier: a factor of `fanout`) into runs of about the target size, and
rewrites each run as one file; what is near the target already stays. Rows may have a place: then only shards that
follow each other by place form a run, merged files are sorted by it, and the manifest lists shards in its order.

A manifest is a Parquet folder of a unique name that lists the live shards. A version is a small file that names its
manifest. It is written under a temporary name and then linked (local folders) or renamed without overwriting (other file
systems) to the version's name, which succeeds for one writer only: of two that commit a version, the other is told so.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

TARGET_BYTES = 64 << 20
FANOUT = 4
#: Tiers count from shards of this size.
BASE_BYTES = 64 << 10
#: A list of up to so many files (some 20 MB) is broadcast, and handed to the reader as it is; longer ones are joined.
LISTED_FILES = 100_000

_MANIFEST = "path string, bytes long, rows long, version long, first struct<part: long, split: long, row: long>"


class VersionConflict(RuntimeError):
    """Another writer committed the version first; nothing of this commit is visible."""


class ShardStore:
    """A table under `root`, in a file system that Spark reaches, holding rows of one schema. Rows are kept in a struct,
    so columns may have any names. `ordered` stores keep rows by the place that append() is given."""

    def __init__(self, spark, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, ordered: bool = False):
        self.spark, self.root, self.target, self.fanout, self.ordered = spark, root.rstrip("/"), target_bytes, fanout, ordered
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # versions

    def version(self) -> int:
        """The last committed version, 0 if none."""
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max([0, *(int(n[1:]) for n in names if n[:1] == "v")])

    def _marker(self, version: int) -> str:
        return f"{self.root}/versions/v{version:09d}"

    def manifest(self, *versions: int) -> DataFrame:
        """(path, bytes, rows, version, first place) of the live shards of the versions, the last if none is named."""
        names = []
        for version in versions or (self.version(),):
            if version:
                stream = self._fs.open(self._path(self._marker(version)))
                names.append(f"{self.root}/manifests/" + self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
        return self.spark.read.schema(_MANIFEST).parquet(*names) if names else self.spark.createDataFrame([], _MANIFEST)

    def _claim(self, version: int, text: str) -> None:
        """Makes the version's file with this text, or raises VersionConflict if it exists: whole or not at all."""
        made, wanted = f"{self.root}/versions/_{uuid.uuid4().hex}", self._marker(version)
        out = self._fs.create(self._path(made), False)
        out.writeBytes(text)
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                local = lambda p: self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(wanted), local(made))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
                plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self._path(made), self._path(wanted), plain)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise VersionConflict(f"version {version} exists") from error
            raise
        finally:
            self._fs.delete(self._path(made), False)

    def commit(self, shards: DataFrame, version: int) -> int:
        """Makes `shards` the manifest of a version, or raises VersionConflict and leaves nothing."""
        name = uuid.uuid4().hex
        shards.select("path", "bytes", "rows", "version", "first").coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        try:
            self._claim(version, name)
        except VersionConflict:
            self._fs.delete(self._path(f"{self.root}/manifests/{name}"), True)
            raise
        return version

    # shards

    def _written(self, folder: str, version: int) -> DataFrame:
        """The shards in a folder, as the manifest lists them; of the rows only the places are read."""
        if not self._holds_files(folder):
            return self.manifest(0)
        first = F.min("place") if self.ordered else F.lit(None)
        meta = self.spark.read.option("recursiveFileLookup", "true").parquet(folder)
        meta = meta.select("_metadata.file_path", "_metadata.file_size", *(["place"] if self.ordered else []))
        made = meta.groupBy(F.col("file_path").alias("path"), F.col("file_size").alias("bytes")).agg(F.count("*").alias("rows"), first.alias("first"))
        return made.select("path", "bytes", "rows", F.lit(version).cast("long").alias("version"), F.col("first").cast("struct<part: long, split: long, row: long>").alias("first"))

    def _holds_files(self, folder: str) -> bool:
        files = self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            if files.next().getPath().getName().endswith(".parquet"):
                return True
        return False

    def _wrapped(self, rows: DataFrame, place: Column | None) -> list[Column]:
        if self.ordered and place is None:
            raise ValueError("an ordered store needs the place of its rows")
        return [F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), *([place.alias("place")] if self.ordered else [])]

    def _add(self, folder: str, tries: int = 100) -> int:
        """Commits the shards of a folder behind the last version; if another writer was faster, behind its version."""
        for _ in range(tries):
            version = self.version() + 1
            try:
                return self.commit(self.manifest(version - 1).unionByName(self._written(folder, version)), version)
            except VersionConflict:
                continue
        raise VersionConflict(f"no version was free in {tries} tries")

    def append(self, rows: DataFrame, place: Column | None = None) -> int:
        """Writes rows as new small shards, one per task, and commits them."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        made = rows.select(*self._wrapped(rows, place))
        (made.sortWithinPartitions("place") if self.ordered else made).write.option("compression", "zstd").parquet(folder)
        return self._add(folder)

    def stage(self, rows: DataFrame, by: Column, place: Column | None = None) -> list[str]:
        """Writes several arrivals in one pass over rows: the folders of the values of `by` (integers), in their order.
        Nothing is visible until add() commits a folder. In an ordered store a shard holds one `part` of places."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        made, keys = rows.select(*self._wrapped(rows, place), by.alias("arrival")), ["arrival"]
        if self.ordered:
            made, keys = made.withColumn("part", F.col("place.part")), ["arrival", "part"]
            made = made.sortWithinPartitions("arrival", "part", "place")
        made.write.option("compression", "zstd").partitionBy(*keys).parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        return [f"{folder}/{n}" for n in sorted((n for n in names if n.startswith("arrival=")), key=lambda n: int(n[8:]))]

    def add(self, folder: str) -> int:
        """Commits an arrival that stage() wrote."""
        return self._add(folder)

    def plan(self, shards: DataFrame, least: int = 2) -> DataFrame:
        """shards with tier and run; run is null for shards near the target and where fewer than `least` would merge.
        Its windows hold a tier's (or, by place, all) rows of the manifest, some 200 bytes a file, not of the table."""
        near = F.col("bytes") * 2 > self.target
        tier = F.floor(F.log(F.greatest(F.col("bytes") / BASE_BYTES, F.lit(1.0))) / F.log(F.lit(float(self.fanout))))
        made = shards.withColumn("tier", F.when(near, F.lit(-1)).otherwise(tier).cast("int"))
        if self.ordered:  # only neighbours of one tier may merge
            along = Window.orderBy("first", "path")
            made = made.withColumn("new", F.coalesce((F.col("tier") != F.lag("tier").over(along)).cast("int"), F.lit(0)))
            made = made.withColumn("group", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
            inside = Window.partitionBy("group").orderBy("first", "path")
        else:
            made = made.withColumn("group", F.col("tier").cast("long"))
            inside = Window.partitionBy("group").orderBy("version", "path")
        before = F.coalesce(F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        made = made.withColumn("run", F.floor(before / F.lit(self.target)))
        several = F.count("*").over(Window.partitionBy("group", "run")) >= least
        made = made.withColumn("run", F.when(several & (F.col("tier") >= 0), F.concat_ws("-", "group", "run"))).drop("group")
        # runs are numbered, so that each is rewritten by a task of its own
        return made.withColumn("task", F.when(F.col("run").isNotNull(), F.dense_rank().over(Window.orderBy(F.col("run").isNull(), "run")) - 1))

    def compact(self, least: int = 2) -> int:
        """One round of merging; commits a version and returns it, or returns the old one if there is no run."""
        version = self.version() + 1
        planned = common.cut(self.plan(self.manifest(version - 1), least))
        n_runs = planned.agg(F.coalesce(F.max("task") + 1, F.lit(0))).first()[0]
        if not n_runs:
            return version - 1
        runs = planned.where("run is not null").select("path", "task")
        rows, listed = self._read(runs)
        side = F.broadcast(runs) if listed else runs
        rows = rows.withColumn("at", F.col("_metadata.file_path")).join(side, F.col("at") == F.col("path")).drop("at", "path")
        rows = rows.repartitionById(n_runs, "task").drop("task")
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        (rows.sortWithinPartitions("place") if self.ordered else rows).write.option("compression", "zstd").parquet(folder)
        kept = planned.where("run is null").drop("tier", "run", "task")
        try:
            return self.commit(kept.unionByName(self._written(folder, version)), version)
        except VersionConflict:  # the shards it read may be gone from the newer version: what it wrote is of no use
            self._fs.delete(self._path(folder), True)
            raise

    def expire(self) -> None:
        """Deletes what earlier versions list and the last one doesn't; readers of older versions must have ended."""
        last = self.version()
        old = [int(s.getPath().getName()[1:]) for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if s.getPath().getName()[:1] == "v"] if last else []
        old = [v for v in old if v < last]
        if old:
            gone = self.manifest(*old).select("path").distinct().join(self.manifest(last).select("path"), "path", "left_anti")
            for r in gone.toLocalIterator():
                self._fs.delete(self._path(r.path), False)
        for v in old:
            self._fs.delete(self._path(self._marker(v)), False)

    def _read(self, shards: DataFrame) -> tuple[DataFrame, bool]:
        """The files of a list of shards, and whether it is short; a longer one is not handed to the reader by name: all
        folders of the store are read, and the caller must join with the list."""
        paths = [r.path for r in shards.select("path").take(LISTED_FILES + 1)]
        reader = self.spark.read.option("recursiveFileLookup", "true")
        if len(paths) > LISTED_FILES:
            return reader.parquet(f"{self.root}/data"), False
        return reader.parquet(*paths), True

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None if it lists no shard."""
        stored = self.read_places(version)
        return None if stored is None else stored.select("row.*")

    def read_places(self, version: int | None = None) -> DataFrame | None:
        """(row, and place in an ordered store) of a version; None if it lists no shard."""
        shards = self.manifest(*([] if version is None else [version]))
        if not shards.limit(1).count():
            return None
        rows, listed = self._read(shards)
        if listed:
            return rows
        return rows.withColumn("at", F.col("_metadata.file_path")).join(shards.select("path"), F.col("at") == F.col("path"), "left_semi").drop("at")


def arrival(doc_id: str = "doc_id") -> Column:
    """Arrivals of uneven sizes: by the first digit of a hash of the id, a half, a quarter, an eighth, the rest."""
    digit = F.substring(F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")), 1, 1)
    return F.when(digit < "8", 0).when(digit < "c", 1).when(digit < "e", 2).when(digit == "e", 3).otherwise(4)


def places(docs: DataFrame) -> Column:
    """Where a row stands in the files that docs are read from: number and split of the part file, and the row's number
    in it, so that a range-sorted table keeps its order. Frames that aren't read from files give their own order."""
    if not common.reads_files(docs):
        return F.struct(F.spark_partition_id().cast("long").alias("part"), F.lit(0).cast("long").alias("split"), F.monotonically_increasing_id().alias("row"))
    number = lambda pattern: F.coalesce(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("long"), F.lit(0))
    return F.struct(number(r"^part-(\d+)").alias("part"), number(r"-c(\d+)\.").alias("split"), F.col("_metadata.row_index").cast("long").alias("row"))


def shard_table(docs: DataFrame, target_bytes: int = TARGET_BYTES, name: str = "arrival", doc_id: str = "doc_id", place_name: str | None = None, root: str | None = None) -> DataFrame:
    """docs and their arrival, through a new store (at `root`, else in the shared folder; the result is read from it, so
    it is the caller's to delete): written in one pass, the arrivals are committed
    one after another, then compacted until no run is left, and read back from the manifest.

    Without `place_name`, arrivals go by a hash of the id. With it, docs are taken in the order of their files: arrivals
    are consecutive stretches of it, shards keep it, and the place is a column of the result. Rows are never changed, merged
    or dropped: nulls, empty and very long texts, ties and repeated rows come back as they were; an empty table comes
    back empty. docs may have columns of any names: where one has that of a new column, the new one gets an underscore more.
    """
    spark, ordered = docs.sparkSession, place_name is not None
    store = ShardStore(spark, root or f"{common.checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}", target_bytes, ordered=ordered)
    name = common.free_name(docs.columns, name)
    plain = [F.col(f"`{c}`") for c in docs.columns]
    if ordered:
        place_name = common.free_name([*docs.columns, name], place_name)
        place = places(docs)
        last = docs.select(F.max(place["part"])).first()[0]
        share = place["part"] / F.lit(float((last or 0) + 1))
        when = F.when(share < 1 / 2, 0).when(share < 3 / 4, 1).when(share < 7 / 8, 2).when(share < 15 / 16, 3).otherwise(4)
        rows = docs.select(*plain, when.alias(name), place.alias(place_name))
        folders = store.stage(rows, F.col(f"`{name}`"), F.col(f"`{place_name}`"))
    else:
        rows = docs.select(*plain, arrival(doc_id).alias(name))
        folders = store.stage(rows, F.col(f"`{name}`"))
    version = 0
    for folder in folders:
        version = store.add(folder)
    while (done := store.compact()) != version:
        version = done
    store.expire()
    out = store.read()
    return rows.where("false") if out is None else out


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    """doc_id, arrival, n_bytes and text_sha256 of all documents, read back from the compacted shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with common.scratch(spark) as root:
        made = shard_table(docs, root=root)
        return common.cut(made.select("doc_id", "arrival", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")))


SQL = {
    "op3_sharding": r"""
SELECT doc_id, CASE WHEN md5(doc_id::VARCHAR) < '8' THEN 0 WHEN md5(doc_id::VARCHAR) < 'c' THEN 1 WHEN md5(doc_id::VARCHAR) < 'e' THEN 2 WHEN md5(doc_id::VARCHAR) < 'f' THEN 3 ELSE 4 END AS arrival,
       strlen(text)::BIGINT AS n_bytes, sha256(text) AS text_sha256
FROM documents""",
}
