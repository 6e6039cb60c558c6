"""Tables that several queries share: built once into the shared folder, found again by what they were built from."""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

#: Part of every name: raise it when the layout of a kept table changes.
LAYOUT = 5


def shared_folder(spark) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, local mode gets a temporary one; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="textquarry_")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def finished(spark, folder: str) -> bool:
    """Whether a job wrote the folder to its end."""
    fs, path = _file_system(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores where it is read in fewer parts than there are (so it is small): only then is it shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def files_digest(spark, path: str) -> str:
    """A digest of the names, sizes and times of the files under a path: another one as soon as a file changes."""
    fs, made = _file_system(spark, path)
    digest, files = hashlib.sha256(), []
    if fs.getFileStatus(made).isFile():
        statuses = [fs.getFileStatus(made)]
    else:
        listed, statuses = fs.listFiles(made, True), []
        while listed.hasNext():
            statuses.append(listed.next())
    for s in statuses:
        files.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
    for line in sorted(files):
        digest.update(line.encode() + b"\n")
    return digest.hexdigest()


def kept(spark, name: str, made_from: str, build: Callable[[str], None], rows: int | None = None) -> str:
    """The folder of a kept table: found, or built by build(folder) under a name of its own and then renamed, so that a
    build that failed or was overtaken by another is never taken for the table. With `rows`, a table found with another
    number of rows is not trusted: it is deleted and built again, and a built one of another number is an error."""
    digest = hashlib.sha256(f"{LAYOUT}|{name}|{made_from}".encode()).hexdigest()[:24]
    folder = f"{shared_folder(spark)}/kept/{name}-{digest}"
    fs, path = _file_system(spark, folder)
    wrong = lambda at: rows is not None and spark.read.parquet(at).count() != rows
    if fs.exists(path) and wrong(folder):
        fs.delete(path, True)
    if not fs.exists(path):
        own = f"{shared_folder(spark)}/kept/_{uuid.uuid4().hex}"
        build(own)
        if wrong(own):
            fs.delete(_file_system(spark, own)[1], True)
            raise ValueError(f"{name} was built with another number of rows than {rows}")
        _, source = _file_system(spark, own)
        # if another build was faster, its table stays; one that slips in here would be put inside it, where no reader looks
        if fs.exists(path) or not fs.rename(source, path):
            fs.delete(source, True)
            if not fs.exists(path):
                raise OSError(f"could not rename {own} to {folder}")
    return folder


def delete(spark, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


@contextlib.contextmanager
def scratch(spark) -> Iterator[str]:
    """A folder of its own in the shared folder, deleted behind the block: what is read from it must be cut inside."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Runs df once and cuts its lineage with a reliable checkpoint in the shared folder. Spark deletes it once nothing
    refers to it, where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
