"""Shared helpers: lineage cuts, byte blocks of Arrow text columns, vectorised word spans and hashes."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once by a vectorised step; a longer document forms a block of its own.
BLOCK_BYTES = 1 << 19
#: Tables of powers of up to so many entries (64 MB) are kept by a worker.
KEPT_POWERS = 1 << 22

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []

#: Lower-cases ASCII A-Z, byte by byte; the bytes of other UTF-8 characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
ALNUM_BYTE = np.zeros(256, dtype=bool)
ALNUM_BYTE[48:58] = ALNUM_BYTE[97:123] = ALNUM_BYTE[128:] = True
#: Bytes of words [^\x20\x09-\x0D]+.
NONSPACE_BYTE = np.ones(256, dtype=bool)
NONSPACE_BYTE[[32, 9, 10, 11, 12, 13]] = False


def checkpoint_dir(spark) -> str:
    """The shared folder of the session. Where none is set, local mode gets a temporary one; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint_")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark, path: str):
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def finished(spark, folder: str) -> bool:
    """Whether a job wrote the folder to its end."""
    fs, path = _file_system(spark, f"{folder}/_SUCCESS")
    return fs.exists(path)


def mark_finished(spark, folder: str) -> None:
    fs, path = _file_system(spark, f"{folder}/_SUCCESS")
    fs.create(path, True).close()


def delete(spark, folder: str) -> None:
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


@contextlib.contextmanager
def scratch(spark) -> Iterator[str]:
    """A folder of its own in the shared folder, deleted behind the block: what is read from it must be cut inside."""
    folder = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        delete(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """Runs df once and cuts its lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(taken: list[str], wanted: str) -> str:
    """`wanted`, with as many underscores behind it as make it differ (in any case) from the names taken."""
    known = {n.lower() for n in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def reads_files(df: DataFrame) -> bool:
    """Whether each row of df is a row of a file, so that the hidden column _metadata tells them apart."""
    nodes = [df._jdf.queryExecution().analyzed()]
    if any(c.lower() == "_metadata" for c in df.columns):
        return False
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias") and not node.nodeName().startswith(("LogicalRelation", "Relation")):
            return False
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return True


def identified(df: DataFrame) -> DataFrame:
    """(row, at): the rows of df as structs, so that no name clashes, and what names each by file and place, the same
    whenever it is read. A frame that isn't read from files is written to the shared folder and read from there."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    at = F.struct(F.unhex(F.md5(F.col("_metadata.file_path").cast("binary"))).alias("file"), F.col("_metadata.row_index").alias("place")).alias("at")
    if reads_files(df):
        return df.select(row, at)
    folder = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.select(row).write.parquet(folder)
    return df.sparkSession.read.parquet(folder).select("row", at)


def not_held_out(id_column: str):
    """True for rows that may be learned from: crc32(id as text) mod 3 is not 1 (null ids count as learnable)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of consecutive rows with about `limit` bytes."""
    data, offsets = text_views(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n, first + 65536)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block, and for each document the index of its first word (plus the total)."""
    mask = is_word[data]
    before = np.empty_like(mask)
    after = np.empty_like(mask)
    if mask.size:
        before[0], before[1:] = False, mask[:-1]
        after[-1], after[:-1] = False, mask[1:]
        inner = offsets[(offsets > 0) & (offsets < mask.size)]
        before[inner] = False
        after[inner - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a long text aren't kept behind it."""
    if _powers and _powers[0].size >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(max(n, BLOCK_BYTES + 1), base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= KEPT_POWERS:
        _powers[:] = made
    return made[0], made[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span; equal bytes give equal hashes wherever they stand."""
    power, inverse = _power_tables(data.size + 1)
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * power[: data.size], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes (len - k + 1 of them)."""
    n = words.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = words[:n].copy()
    for j in range(1, k):
        g *= np.uint64(0xD1342543DE82EF95)
        g += words[j : j + n]
    return mix(g)


def sliding(values: np.ndarray, width: int, reduce: Callable) -> np.ndarray:
    """reduce (minimum or maximum) over each window of `width` values, by doubling."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = reduce(out[: out.size - step], out[step:])
        done += step
    return out


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [low, high): the range that each member belongs to, and the members, concatenated."""
    count = high - low
    owner = np.repeat(np.arange(low.size), count)
    return owner, np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count) + low[owner]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the edges (a[i], b[i]); min-hooking and pointer jumping."""
    label = np.arange(n)
    while a.size:
        la, lb = label[a], label[b]
        live = la != lb
        a, b, la, lb = a[live], b[live], la[live], lb[live]
        if not a.size:
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def append_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with columns that `compute` derives from each Arrow batch; all other columns pass through, but for those
    named like a new one (in any case), which it replaces."""
    names = [f.name for f in fields]
    taken = {n.lower() for n in names}
    stay = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in taken]
    schema = T.StructType([*(df.schema.fields[i] for i in stay), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.rename_columns(given))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *made], names=[*(given[i] for i in stay), *names])

    given = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(given))]).mapInArrow(run, schema)  # names with dots can't be handed over
