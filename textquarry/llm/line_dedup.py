"""Line dedup: every run of at least two lines, and every long line, that stands at an earlier place goes.

All pairs of consecutive lines are looked up, not only those at chunk boundaries: a run of lines repeats exactly if each
of its pairs does, so the union of the repeated pairs is the whole repeated run, wherever it begins and whatever stands
around it. A long line is looked up by itself. Of equal pairs the one at the smallest (document, position) stays, so the
first place of a line is never removed. Blank lines are lines.

A pair is told by the 64-bit hashes of its two lines. That equal hashes mean equal bytes is checked on the bytes of all
lines: the distinct ones of a hash, with partial aggregation, so a line that a third of all documents hold is compared
where it stands. Lines whose hash stands for different bytes are told by SHA-256 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A line of more words, or of at least so many bytes, is looked up by itself.
LONG_WORDS = 50
LONG_BYTES = 400
#: Longer lines travel as zstd frames to be compared: different bytes have different frames, and should equal ones too (of
#: workers with different libraries), the line counts as a clash and is told by its SHA-256.
PACKED_BYTES = 64


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: starts of all lines, their ends with and without the newline, their document.

    Every byte belongs to one line; a line ends behind its newline or with its text."""
    ends = np.union1d(np.flatnonzero(data == 10) + 1, offsets[1:][np.diff(offsets) > 0])
    starts = np.concatenate([[0], ends[:-1]])[: ends.size]
    bare = ends - (data[ends - 1] == 10) if ends.size else ends
    return starts, ends, bare, np.searchsorted(offsets, starts, "right") - 1


def line_hashes(data: np.ndarray, starts: np.ndarray, bare: np.ndarray, clashes: np.ndarray) -> np.ndarray:
    """Hash of each line; those in `clashes` (sorted) are replaced by 64 bits of the line's SHA-256."""
    h = common.span_hashes(data, starts, bare).view(np.int64) if starts.size else np.zeros(0, np.int64)
    if clashes.size:
        for i in np.flatnonzero(np.isin(h, clashes)).tolist():
            h[i] = int.from_bytes(hashlib.sha256(data[starts[i] : bare[i]].tobytes()).digest()[:8], "little", signed=True)
    return h


def is_long(data: np.ndarray, starts: np.ndarray, bare: np.ndarray) -> np.ndarray:
    word = common.NONSPACE_BYTE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    count = np.concatenate([[0], np.cumsum(begins)])
    return (count[bare] - count[starts] > LONG_WORDS) | (bare - starts >= LONG_BYTES)


def _line_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = np.zeros(0, np.int64)
    for batch in batches:
        for _, _, data, offsets in common.text_blocks(batch.column(0)):
            starts, _, bare, _ = lines_of(data, offsets)
            h, at = np.unique(line_hashes(data, starts, bare, nothing), return_inverse=True)
            raw, made, codec = data.tobytes(), {}, pa.Codec("zstd")
            for k, x, y in zip(at.tolist(), starts.tolist(), bare.tolist()):
                made.setdefault((k, raw[x:y]))
            packed = [codec.compress(b, asbytes=True) if len(b) > PACKED_BYTES else b for _, b in made]
            yield pa.RecordBatch.from_arrays([pa.array(h[[k for k, _ in made]] if made else nothing), pa.array(packed, pa.binary())], names=["h", "bytes"])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for batch in batches:
        texts = [v.as_buffer() if v.is_valid else None for v in batch.column(2)]
        sizes = pa.array([None if v is None else v.size for v in texts], pa.int64())
        packed = pa.array([None if v is None else codec.compress(v, asbytes=True) for v in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, packed], names=["doc_id", "key", "size", "packed"])


def _unpacked(sizes: pa.Array, packed: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    raw = [(codec.decompress(v.as_buffer(), n, asbytes=True) if n else b"") if v.is_valid else None for n, v in zip(sizes.to_pylist(), packed)]
    return pa.array(raw, pa.binary()).cast(pa.string())


def _unit_rows(clashes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for row, _, data, offsets in common.text_blocks(batch.column(2)):
                starts, _, bare, doc = lines_of(data, offsets)
                if not starts.size:
                    continue
                h = line_hashes(data, starts, bare, clashes)
                two = np.flatnonzero(doc[1:] == doc[:-1])
                one = np.flatnonzero(is_long(data, starts, bare))
                first = np.concatenate([two, one])
                at = pa.array(row + doc[first])
                single = pa.array(np.arange(first.size) >= two.size)
                second = pa.array(np.concatenate([h[two + 1], np.zeros(one.size, np.int64)]))
                yield pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array((starts - offsets[doc])[first]), single, pa.array(h[first]), second], names=["doc_id", "key", "start", "single", "a", "b"])

    return run


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text, kept (text without the removed lines), n_lines, n_removed (lines),
    removed (start bytes of the removed runs of lines).

    Null text stays null and has no lines; an empty text has none either. Rows with the same id and text are one document,
    treated alike; rows with one id and different texts, a tie, go by a hash of their texts; a null id comes after all
    others. A very long text is a block of its own and must fit in a task's memory. An empty table gives an empty one.
    Columns are taken by name, so others don't matter.
    """
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("key"), F.col(f"`{text}`").alias("text"))
    # a hash has one line's bytes, but for clashes: a set of them travels as one copy
    seen = slim.select("text").mapInArrow(_line_bytes, "h long, bytes binary").groupBy("h").agg(F.collect_set("bytes").alias("lines"))
    clashes = np.sort(np.array([r.h for r in seen.where(F.size("lines") > 1).select("h").collect()], np.int64))
    base = [slim.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("start", T.LongType()), T.StructField("single", T.BooleanType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]
    units = slim.mapInArrow(_unit_rows(clashes), T.StructType(base))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "start")
    # one place or several? two extremes tell it, and repeated rows share a place
    keepers = units.groupBy("single", "a", "b").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("single", "a", "b", "low")
    keepers = common.cut(keepers)  # with a shuffle of its own on both sides, the join can split a pair with many places
    # a unit's first byte, doubled, plus 1 for a line by itself
    found = units.join(keepers, ["single", "a", "b"]).where(place != F.col("low")).select("doc_id", "key", (F.col("start") * 2 + F.col("single").cast("long")).alias("unit"))
    gone = found.groupBy("doc_id", "key").agg(F.collect_set("unit").alias("units"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"), "units")
    # texts travel compressed
    packed = slim.mapInArrow(_packed_texts, T.StructType([slim.schema["doc_id"], T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("packed", T.BinaryType())]))
    joined = packed.join(gone, packed.doc_id.eqNullSafe(gone.gone_id) & packed.key.eqNullSafe(gone.gone_key), "left").select("doc_id", "size", "packed", "units")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = _unpacked(batch.column(1), batch.column(2))
            hits = batch.column(3)
            kept, n_lines, n_removed, removed = [], [], [], []
            for row, stop, data, offsets in common.text_blocks(column):
                starts, ends, _, doc = lines_of(data, offsets)
                n_lines.append(np.bincount(doc, minlength=offsets.size - 1).astype(np.int64))
                lost = np.zeros(offsets.size - 1, np.int64)
                raw = data.tobytes()
                edge = np.searchsorted(doc, np.arange(offsets.size))
                for i in range(stop - row):
                    if not hits[row + i].is_valid:
                        kept.append(raw[offsets[i] : offsets[i + 1]])
                        removed.append(None)
                        continue
                    unit = hits[row + i].values.to_numpy(zero_copy_only=False)
                    a, b = starts[edge[i] : edge[i + 1]], ends[edge[i] : edge[i + 1]]
                    first = np.searchsorted(a - offsets[i], unit >> 1)
                    out = np.zeros(a.size + 1, bool)
                    out[first] = True
                    out[first[unit % 2 == 0] + 1] = True
                    out = out[: a.size]
                    lost[i] = out.sum()
                    begins = out.copy()
                    begins[1:] &= ~out[:-1]
                    removed.append((a - offsets[i])[begins].tolist())
                    kept.append(b"".join(raw[x:y] for x, y in zip(a[~out].tolist(), b[~out].tolist())))
                n_removed.append(lost)
            texts = pa.array([None if v is None else v.decode() for v in kept], pa.string()) if kept else pa.array([], pa.string())
            texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, texts, pa.array(np.concatenate([*n_lines, np.zeros(0, np.int64)])), pa.array(np.concatenate([*n_removed, np.zeros(0, np.int64)])), pa.array(removed, pa.list_(pa.int64()))], names=["doc_id", "text", "kept", "n_lines", "n_removed", "removed"])

    schema = T.StructType([slim.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.LongType()))])
    return joined.mapInArrow(rebuild, schema)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chunks_removed and kept_sha256 of all documents."""
    made = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_lines", "n_removed", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_chunks_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, str | None]:
    """Kept texts by a set of all pairs of lines and all long lines in order, for tests."""
    seen: set[tuple[bytes, ...]] = set()
    out: dict[int, str | None] = {}
    for doc, text in sorted(rows):
        lines = (text or "").encode().split(b"\n")
        ended = [x + b"\n" for x in lines[:-1]] + [lines[-1]] * bool(lines[-1])
        bare, gone = [x.removesuffix(b"\n") for x in ended], set()
        for i, line in enumerate(bare):
            units = [(line,)] * (len(line.split()) > LONG_WORDS or len(line) >= LONG_BYTES) + [tuple(bare[i : i + 2])] * (i + 1 < len(bare))
            for unit in units:
                if unit in seen:
                    gone.update(range(i, i + len(unit)))
                seen.add(unit)
        out[doc] = None if text is None else b"".join(x for i, x in enumerate(ended) if i not in gone).decode()
    return out


SQL = {
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS p, ends_with(text, chr(10)) AS closed FROM documents WHERE text IS NOT NULL AND text != ''),
e AS (SELECT doc_id, CASE WHEN closed THEN p[1:len(p) - 1] ELSE p END AS p, closed FROM d),
l AS (SELECT doc_id, i, p[i] AS t, CASE WHEN i < len(p) THEN p[i + 1] END AS nx, i < len(p) OR closed AS ended FROM e, unnest(range(1, len(p) + 1)) AS r(i)),
u AS (SELECT doc_id, i, 2 AS n, t AS a, nx AS b FROM l WHERE nx IS NOT NULL
      UNION ALL SELECT doc_id, i, 1, t, '' FROM l WHERE strlen(t) >= 400 OR len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) > 50),
v AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, a, b ORDER BY doc_id, i) AS place FROM u),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM v, unnest(range(0, n)) AS r(k) WHERE place > 1),
k AS (SELECT l.doc_id, l.i, t, ended, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i),
s AS (SELECT doc_id, count(*) AS n_lines, sum(gone::INT) AS n_removed, sum((gone AND NOT before)::INT) AS n_runs, string_agg(CASE WHEN gone THEN '' WHEN ended THEN t || chr(10) ELSE t END, '' ORDER BY i) AS kept
      FROM (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM k) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_chunks_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN s USING (doc_id)""",
}
