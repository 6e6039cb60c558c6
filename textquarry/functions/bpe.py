"""Ids of a public tokenizer's vocabulary file, and texts from ids, in Arrow batches. The file lies at the same path on
every worker and is loaded once in each process; tokenizers are never trained here."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PREFIX = {"code": "<CODE> ", "text": "<TEXT> ", None: ""}
SCHEMA = "doc_id long, ids array<int>, mask array<tinyint>, n_tokens long"


#: Texts of so many bytes, or ids of so many texts, are at hand at once, or a single text.
CHARACTERS, TOKENS = 1 << 20, 1 << 18


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose values (bytes of strings, entries of lists) are `most` together, or one row."""
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        ends = np.cumsum(np.asarray(pc.fill_null(length, 0)).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(low, high - low)
            low = high


@functools.lru_cache(maxsize=4)
def vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(docs: DataFrame, path: str, size: int | None = 256, modality: str | None = None, pad_id: int = 0) -> DataFrame:
    """(doc_id, ids, mask, n_tokens) of docs (doc_id, text): ids cut or filled up with pad_id to `size` (null: as they are),
    the mask 1 for real ones, and how many there were. Null texts are empty ones; the modality puts <CODE> or <TEXT> first."""
    if modality not in PREFIX:
        raise ValueError("modality is code, text or None")
    if size is not None and size < 1:
        raise ValueError("size must be at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for part in slices(batches, 1, CHARACTERS):
            texts = [PREFIX[modality] + (t or "") for t in part.column(1).to_pylist()]
            # no offsets, and what a text makes is an array before the next slice
            every = [np.asarray(e.ids, np.int32) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
            n = np.array([x.size for x in every], np.int64)
            if size is None:
                kept, flat = n, np.concatenate(every)
                mask = np.ones(flat.size, np.int8)
            else:
                kept = np.full(n.size, size, np.int64)
                flat = np.full((n.size, size), pad_id, np.int32)
                for row, x in zip(flat, every):
                    row[: x.size] = x[:size]
                mask = (np.arange(size) < n[:, None]).astype(np.int8).ravel()
                flat = flat.ravel()
            at = pa.array(np.concatenate([[0], np.cumsum(kept)]).astype(np.int32))
            columns = [part.column(0), pa.ListArray.from_arrays(at, pa.array(flat)), pa.ListArray.from_arrays(at, pa.array(mask)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "mask", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str, skip_special_tokens: bool = True) -> DataFrame:
    """(doc_id, decoded): texts of the ids that the mask keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for part in slices(batches, 1, TOKENS):
            kept = [[i for i, m in zip(ids, mask) if m] for ids, mask in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            texts = own.decode_batch(kept, skip_special_tokens=skip_special_tokens)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids", "mask").mapInArrow(run, "doc_id long, decoded string")
