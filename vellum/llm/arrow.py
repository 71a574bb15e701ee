"""Small helpers for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = "__text"


def texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text as UTF-8 bytes (null text: empty), under names that other columns can't clash with."""
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias(TEXT),
    )


def by_bytes(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values with about ``limit`` bytes each; one value at least."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and size + len(v) > limit:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)


def sliced(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of a binary column without nulls, a row at least; none is copied."""
    col, start = batch.column(column), 0
    if not batch.num_rows:
        return
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns what this process has freed to the system, where its C library can; else nothing happens."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(fn: Callable) -> Callable:
    """``fn`` over batches, and then what it held goes back to the system: workers are used again by tasks of other kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return run


def map_texts(df: DataFrame, fn: Callable[[list[bytes]], list], schema: str, names: list[str]) -> DataFrame:
    """``fn`` takes the texts of a batch and gives one list or Arrow array for each name; ``doc_id`` is carried along."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = fn(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *(c if isinstance(c, pa.Array) else pa.array(c) for c in cols)], ["doc_id", *names])

    return df.mapInArrow(giving_back(run), schema)
