"""Helpers shared by the corpus operators: input cleaning, grouped Arrow streams; shared storage is the library's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrv.sources.scratch import materialize, shared_dir  # noqa: F401  (for the operators)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text under fixed names, a null text as the empty one; other columns go."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about limit bytes of one text column each, one row at least."""
    start, size = 0, 0
    col = batch.column(column)
    for i in range(batch.num_rows):
        size += len(col[i].as_buffer() or b"") if col[i].is_valid else 0
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for a task's batches; at the end the memory that it has freed goes back to the system.

    A Python worker waits for its next task beside the JVM, which may need that memory in a stage without Python.
    """

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from a stream sorted by its keys.

    A group that spans batches is carried over; tables hold several groups, so that small ones share a numpy pass.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = [table.column(k)[table.num_rows - 1].as_py() for k in keys]
        cut = table.num_rows - 1
        while cut > 0 and [table.column(k)[cut - 1].as_py() for k in keys] == last:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
        held, n = rest.to_batches(), 0 if cut else rest.num_rows // 2
    if held:
        yield pa.Table.from_batches(held)
