"""Rows of Python beside Spark, with Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that an Arrow batch from Spark holds at most, and rows of one that goes back (a row's own results stay together).
BATCH_ROWS, BATCH_BYTES, OUT_ROWS = 256, 4 << 20, 2048


def release() -> None:
    """Gives memory that Arrow and the C library hold on to back, since a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(rows, schema) on batches of bounded size, whose workers release memory at the end of a task."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def mapped_rows(df: DataFrame, rows: Callable[..., list[tuple]], types: dict[str, pa.DataType], schema: str, most: int = OUT_ROWS) -> DataFrame:
    """The rows that a function makes of each row's columns; one row's values at a time are Python objects, and batches go back after `most` rows."""

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types.values())], names=[*types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for k in range(batch.num_rows):
                out += rows(*(column[k].as_py() for column in batch.columns))
                if len(out) >= most:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return mapped(df, run, schema)
