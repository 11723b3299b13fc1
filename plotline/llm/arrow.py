"""Arrow batches of texts: slices of bounded size, bytes without copies, appended columns."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Text bytes handled at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and each text's bounds; a null is an empty text."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts in column ``text`` stay near ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, memory that the task has freed goes back to the machine, for workers wait idle."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def append(docs: DataFrame, text: str, fields: list[StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], limit: int = SLICE_BYTES) -> DataFrame:
    """``docs`` and the columns that a task's worker makes of each slice.

    ``make`` runs once per task and returns the worker; a slice has about ``limit`` bytes of text.  Like ``withColumn``, a
    new column replaces one of the same name.
    """
    base = docs.drop(*[f.name for f in fields])
    at, names = base.columns.index(text), [*base.columns, *[f.name for f in fields]]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, at, limit):
            made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(work(part), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    return base.mapInArrow(lambda batches: released(run(batches)), StructType([*base.schema.fields, *fields]))
