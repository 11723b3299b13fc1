"""Tables cut into sorted pieces, and what the pieces must know of each other.

A piece is a range of the sort order.  A group larger than a piece spans
several, so no group is ever gathered in one task; each piece hands at most two
small summaries to the driver, and gets its neighbours' back by broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plotline.session import checkpoint_folder


def sorted_pieces(df: DataFrame, *order: str) -> DataFrame:
    """The frame range-partitioned and sorted, checkpointed so that its pieces stay the same."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()


def stretches(batches: Iterator[pa.RecordBatch], key: Callable[[dict], object], columns: list[str]) -> Iterator[tuple[object, list[dict]]]:
    """Consecutive rows of a piece with equal key."""
    rows = (row for batch in batches for row in batch.select(columns).to_pylist())
    for value, group in groupby(rows, key):
        yield value, list(group)


def piece_number() -> int:
    return TaskContext.get().partitionId()
