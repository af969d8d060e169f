"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .. import session
from ..session import park, shared_dir, table

__all__ = ["by_slices", "forget", "kept", "park", "shared_dir", "ship", "table"]

#: What this Python worker keeps between tasks: one thing at a time.
KEPT: dict[tuple, Any] = {}
#: Rows and bytes of a batch that goes to a Python worker, in place of Spark's defaults: texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """The thing of this key, made if the worker does not have it. A worker outlives its tasks and serves one operator
    after another, so whatever it kept for another key goes."""
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = make()
    return KEPT[key]


def forget() -> None:
    """Drop what another operator has kept: for operators that keep nothing themselves."""
    KEPT.clear()


def by_slices(batches: Iterator[pa.RecordBatch], rows: int = 500, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Short batches, so that long texts do not pile up: at most `rows` rows, and of `size` bytes of text or one row."""
    for batch in batches:
        ends = np.zeros(batch.num_rows + 1, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                offsets = np.frombuffer(column.buffers()[1] or bytes(4), np.int32)[column.offset : column.offset + batch.num_rows + 1].astype(np.int64)
                ends += offsets - offsets[0] if len(offsets) == len(ends) else 0
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, ends[start] + size, side="right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, and send them small batches where the session has Spark's defaults."""
    session.ship(spark)
    for name, (default, own) in BATCH.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, own)
