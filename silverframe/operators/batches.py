"""Rows dealt evenly over tasks, and batches cut by their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt over tasks by ``key``, four a core: for small rows that each cost much, which few files or few blocks would give to few tasks.

    The number is fixed, since a plan that joins small partitions again would undo it.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def by_bytes(batch: pa.RecordBatch, name: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, so that what is made of a slice is bounded too."""
    lengths = pa.compute.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, int)
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=False):
        yield batch.slice(int(a), int(b - a))
