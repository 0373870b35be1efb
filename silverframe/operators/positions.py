"""Positions in a global order without a one-task window."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder; sets a folder only where none is configured."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """``df`` with its 0-based position under ``order``.

    Rows are range-partitioned and sorted; a row's position is its place in its partition plus the sizes of the
    partitions before it, so only one number per partition is brought together. The sorted rows are
    checkpointed, because a second sampling of the ranges could differ.
    """
    mask = (1 << 33) - 1
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("p")).count().collect())
    starts = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *(n for _, n in sizes)]), strict=False))
    if not starts:
        return placed.withColumn(name, F.col("_at")).drop("_at")
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), part) if len(starts) <= 500 else None
    if offset is None:
        table = df.sparkSession.createDataFrame(list(starts.items()), "_p long, _start long")
        placed = placed.withColumn("_p", part).join(F.broadcast(table), "_p")
        offset = F.col("_start")
    return placed.withColumn(name, (offset + F.col("_at").bitwiseAND(F.lit(mask))).cast("long")).drop("_at", "_p", "_start")
