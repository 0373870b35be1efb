"""Helpers shared by the training-data operators: shared-folder tables, Arrow batches, text bytes."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode (tests) a new one where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def write_table(df: DataFrame, name: str, options: dict[str, str] | None = None) -> str:
    """Write ``df`` as Parquet into the shared folder and return its path.

    A committed table replaces the lineage behind it, so a lost executor costs a re-read and not a
    recomputation. Tables are removed by :func:`drop_table` or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/silverframe/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | (options or {}))).parquet(path)
    return keep_until_exit(spark, path)


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """``path``, which is deleted when the driver exits."""
    _TABLES.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back with the same schema."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`write_table` made, through Spark's own file system layer."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows in the jobs that run inside: for rows that are long themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table_path(df: DataFrame) -> str:
    """Folder of a table that :func:`materialize` returned."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else ""


@atexit.register
def _drop_all() -> None:
    for spark, path in _TABLES:
        try:
            drop_table(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


def batch_texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch; null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def by_bytes(batch: pa.RecordBatch, name: str = "text", limit: int = 4 << 20):
    """Slices of a batch with about ``limit`` bytes of text each, so that very long texts bound the work arrays."""
    lengths = pa.compute.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, int)
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=False):
        yield batch.slice(int(a), int(b - a))
