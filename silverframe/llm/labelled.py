"""Bounded, deterministic samples of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id, folds: int):
    """crc32 of the id's text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id, folds: int, left: int):
    return F.coalesce(fold(doc_id, folds) == left, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, left: int, per_class: int, longest: int) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` labelled documents of each class outside the held-out fold.

    The documents with the least hashes of their ids are taken, so the sample doesn't depend on partitions. What reaches the
    driver is bounded: one text of each id (that with the least hash), of at most ``longest`` characters; the sample leaves longer ones out.
    Ids with several labels count by their highest; null texts, ids and labels are left out.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).where(~held_out(F.col("doc_id"), folds, left))
    by_id = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).alias("y"))
    rank = F.xxhash64("doc_id", F.lit(7))
    chosen = None
    for y in (0, 1):
        part = by_id.where(F.col("y") == y).orderBy(rank, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.collect()  # at most 2 * per_class ids
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame([(r.doc_id, int(r.y)) for r in ids], "doc_id long, y int"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text") <= longest).join(picked, "doc_id")
    rows = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: r.doc_id)]
