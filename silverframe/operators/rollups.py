"""Roll-ups over a library: folder tree, counts, runs of dates, export totals, first free names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def folder_tree(entries: DataFrame) -> DataFrame:
    """path, parent, depth, n: every folder with its direct count; ancestors appear, with 0 if they hold no entry.

    Counts come first, so that prefixes are expanded once per folder and not once per entry.
    """
    direct = entries.groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.split("folder", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k == F.size(parts)).alias("own")))
    below = direct.where("folder is not null").select("n", F.explode(prefixes).alias("p")).select("p.path", F.when(F.col("p.own"), F.col("n")).otherwise(0).alias("n"))
    root = direct.where("folder is null").select(F.lit("").alias("path"), "n")
    zero = entries.sparkSession.createDataFrame([("", 0)], "path string, n long")
    total = below.unionByName(root).unionByName(zero).groupBy("path").agg(F.sum("n").cast("long").alias("n"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    parent = F.when(F.col("path") == "", F.lit(None)).otherwise(F.regexp_replace("path", "/?[^/]*$", ""))
    return total.select("path", parent.alias("parent"), depth.alias("depth"), "n")


def library_totals(entries: DataFrame, archive: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row: all entries, archived ones, visible ones and picked ones."""
    marked = entries.join(archive.select("id", F.lit(True).alias("archived")), "id", "left").join(metadata.select("id", "pick"), "id", "left")
    return marked.agg(F.count("*").alias("n_all"), F.count_if("archived").alias("n_archived"), F.count_if(F.col("archived").isNull()).alias("n_visible"), F.count_if(F.col("pick") == "pick").alias("n_picked"))


def album_sizes(album_entries: DataFrame) -> DataFrame:
    """Entries of each album, archived ones included."""
    return album_entries.groupBy("album_id").agg(F.count("*").alias("n"))


def date_islands(rows: DataFrame, key: str, order: list[str], day: str) -> DataFrame:
    """Runs of equal days in each ``key``'s order: first position, day, length; equal days apart stay apart."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((F.col(day) != F.lag(day).over(w)).cast("int"), F.lit(1))
    marked = rows.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "island").agg(F.min(day).alias("day"), F.count("*").alias("n"))


def export_summary(results: DataFrame) -> DataFrame:
    """Totals by status: a warning counts as exported too."""
    s = F.col("status")
    return results.agg(F.count("*").alias("n_items"), F.count_if(s.isin("success", "warning")).alias("n_exported"), F.count_if(s == "skipped").alias("n_skipped"), F.count_if(s == "error").alias("n_failed"), F.count_if(s == "warning").alias("n_warnings"))


def first_free_number(names: DataFrame, key: str, number: str) -> DataFrame:
    """For each key, the least number from 1 that isn't taken."""
    keys = names.select(F.col(key).alias("_key"), F.col(number).alias("_number"))
    taken = keys.where("_number >= 1").distinct()
    w = Window.partitionBy("_key").orderBy("_number")
    # names of our own: a number column of the name of the rank would be replaced by it
    gaps = taken.withColumn("_rank", F.row_number().over(w)).groupBy("_key").agg(F.max(F.when(F.col("_number") == F.col("_rank"), F.col("_rank"))).alias("_top"))
    return keys.select("_key").distinct().join(gaps, "_key", "left").select(F.col("_key").alias(key), (F.coalesce("_top", F.lit(0)) + 1).cast("long").alias("free"))
