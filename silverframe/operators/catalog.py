"""Set-valued catalog maintenance and last-writer-wins merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prune(table: DataFrame, entries: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a catalog table whose entry is still in the scan."""
    return table.join(entries.select(F.col("id").alias(key)), key, "left_semi")


def album_union(albums: DataFrame, added: DataFrame, now: int) -> DataFrame:
    """Albums (album_id, entry_ids, updated_at) with ids added at the end (album_id, ids), first occurrence kept.

    The clock of a touched album moves even if nothing is new.
    """
    both = albums.join(added, "album_id", "left")
    return both.select("album_id", F.when(F.col("ids").isNull(), F.col("entry_ids")).otherwise(F.array_union("entry_ids", "ids")).alias("entry_ids"), F.when(F.col("ids").isNull(), F.col("updated_at")).otherwise(F.lit(now)).alias("updated_at"))


def album_remove(album_entries: DataFrame, removed: DataFrame) -> DataFrame:
    """Album pairs without the removed entries (column ``id``); positions close up."""
    left = album_entries.join(removed.select(F.col("id").alias("entry_id")), "entry_id", "left_anti")
    return left.withColumn("pos", (F.row_number().over(Window.partitionBy("album_id").orderBy("pos")) - 1).cast("long"))


def archive_entries(archive: DataFrame, ids: DataFrame) -> DataFrame:
    return archive.select("id").union(ids.select("id")).distinct()


def restore_entries(archive: DataFrame, ids: DataFrame) -> DataFrame:
    """The archive without restored ids; their album places don't come back."""
    return archive.select("id").join(ids.select("id"), "id", "left_anti")


def upsert_metadata(metadata: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Metadata with changed fields; a null in ``changes`` leaves a field. New entries start from the defaults."""
    c = changes.select("id", *(F.col(f).alias(f"new_{f}") for f in ("pick", "rating", "color_label")), F.lit(True).alias("changed"))
    m = metadata.select("id", "pick", "rating", "color_label", "updated_at").join(c, "id", "full")
    return m.select("id", F.coalesce("new_pick", "pick", F.lit("none")).alias("pick"), F.coalesce("new_rating", "rating", F.lit(0)).alias("rating"), F.coalesce("new_color_label", "color_label").alias("color_label"), F.when(F.col("changed"), F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"))


def newest_wins(entries: DataFrame, catalog: DataFrame, sidecars: DataFrame) -> DataFrame:
    """For each entry the source of its edits: a sidecar that is newer than the catalog; a tie goes to the catalog."""
    rows = entries.select("id").join(catalog.select("id", F.col("updated_at").alias("clock"), F.col("rating").alias("c")), "id", "left").join(sidecars.select("id", "modified", F.col("rating").alias("s")), "id", "left")
    newer = F.coalesce(F.col("modified") > F.coalesce("clock", F.lit(0)), F.lit(False))
    return rows.select("id", F.when(newer, "sidecar").when(F.col("clock").isNotNull(), "catalog").otherwise("default").alias("origin"), F.when(newer, F.col("s")).otherwise(F.coalesce("c", F.lit(0))).alias("rating"))


def stale_signatures(components: DataFrame, entries: DataFrame) -> DataFrame:
    """Components whose stored source (id, path, size, modified) isn't the entry's any more; a lost entry is stale too."""
    now = entries.select("id", F.struct("relative_path", "size", "last_modified").alias("now"))
    return components.join(now, "id", "left").select("id", (~F.struct("relative_path", "size", "last_modified").eqNullSafe(F.col("now"))).alias("stale"))


def missing_and_orphans(references: DataFrame, assets: DataFrame) -> DataFrame:
    """asset_id and problem: referenced but missing, or there but not referenced."""
    r, a = references.select("asset_id").distinct(), assets.select("asset_id").distinct()
    return r.join(a, "asset_id", "left_anti").withColumn("problem", F.lit("missing")).unionByName(a.join(r, "asset_id", "left_anti").withColumn("problem", F.lit("orphan")))


def last_values(log: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Trailing-edge debounce of a log (key, ts, event_id, value): the last value of each burst of events at most ``gap_ms`` apart."""
    burst = F.session_window("ts", f"{gap_ms} milliseconds")
    return log.groupBy(key, burst.alias("burst")).agg(F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts")).drop("burst")


def grouped_edits(log: DataFrame) -> DataFrame:
    """One patch for each (entry, edit group, target) of a log: the first value before, the last after, in order of ``seq``."""
    return log.groupBy("entry", "edit_group", "target").agg(F.min_by("before", "seq").alias("before"), F.max_by("after", "seq").alias("after"), F.min("seq").alias("seq"), F.count("*").alias("n"))
