"""Albums, selection, clocks of edits, aspect ratios and date groups of packed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverframe.functions.scalars import next_clock


def create_albums(albums: DataFrame, created: DataFrame, now: int) -> DataFrame:
    """Albums (album_id, name, entry_ids, created_at, updated_at) with new ones (album_id, name) at the end; a blank name creates none."""
    name = F.trim("name")
    fresh = created.where(F.length(name) > 0).select("album_id", name.alias("name"), F.array().cast("array<bigint>").alias("entry_ids"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"))
    return albums.select(*fresh.columns).unionByName(fresh)


def rename_albums(albums: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """Albums under new names (album_id, name), trimmed; a blank one changes nothing."""
    new = names.select("album_id", F.trim("name").alias("new")).where(F.length("new") > 0)
    rows = albums.join(new, "album_id", "left")
    renamed = F.col("new").isNotNull()
    return rows.withColumn("name", F.coalesce("new", "name")).withColumn("updated_at", F.when(renamed, F.lit(now)).otherwise(F.col("updated_at"))).select(*albums.columns)


def delete_albums(albums: DataFrame, ids: DataFrame) -> DataFrame:
    return albums.join(ids.select("album_id"), "album_id", "left_anti")


def view_after_delete(views: DataFrame, ids: DataFrame) -> DataFrame:
    """Views (viewer, album_id; null: all photos) after albums went: who looked at one of them sees all photos."""
    gone = ids.select("album_id").distinct().withColumn("gone", F.lit(True))
    return views.join(gone, "album_id", "left").select("viewer", F.when(F.col("gone").isNull(), F.col("album_id")).alias("album_id"))


def toggled(selected: Column, entry: Column) -> Column:
    """A selection with an entry taken out if it is in, else added at its end."""
    return F.when(F.array_contains(selected, entry), F.array_remove(selected, entry)).otherwise(F.array_append(selected, entry))


def focused(selected: Column, entry: Column) -> Column:
    """The entry in focus after a toggle: the entry if it is selected now, else the last of the rest."""
    return F.when(F.array_contains(selected, entry), entry).otherwise(F.try_element_at(selected, F.lit(-1)))


def mirrored(metadata: DataFrame, edits: DataFrame) -> DataFrame:
    """Metadata (id, rating, develop_updated_at, updated_at) after edits (id, source_updated_at, new_rating or null): clocks only go up.

    An edit moves the clock of edits; the clock of metadata moves where a field changes with it. Entries without metadata start at 0.
    """
    rows = metadata.join(edits, "id", "full")
    zero = F.lit(0).cast("long")
    develop = F.when(F.col("source_updated_at").isNull(), F.coalesce("develop_updated_at", zero)).otherwise(next_clock(F.col("source_updated_at"), F.coalesce("develop_updated_at", zero)))
    clock = F.when(F.col("new_rating").isNull(), F.coalesce("updated_at", zero)).otherwise(next_clock(F.col("source_updated_at"), F.coalesce("updated_at", zero)))
    return rows.select("id", F.coalesce("new_rating", "rating", F.lit(0)).alias("rating"), develop.alias("develop_updated_at"), clock.alias("updated_at"))


def merged_ratios(entries: DataFrame, seed: DataFrame, current: DataFrame) -> DataFrame:
    """Aspect ratios (id, ratio) of the entries: the seed's, else the current one."""
    rows = entries.select("id").join(seed.select("id", F.col("ratio").alias("s")), "id", "left").join(current.select("id", F.col("ratio").alias("c")), "id", "left")
    return rows.select("id", F.coalesce("s", "c").alias("ratio")).where("ratio is not null")


def date_groups(tiles: DataFrame, key: str, day: str) -> DataFrame:
    """Groups of packed rows (key, row, pos, day) with one day, that of their first tile: first row, day, rows and tiles. Equal days apart stay apart."""
    rows = tiles.groupBy(key, "row").agg(F.min_by(day, "pos").alias("day"), F.count("*").alias("tiles"))
    w = Window.partitionBy(key).orderBy("row")
    new = F.when(F.col("day").eqNullSafe(F.lag("day").over(w)) & F.lag("row").over(w).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("group", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "group").agg(F.min("row").alias("first_row"), F.min("day").alias("day"), F.count("*").alias("n_rows"), F.sum("tiles").alias("n_tiles")).drop("group")
