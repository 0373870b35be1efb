"""Changes of a catalog that concern several of its tables at once, with their clocks.

A change gives a whole new catalog, so that one write can replace the old one. Changed entries are a table of ids (null ones mean
nothing, repeated ones count once); an empty table changes nothing, clocks included.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.operators import catalog


@dataclass(frozen=True)
class Catalog:
    """entries (id), metadata (id, updated_at), albums (album_id, updated_at), members (album_id, pos, entry_id), archive (id); more columns stay."""

    entries: DataFrame
    metadata: DataFrame
    albums: DataFrame
    members: DataFrame
    archive: DataFrame


def _ids(ids: DataFrame) -> DataFrame:
    return ids.select("id").where("id is not null").distinct()


def take_from_albums(c: Catalog, ids: DataFrame, now: int, album: int | None = None) -> Catalog:
    """Entries leave one album, or all. The clock of each album that was asked moves, whether or not it held any of them."""
    gone, names = _ids(ids), c.albums.columns
    asked = F.lit(True) if album is None else F.coalesce(F.col("album_id") == album, F.lit(False))
    kept = c.members.where(~asked).unionByName(catalog.album_remove(c.members.where(asked), gone).select(*c.members.columns))
    some = gone.groupBy().agg((F.count("*") > 0).alias("some_ids"))  # one row
    clock = F.when(asked & F.col("some_ids"), F.lit(now)).otherwise(F.col("updated_at")).cast("long")
    return replace(c, members=kept, albums=c.albums.crossJoin(F.broadcast(some)).withColumn("updated_at", clock).select(*names))


def archive_entries(c: Catalog, ids: DataFrame, now: int) -> Catalog:
    """Entries go to the archive and leave all albums; entries and metadata stay."""
    return replace(take_from_albums(c, ids, now), archive=catalog.archive_entries(c.archive, _ids(ids)))


def restore_entries(c: Catalog, ids: DataFrame) -> Catalog:
    """Entries leave the archive; their places in albums don't come back, and no clock moves."""
    return replace(c, archive=catalog.restore_entries(c.archive, _ids(ids)))


def delete_entries(c: Catalog, ids: DataFrame) -> Catalog:
    """Entries go, and with them all that names an entry that isn't there: metadata, places in albums, archive. No clock moves."""
    left = c.entries.join(_ids(ids), "id", "left_anti").select(*c.entries.columns)
    there = left.select("id").distinct()
    lost = c.members.select(F.col("entry_id").alias("id")).distinct().join(there, "id", "left_anti")
    return replace(c, entries=left, metadata=catalog.prune(c.metadata, there).select(*c.metadata.columns), members=catalog.album_remove(c.members, lost).select(*c.members.columns), archive=c.archive.join(there, "id", "left_semi").select(*c.archive.columns))


def rows(c: Catalog) -> DataFrame:
    """A catalog as one table: part, id, entry_id, pos, updated_at."""
    none = F.lit(None).cast("long")
    part = lambda t, name, key, entry=none, pos=none, clock=none: t.select(F.lit(name).alias("part"), F.col(key).cast("long").alias("id"), entry.cast("long").alias("entry_id"), pos.cast("long").alias("pos"), clock.cast("long").alias("updated_at"))
    members = part(c.members, "member", "album_id", F.col("entry_id"), F.col("pos"))
    out = part(c.entries, "entry", "id").unionAll(part(c.metadata, "metadata", "id", clock=F.col("updated_at")))
    return out.unionAll(part(c.albums, "album", "album_id", clock=F.col("updated_at"))).unionAll(members).unionAll(part(c.archive, "archived", "id"))
