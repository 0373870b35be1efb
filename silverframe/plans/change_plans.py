"""Archive, restore, delete and album changes over a whole catalog, with comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.operators import catalog_changes as changes
from silverframe.plans import fixtures as fx
from silverframe.plans.fixtures import sql
from silverframe.plans.library_plans import query

NOW = 1_800_000_000_000


def whole(spark, d):
    """All entries, metadata, albums, places and archived ids; an album's clock is its number."""
    members = fx.album_entries(spark, d)
    albums = members.select("album_id").distinct().withColumn("updated_at", F.col("album_id").cast("long"))
    return changes.Catalog(fx.entries(spark, d), fx.metadata(spark, d), albums, members, fx.archive(spark, d))


def rejected(spark, d):
    return fx.metadata(spark, d).where("pick = 'reject'").select("id")


def state(chosen: str, entry: str = "true", kept: str = "true", member: str = "true", archived: str = "SELECT id FROM archive", clock: str = "album_id") -> str:
    """SQL of a whole catalog of which rows of each part are kept; ``chosen`` selects the ids of the change as ``c``."""
    return sql(
        f""", c AS ({chosen}), alive AS (SELECT id FROM entries WHERE {entry}), al AS (SELECT DISTINCT album_id FROM album_entries),
        left_over AS (SELECT album_id, entry_id, row_number() OVER (PARTITION BY album_id ORDER BY pos) - 1 AS pos FROM album_entries WHERE {member})
        SELECT 'entry' AS part, id::BIGINT AS id, NULL::BIGINT AS entry_id, NULL::BIGINT AS pos, NULL::BIGINT AS updated_at FROM alive
        UNION ALL SELECT 'metadata', id, NULL, NULL, updated_at FROM metadata WHERE {kept}
        UNION ALL SELECT 'album', album_id, NULL, NULL, {clock} FROM al
        UNION ALL SELECT 'member', album_id, entry_id, pos, NULL FROM left_over
        UNION ALL SELECT 'archived', id, NULL, NULL, NULL FROM ({archived})""",
        "entries", "metadata", "album_entries", "archive",
    )


_REJECTED = "SELECT id FROM metadata WHERE pick = 'reject'"


@query("archive_change", state(_REJECTED, member="entry_id NOT IN (FROM c)", archived="SELECT id FROM archive UNION FROM c", clock=str(NOW)))
def archive_change(spark, d):
    return changes.rows(changes.archive_entries(whole(spark, d), rejected(spark, d), NOW))


@query("restore_change", state(_REJECTED, archived="SELECT id FROM archive WHERE id NOT IN (FROM c)"))
def restore_change(spark, d):
    return changes.rows(changes.restore_entries(whole(spark, d), rejected(spark, d)))


@query("delete_change", state(_REJECTED, entry="id NOT IN (FROM c)", kept="id IN (FROM alive)", member="entry_id IN (FROM alive)", archived="SELECT id FROM archive WHERE id IN (FROM alive)"))
def delete_change(spark, d):
    return changes.rows(changes.delete_entries(whole(spark, d), rejected(spark, d)))


@query("album_change", state(_REJECTED, member="album_id <> 7 OR entry_id NOT IN (FROM c)", clock=f"CASE WHEN album_id = 7 THEN {NOW} ELSE album_id END"))
def album_change(spark, d):
    return changes.rows(changes.take_from_albums(whole(spark, d), rejected(spark, d), NOW, album=7))
