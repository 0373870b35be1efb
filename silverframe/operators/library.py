"""The library query: scope, curation and format filters, and sort, over entries and their sparse metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverframe.operators.positions import with_position

LABELS = ("red", "yellow", "green", "blue", "purple")


@dataclass(frozen=True)
class Library:
    """entries(id, name, relative_path, folder, size, last_modified, profile_id), metadata(id, pick, rating,
    color_label, updated_at), album_entries(album_id, pos, entry_id), archive(id)."""

    entries: DataFrame
    metadata: DataFrame
    album_entries: DataFrame
    archive: DataFrame


@dataclass(frozen=True)
class View:
    """What is looked at: ``all``, one ``folder`` (key: its path, "" the root, None all), an ``album`` or the ``archive``."""

    kind: str = "all"
    key: object = None


@dataclass(frozen=True)
class LibraryQuery:
    view: View = field(default_factory=View)
    curation: str = "all"
    format: str = "all"
    sort: str = "name"


def with_metadata(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every entry with its metadata; entries without any have pick none, rating 0, no label and clock 0."""
    m = metadata.select("id", "pick", "rating", "color_label", "updated_at")
    return entries.join(m, "id", "left").withColumns({"pick": F.coalesce("pick", F.lit("none")), "rating": F.coalesce("rating", F.lit(0)), "updated_at": F.coalesce("updated_at", F.lit(0).cast("long"))})


def curation_filters() -> dict[str, Column]:
    """The curation filters by name. Star filters are equalities; only ``rated`` is a bound."""
    pick, rating, label = F.col("pick"), F.col("rating"), F.col("color_label")
    return {
        "all": F.lit(True),
        "picked": pick == "pick",
        "rejected": pick == "reject",
        "unpicked": pick == "none",
        "rated": rating >= 1,
        **{f"rating-{n}": rating == n for n in range(1, 6)},
        **{f"label-{c}": label.eqNullSafe(c) for c in LABELS},
    }


def by_curation(df: DataFrame, name: str) -> DataFrame:
    """Rows of a frame with metadata under a curation filter; an unknown name keeps all."""
    return df.where(curation_filters().get(name, F.lit(True)))


def by_format(entries: DataFrame, name: str) -> DataFrame:
    """``standard``, or ``raw``: everything else, entries without a known format included."""
    standard = F.col("profile_id").eqNullSafe("standard")
    return entries.where({"raw": ~standard, "standard": standard}.get(name, F.lit(True)))


def by_folder(entries: DataFrame, path: str | None) -> DataFrame:
    """Entries directly in a folder: None for all, "" for the root."""
    if path is None:
        return entries
    return entries.where(F.col("folder").isNull() if path == "" else F.col("folder") == path)


def by_album(entries: DataFrame, album_entries: DataFrame, album_id: int | None) -> DataFrame:
    """Entries of an album; no album is no filter."""
    if album_id is None:
        return entries
    members = album_entries.where(F.col("album_id") == album_id).select(F.col("entry_id").alias("id"))
    return entries.join(members, "id", "left_semi")


def hide_archived(entries: DataFrame, archive: DataFrame) -> DataFrame:
    return entries.join(archive.select("id"), "id", "left_anti")


def only_archived(entries: DataFrame, archive: DataFrame) -> DataFrame:
    return entries.join(archive.select("id"), "id", "left_semi")


def in_view(library: Library, view: View) -> DataFrame:
    """Entries of a view. Only the archive shows archived ones; an empty archive shows all entries, an unknown album no filter."""
    if view.kind == "archive":
        return library.entries if library.archive.isEmpty() else only_archived(library.entries, library.archive)
    shown = hide_archived(library.entries, library.archive)
    if view.kind == "folder":
        return by_folder(shown, view.key)
    if view.kind == "album":
        known = not library.album_entries.where(F.col("album_id") == view.key).isEmpty()
        return by_album(shown, library.album_entries, view.key if known else None)
    return shown


def sort_order(name: str, collation: str | None = "UNICODE") -> list[Column]:
    """Sort keys, all with the path last: scan order settles ties. Names compare as people order them; by bytes without a collation."""
    text = F.col("name") if collation is None else F.collate("name", collation)
    last = F.col("relative_path")
    return {
        "name": [text, last],
        "date": [F.desc("last_modified"), last],
        "rating": [F.desc("rating"), text, last],
        "pick": [F.when(F.col("pick") == "pick", 0).when(F.col("pick") == "none", 1).otherwise(2), text, last],
    }[name]


def visible_entries(library: Library, query: LibraryQuery) -> DataFrame:
    """The entries that a query shows, with ``pos`` from 0 in its order."""
    rows = by_format(with_metadata(in_view(library, query.view), library.metadata), query.format)
    return with_position(by_curation(rows, query.curation), *sort_order(query.sort))


def latest(entries: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest entries, by a top-n per task."""
    return entries.orderBy(*sort_order("date")).limit(n)


def search_albums(albums: DataFrame, text: str) -> DataFrame:
    """Albums whose name contains a text in any case, with ``exact`` where it is the name."""
    wanted = text.strip().lower()
    return albums.where(F.lower("name").contains(wanted)).withColumn("exact", F.lower(F.trim("name")) == wanted)


def albums_with_any(album_entries: DataFrame, selected: DataFrame) -> DataFrame:
    """Albums that hold any selected entry (column ``id``)."""
    return album_entries.join(selected.select(F.col("id").alias("entry_id")), "entry_id", "left_semi").select("album_id").distinct()


def toggled_rating(current: str, rating: int) -> str:
    """The curation filter after a click on a star: the same star again clears it; no star clears a filter by rating."""
    name = f"rating-{rating}"
    if rating == 0:
        return "all" if rating_of(current) else current
    return "all" if current == name else name


def rating_of(curation: str) -> int:
    """The stars that a curation filter asks for; 0 if it is of another kind."""
    return int(curation[-1]) if curation in {f"rating-{k}" for k in range(1, 6)} else 0
