"""Catalog documents of either version as rows: entries with their marks and edit documents, albums, archived entries.

A catalog that breaks a rule gives its problems and no rows. Entries of version 1 hold older settings, which are brought up to
date; those of version 2 hold edit documents. An entry without a clock of its edits has that of its marks if it has edits.
A catalog is one JSON value by its format, so it is read by one task; many catalogs are read by many.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from silverframe.functions.rules import Choice, Fields, Items, Number, Optional, Text, breaches, is_number
from silverframe.functions.sidecars import LABELS
from silverframe.operators.batches import by_bytes
from silverframe.operators.document_rules import Found, load, migrate, parse

VERSIONS, MOST_ITEMS = (1, 2), 2**31
MARKS = Fields({"pick": Choice(("none", "pick", "reject")), "rating": Number(0, 5, whole=True), "updatedAt": Number(), "developUpdatedAt": Optional(Number())})
ALBUM = Fields({"id": Text(empty=True), "name": Text(empty=True), "entryIds": Items(Text(empty=True), 0, MOST_ITEMS), "createdAt": Number(), "updatedAt": Number()})
ROWS = "kind string, key string, place int, value string, path string, rule string"


def _entry(value: Any, version: int, path: str) -> tuple[dict | None, Found]:
    found = breaches(MARKS, value, path)
    if not isinstance(value, dict):
        return None, found
    label = value.get("colorLabel", 0)
    if label is not None:
        found += breaches(Choice(LABELS), label, f"{path}.colorLabel")
    develop = None
    if "develop" in value:
        develop, more = (migrate if version == 1 else parse)(value["develop"])
        found += [(f"{path}.develop.{p}".rstrip("."), rule) for p, rule in more]
    if found:
        return None, found
    clock = value.get("developUpdatedAt", value["updatedAt"] if develop else 0)
    return {"pick": value["pick"], "rating": int(value["rating"]), "colorLabel": label, "develop": develop, "developUpdatedAt": clock, "updatedAt": value["updatedAt"]}, []


def catalog_parts(value: Any) -> tuple[list[tuple[str, str, int, dict | None]], Found]:
    """(kind, key, place, value) of a catalog's parts, and the rules it breaks."""
    if not isinstance(value, dict):
        return [], [("", "object")]
    version = value.get("version")
    if not is_number(version) or version != int(version):
        return [], [("version", "number")]
    if version not in VERSIONS:
        return [], [("version", "newer" if version > VERSIONS[-1] else "unsupported")]
    found = breaches(Text(empty=True), value.get("rootPath"), "rootPath")
    entries = value.get("entries")
    albums, archived = (value.get(n) if value.get(n) is not None else [] for n in ("albums", "archivedEntryIds"))
    rows: list[tuple[str, str, int, dict | None]] = []
    if not isinstance(entries, dict):
        found.append(("entries", "object"))
    for i, (key, entry) in enumerate(entries.items() if isinstance(entries, dict) else ()):
        parsed, more = _entry(entry, int(version), f"entries.{key}")
        found += more
        rows.append(("entry", key, i, parsed))
    found += breaches(Items(ALBUM, 0, MOST_ITEMS), albums, "albums") + breaches(Items(Text(empty=True), 0, MOST_ITEMS), archived, "archivedEntryIds")
    if found:
        return [], found
    rows += [("album", a["id"], i, {n: a[n] for n in ALBUM.of}) for i, a in enumerate(albums)]
    return rows + [("archived", key, i, None) for i, key in enumerate(archived)], []


def catalog_rows(texts: DataFrame) -> DataFrame:
    """id and ``ROWS`` of catalogs (id, text): a row for each entry, album (values as JSON) and archived entry, or for each problem.

    ``place`` is a part's place among its kind. A text that is null or no JSON is the problem ``json``.
    """

    def run(batches):
        for batch in (part for whole in batches for part in by_bytes(whole)):
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    rows, problems = catalog_parts(load(text))
                except (ValueError, RecursionError):
                    rows, problems = [], [("", "json")]
                out += [(key, kind, name, place, None if value is None else json.dumps(value), None, None) for kind, name, place, value in rows]
                out += [(key, "problem", None, place, None, path, rule) for place, (path, rule) in enumerate(problems)]
            types = [batch.schema.field("id").type, pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "kind", "key", "place", "value", "path", "rule"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, {ROWS}")
