"""Sidecars of entries: what they say, and what to write into them."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverframe.functions import sidecars as sc

_BASE64 = "^[A-Za-z0-9+/]*={0,2}$"
WRITTEN = "path string, bytes long, error string"


def mask_payload(masking: Column, assets: Column) -> Column:
    """Masks and their assets (JSON texts) as they stand in a sidecar."""
    text = F.concat(F.lit('{"version":2,"masking":'), masking, F.lit(',"maskAssets":'), assets, F.lit("}"))
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", "")  # a session may cut base 64 into lines


def mask_texts(payload: Column) -> Column:
    """(version, masking, assets, error) of a payload: JSON texts; ``error`` where it isn't base 64 of an object with all three."""
    fine = (F.length(payload) > 0) & (F.length(payload) % 4 == 0) & payload.rlike(_BASE64)
    text = F.try_validate_utf8(F.when(fine, F.unbase64(payload)).cast("string"))
    value = F.try_parse_json(text)
    part = lambda name: F.try_variant_get(value, f"$.{name}", "string")
    there = lambda name: F.try_variant_get(value, f"$.{name}", "variant").isNotNull()
    error = (
        F.when(payload.isNull(), None)
        .when(~fine, "not base 64")
        .when(F.try_variant_get(value, "$", "map<string,variant>").isNull(), "no object")
        .when(~(there("version") & there("masking") & there("maskAssets")), "incomplete")
    )
    return F.struct(part("version").alias("version"), part("masking").alias("masking"), part("maskAssets").alias("assets"), error.alias("error"))


def sidecar_records(texts: DataFrame, masks: str = sc.MASKS) -> DataFrame:
    """id, settings, rating, has_label, color_label, masking, assets, source and error of sidecar texts (id, text).

    A rating or label that says nothing is null without ``has_label``; an unreadable file has only its error. ``source`` tells
    whether a file holds mask data (2) or not (1); masks that can't be read are an error of the file.
    """
    said = texts.select("id", sc.sidecar_properties(F.col("text"), masks).alias("p"))
    masking = F.when(F.col("p.masks") != "", F.col("p.masks"))
    rows = said.select("id", "p", masking.isNotNull().alias("masked"), mask_texts(masking).alias("m"), sc.label(F.col("p.xmp")).alias("label"))
    error = F.coalesce("p.error", "m.error")
    fine = lambda c, name: F.when(error.isNull(), c).alias(name)
    return rows.select(
        "id",
        fine(F.col("p.settings"), "settings"),
        fine(sc.rating(F.col("p.xmp")), "rating"),
        F.coalesce(error.isNull() & F.col("label.known"), F.lit(False)).alias("has_label"),
        fine(F.col("label.value"), "color_label"),
        fine(F.coalesce("m.masking", F.lit('{"masks":[]}')), "masking"),
        fine(F.coalesce("m.assets", F.lit("{}")), "assets"),
        fine(F.when(F.col("masked"), 2).otherwise(1), "source"),
        error.alias("error"),
    )


def sidecar_contents(rows: DataFrame, masks: str = sc.MASKS) -> DataFrame:
    """id, contents and error: the new sidecar of each row, null where there is nothing to say.

    ``rows``: id, settings, masking and assets (JSON texts), rating, color_label and existing (the present text, null without a
    file). Without a file, settings and marks of an untouched image need none. Null settings are the defaults.
    """
    masking, assets = F.coalesce("masking", F.lit('{"masks":[]}')), F.coalesce("assets", F.lit("{}"))
    no_masks = F.size(F.try_variant_get(F.try_parse_json(masking), "$.masks", "array<variant>")) == 0
    payload = F.when(~F.coalesce(no_masks, F.lit(False)), mask_payload(masking, assets)).alias("masks")
    made = sc.sidecar_texts(rows.select("id", "existing", "settings", "rating", F.col("color_label").alias("label"), payload), masks)
    return made.select("id", F.col("text").alias("contents"), "error")


def write_files(contents: DataFrame, root: str) -> DataFrame:
    """path, bytes and error of each written row of ``contents`` (path below ``root``, contents); nulls aren't written.

    Each task writes its rows through the file system of ``root`` (any that pyarrow opens): under a name of its own
    first, then renamed into place, so that a reader sees the old text or the new one, and a task that runs again
    writes the same. Rows of equal path should be one row; the last to be renamed stays. Errors are rows.
    """

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("contents").to_pylist(), strict=True):
                data, target = text.encode(), f"{base.rstrip('/')}/{path}"
                part = f"{target}.{uuid.uuid4().hex}.part"
                try:
                    system.create_dir(target.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(part) as f:
                        f.write(data)
                    system.move(part, target)
                    out.append((path, len(data), None))
                except OSError as e:
                    out.append((path, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["path", "bytes", "error"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("error", pa.string())]))

    return contents.where("path IS NOT NULL AND contents IS NOT NULL").select("path", "contents").mapInArrow(run, WRITTEN)
