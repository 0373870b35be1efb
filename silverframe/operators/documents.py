"""Edit documents as rows: totals, audit of their rules, canonical form.

``documents``: id, masks (array of struct: id, components; a component is a struct of id, kind, asset and strokes, a
stroke of at least points) and assets (map from id to content). Each rule is an expression over one document, so an
audit needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverframe.operators.edits import MAX_POINTS, MAX_STROKES

MAX_BYTES = 16 << 20


def _components() -> Column:
    return F.flatten(F.transform(F.coalesce("masks", F.array()), lambda m: m["components"]))


def _keys() -> Column:
    return F.coalesce(F.map_keys("assets"), F.array())


def _parts(documents: DataFrame) -> DataFrame:
    """Documents with their components and keys of assets as columns, so that each is worked out once."""
    return documents.select("id", "masks", "assets", _components().alias("components"), _keys().alias("keys"))


def _strokes() -> Column:
    brush = F.filter("components", lambda c: c["kind"] == "brush")
    return F.flatten(F.transform(brush, lambda c: F.coalesce(c["strokes"], F.array())))


def _points(strokes: Column) -> Column:
    return F.aggregate(strokes, F.lit(0), lambda n, s: n + F.coalesce(F.size(s["points"]), F.lit(0)))


def totals(documents: DataFrame) -> DataFrame:
    """(id, n_masks, n_components, n_strokes, n_points, n_assets) of each document; nulls count as empty."""
    row = _parts(documents).withColumn("strokes", _strokes())
    return row.select("id", F.size(F.coalesce("masks", F.array())).alias("n_masks"), F.size("components").alias("n_components"), F.size("strokes").alias("n_strokes"), _points(F.col("strokes")).alias("n_points"), F.size("keys").alias("n_assets"))


def violations(documents: DataFrame, max_strokes: int = MAX_STROKES, max_points: int = MAX_POINTS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, rule, subject): each broken rule of each document with the id it is about (null for limits).

    Rules: an id of masks and components that repeats, a component of kind ``ai`` without its asset, an asset that no
    component refers to, limits of strokes, points and bytes as JSON. A document is read once for all of them.
    """
    ids = F.concat(F.transform(F.coalesce("masks", F.array()), lambda m: m["id"]), F.transform("components", lambda c: c["id"]))
    referred = F.array_distinct(F.transform(F.filter("components", lambda c: c["kind"] == "ai"), lambda c: c["asset"]))
    # an id repeats if it sorts next to itself
    row = _parts(documents).select("id", "keys", F.sort_array(ids).alias("ids"), referred.alias("referred"), _strokes().alias("strokes"), F.octet_length(F.to_json(F.struct("masks", "assets"))).alias("bytes"))
    repeated = F.array_distinct(F.filter("ids", lambda v, i: (i > 0) & (v == F.try_element_at("ids", i))))
    about = lambda subjects, rule: F.transform(subjects, lambda v: F.struct(F.lit(rule).alias("rule"), v.cast("string").alias("subject")))
    named = F.concat(about(repeated, "repeated id"), about(F.array_except("referred", "keys"), "missing asset"), about(F.array_except("keys", "referred"), "unused asset"))
    over = [("too many strokes", F.size("strokes") > max_strokes), ("too many points", _points(F.col("strokes")) > max_points), ("too large", F.col("bytes") > max_bytes)]
    none = F.lit(None).cast("string")
    limits = F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(rule).alias("rule"), none.alias("subject"))) for rule, broken in over)))
    return row.select("id", F.explode(F.concat(F.coalesce(named, F.array()), limits)).alias("v")).select("id", "v.rule", "v.subject")


def canonical_assets(assets: Column) -> Column:
    """A map with its entries in order of their keys."""
    return F.map_from_entries(F.array_sort(F.map_entries(assets)))


def is_default_masking() -> Column:
    """Whether a document has neither masks nor assets."""
    return (F.size(F.coalesce("masks", F.array())) == 0) & (F.size(_keys()) == 0)


def same_document(a: Column, b: Column) -> Column:
    """Whether two structs are equal as JSON texts, order of map entries included."""
    return F.to_json(a) == F.to_json(b)


def mask_diagnostics(components: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, mask, component, asset, kind, blocks): what is wrong with components of kind ``ai`` and whether it stops an export.

    ``components``: id, mask, component, asset, stale; ``assets``: id, asset, verified. A component may be stale and have
    a missing or corrupt asset at once; stale ones don't stop an export.
    """
    known = components.join(assets.select("id", "asset", F.coalesce("verified", F.lit(False)).alias("verified")), ["id", "asset"], "left")
    kinds = F.array(F.when(F.col("stale"), "stale-ai"), F.when(F.col("verified").isNull(), "missing-asset").when(~F.col("verified"), "corrupt-asset"))
    rows = known.select("id", "mask", "component", "asset", F.explode(F.array_compact(kinds)).alias("kind"))
    return rows.withColumn("blocks", F.col("kind") != "stale-ai")


def asset_error(asset: Column, max_edge: int = 2048, max_bytes: int = MAX_BYTES) -> Column:
    """What is wrong with a raster asset (struct of id, sha256, width, height, byte_length, png as base 64); null if nothing.

    Checks run in order: base 64 and its length, the signature and header of a PNG, the digest's form, the id, the
    sizes, and the digest of the bytes.
    """
    raw = F.try_to_binary(asset["png"], F.lit("base64"))
    code = F.hex(F.substring(raw, 1, 24))
    number = lambda at: F.conv(F.substring(code, at * 2 + 1, 8), 16, 10).cast("long")
    edge = lambda v: F.coalesce(v.between(1, max_edge), F.lit(False))
    return (
        F.when(raw.isNull() | ~F.coalesce(asset["byte_length"].between(8, max_bytes) & (F.octet_length(raw) == asset["byte_length"]), F.lit(False)), "length")
        .when(~code.startswith("89504E470D0A1A0A"), "signature")
        .when((F.octet_length(raw) < 24) | (F.substring(code, 25, 8) != "49484452"), "header")
        .when(~F.coalesce(asset["sha256"].rlike("^[a-f0-9]{64}$"), F.lit(False)), "digest form")
        .when(~F.coalesce(asset["id"] == asset["sha256"], F.lit(False)), "id")
        .when(~edge(asset["width"]) | ~edge(asset["height"]) | (number(16) != asset["width"]) | (number(20) != asset["height"]), "size")
        .when(F.sha2(raw, 256) != asset["sha256"], "digest")
    )
