"""Queries of document rules and older settings; each row is one case of the rules, with its key in it."""

from __future__ import annotations

import base64
import hashlib
import json
import struct

from pyspark.sql import functions as F

from silverframe.functions import settings as st
from silverframe.operators.batches import dealt
from silverframe.operators.catalog_documents import catalog_rows
from silverframe.operators.document_rules import parsed_documents
from silverframe.plans import fixtures as fx
from silverframe.plans.library_plans import query

_PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 4, 3) + b"\x08\0\0\0\0"
_KEY = hashlib.sha256(_PNG).hexdigest()
_AT = "settings.masking.masks[0]"


def _asset():
    return {"id": _KEY, "sha256": _KEY, "mimeType": "image/png", "width": 4, "height": 3, "byteLength": len(_PNG), "pngBase64": base64.b64encode(_PNG).decode()}


def _document():
    """A document with each kind of component that breaks no rule."""
    point = {"x": 0.25, "y": 1}
    brush = {"kind": "brush", "id": "b", "operation": "add", "strokes": [{"points": [point, point]}, {"points": [point], "flow": 0.5}], "size": 0.5, "feather": 0, "flow": 1, "density": 1}
    ai = {"kind": "ai", "id": "a", "operation": "add", "selector": "sky", "assetId": _KEY, "model": {"id": "sky", "revision": "1"}, "source": {"entryId": "e", "relativePath": "p", "size": 5, "lastModified": 1.5}, "inference": {"width": 8, "height": 8, "threshold": 0.5}}
    parts = [brush, {"kind": "linear-gradient", "id": "l", "operation": "subtract", "start": point, "end": point}, {"kind": "radial-gradient", "id": "r", "operation": "add", "center": point, "radiusX": 0.5, "radiusY": 0.5, "rotation": 700, "feather": 1}, ai]
    mask = {"id": "m", "name": "Sky", "enabled": True, "inverted": False, "components": parts, "adjustments": st.DEFAULTS["basic"]}
    return json.loads(json.dumps({"version": 2, "settings": st.DEFAULTS | {"masking": {"masks": [mask]}}, "maskAssets": {_KEY: _asset()}, "more": "@"}))


_GONE = object()


def _changed(*changes):
    """The document with values put at paths (tuples of keys)."""
    d = _document()
    for path, value in changes:
        at = d
        for key in path[:-1]:
            at = at[key]
        if value is _GONE:
            del at[path[-1]]
        else:
            at[path[-1]] = value
    return json.dumps(d)


_M, _S, _A = ("settings", "masking", "masks"), "settings", ("maskAssets", _KEY)
_C = (*_M, 0, "components")
# (text, breaches): a rule broken at a time, as the rules say, then several at once
CASES = [
    (_changed(), []),
    ("[]", [("", "object")]),
    ("{", [("", "json")]),
    (_changed((("version",), "2")), [("version", "number")]),
    (_changed((("version",), 3)), [("version", "newer")]),
    (_changed((("version",), 1)), [("version", "unsupported")]),
    (_changed(((_S, "basic"), None)), [("settings.basic", "object")]),
    (_changed(((_S, "basic", "tint"), "1")), [("settings.basic.tint", "number")]),
    (_changed(((_S, "basic", "tint"), _GONE)), [("settings.basic.tint", "number")]),
    (_changed(((_S, "basic", "tint"), True)), [("settings.basic.tint", "number")]),
    (_changed(((_S, "crop", "enabled"), 1)), [("settings.crop.enabled", "boolean")]),
    (_changed(((_S, "crop", "width"), 1.01)), [("settings.crop.width", "range")]),
    (_changed(((_S, "crop", "aspectPreset"), "7:5")), [("settings.crop.aspectPreset", "choice")]),
    (_changed(((_S, "curve", "red"), [{"x": 0, "y": 0}])), [("settings.curve.red", "count")]),
    (_changed(((_S, "curve", "blue"), [{"x": 0, "y": 0}, {"x": 0, "y": 1}])), [("settings.curve.blue", "order")]),
    (_changed(((_S, "curve", "rgb", 1, "y"), -0.1)), [("settings.curve.rgb[1].y", "range")]),
    (_changed(((_S, "mixer", "aqua"), [])), [("settings.mixer.aqua", "object")]),
    (_changed(((_S, "mixer", "magenta", "hue"), None)), [("settings.mixer.magenta.hue", "number")]),
    (_changed(((_S, "effects", "grain"), _GONE)), [("settings.effects.grain", "number")]),
    (_changed(((_S, "effects", "grainSize"), None), ((_S, "effects", "noiseDetail"), _GONE)), []),
    (_changed(((_S, "effects", "grainSize"), "9")), [("settings.effects.grainSize", "number")]),
    (_changed(((_S, "masking"), _GONE)), [("settings.masking", "object")]),
    (_changed((_M, [_document()["settings"]["masking"]["masks"][0]] * 17)), [("settings.masking.masks", "count")]),
    (_changed(((*_M, 0, "name"), "")), [(f"{_AT}.name", "empty")]),
    (_changed(((*_M, 0, "id"), 5)), [(f"{_AT}.id", "string")]),
    (_changed((_C, [])), [(f"{_AT}.components", "count")]),
    (_changed(((*_C, 0, "kind"), "eraser")), [(f"{_AT}.components[0].kind", "choice")]),
    (_changed(((*_C, 1, "operation"), "xor")), [(f"{_AT}.components[1].operation", "choice")]),
    (_changed(((*_C, 0, "strokes"), [])), [(f"{_AT}.components[0].strokes", "count")]),
    (_changed(((*_C, 0, "strokes", 1, "points", 0, "x"), 2)), [(f"{_AT}.components[0].strokes[1].points[0].x", "range")]),
    (_changed(((*_C, 0, "strokes", 1, "flow"), None)), [(f"{_AT}.components[0].strokes[1].flow", "number")]),
    (_changed(((*_C, 2, "rotation"), "0")), [(f"{_AT}.components[2].rotation", "number")]),
    (_changed(((*_C, 3, "model", "id"), "face")), [(f"{_AT}.components[3].model.id", "choice")]),
    (_changed(((*_C, 3, "source", "size"), 1.5)), [(f"{_AT}.components[3].source.size", "range")]),
    (_changed(((*_C, 3, "inference", "width"), 9000)), [(f"{_AT}.components[3].inference.width", "range")]),
    (_changed(((*_M, 0, "adjustments", "tint"), _GONE)), [(f"{_AT}.adjustments.tint", "number")]),
    (_changed((("maskAssets",), [])), [("maskAssets", "object")]),
    (_changed(((*_A, "mimeType"), "image/gif")), [(f"maskAssets.{_KEY}.mimeType", "choice")]),
    (_changed(((*_A, "byteLength"), 30)), [(f"maskAssets.{_KEY}.byteLength", "length")]),
    (_changed(((*_A, "pngBase64"), "a-b=")), [(f"maskAssets.{_KEY}.pngBase64", "base64")]),
    (_changed(((*_A, "width"), 5)), [(f"maskAssets.{_KEY}", "size")]),
    (_changed(((*_A, "sha256"), "x")), [(f"maskAssets.{_KEY}.sha256", "digest form")]),
    (_changed((("maskAssets", "k"), _asset())), [("maskAssets.k.id", "key")]),
    (_changed((("maskAssets",), {})), [(_KEY, "missing asset")]),
    (_changed((_C, _document()["settings"]["masking"]["masks"][0]["components"][:3])), [(_KEY, "unused asset")]),
    (_changed(((*_C, 1, "id"), "b"), ((*_C, 2, "id"), "m")), [("b", "repeated id"), ("m", "repeated id")]),
    (_changed(((*_C, 0, "strokes"), [{"points": [{"x": 0, "y": 0}] * 8192}] * 9)), [("", "too many points")]),
    (_changed(((_S, "basic", "tint"), "1"), ((_S, "crop", "x"), 2), ((*_M, 0, "enabled"), None)), [("settings.basic.tint", "number"), ("settings.crop.x", "range"), (f"{_AT}.enabled", "boolean")]),
]
_LISTED = ", ".join(f"({i}, '{p}', '{r}')" for i, (_, found) in enumerate(CASES) for p, r in found)


def _texts(spark, d):
    """A part's key picks its case and is in its text. The cases are a small table of their own, sent to all, since a case is not to be one task's."""
    cases = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "case int, text string")
    parts = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(CASES)).cast("int").alias("case"))
    return dealt(parts, "id").join(F.broadcast(cases), "case").select("id", F.replace("text", F.lit('"@"'), F.col("id").cast("string")).alias("text"))


@query("document_rules", f" SELECT p_partkey AS id, path, rule FROM part JOIN (VALUES {_LISTED}) c(k, path, rule) ON p_partkey % {len(CASES)} = k")
def document_rules(spark, d):
    return parsed_documents(_texts(spark, d)).select("id", F.inline("problems"))


_FINE = ", ".join(str(i) for i, (_, found) in enumerate(CASES) if not found)


@query("document_parsed", f" SELECT p_partkey AS id, 25.0::DOUBLE AS grain_size, 50.0::DOUBLE AS noise_detail, 1.0::DOUBLE AS first_flow, 0.5::DOUBLE AS second_flow FROM part WHERE p_partkey % {len(CASES)} IN ({_FINE})")
def document_parsed(spark, d):
    """Documents that break no rule, with what they left out: effects by default, a stroke's flow from its component."""
    at = lambda path: F.get_json_object("document", path).cast("double")
    flow = "$.settings.masking.masks[0].components[0].strokes[{}].flow"
    return parsed_documents(_texts(spark, d)).where("document IS NOT NULL").select("id", at("$.settings.effects.grainSize").alias("grain_size"), at("$.settings.effects.noiseDetail").alias("noise_detail"), at(flow.format(0)).alias("first_flow"), at(flow.format(1)).alias("second_flow"))


@query("document_migration", """ SELECT p_partkey AS id, 'older' AS source, CASE WHEN p_partkey % 5 < 4 THEN (p_partkey % 9)::DOUBLE END AS exposure, CASE WHEN p_partkey % 5 < 4 THEN 50.0::DOUBLE END AS grain_roughness,
    CASE WHEN p_partkey % 5 < 4 THEN (p_partkey % 7)::DOUBLE END AS hue, CASE WHEN p_partkey % 5 < 3 THEN round(least(1, greatest(0, (64 + p_partkey % 401 - 200) / 255.0::DOUBLE)), 9) WHEN p_partkey % 5 = 3 THEN 0.0 END AS second_y,
    CASE WHEN p_partkey % 5 < 3 THEN 5 WHEN p_partkey % 5 = 3 THEN 3 END::INTEGER AS points, CASE WHEN p_partkey % 5 = 4 THEN 'settings.crop.angle number' END AS problem FROM part""")
def document_migration(spark, d):
    """Older settings: sliders of the tone curve become points, points are put right, what is missing gets its default."""
    k = F.col("p_partkey")
    curve = F.when(k % 5 < 3, F.concat(F.lit('{"shadows":'), (k % 401 - 200).cast("string"), F.lit("}"))).otherwise('{"rgb":[{"x":0.9,"y":2},{"x":0.5,"y":-1},{"x":"a","y":0},{"x":0.1,"y":0.2}]}')
    crop = F.when(k % 5 == 4, '{"angle":null}').otherwise("{}")
    text = F.concat(F.lit('{"basic":{"exposure":'), (k % 9).cast("string"), F.lit('},"mixer":{"aqua":{"hue":'), (k % 7).cast("string"), F.lit('}},"effects":{"grain":1},"crop":'), crop, F.lit(',"curve":'), curve, F.lit("}"))
    at = lambda path: F.get_json_object("document", f"$.settings.{path}")
    points = F.from_json(at("curve.rgb"), "array<struct<x:double,y:double>>")
    rows = parsed_documents(dealt(fx.table(spark, d, "part").select("p_partkey"), "p_partkey").select(k.alias("id"), text.alias("text")))
    return rows.select("id", "source", at("basic.exposure").cast("double").alias("exposure"), at("effects.grainRoughness").cast("double").alias("grain_roughness"), at("mixer.aqua.hue").cast("double").alias("hue"), F.round(F.get(points, F.lit(1))["y"], 9).alias("second_y"), F.when(points.isNotNull(), F.size(points)).alias("points"), F.concat_ws(" ", F.get("problems", F.lit(0))["path"], F.get("problems", F.lit(0))["rule"]).alias("problem")).withColumn("problem", F.nullif("problem", F.lit("")))


def _catalogs(spark, d):
    """A catalog for each customer, of version 1 and 2 in turn; every seventh one breaks a rule."""
    k = F.col("c_custkey")
    n = lambda c: c.cast("string")
    develop = F.when(k % 2 == 0, json.dumps({"version": 2, "settings": st.DEFAULTS | {"masking": {"masks": []}}, "maskAssets": {}})).otherwise(F.concat(F.lit('{"basic":{"exposure":'), n(k % 5), F.lit("}}")))
    clock = F.when(k % 3 == 0, F.concat(F.lit(',"developUpdatedAt":'), n(k * 2))).otherwise("")
    first = F.concat(F.lit('{"pick":"pick","rating":'), n(k % 6), F.lit(',"colorLabel":"red","develop":'), develop, clock, F.lit(',"updatedAt":'), n(k), F.lit("}"))
    second = F.concat(F.lit('{"pick":"none","rating":'), F.when(k % 7 == 0, "5.5").otherwise("0"), F.lit(',"colorLabel":null,"updatedAt":1}'))
    rest = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(',"albums":[{"id":"x","name":"N","entryIds":["a"],"createdAt":1,"updatedAt":'), n(k), F.lit('}],"archivedEntryIds":["b","c"]')))
    text = F.concat(F.lit('{"version":'), n(2 - k % 2), F.lit(',"rootPath":"/r","entries":{"a":'), first, F.lit(',"b":'), second, F.lit("}"), rest, F.lit("}"))
    return dealt(fx.table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("id"), text.alias("text"))


@query("catalog_documents", """ WITH c AS (SELECT c_custkey AS k FROM customer), good AS (SELECT k FROM c WHERE k % 7 > 0)
    SELECT k AS id, 'entry' AS kind, 'a' AS key, 0 AS place, k % 6 AS rating, CASE WHEN k % 3 = 0 THEN k * 2 ELSE k END AS clock, CASE WHEN k % 2 = 0 THEN 0.0 ELSE k % 5 END::DOUBLE AS exposure, NULL AS path, NULL AS rule FROM good
    UNION ALL SELECT k, 'entry', 'b', 1, 0, 0, NULL, NULL, NULL FROM good
    UNION ALL SELECT k, 'album', 'x', 0, NULL, k, NULL, NULL, NULL FROM good WHERE k % 4 > 0
    UNION ALL SELECT k, 'archived', unnest(['b', 'c']), unnest([0, 1]), NULL, NULL, NULL, NULL, NULL FROM good WHERE k % 4 > 0
    UNION ALL SELECT k, 'problem', NULL, 0, NULL, NULL, NULL, 'entries.b.rating', 'range' FROM c WHERE k % 7 = 0""")
def catalog_documents(spark, d):
    at = lambda path, kind: F.get_json_object("value", f"$.{path}").cast(kind)
    rows = catalog_rows(_catalogs(spark, d))
    clock = F.when(F.col("kind") == "entry", at("developUpdatedAt", "long")).otherwise(at("updatedAt", "long"))
    return rows.select("id", "kind", "key", "place", at("rating", "long").alias("rating"), clock.alias("clock"), at("develop.settings.basic.exposure", "double").alias("exposure"), "path", "rule")
