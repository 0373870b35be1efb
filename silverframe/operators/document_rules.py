"""Edit documents as JSON texts: every broken rule with its path, parsed documents, and older settings brought up to date.

A document that breaks a rule of shape is reported with all of them; one of right shape is then held against the rules that
look at all of it: ids that repeat, assets that are missing or not used, limits of strokes, points and bytes.
"""

from __future__ import annotations

import base64
import json
import re
from collections import Counter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from silverframe.functions import settings as st
from silverframe.functions.rules import Choice, Fields, Flag, Items, Number, OneOf, Optional, Text, breaches, is_number
from silverframe.operators.batches import by_bytes

# Limits of the format.
MAX_MASKS, MAX_COMPONENTS, MAX_STROKES, MAX_POINTS, MAX_STROKE_POINTS, MAX_MATTE = 16, 64, 4096, 65536, 8192, 2048
MAX_BYTES, MAX_INFERENCE, MAX_CURVE, MAX_WHOLE, VERSION = 16 << 20, 8192, 256, 2**53 - 1, 2
REQUIRED_EFFECTS = ("vignette", "grain", "sharpening", "noiseReduction")
STROKE = ("size", "feather", "flow", "density")

UNIT = Number(0, 1)
POINT = Fields({"x": UNIT, "y": UNIT})
BASIC = Fields({n.name: Number() for n in st.BASIC})
CROP = Fields({"enabled": Flag(), **{n: UNIT for n in st.RECTANGLE}, **{n.name: Number() for n in st.TRANSFORM}, "aspectPreset": Choice(st.PRESETS), "customAspectWidth": Number(), "customAspectHeight": Number()})
SETTINGS = {
    "basic": BASIC,
    "crop": CROP,
    "curve": Fields({c: Items(POINT, 2, MAX_CURVE, rising="x") for c, _ in st.CURVES}),
    "mixer": Fields({c: Fields({b: Number() for b, _ in st.BAND}) for c in st.COLORS}),
    "effects": Fields({n.name: Number() if n.name in REQUIRED_EFFECTS else Optional(Number(), null=True) for n in st.EFFECTS}),
}
COMPONENT = OneOf(
    "kind",
    Fields({"id": Text(), "operation": Choice(("add", "subtract"))}),
    {
        "brush": Fields({"strokes": Items(Fields({"points": Items(POINT, 1, MAX_STROKE_POINTS), **{n: Optional(UNIT) for n in STROKE}}), 1, MAX_STROKES), **{n: UNIT for n in STROKE}}),
        "linear-gradient": Fields({"start": POINT, "end": POINT}),
        "radial-gradient": Fields({"center": POINT, "radiusX": UNIT, "radiusY": UNIT, "rotation": Number(), "feather": UNIT}),
        "ai": Fields(
            {
                "selector": Choice(("subject", "sky")),
                "assetId": Text(),
                "model": Fields({"id": Choice(("subject", "sky")), "revision": Text()}),
                "source": Fields({"entryId": Text(), "relativePath": Text(), "size": Number(0, MAX_WHOLE, whole=True), "lastModified": Number()}),
                "inference": Fields({"width": Number(1, MAX_INFERENCE, whole=True), "height": Number(1, MAX_INFERENCE, whole=True), "threshold": UNIT}),
            }
        ),
    },
)
MASK = Fields({"id": Text(), "name": Text(), "enabled": Flag(), "inverted": Flag(), "components": Items(COMPONENT, 1, MAX_COMPONENTS), "adjustments": BASIC})
MASKING = Fields({"masks": Items(MASK, 0, MAX_MASKS)})
ASSET = Fields({"id": Text(), "sha256": Text(empty=True), "mimeType": Choice(("image/png",)), "width": Number(1, MAX_MATTE, whole=True), "height": Number(1, MAX_MATTE, whole=True), "byteLength": Number(8, MAX_BYTES, whole=True), "pngBase64": Text(empty=True)})
Found = list[tuple[str, str]]


def _asset(value: Any, key: str) -> Found:
    path = f"maskAssets.{key}"
    found = breaches(ASSET, value, path)
    if found:
        return found
    text = value["pngBase64"]
    if not text or len(text) % 4 or not re.fullmatch("[A-Za-z0-9+/]*={0,2}", text):
        return [(f"{path}.pngBase64", "base64")]
    raw = base64.b64decode(text)
    found = [(f"{path}.byteLength", "length")] if len(raw) != value["byteLength"] else []
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        found.append((f"{path}.pngBase64", "signature"))
    elif len(raw) < 24 or raw[12:16] != b"IHDR":
        found.append((f"{path}.pngBase64", "header"))
    elif (int.from_bytes(raw[16:20]), int.from_bytes(raw[20:24])) != (value["width"], value["height"]):
        found.append((path, "size"))
    if not re.fullmatch("[a-f0-9]{64}", value["sha256"]):
        found.append((f"{path}.sha256", "digest form"))
    elif value["id"] != value["sha256"]:
        found.append((f"{path}.id", "digest"))
    return found + ([(f"{path}.id", "key")] if value["id"] != key else [])


def _whole(document: dict, size: int) -> Found:
    """Rules of a document of right shape."""
    masks, assets = document["settings"]["masking"]["masks"], document["maskAssets"]
    components = [c for m in masks for c in m["components"]]
    ids = Counter(x["id"] for x in [*masks, *components])
    wanted = {c["assetId"] for c in components if c["kind"] == "ai"}
    strokes = [s for c in components if c["kind"] == "brush" for s in c["strokes"]]
    found = [(i, "repeated id") for i in sorted(ids) if ids[i] > 1]
    found += [(i, "missing asset") for i in sorted(wanted - assets.keys())]
    limits = (("too many strokes", len(strokes), MAX_STROKES), ("too many points", sum(len(s["points"]) for s in strokes), MAX_POINTS))
    found += [("", rule) for rule, n, most in limits if n > most]
    found += [(i, "unused asset") for i in sorted(assets.keys() - wanted)]
    return found + ([("", "too large")] if size > MAX_BYTES else [])


def load(text: str | None) -> Any:
    """A JSON text's value; ValueError for what isn't JSON, numbers that no JSON has included."""

    def refuse(name: str):
        raise ValueError(name)

    return json.loads(text or "", parse_constant=refuse)


def _filled(settings: dict) -> None:
    """Settings that a document may leave out, put in."""
    for n in st.EFFECTS:
        if settings["effects"].get(n.name) is None:
            settings["effects"][n.name] = float(n.default)
    for mask in settings.get("masking", {}).get("masks", []):
        for c in mask["components"]:
            for stroke in c["strokes"] if c["kind"] == "brush" else []:
                stroke.update({n: c[n] for n in STROKE if n not in stroke})


def _size(document: dict, given: int | None) -> int:
    """Bytes of a document as JSON, or a bound of them within the limit, told by the ``given`` characters of its text.

    A number's shortest text is at most six times as long as it was given, a character of a text has at most four bytes; what was
    left out and put in has at most 160 bytes a stroke and 2,000 for the effects.
    """
    strokes = sum(len(c["strokes"]) for m in document["settings"]["masking"]["masks"] for c in m["components"] if c["kind"] == "brush")
    most = MAX_BYTES + 1 if given is None else given * 6 + strokes * 160 + 2_000
    return most if most <= MAX_BYTES else len(json.dumps(document, separators=(",", ":"), ensure_ascii=False).encode(errors="surrogatepass"))


def parse(value: Any, given: int | None = None) -> tuple[dict | None, Found]:
    """A document of the present version with what it may leave out, or None and the rules it breaks; ``given`` as in :func:`_size`."""
    if not isinstance(value, dict):
        return None, [("", "object")]
    version = value.get("version")
    if not is_number(version) or version != VERSION:
        return None, [("version", "number" if not is_number(version) else "newer" if version > VERSION else "unsupported")]
    found = breaches(Fields(SETTINGS | {"masking": MASKING}), value.get("settings"), "settings")
    assets = value.get("maskAssets")
    if isinstance(assets, dict):
        found += [x for key in sorted(assets) for x in _asset(assets[key], key)]
    else:
        found.append(("maskAssets", "object"))
    if found:
        return None, found
    _filled(value["settings"])
    document = {"version": VERSION, "settings": value["settings"], "maskAssets": {k: assets[k] for k in sorted(assets)}}
    found = _whole(document, _size(document, given))
    return (None, found) if found else (document, [])


def _curves(value: Any) -> dict[str, list[dict]]:
    """Curves of older settings: three sliders of the master curve, or points of any quality."""
    value = value if isinstance(value, dict) else {}
    sliders = [value.get(n) for n in ("shadows", "midtones", "highlights")]
    if any(map(is_number, sliders)):
        shift = [0, *(x if is_number(x) else 0 for x in sliders), 0]
        master = [{"x": x / 255, "y": min(1.0, max(0.0, (x + d) / 255))} for x, d in zip((0, 64, 128, 192, 255), shift, strict=True)]
        return {c: master if c == "rgb" else st.LINE for c, _ in st.CURVES}

    def points(of: Any) -> list[dict]:
        fine = [p for p in of if isinstance(p, dict) and is_number(p.get("x")) and is_number(p.get("y"))] if isinstance(of, list) else []
        return st.curve_points([(p["x"], p["y"]) for p in fine])

    return {c: points(value.get(c)) for c, _ in st.CURVES}


def migrate(value: Any) -> tuple[dict | None, Found]:
    """A document from settings of before documents had a version: missing settings get their defaults, the rest must be right."""
    if not isinstance(value, dict):
        return None, [("", "object")]
    found: Found = []

    def over(default: dict, given: dict, name: str, path: str) -> dict:
        if name in given and not isinstance(given[name], dict):
            found.append((path, "object"))
        return default | (given.get(name) if isinstance(given.get(name), dict) else {})

    merged = {g: over(st.DEFAULTS[g], value, g, f"settings.{g}") for g in ("basic", "crop", "effects")}
    bands = over({}, value, "mixer", "settings.mixer")
    merged["mixer"] = {c: over(st.DEFAULTS["mixer"][c], bands, c, f"settings.mixer.{c}") for c in st.COLORS}
    merged["curve"] = _curves(value.get("curve"))
    found += breaches(Fields(SETTINGS), merged, "settings")
    if found:
        return None, found
    _filled(merged)
    return {"version": VERSION, "settings": {g: merged[g] for g in SETTINGS} | {"masking": {"masks": []}}, "maskAssets": {}}, []


PARSED = "document string, source string, problems array<struct<path:string,rule:string>>"


def parsed_documents(texts: DataFrame) -> DataFrame:
    """id, document, source and problems of JSON texts (id, text) of documents of the present version and of older settings.

    ``document`` is the parsed document as JSON, null for one that breaks rules; ``problems`` lists these. Older settings, which have no
    version and no settings of their own, are brought up to date; ``source`` tells which of the two a text was. A text that is null or no
    JSON breaks the rule ``json``.
    """

    def read(text: str | None) -> tuple[str | None, str | None, Found]:
        try:
            value = load(text)
        except (ValueError, RecursionError):
            return None, None, [("", "json")]
        old = isinstance(value, dict) and not value.keys() & {"version", "settings"}
        document, found = migrate(value) if old else parse(value, len(text))
        return None if document is None else json.dumps(document), "older" if old else "document", found

    def run(batches):
        kind = pa.list_(pa.struct([("path", pa.string()), ("rule", pa.string())]))
        for batch in (part for whole in batches for part in by_bytes(whole)):
            rows = [read(t) for t in batch.column("text").to_pylist()]
            problems = pa.array([[{"path": p, "rule": r} for p, r in row[2]] for row in rows], kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)), problems], ["id", "document", "source", "problems"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, {PARSED}")
