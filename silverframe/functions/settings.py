"""Develop settings: their shape, defaults, and their two-way mapping to sidecar properties.

A settings column is a struct of five groups (``SETTINGS``). A property is a text or, for curves, a list of texts. The mapping
is a small helper of the sidecar codec, which works on one file's text at a time.
"""

from __future__ import annotations

import json
import math
import re
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F



class Number(NamedTuple):
    """A numeric setting: its default, its property, the places it is written with, and what the property adds to it."""

    name: str
    default: float
    property: str
    places: int = 0
    offset: float = 0.0


# Settings, defaults and property names as sidecars of this format have them.
BASIC = (
    Number("exposure", 0, "Exposure2012", 2),
    Number("contrast", 0, "Contrast2012"),
    Number("highlights", 0, "Highlights2012"),
    Number("shadows", 0, "Shadows2012"),
    Number("whites", 0, "Whites2012"),
    Number("blacks", 0, "Blacks2012"),
    Number("temperature", 0, "Temperature", 0, 5500),
    Number("tint", 0, "Tint"),
    Number("vibrance", 0, "Vibrance"),
    Number("saturation", 0, "Saturation"),
)
TRANSFORM = (
    Number("angle", 0, "CropAngle", 2),
    Number("perspectiveX", 0, "PerspectiveHorizontal"),
    Number("perspectiveY", 0, "PerspectiveVertical"),
    Number("distortion", 0, "LensManualDistortionAmount"),
)
EFFECTS = (
    Number("vignette", 0, "PostCropVignetteAmount"),
    Number("vignetteMidpoint", 50, "PostCropVignetteMidpoint"),
    Number("vignetteRoundness", 0, "PostCropVignetteRoundness"),
    Number("vignetteFeather", 50, "PostCropVignetteFeather"),
    Number("vignetteHighlights", 0, "PostCropVignetteHighlightContrast"),
    Number("grain", 0, "GrainAmount"),
    Number("grainSize", 25, "GrainSize"),
    Number("grainRoughness", 50, "GrainFrequency"),
    Number("sharpening", 0, "Sharpness"),
    Number("sharpenRadius", 1, "SharpenRadius", 1),
    Number("sharpenDetail", 25, "SharpenDetail"),
    Number("sharpenMasking", 0, "SharpenEdgeMasking"),
    Number("noiseReduction", 0, "LuminanceSmoothing"),
    Number("noiseDetail", 50, "LuminanceNoiseReductionDetail"),
    Number("noiseContrast", 0, "LuminanceNoiseReductionContrast"),
    Number("colorNoiseReduction", 0, "ColorNoiseReduction"),
    Number("colorNoiseDetail", 50, "ColorNoiseReductionDetail"),
    Number("colorNoiseSmoothness", 50, "ColorNoiseReductionSmoothness"),
)
COLORS = ("red", "orange", "yellow", "green", "aqua", "blue", "purple", "magenta")
BAND = (("hue", "HueAdjustment"), ("saturation", "SaturationAdjustment"), ("luminance", "LuminanceAdjustment"))
CURVES = (("rgb", "ToneCurvePV2012"), ("red", "ToneCurvePV2012Red"), ("green", "ToneCurvePV2012Green"), ("blue", "ToneCurvePV2012Blue"))
PRESETS = ("original", "free", "1:1", "4:3", "3:2", "16:9", "5:4", "2:3", "9:16", "custom")
RECTANGLE = ("x", "y", "width", "height")
LINE = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
_DECIMAL, _BASED = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"), re.compile("0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)")
PROCESS_VERSION, CURVE_NAME, LEAST_SIDE = "15.0", "Custom", 0.05

_doubles = lambda names: ", ".join(f"{n}: double" for n in names)
_point = "array<struct<x: double, y: double>>"
SETTINGS = (
    f"struct<basic: struct<{_doubles(n.name for n in BASIC)}>, "
    f"crop: struct<enabled: boolean, {_doubles(RECTANGLE)}, {_doubles(n.name for n in TRANSFORM)}, aspectPreset: string, customAspectWidth: double, customAspectHeight: double>, "
    f"curve: struct<{', '.join(f'{c}: {_point}' for c, _ in CURVES)}>, "
    f"mixer: struct<{', '.join(f'{c}: struct<{_doubles(b for b, _ in BAND)}>' for c in COLORS)}>, "
    f"effects: struct<{_doubles(n.name for n in EFFECTS)}>>"
)


def to_fixed(x: float, places: int) -> str:
    """``x`` with so many decimals; a half in its exact binary value goes away from zero."""
    return ("-" if x < 0 else "") + str(Decimal(abs(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def whole(x: float) -> str:
    """The nearest whole number, halves towards plus infinity."""
    down = math.floor(x)
    return str(down + (x - down >= 0.5))


def number(text: str | None) -> float | None:
    """A property's text as a finite number, white space around it ignored and nothing as 0; None for all else."""
    if text is None:
        return None
    bare = text.strip().strip("\ufeff")
    if bare == "" or _DECIMAL.fullmatch(bare):
        found = float(bare or 0)
    elif _BASED.fullmatch(bare):
        found = float(int(bare, 0))
    else:
        return None
    return found if math.isfinite(found) else None


def curve_points(points: list[tuple[float | None, float | None]]) -> list[dict]:
    """Points as a curve keeps them: clamped, in order, the last of each 1/255, ends at 0 and 1; under two: the straight line."""
    kept = sorted(((min(1.0, max(0.0, x)), min(1.0, max(0.0, y))) for x, y in points if x is not None and y is not None), key=lambda p: p[0])
    kept = [p for p, after in zip(kept, [*kept[1:], None], strict=False) if after is None or whole(p[0] * 255) != whole(after[0] * 255)]
    if len(kept) < 2:
        return LINE
    return [{"x": x, "y": y} for x, y in [(0.0, kept[0][1]), *kept[1:-1], (1.0, kept[-1][1])]]


def properties(s: dict) -> dict[str, str | list[str]]:
    """The sidecar properties of settings, in the order they are written."""
    crop, numbers = s["crop"], lambda group, of: {n.property: to_fixed(s[group][n.name], n.places) if n.places else whole(s[group][n.name] + n.offset) for n in of}
    edges = {"CropLeft": crop["x"], "CropTop": crop["y"], "CropRight": crop["x"] + crop["width"], "CropBottom": crop["y"] + crop["height"]}
    pairs = lambda c: [f"{whole(p['x'] * 255)}, {whole(p['y'] * 255)}" for p in curve_points([(p["x"], p["y"]) for p in s["curve"][c]])]
    return {
        "HasCrop": "True" if crop["enabled"] else "False",
        **{n: to_fixed(v, 6) for n, v in edges.items()},
        **numbers("crop", TRANSFORM),
        "ProcessVersion": PROCESS_VERSION,
        **numbers("basic", BASIC),
        "ToneCurveName2012": CURVE_NAME,
        **{p: pairs(c) for c, p in CURVES},
        **{f"{p}{c.capitalize()}": whole(s["mixer"][c][b]) for c in COLORS for b, p in BAND},
        **numbers("effects", EFFECTS),
    }


def from_properties(texts: dict[str, str], lists: dict[str, list[str]]) -> dict:
    """Settings from properties; what is missing or no number has its default."""

    def value(name: str, default: float) -> float:
        found = None if name in lists else number(texts.get(name))
        return default if found is None else found

    def curve(name: str) -> list[dict]:
        pairs = lists.get(name) or (texts[name].split(";") if texts.get(name) else None)
        if pairs is None:
            return LINE
        points = []
        for x, y in ([*p.split(","), None][:2] for p in pairs):
            points.append(tuple(None if n is None else n / 255 for n in (number(x), number(y))))
        return curve_points(points)

    numbers = lambda of: {n.name: value(n.property, n.default + n.offset) - n.offset for n in of}
    left, top, right, bottom = (value(n, d) for n, d in (("CropLeft", 0.0), ("CropTop", 0.0), ("CropRight", 1.0), ("CropBottom", 1.0)))
    frame = {"enabled": texts.get("HasCrop") == "True" or left > 0 or top > 0, "x": left, "y": top, "width": max(LEAST_SIDE, right - left), "height": max(LEAST_SIDE, bottom - top)}
    return {
        "basic": numbers(BASIC),
        "crop": frame | numbers(TRANSFORM) | {"aspectPreset": PRESETS[0], "customAspectWidth": 1.0, "customAspectHeight": 1.0},
        "curve": {c: curve(p) for c, p in CURVES},
        "mixer": {c: {b: value(f"{p}{c.capitalize()}", 0.0) for b, p in BAND} for c in COLORS},
        "effects": numbers(EFFECTS),
    }


#: The settings of an image that nobody edited.
DEFAULTS = from_properties({}, {})


def defaults() -> Column:
    """The settings of an image that nobody edited."""
    return F.from_json(F.lit(json.dumps(DEFAULTS)), SETTINGS)
