"""Mask coverage from 0 to 255 as column arithmetic, and its integer composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silverframe.functions.scalars import round_half_up, smoothstep


def linear_gradient(x: Column, y: Column, w: int, h: int, start: tuple[float, float], end: tuple[float, float]) -> Column:
    """Full at the start, none at the end; a gradient without length covers nothing."""
    dx, dy = (end[0] - start[0]) * max(1, w - 1), (end[1] - start[1]) * max(1, h - 1)
    size = dx * dx + dy * dy
    if size < 1e-6:
        return F.lit(0).cast("long")
    t = ((x - start[0] * max(1, w - 1)) * dx + (y - start[1] * max(1, h - 1)) * dy) / size
    return round_half_up((1 - smoothstep(0.0, 1.0, t)) * 255)


def radial_gradient(x: Column, y: Column, w: int, h: int, centre: tuple[float, float], radii: tuple[float, float], rotation: float, feather: float) -> Column:
    """Full inside a rotated ellipse, fading over its feathered rim."""
    rx, ry = radii[0] * max(1, w - 1), radii[1] * max(1, h - 1)
    if rx <= 0 or ry <= 0:
        return F.lit(0).cast("long")
    a = F.radians(F.lit(rotation))
    dx, dy = x - centre[0] * max(1, w - 1), y - centre[1] * max(1, h - 1)
    u, v = (F.cos(a) * dx + F.sin(a) * dy) / rx, (F.cos(a) * dy - F.sin(a) * dx) / ry
    far = F.sqrt(u * u + v * v)
    if feather <= 0:
        return F.when(far < 1, 255).otherwise(0).cast("long")
    return round_half_up((1 - smoothstep(1 - feather, 1.0, far)) * 255)


def compose(below: Column, source: Column, operation: str) -> Column:
    """One step of composition; every step rounds to whole levels, so order matters."""
    kept = round_half_up(below * (255 - source) / 255.0)
    return F.least(F.lit(255), source + kept) if operation == "add" else kept


def compose_all(parts: list[tuple[Column, str]], inverted: bool = False, enabled: bool = True) -> Column:
    """The coverage of a mask from its components in order."""
    out = F.lit(0).cast("long")
    for source, operation in parts:
        out = compose(out, source, operation)
    if inverted and parts:
        out = 255 - out
    return out.cast("long") if enabled else F.lit(0).cast("long")


def matte_coverage(value: Column, threshold: float) -> Column:
    """Coverage of a model's matte (0 to 1): below the threshold nothing."""
    return F.when(value < threshold, 0).otherwise(round_half_up(value * 255)).cast("long")


def mask_planes(parts: list[tuple[Column, str, Column]], inverted: bool = False, enabled: bool = True) -> tuple[Column, Column]:
    """The planes (adjustment, inspection) of a mask from components (coverage, operation, whether it may adjust).

    The inspection plane has all components. Both are inverted only if some component may adjust, and a mask that is
    off adjusts nothing.
    """
    adjustment = inspection = F.lit(0).cast("long")
    some = F.lit(False)
    for source, operation, able in parts:
        inspection = compose(inspection, source, operation)
        adjustment = F.when(able, compose(adjustment, source, operation)).otherwise(adjustment)
        some = some | able
    if inverted:
        adjustment, inspection = (F.when(some, 255 - plane).otherwise(plane) for plane in (adjustment, inspection))
    return (adjustment if enabled else F.lit(0)).cast("long"), inspection.cast("long")
