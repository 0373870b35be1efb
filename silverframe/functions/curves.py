"""Tone curves as arrays of points: normalization, monotone cubic sampling, look-up tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silverframe.functions.scalars import clamp, let, round_half_up

LUT_SIZE = 256
POINTS = "array<struct<x:double,y:double>>"


def identity() -> Column:
    return F.array(*(F.struct(F.lit(v).alias("x"), F.lit(v).alias("y")) for v in (0.0, 1.0)))


def point(x: Column | float, y: Column | float) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def normalize(points: Column) -> Column:
    """Finite points clamped, in order of x, the last of each 1/255 bucket, ends at 0 and 1; under two: the identity."""
    finite = F.filter(points, lambda p: F.coalesce(~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")), F.lit(False)))
    indexed = F.transform(finite, lambda p, i: F.struct(clamp(p["x"]).alias("x"), i.alias("i"), clamp(p["y"]).alias("y")))
    ordered = F.array_sort(indexed)  # equal x keep their order
    bucket = lambda p: round_half_up(p["x"] * 255)
    kept = F.filter(ordered, lambda p, i: (i == F.size(ordered) - 1) | (bucket(p) != bucket(F.try_element_at(ordered, i + 2))))
    n = F.size(kept)
    pinned = F.transform(kept, lambda p, i: F.struct(F.when(i == 0, 0.0).when(i == n - 1, 1.0).otherwise(p["x"]).alias("x"), p["y"].alias("y")))
    return F.when(points.isNull() | (n < 2), identity()).otherwise(pinned)


def from_sliders(shadows: Column, midtones: Column, highlights: Column) -> Column:
    """The five-point curve of three older sliders."""
    at = lambda x, d: point(x / 255, clamp((F.lit(float(x)) + F.coalesce(d, F.lit(0.0))) / 255))
    zero = F.lit(0.0)
    return F.array(at(0, zero), at(64, shadows), at(128, midtones), at(192, highlights), at(255, zero))


def sample(points: Column, value: Column) -> Column:
    """A normalized curve's value, by a cubic through the segment whose end slopes are limited to stay monotone."""
    n = F.size(points)

    def segment(at: Column) -> Column:
        """The points around a value: before, left, right, after; ``found`` unless it lies beyond the last."""
        k = at["k"]
        point_at = lambda i: F.try_element_at(points, i)
        return F.struct(at["v"].alias("v"), (k > 0).alias("found"), point_at(F.greatest(k - 2, F.lit(1))).alias("before"), point_at(F.greatest(k - 1, F.lit(1))).alias("left"), point_at(F.greatest(k, F.lit(1))).alias("right"), point_at(F.least(k + 1, n)).alias("after"), point_at(n).alias("end"))

    def slopes(s: Column) -> Column:
        left, right, before, after = (s[c] for c in ("left", "right", "before", "after"))
        zero = F.lit(0.0)
        slope = lambda a, b: F.coalesce((b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], zero), zero)
        width = right["x"] - left["x"]
        return F.struct(s["v"].alias("v"), s["found"].alias("found"), left.alias("left"), right.alias("right"), s["end"].alias("end"), width.alias("width"), slope(left, right).alias("seg"), slope(before, right).alias("ls"), slope(left, after).alias("rs"))

    def limited(s: Column) -> Column:
        seg = s["seg"]
        usable = lambda v: F.when((seg == 0) | (v * seg < 0), 0.0).otherwise(v)
        size = F.hypot(usable(s["ls"]) / F.nullif(seg, F.lit(0.0)), usable(s["rs"]) / F.nullif(seg, F.lit(0.0)))
        limit = F.when(size > 3, 3 / size).otherwise(1.0)
        return F.struct(*(s[c].alias(c) for c in ("v", "found", "left", "right", "end", "width")), (usable(s["ls"]) * limit).alias("ls"), (usable(s["rs"]) * limit).alias("rs"), ((s["v"] - s["left"]["x"]) / F.nullif(s["width"], F.lit(0.0))).alias("t"))

    def cubic(s: Column) -> Column:
        t, left, right, width = s["t"], s["left"], s["right"], s["width"]
        t2, t3 = t * t, t * t * t
        y = (2 * t3 - 3 * t2 + 1) * left["y"] + (t3 - 2 * t2 + t) * width * s["ls"] + (-2 * t3 + 3 * t2) * right["y"] + (t3 - t2) * width * s["rs"]
        return F.when(~s["found"], F.coalesce(s["end"]["y"], s["v"])).when(width == 0, left["y"]).otherwise(clamp(y))

    def located(v: Column) -> Column:
        # the first segment whose right end is not before the value
        k = F.array_position(F.transform(points, lambda p, i: (i > 0) & (v <= p["x"])), True).cast("int")
        return F.struct(v.alias("v"), k.alias("k"))

    out = let(clamp(value), located)
    for step in (segment, slopes, limited, cubic):
        out = let(out, step)
    return out


def look_up_table(points: Column) -> Column:
    """The curve at 256 even steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(LUT_SIZE - 1)), lambda i: sample(points, i / float(LUT_SIZE - 1)))


def look_up(lut: Column, value: Column) -> Column:
    """A table's value by linear interpolation."""
    at = clamp(value) * (LUT_SIZE - 1)
    low = F.floor(at).cast("int")
    t = at - low
    return F.element_at(lut, low + 1) * (1 - t) + F.element_at(lut, F.least(low + 1, F.lit(LUT_SIZE - 1)) + 1) * t


GAP = 1 / 255


def move_point(points: Column, index: Column, to: Column) -> Column:
    """Points with one moved between its neighbours, a gap from each; the ends keep their x."""
    n = F.size(points)

    def moved(p, i):
        before, after = F.try_element_at(points, i), F.try_element_at(points, i + 2)
        x = F.when(i == 0, 0.0).when(i == n - 1, 1.0).otherwise(F.least(after["x"] - GAP, F.greatest(before["x"] + GAP, to["x"])))
        return F.when(i == index, F.struct(x.alias("x"), clamp(to["y"]).alias("y"))).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y")))

    return F.transform(points, lambda p, i: F.when(i == 0, F.struct(F.when(index == 0, 0.0).otherwise(p["x"]).alias("x"), F.when(index == 0, clamp(to["y"])).otherwise(p["y"]).alias("y"))).otherwise(moved(p, i)))


def add_point(points: Column, new: Column) -> Column:
    """Points with a new one in its place; one that is nearer than the gap to a point moves that one up or down."""
    near = F.filter(F.transform(points, lambda p, i: F.when(F.abs(p["x"] - new["x"]) < GAP, i)), lambda i: i.isNotNull())
    at = F.try_element_at(near, F.lit(1))
    onto = F.struct(F.try_element_at(points, at + 1)["x"].alias("x"), new["y"].alias("y"))
    keyed = F.transform(F.concat(points, F.array(new)), lambda p, i: F.struct(p["x"].alias("x"), i.alias("i"), p["y"].alias("y")))
    placed = F.transform(F.array_sort(keyed), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return F.when(at.isNotNull(), move_point(points, at, onto)).otherwise(placed)


def remove_point(points: Column, index: Column) -> Column:
    """Points without one; the ends stay."""
    return F.filter(points, lambda p, i: (i != index) | (index <= 0) | (index >= F.size(points) - 1))


CHANNELS = ("rgb", "red", "green", "blue")


def channel_table(curve: dict[str, Column]) -> Column:
    """Tables of the master, red, green and blue curves (struct of arrays of 256 values); a missing curve is the identity."""
    even = F.transform(F.sequence(F.lit(0), F.lit(LUT_SIZE - 1)), lambda i: i / float(LUT_SIZE - 1))
    return F.struct(*((let(normalize(curve[c]), look_up_table) if c in curve else even).alias(c) for c in CHANNELS))


def apply_channels(table: Column, color: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """A color through the master curve, then each channel through its own."""
    own = lambda c: lambda m: look_up(table[c], m)
    return tuple(let(look_up(table["rgb"], v), own(c)) for v, c in zip(color, CHANNELS[1:], strict=True))
