"""Crop, orientation, transform and export-size geometry as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverframe.functions.scalars import clamp, let, round_half_up

MIN_CROP = 0.05
MAX_EDGE, MAX_PIXELS = 100_000, 50_000_000


@dataclass(frozen=True)
class Rect:
    x: Column
    y: Column
    width: Column
    height: Column


def contained(cw: Column, ch: Column, iw: Column, ih: Column) -> Rect:
    """The largest rectangle of an image's ratio in the middle of a container."""
    wide = iw / ih > cw / ch
    w = F.when(wide, cw).otherwise(ch * (iw / ih))
    h = F.when(wide, cw / (iw / ih)).otherwise(ch)
    return Rect((cw - w) / 2, (ch - h) / 2, w, h)


def clamp_crop(r: Rect) -> Rect:
    """A crop of at least the least size inside the unit square."""
    w, h = clamp(r.width, MIN_CROP, 1.0), clamp(r.height, MIN_CROP, 1.0)
    return Rect(F.greatest(F.lit(0.0), F.least(1 - w, r.x)), F.greatest(F.lit(0.0), F.least(1 - h, r.y)), w, h)


def fit_rotation(rows: DataFrame, r: Rect, angle: Column, iw: Column, ih: Column) -> DataFrame:
    """``rows`` with a struct ``fitted`` (x, y, width, height): the crop shrunk and moved so that its rotated box stays in the image.

    Each step is columns, since one expression would spell out the first steps again wherever the last ones use them.
    """
    mark = "_"
    while any(n.startswith(mark) for n in rows.columns):
        mark += "_"
    col = lambda n: F.col(mark + n)
    step = lambda df, **values: df.withColumns({mark + n: v for n, v in values.items()})
    c, a = clamp_crop(r), F.radians(F.abs(angle))
    df = step(rows, w=c.width, h=c.height, cos=F.abs(F.cos(a)), sin=F.abs(F.sin(a)))
    x, y, w, h, cos, sin, half_w, half_h, scale = map(col, ("x", "y", "w", "h", "cos", "sin", "half_w", "half_h", "scale"))
    df = step(df, x=F.greatest(F.lit(0.0), F.least(1 - w, r.x)), y=F.greatest(F.lit(0.0), F.least(1 - h, r.y)))
    df = step(df, half_w=(cos * (w * iw) + sin * (h * ih)) / 2, half_h=(sin * (w * iw) + cos * (h * ih)) / 2)
    df = step(df, scale=F.least(F.lit(1.0), iw / (half_w * 2), ih / (half_h * 2)))
    df = step(df, bw=half_w * scale, bh=half_h * scale, to_w=w * scale, to_h=h * scale)
    to_x = F.greatest(col("bw"), F.least(iw - col("bw"), (x + w / 2) * iw)) / iw - col("to_w") / 2
    to_y = F.greatest(col("bh"), F.least(ih - col("bh"), (y + h / 2) * ih)) / ih - col("to_h") / 2
    df = step(df, still=angle.isNull() | F.isnan(angle) | (angle == 0) | (iw <= 0) | (ih <= 0), to_x=to_x, to_y=to_y)
    kept = {"x": x, "y": y, "width": w, "height": h}
    moved = {"x": col("to_x"), "y": col("to_y"), "width": col("to_w"), "height": col("to_h")}
    fitted = F.struct(*(F.when(col("still"), kept[n]).otherwise(moved[n]).alias(n) for n in kept))
    return df.select(*(F.col(f"`{n}`") for n in rows.columns), fitted.alias("fitted"))


def fit_ratio(r: Rect, ratio: Column) -> Rect:
    """A crop of the same centre and area with a ratio of sides, as far as the unit square allows."""
    c = clamp_crop(r)
    low, high = F.greatest(F.lit(MIN_CROP), MIN_CROP * ratio), F.least(F.lit(1.0), ratio)
    w = F.greatest(low, F.least(high, F.sqrt(c.width * c.height * ratio)))
    h = w / ratio
    moved = clamp_crop(Rect(c.x + c.width / 2 - w / 2, c.y + c.height / 2 - h / 2, w, h))
    still = ratio.isNull() | F.isnan(ratio) | (ratio <= 0) | (low > high)
    return Rect(*(F.when(still, a).otherwise(b) for a, b in ((c.x, moved.x), (c.y, moved.y), (c.width, moved.width), (c.height, moved.height))))


def ratio_from_text(width: Column, height: Column) -> Column:
    """A ratio typed as two numbers; null unless both are positive."""
    w, h = F.trim(width).try_cast("double"), F.trim(height).try_cast("double")
    return F.when((w > 0) & (h > 0) & ~F.isnan(w) & ~F.isnan(h), w / h)


def orient(u: Column, v: Column, orientation: Column) -> tuple[Column, Column]:
    """Image coordinates under the eight EXIF orientations."""
    o = orientation
    x = F.when(o.isin(2, 3), 1 - u).when(o.isin(5, 6), v).when(o.isin(7, 8), 1 - v).otherwise(u)
    y = F.when(o.isin(3, 4), 1 - v).when(o.isin(5, 8), u).when(o.isin(6, 7), 1 - u).otherwise(v)
    return x, y


def oriented_size(width: Column, height: Column, flip: Column) -> tuple[Column, Column]:
    """Width and height after a quarter turn (flip 5 or 6)."""
    turned = flip.isin(5, 6)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def rotate_about(x: Column, y: Column, cx: Column, cy: Column, degrees: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Unit coordinates turned about a centre in pixel space."""
    a = F.radians(degrees)
    px, py = (x - cx) * w, (y - cy) * h
    return cx + (F.cos(a) * px - F.sin(a) * py) / w, cy + (F.sin(a) * px + F.cos(a) * py) / h


def output_to_source(u: Column, v: Column, crop: Rect, angle: Column, w: Column, h: Column, persp_x: Column, persp_y: Column, distortion: Column, orientation: Column) -> tuple[Column, Column]:
    """Where in the stored image an output coordinate comes from: crop, rotation, perspective, distortion, orientation."""
    x, y = crop.x + u * crop.width, crop.y + (1 - v) * crop.height
    x, y = rotate_about(x, y, crop.x + crop.width / 2, crop.y + crop.height / 2, -angle, w, h)
    dx, dy = x - 0.5, y - 0.5
    r2 = dx * dx + dy * dy
    x, y = x + dy * persp_x * 0.002 + dx * r2 * distortion * 0.001, y + dx * persp_y * 0.002 + dy * r2 * distortion * 0.001
    sx, sy = orient(clamp(x), clamp(y), orientation)
    return clamp(sx), clamp(sy)


def source_to_output(u: Column, v: Column, crop: Rect, angle: Column, w: Column, h: Column, persp_x: Column, persp_y: Column, distortion: Column) -> tuple[Column, Column]:
    """The inverse of :func:`output_to_source` for oriented coordinates; the lens terms by six fixed-point rounds."""

    def once(acc: Column, _: Column) -> Column:
        dx, dy = acc["x"] - 0.5, acc["y"] - 0.5
        r2 = dx * dx + dy * dy
        return F.struct((u - dy * persp_x * 0.002 - dx * r2 * distortion * 0.001).alias("x"), (v - dx * persp_y * 0.002 - dy * r2 * distortion * 0.001).alias("y"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(clamp(u).alias("x"), clamp(v).alias("y")), once)
    x, y = rotate_about(s["x"], s["y"], crop.x + crop.width / 2, crop.y + crop.height / 2, angle, w, h)
    return clamp((x - crop.x) / crop.width), clamp(1 - (y - crop.y) / crop.height)


def export_size(w: Column, h: Column, mode: Column, edge: Column, fit_w: Column, fit_h: Column, never_upscale: bool = True) -> tuple[Column, Column]:
    """Exported width and height for the modes original, long-edge and fit; null beyond the limits."""
    ratio = F.when(mode == "long-edge", edge / F.greatest(w, h)).when(mode == "fit", F.least(fit_w / w, fit_h / h)).otherwise(F.lit(1.0))
    if never_upscale:
        ratio = F.least(ratio, F.lit(1.0))
    ow = F.when(ratio == 1, w).otherwise(F.greatest(F.lit(1), round_half_up(w * ratio)))
    oh = F.when(ratio == 1, h).otherwise(F.greatest(F.lit(1), round_half_up(h * ratio)))
    allowed = (ow <= MAX_EDGE) & (oh <= MAX_EDGE) & (ow * oh <= MAX_PIXELS)
    return F.when(allowed, ow).cast("long"), F.when(allowed, oh).cast("long")


def drag_crop(r: Rect, handle: Column, dx: Column, dy: Column, ratio: Column) -> Rect:
    """A crop after one of its handles (``move``, ``n``, ``ne``, ... ``nw``) was dragged.

    Without a ratio (null or not positive) the dragged sides move, each at least the least size from its opposite.
    With one, width follows the pointer and height follows width; opposite sides, or the middle across an edge, stay.
    A handle that can't keep both the ratio and the least size changes nothing.
    """
    names = ("x", "y", "width", "height")
    rect = lambda *v: F.struct(*(k.alias(n) for k, n in zip(v, names, strict=True)))
    move = handle == "move"
    west, east, north, south = (~move & F.contains(handle, F.lit(k)) for k in "wens")
    across, along = ~(north | south), ~(west | east)

    def free(c: Column) -> Column:
        """The dragged sides, each on its own."""
        right, bottom = c["x"] + c["width"], c["y"] + c["height"]
        left = F.when(west, F.greatest(F.lit(0.0), F.least(right - MIN_CROP, c["x"] + dx))).otherwise(c["x"])
        top = F.when(north, F.greatest(F.lit(0.0), F.least(bottom - MIN_CROP, c["y"] + dy))).otherwise(c["y"])
        end = F.when(east, F.greatest(c["x"] + MIN_CROP, F.least(F.lit(1.0), right + dx))).otherwise(right)
        low = F.when(south, F.greatest(c["y"] + MIN_CROP, F.least(F.lit(1.0), bottom + dy))).otherwise(bottom)
        return rect(left, top, end - left, low - top)

    def sized(c: Column) -> Column:
        """The crop with the width that a locked ratio gives it, null if it doesn't fit."""
        cx, cy = c["x"] + c["width"] / 2, c["y"] + c["height"] / 2
        room_x = F.when(along, 2 * F.least(cx, 1 - cx)).when(west, c["x"] + c["width"]).otherwise(1 - c["x"])
        room_y = F.when(across, 2 * F.least(cy, 1 - cy)).when(north, c["y"] + c["height"]).otherwise(1 - c["y"])
        least, most = F.greatest(F.lit(MIN_CROP), MIN_CROP * ratio), F.least(room_x, room_y * ratio)
        by_width = across | (~along & (F.abs(dx) >= F.abs(dy)))
        asked = F.when(by_width, c["width"] + F.when(west, -dx).otherwise(dx)).otherwise((c["height"] + F.when(north, -dy).otherwise(dy)) * ratio)
        return F.struct(c.alias("c"), F.when(least <= most, F.greatest(least, F.least(most, asked))).alias("w"))

    def placed(s: Column) -> Column:
        c, w, h = s["c"], s["w"], s["w"] / ratio
        x = F.when(along, c["x"] + c["width"] / 2 - w / 2).when(west, c["x"] + c["width"] - w).otherwise(c["x"])
        y = F.when(across, c["y"] + c["height"] / 2 - h / 2).when(north, c["y"] + c["height"] - h).otherwise(c["y"])
        return F.when(w.isNull(), c).otherwise(inside(x, y, w, h))

    inside = lambda x, y, w, h: rect(*(lambda k: (k.x, k.y, k.width, k.height))(clamp_crop(Rect(x, y, w, h))))
    locked = F.coalesce((ratio > 0) & ~F.isnan(ratio) & (ratio < float("inf")), F.lit(False))
    start = inside(r.x, r.y, r.width, r.height)
    moved = lambda c: inside(c["x"] + dx, c["y"] + dy, c["width"], c["height"])
    out = F.when(move, let(start, moved)).when(locked, let(let(start, sized), placed)).otherwise(let(start, free))
    return Rect(*(out[n] for n in names))


# Named ratios of sides.
RATIOS = {"1:1": 1.0, "4:3": 4 / 3, "3:2": 3 / 2, "16:9": 16 / 9, "5:4": 5 / 4, "2:3": 2 / 3, "9:16": 9 / 16}


def preset_ratio(preset: Column, iw: Column, ih: Column, custom_w: Column, custom_h: Column) -> Column:
    """The ratio of a crop's sides in unit coordinates that a preset asks for; null for ``free``, unknown names and empty images."""
    named = F.create_map(*(F.lit(v) for kv in RATIOS.items() for v in kv))
    custom = F.when((custom_w > 0) & (custom_h > 0), custom_w / custom_h)
    pixels = F.when(preset == "original", iw / ih).when(preset == "custom", custom).otherwise(F.try_element_at(named, preset))
    return F.when((iw > 0) & (ih > 0), pixels * ih / iw)
