"""Rendering over tiles: images of any size cropped, turned, straightened and resampled tile by tile.

Source images are tables of tiles on a grid (image_id, tx, ty, w, h, and r, g, b in row order). An output tile needs the part of
the source that its transformed bounds touch: the parts are cut from the source tiles before they are shuffled to the output tile's
group, so a task holds one window of the source, or small ones of about as many pixels, and not an image.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverframe.functions.scalars import clamp, round_half_up

PLANES = ("r", "g", "b")
TILE = ("image_id", "tx", "ty", "x", "y", "w", "h")
JOB = ("width", "height", "orientation", "out_w", "out_h", "crop")
#: Crop settings of a job; a job without any keeps the whole image.
CROP = "struct<x:double,y:double,width:double,height:double,angle:double,perspective_x:double,perspective_y:double,distortion:double>"


def cut(plane: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The w x h part at (x, y) of a plane of rows of ``width``."""
    rows = F.transform(F.sequence(y, y + h - 1), lambda r: F.slice(plane, (r * width + x + 1).cast("int"), w.cast("int")))
    return F.flatten(rows)


def fit_edge(images: DataFrame, edge: int) -> DataFrame:
    """``images`` with out_w and out_h: their upright size (orientations from 5 are turned), scaled down to an edge of at most ``edge``."""
    turned = F.coalesce(F.col("orientation") >= 5, F.lit(False))
    w, h = F.when(turned, F.col("height")).otherwise(F.col("width")), F.when(turned, F.col("width")).otherwise(F.col("height"))
    scale = F.least(F.lit(1.0), edge / F.greatest(w, h))
    size = lambda n: F.greatest(F.lit(1), round_half_up(n * scale)).cast("int")
    return images.withColumns({"out_w": size(w), "out_h": size(h)})


def _settings(crop: Column) -> dict[str, Column]:
    whole = {"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0, "angle": 0.0, "perspective_x": 0.0, "perspective_y": 0.0, "distortion": 0.0}
    return {k: F.coalesce(crop[k], F.lit(v)) for k, v in whole.items()}


def output_tiles(jobs: DataFrame, edge: int = 512, window: int = 1024) -> DataFrame:
    """Output tiles of jobs with the window of the source that each needs: tx, ty, x, y, w, h, left, top, right, bottom.

    ``jobs``: image_id, width, height, orientation (1 to 8; null counts as 1), out_w, out_h, crop (``CROP``, may be null). A window
    bounds 25 places of the tile, widened by a pixel, after transformation, with a margin for perspective and distortion and one pixel
    for interpolation; a bound is rounded to a millionth of a pixel first, so that it doesn't hang on the last bit. Tiles of images that are scaled down are smaller, so that a window without perspective or distortion stays at
    about ``window`` pixels of edge. Jobs without a positive size give no tile.
    """
    c = F.col
    turned = F.coalesce(c("orientation") >= 5, F.lit(False))
    shown_w, shown_h = F.when(turned, c("height")).otherwise(c("width")), F.when(turned, c("width")).otherwise(c("height"))
    scale = F.greatest(shown_w / c("out_w"), shown_h / c("out_h"))
    step = clamp(F.floor(window / (scale * 2)), F.lit(1), F.lit(edge)).cast("int")
    sized = jobs.where("width > 0 and height > 0 and out_w > 0 and out_h > 0").select("image_id", *JOB).withColumn("step", step)
    count = lambda n: F.sequence(F.lit(0), (F.ceil(c(n) / c("step")) - 1).cast("int"))
    grid = sized.withColumn("tx", F.explode(count("out_w"))).withColumn("ty", F.explode(count("out_h")))
    grid = grid.withColumns({"x": c("tx") * c("step"), "y": c("ty") * c("step")})
    grid = grid.withColumns({"w": F.least(c("step"), c("out_w") - c("x")), "h": F.least(c("step"), c("out_h") - c("y"))})

    s = _settings(c("crop"))
    x0, x1 = F.greatest(F.lit(0), c("x") - 1), F.least(c("out_w"), c("x") + c("w") + 1)
    y0, y1 = F.greatest(F.lit(0), c("y") - 1), F.least(c("out_h"), c("y") + c("h") + 1)

    numbers = {"x0": x0, "x1": x1, "y0": y0, "y1": y1, "shown_w": shown_w, "shown_h": shown_h, "turn": F.coalesce(c("orientation"), F.lit(1)), "image_w": c("width"), "image_h": c("height"), "image_out_w": c("out_w"), "image_out_h": c("out_h"), **{f"crop_{k}": v for k, v in s.items()}}
    rows = grid.drop("step").withColumn("_n", F.struct(*(v.cast("double").alias(k) for k, v in numbers.items())))

    given, settings = list(numbers), list(s)

    def bound(batches):
        for batch in batches:
            at = batch.schema.get_field_index("_n")
            n = {k: v.to_numpy(zero_copy_only=False)[:, None] for k, v in zip(given, batch.column(at).flatten(), strict=True)}
            k = np.arange(25)
            u, v = (n["x0"] + (n["x1"] - n["x0"]) * (k % 5) / 4) / n["image_out_w"], (n["y0"] + (n["y1"] - n["y0"]) * (k // 5) / 4) / n["image_out_h"]
            crop = {name: n[f"crop_{name}"] for name in settings}
            sx, sy = _stored(*_bent(u, v, crop, n["shown_w"], n["shown_h"]), n["turn"])
            margin = ((np.abs(crop["perspective_x"]) + np.abs(crop["perspective_y"])) * 0.001 + np.abs(crop["distortion"]) * 0.00025)[:, 0]
            columns = []
            for places, size in ((sx, n["image_w"][:, 0]), (sy, n["image_h"][:, 0])):
                # settings that are no numbers take the whole image
                low = np.nan_to_num(np.maximum(0, places.min(axis=1) - margin), nan=0.0)
                high = np.nan_to_num(np.minimum(1, places.max(axis=1) + margin), nan=1.0)
                columns.append((np.maximum(0, np.floor(np.round(low * size, 6)) - 1), np.minimum(size, np.ceil(np.round(high * size, 6)) + 1)))
            (left, right), (top, bottom) = columns
            kept = batch.drop_columns(["_n"])
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(b.astype(np.int32)) for b in (left, top, right, bottom))], [*kept.schema.names, "left", "top", "right", "bottom"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_n").schema.fields)
    return rows.mapInArrow(bound, f"{names}, left int, top int, right int, bottom int")


def _bent(u: np.ndarray, v: np.ndarray, crop: dict, shown_w: np.ndarray, shown_h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output coordinates after crop, rotation, perspective and distortion; of one job, or of a job a row."""
    u, v = crop["x"] + u * crop["width"], crop["y"] + v * crop["height"]
    mx, my = crop["x"] + crop["width"] / 2, crop["y"] + crop["height"] / 2
    angle = np.radians(-crop["angle"])
    px, py = (u - mx) * shown_w, (v - my) * shown_h
    u, v = mx + (np.cos(angle) * px - np.sin(angle) * py) / shown_w, my + (np.sin(angle) * px + np.cos(angle) * py) / shown_h
    dx, dy = u - 0.5, v - 0.5
    bulge = (dx * dx + dy * dy) * crop["distortion"] * 0.001
    u, v = u + dy * crop["perspective_x"] * 0.002 + dx * bulge, v + dx * crop["perspective_y"] * 0.002 + dy * bulge
    return np.clip(u, 0, 1), np.clip(v, 0, 1)


def _stored(u: np.ndarray, v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upright coordinates in the image as it is stored."""
    u, v = np.where(turn >= 5, v, u), np.where(turn >= 5, u, v)
    return np.where(np.isin(turn, (2, 3, 7, 8)), 1 - u, u), np.where(np.isin(turn, (3, 4, 6, 7)), 1 - v, v)


def source_places(x: np.ndarray, y: np.ndarray, job: dict) -> tuple[np.ndarray, np.ndarray]:
    """Where output pixels are sampled, in pixels of the stored source; the same transform as :func:`output_to_source`."""
    width, height, turn, crop = job["width"], job["height"], job["orientation"] or 1, job["crop"]
    if crop is None and turn == 1:
        return (x + 0.5) * width / job["out_w"] - 0.5, (y + 0.5) * height / job["out_h"] - 0.5
    u, v = (x + 0.5) / job["out_w"], (y + 0.5) / job["out_h"]
    if crop is not None:
        shown_w, shown_h = (height, width) if turn >= 5 else (width, height)
        u, v = _bent(u, v, crop, shown_w, shown_h)
    u, v = _stored(u, v, turn)
    return u * width - 0.5, v * height - 0.5


def sample(planes: list[np.ndarray], sx: np.ndarray, sy: np.ndarray, left: int, top: int, width: int, height: int) -> list[np.ndarray]:
    """Bilinear samples at source places from a window of the source at (left, top); edges of the image repeat."""
    sx, sy = np.clip(sx, 0, width - 1), np.clip(sy, 0, height - 1)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    tx, ty = sx - x0, sy - y0
    xs, ys = (x0 - left, np.minimum(x0 + 1, width - 1) - left), (y0 - top, np.minimum(y0 + 1, height - 1) - top)
    out = []
    for p in planes:
        upper = p[ys[0], xs[0]] * (1 - tx) + p[ys[0], xs[1]] * tx
        lower = p[ys[1], xs[0]] * (1 - tx) + p[ys[1], xs[1]] * tx
        out.append(upper * (1 - ty) + lower * ty)
    return out


def render(tiles: DataFrame, jobs: DataFrame, source_edge: int = 512, edge: int = 512, window: int = 1024) -> DataFrame:
    """(image_id, tx, ty, x, y, w, h, r, g, b): the output tiles of jobs (:func:`output_tiles`) from source tiles of ``source_edge``.

    One job an image. Source tiles that are missing or null count as zeros; tiles without a job are left out.
    """
    c = F.col
    wanted = output_tiles(jobs, edge, window)
    touched = lambda a, b: F.sequence(F.floor(c(a) / source_edge).cast("int"), F.floor((c(b) - 1) / source_edge).cast("int"))
    asks = wanted.withColumn("sx", F.explode(touched("left", "right"))).withColumn("sy", F.explode(touched("top", "bottom")))
    source = tiles.select("image_id", c("tx").alias("sx"), c("ty").alias("sy"), c("w").alias("sw"), c("h").alias("sh"), *(c(p).cast("array<double>") for p in PLANES))
    both = asks.join(source.where("r is not null and g is not null and b is not null and sw > 0 and sh > 0"), ["image_id", "sx", "sy"], "left")
    px, py = F.greatest(c("left") - c("sx") * source_edge, F.lit(0)), F.greatest(c("top") - c("sy") * source_edge, F.lit(0))
    pw, ph = F.least(c("right") - c("sx") * source_edge, c("sw")) - px, F.least(c("bottom") - c("sy") * source_edge, c("sh")) - py
    parts = both.withColumns({"px": px, "py": py, "pw": pw, "ph": ph})
    inside = (c("pw") > 0) & (c("ph") > 0)
    parts = parts.withColumns({p: F.when(inside, cut(c(p), c("sw"), c("px"), c("py"), c("pw"), c("ph"))) for p in PLANES})
    place = {"px": c("sx") * source_edge + c("px") - c("left"), "py": c("sy") * source_edge + c("py") - c("top")}
    parts = parts.withColumns(place).drop("sx", "sy", "sw", "sh")

    def draw(parts: list[dict]) -> tuple:
        job = parts[0]
        planes = [np.zeros((job["bottom"] - job["top"], job["right"] - job["left"])) for _ in PLANES]
        for part in parts:
            x, y, w, h = (part[k] for k in ("px", "py", "pw", "ph"))
            for p, name in zip(planes, PLANES, strict=True):
                if part[name] is not None:
                    p[y : y + h, x : x + w] = part[name].reshape(h, w)
        y, x = np.mgrid[job["y"] : job["y"] + job["h"], job["x"] : job["x"] + job["w"]]
        drawn = sample(planes, *source_places(x, y, job), job["left"], job["top"], job["width"], job["height"])
        return (*(job[k] for k in TILE), *(v.ravel() for v in drawn))

    def draw_all(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = table.drop_columns([*PLANES, "_images", "_across", "_down"]).to_pylist()
        for name in PLANES:
            lists = table[name].chunk(0)
            values, ends, there = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
            for row, start, end, valid in zip(rows, ends, ends[1:], there, strict=False):
                row[name] = values[start:end] if valid else None
        windows: dict[tuple, list[dict]] = {}
        for row in rows:
            windows.setdefault((row["image_id"], row["tx"], row["ty"]), []).append(row)
        made = zip(*map(draw, windows.values()), strict=True)
        return pa.table([pa.array(column, f.type) for column, f in zip(made, schema, strict=True)], schema=schema)

    schema = pa.schema([("image_id", pa.int64()), *((k, pa.int32()) for k in TILE[1:]), *((p, pa.list_(pa.float64())) for p in PLANES)])
    typed = parts.withColumns({**{k: c(k).cast("int") for k in ("width", "height", "orientation", "out_w", "out_h", "x", "y", "w", "h")}, "image_id": c("image_id").cast("long"), "crop": F.when(c("crop").isNotNull(), F.struct(*(v.cast("double").alias(k) for k, v in _settings(c("crop")).items())))})
    # a group is windows of about a million pixels together: one large window, or small ones of neighbouring tiles and images
    many = max(1, (1 << 20) // window**2)
    side = max(1, int(many**0.25))
    group = {"_images": F.floor(c("image_id") / max(1, many // side**2)), "_across": F.floor(c("tx") / side), "_down": F.floor(c("ty") / side)}
    return typed.withColumns(group).groupBy(*group).applyInArrow(draw_all, "image_id long, tx int, ty int, x int, y int, w int, h int, r array<double>, g array<double>, b array<double>")


def joined_rows(tiles: DataFrame) -> DataFrame:
    """(image_id, y, r, g, b): whole rows of images from their tiles, pasted in the order of x."""
    c = F.col
    row = lambda p, i: F.slice(c(p), (i * c("w") + 1).cast("int"), c("w").cast("int")).alias(p)
    lines = tiles.where("w > 0 and h > 0").select("image_id", F.explode(F.transform(F.sequence(F.lit(0), c("h") - 1), lambda i: F.struct((c("y") + i).alias("y"), c("x").alias("x"), *(row(p, i) for p in PLANES)))).alias("s"))
    rows = lines.groupBy("image_id", c("s.y").alias("y")).agg(F.array_sort(F.collect_list(F.struct("s.x", *(f"s.{p}" for p in PLANES)))).alias("l"))  # the tiles of one row
    return rows.select("image_id", "y", *(F.flatten(c(f"l.{p}")).alias(p) for p in PLANES))


def to_bytes(level: Column, most: int = 65_535) -> Column:
    """A level of 0 to ``most`` as a whole number of 0 to 255."""
    return clamp(round_half_up(level * 255 / most), F.lit(0), F.lit(255))
