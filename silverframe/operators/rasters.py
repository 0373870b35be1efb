"""Rasters as rows: pixel tables from tiles, stencils, resampling, scores of straightening angles.

A raster arrives as tiles (image_id, tx, ty, r, g, b as arrays in row order). Pointwise work runs on pixel
rows; neighbours come from tiles whose border is widened by a halo, so a stencil shuffles borders and not pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.functions.scalars import round_half_up


def pixels(tiles: DataFrame, width: int) -> DataFrame:
    """(image_id, x, y, r, g, b) of one-tile images (image_id, r, g, b)."""
    rows = tiles.select("image_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("p", "c"))
    return rows.select("image_id", (F.col("p") % width).alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), "c.r", "c.g", "c.b")


def neighbour_average(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels with the average of their four neighbours (ar, ag, ab), edges repeated, from whole arrays."""
    at = lambda a, x, y: F.element_at(a, (y * width + x + 1).cast("int"))
    p = F.col("p")
    x, y = p % width, F.floor(p / width)
    ways = [(F.least(x + 1, F.lit(width - 1)), y), (F.greatest(x - 1, F.lit(0)), y), (x, F.least(y + 1, F.lit(height - 1))), (x, F.greatest(y - 1, F.lit(0)))]
    rows = tiles.select("image_id", "r", "g", "b", F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("p"))
    mean = {f"a{c}": sum((at(F.col(c), *w) for w in ways), F.lit(0.0)) * 0.25 for c in "rgb"}
    return rows.select("image_id", x.cast("int").alias("x"), y.cast("int").alias("y"), *(at(F.col(c), x, y).alias(c) for c in "rgb"), *(v.alias(k) for k, v in mean.items()))


def bilinear(tiles: DataFrame, width: int, height: int, out_w: int, out_h: int) -> DataFrame:
    """Pixels of images resized to ``out_w`` x ``out_h``, each from four of the source, in array arithmetic."""
    p = F.col("p")
    ox, oy = p % out_w, F.floor(p / out_w)
    sx, sy = (ox + 0.5) * (width / out_w) - 0.5, (oy + 0.5) * (height / out_h) - 0.5
    lx, ly = F.floor(sx), F.floor(sy)
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("int")
    at = lambda c, x, y: F.element_at(F.col(c), clip(y, height) * width + clip(x, width) + 1)
    tx, ty = sx - lx, sy - ly
    value = lambda c: (at(c, lx, ly) * (1 - tx) + at(c, lx + 1, ly) * tx) * (1 - ty) + (at(c, lx, ly + 1) * (1 - tx) + at(c, lx + 1, ly + 1) * tx) * ty
    rows = tiles.select("image_id", "r", "g", "b", F.explode(F.sequence(F.lit(0), F.lit(out_w * out_h - 1))).alias("p"))
    return rows.select("image_id", ox.cast("int").alias("x"), oy.cast("int").alias("y"), *(value(c).alias(c) for c in "rgb"))


def tile_grid(images: DataFrame, edge: int = 2048) -> DataFrame:
    """Output tiles (tx, ty, x, y, w, h) of images (image_id, width, height)."""
    n = lambda c: F.sequence(F.lit(0), (F.ceil(F.col(c) / edge) - 1).cast("int"))
    both = images.where("width > 0 and height > 0").select("image_id", "width", "height", F.explode(n("width")).alias("tx")).withColumn("ty", F.explode(n("height")))
    x, y = F.col("tx") * edge, F.col("ty") * edge
    return both.select("image_id", "tx", "ty", x.alias("x"), y.alias("y"), F.least(F.lit(edge), F.col("width") - x).alias("w"), F.least(F.lit(edge), F.col("height") - y).alias("h"))


def with_halo(tiles: DataFrame, halo: int) -> DataFrame:
    """Tiles (image_id, tx, ty, w, h, plane: array in row order) widened by ``halo`` pixels of the tiles around them.

    Each tile sends its neighbours only the strips that they need; missing neighbours repeat the edge.
    """

    def strips(batches):
        for batch in batches:
            out = {k: [] for k in ("image_id", "tx", "ty", "dx", "dy", "w", "h", "part")}
            for r in batch.to_pylist():
                a = np.array(r["plane"], float).reshape(r["h"], r["w"])
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        ys = slice(None) if dy == 0 else slice(max(0, r["h"] - halo), None) if dy > 0 else slice(0, halo)
                        xs = slice(None) if dx == 0 else slice(max(0, r["w"] - halo), None) if dx > 0 else slice(0, halo)
                        part = a[ys, xs]
                        for k, v in zip(out, (r["image_id"], r["tx"] + dx, r["ty"] + dy, -dx, -dy, part.shape[1], part.shape[0], part.ravel().tolist()), strict=True):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("image_id", pa.int64()), *((c, pa.int32()) for c in ("tx", "ty", "dx", "dy", "w", "h")), ("part", pa.list_(pa.float64()))]))

    def join(pdf):
        parts = {(r.dx, r.dy): np.array(r.part).reshape(r.h, r.w) for r in pdf.itertuples()}
        if (0, 0) not in parts:
            return pdf.iloc[:0][["image_id", "tx", "ty", "w", "h"]].assign(plane=pdf["part"].iloc[:0])
        own = parts[0, 0]
        h, w = own.shape
        out = np.pad(own, halo, mode="edge")
        for (dx, dy), a in parts.items():
            if (dx, dy) != (0, 0):
                y0 = {-1: halo - a.shape[0], 0: halo, 1: halo + h}[dy]
                x0 = {-1: halo - a.shape[1], 0: halo, 1: halo + w}[dx]
                out[y0 : y0 + a.shape[0], x0 : x0 + a.shape[1]] = a[: out.shape[0] - y0, : out.shape[1] - x0]
        first = pdf.iloc[:1][["image_id", "tx", "ty"]]
        return first.assign(w=out.shape[1], h=out.shape[0], plane=[out.ravel().tolist()])

    moved = tiles.select(F.col("image_id").cast("long"), F.col("tx").cast("int"), F.col("ty").cast("int"), F.col("w").cast("int"), F.col("h").cast("int"), F.col("plane").cast("array<double>")).mapInArrow(strips, "image_id long, tx int, ty int, dx int, dy int, w int, h int, part array<double>")
    return moved.groupBy("image_id", "tx", "ty").applyInPandas(join, "image_id long, tx int, ty int, w int, h int, plane array<double>")  # nine strips a group


def luma_histogram(px: DataFrame, bins: int = 16) -> DataFrame:
    """Pixels of each image in each of ``bins`` even ranges of luminance."""
    level = F.least(F.lit(bins - 1), F.floor((F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722) * bins)).cast("long")
    return px.groupBy("image_id", level.alias("bin")).agg(F.count("*").alias("n"))


def line_scores(px: DataFrame, width: int, height: int, angles: list[float]) -> DataFrame:
    """For each image and angle: the mean squared difference between the averages of neighbouring slanted rows.

    Levels of ``level`` (whole numbers) are summed, so the result doesn't depend on partitions; a row's average is
    its sum, since all rows have ``width`` samples.
    """
    a = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.tan(F.radians(F.lit(v))).alias("slope")) for i, v in enumerate(angles)))).alias("a")
    rows = px.select("image_id", "x", "y", "level", a).select("image_id", "x", "y", "level", F.col("a.i").alias("angle"), F.col("a.slope").alias("slope"))
    middle = (width - 1) / 2
    # a sample at (x, y) lies on every line whose rounded offset brings it there; lines are shifted copies, so it is one
    line = F.col("y") - round_half_up(F.col("slope") * (F.col("x") - middle) + 0.0)
    margin = F.ceil(F.abs(F.col("slope")) * middle) + 1
    sums = rows.withColumns({"line": line, "margin": margin}).where((F.col("line") >= F.col("margin")) & (F.col("line") < height - F.col("margin"))).groupBy("image_id", "angle", "line").agg(F.sum("level").alias("s"))
    nxt = sums.select("image_id", "angle", (F.col("line") - 1).alias("line"), F.col("s").alias("t"))
    diff = sums.join(nxt, ["image_id", "angle", "line"])
    return diff.groupBy("image_id", "angle").agg(F.sum((F.col("t") - F.col("s")) * (F.col("t") - F.col("s"))).alias("total"), F.count("*").alias("n"))


def best_angle(scores: DataFrame) -> DataFrame:
    """The first angle with the highest mean score of each image."""
    mean = F.col("total") / F.col("n")
    return scores.groupBy("image_id").agg(F.max_by("angle", F.struct(mean, -F.col("angle"))).alias("angle"))


def brush_coverage(strokes: DataFrame, width: int, height: int) -> DataFrame:
    """Coverage (mask_id, x, y, coverage from 1 to 255) of brush strokes, later stamps over earlier ones.

    ``strokes``: mask_id, stroke (its order), radius in pixels, feather, alpha, points (array of x, y from 0 to 1).
    Stamps stand at most half a radius apart along each segment. A pixel's stamps are folded in order; only those
    that touch it are gathered.
    """
    pts = F.transform("points", lambda p: F.struct((p["x"] * (width - 1)).alias("x"), (p["y"] * (height - 1)).alias("y")))
    s = strokes.where((F.col("alpha") > 0) & (F.size("points") > 0)).select("mask_id", "stroke", F.greatest(F.lit(0.5), F.col("radius")).alias("radius"), "feather", "alpha", pts.alias("p"))
    seg = s.select("*", F.posexplode("p").alias("i", "end")).withColumn("start", F.when(F.col("i") > 0, F.try_element_at("p", F.col("i"))).otherwise(F.col("end")))
    far = F.hypot(F.col("end.x") - F.col("start.x"), F.col("end.y") - F.col("start.y"))
    steps = F.greatest(F.lit(1), F.ceil(far / F.greatest(F.lit(1.0), F.col("radius") * 0.5))).cast("int")
    stamp = seg.withColumn("steps", F.when(F.col("i") == 0, 1).otherwise(steps)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    t = F.col("k") / F.col("steps")
    at = stamp.select("mask_id", "stroke", "i", "k", "radius", "feather", "alpha", (F.col("start.x") + (F.col("end.x") - F.col("start.x")) * t).alias("cx"), (F.col("start.y") + (F.col("end.y") - F.col("start.y")) * t).alias("cy"))
    span = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor(F.col(c) - F.col("radius"))).cast("int"), F.least(F.lit(n - 1), F.ceil(F.col(c) + F.col("radius"))).cast("int"))
    inside = (F.col("cx") + F.col("radius") >= 0) & (F.col("cx") - F.col("radius") <= width - 1) & (F.col("cy") + F.col("radius") >= 0) & (F.col("cy") - F.col("radius") <= height - 1)
    px = at.where(inside).withColumn("x", F.explode(span("cx", width))).withColumn("y", F.explode(span("cy", height)))
    d, inner = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), F.col("radius") * (1 - F.col("feather"))
    fade = (d - inner) / F.nullif(F.col("radius") - inner, F.lit(0.0))
    fade = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), fade)), F.lit(1.0))
    edge = F.when(d <= inner, 1.0).otherwise(1 - fade * fade * (3 - 2 * fade))
    source = round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), edge * F.col("alpha"))) * 255)
    drawn = px.select("mask_id", "x", "y", F.struct("stroke", "i", "k", source.alias("v")).alias("s")).where("s.v > 0")
    over = F.aggregate(F.array_sort("list"), F.lit(0).cast("long"), lambda acc, s: F.least(F.lit(255).cast("long"), s["v"] + F.floor(acc * (255 - s["v"]) / 255.0 + 0.5)))
    return drawn.groupBy("mask_id", "x", "y").agg(F.collect_list("s").alias("list")).select("mask_id", "x", "y", over.alias("coverage"))


ANGLES = [k / 4 for k in range(-60, 61)]


def straighten_angle(px: DataFrame, width: int, height: int, distinct: float = 1.08) -> DataFrame:
    """(image_id, degrees): the turn that levels each image of ``level`` pixels, in tenths of a degree, 0 if no angle stands out.

    An angle's score is that of slanted rows or columns, whichever is higher; the best (the lowest of equal ones) must
    reach ``distinct`` times the mean over all angles. Images without a scored line turn by 0.
    """
    mean = lambda scores, samples: scores.select("image_id", "angle", (F.col("total") / F.col("n") / float(samples * samples)).alias("score"))
    rows = mean(line_scores(px, width, height, ANGLES), width)
    turned = px.select("image_id", F.col("y").alias("x"), F.col("x").alias("y"), "level")
    columns = mean(line_scores(turned, height, width, [-a for a in ANGLES]), height)
    floor = px.select("image_id").distinct().select("image_id", F.lit(ANGLES.index(0.0)).alias("angle"), F.lit(0.0).alias("score"))
    best = rows.unionByName(columns).unionByName(floor).groupBy("image_id", "angle").agg(F.max("score").alias("score"))
    top = best.groupBy("image_id").agg(F.max_by("angle", F.struct("score", -F.col("angle"))).alias("angle"), F.max("score").alias("top"), (F.sum("score") / len(ANGLES)).alias("mean"))
    degrees = F.element_at(F.array(*map(F.lit, ANGLES)), F.col("angle") + 1)
    stands_out = (F.col("top") > 0) & (F.col("top") >= F.col("mean") * distinct)
    return top.select("image_id", F.when(stands_out, round_half_up(-degrees * 10) / 10).otherwise(0.0).alias("degrees"))
