"""Rendering and resampling over tiles, with comparison SQL that works on whole images pixel by pixel.

The images come from the vectors: six of 64 components are the 8 x 8 tiles of an image, three in a row, whose last column and row
of tiles are cut, so that sizes differ; an image of fewer vectors is one row of tiles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.functions.scalars import scaled
from silverframe.operators import tiles
from silverframe.plans import fixtures as fx
from silverframe.plans.image_plans import s_scaled
from silverframe.plans.library_plans import query

EDGE = 8


def images(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("image_id"))
    n = e.groupBy("image_id").agg(F.count("*").alias("n"))
    i, six = F.col("image_id"), F.col("n") == 6
    return n.select("image_id", F.when(six, 3).otherwise(F.col("n")).cast("int").alias("columns"), F.when(six, 2).otherwise(1).alias("rows")).select("image_id", "columns", (F.col("columns") * EDGE - i % 8).cast("int").alias("width"), (F.col("rows") * EDGE - i % 5).cast("int").alias("height"), (i % 8 + 1).cast("int").alias("orientation"))


def source(spark, d):
    """Tiles of 16-bit levels; green is red backwards and blue its negative."""
    level = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(65535.0), (v.cast("double") + 0.5) * 65535))))
    e = fx.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("image_id"), (F.col("vec_id") % 6).alias("k"), level.alias("p"))
    t = e.join(images(spark, d), "image_id")
    at = t.withColumns({"tx": (F.col("k") % F.col("columns")).cast("int"), "ty": F.floor(F.col("k") / F.col("columns")).cast("int")})
    size = at.withColumns({"w": F.least(F.lit(EDGE), F.col("width") - F.col("tx") * EDGE), "h": F.least(F.lit(EDGE), F.col("height") - F.col("ty") * EDGE)})
    part = lambda a: tiles.cut(a, F.lit(EDGE), F.lit(0), F.lit(0), F.col("w"), F.col("h"))
    return size.select("image_id", "tx", "ty", "w", "h", part(F.col("p")).alias("r"), part(F.reverse("p")).alias("g"), part(F.transform("p", lambda v: 65535 - v)).alias("b"))


def crops(spark, d):
    """Jobs with every crop setting, two in nine without any."""
    i = F.col("image_id")
    value = lambda v, k: v.cast("double").alias(k)
    crop = F.struct(value(0.05 + i % 4 * 0.05, "x"), value(0.1 + i % 3 * 0.05, "y"), value(0.6 + i % 5 * 0.05, "width"), value(0.55 + i % 6 * 0.05, "height"), value(i % 31 - 15, "angle"), value(i % 21 - 10, "perspective_x"), value(i % 17 - 8, "perspective_y"), value(i % 41 - 20, "distortion"))
    return images(spark, d).select("*", (i % 11 + 5).cast("int").alias("out_w"), (i % 9 + 4).cast("int").alias("out_h"), F.when(i % 9 > 1, crop).alias("crop"))


def drawn(result, value):
    """Pixels of rendered tiles, out of whole rows."""
    c = F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "c")
    return tiles.joined_rows(result).select("image_id", "y", c).select("image_id", "x", "y", *(value(F.col(f"c.{p}")).alias(p) for p in "rgb"))


IMAGES = """ i AS (SELECT image_id, CASE WHEN n = 6 THEN 3 ELSE n END AS columns, CASE WHEN n = 6 THEN 2 ELSE 1 END AS rows FROM (SELECT vec_id // 6 AS image_id, count(*) AS n FROM embeddings GROUP BY ALL)),
    img AS (SELECT image_id, columns, columns * 8 - image_id % 8 AS width, rows * 8 - image_id % 5 AS height, image_id % 8 + 1 AS o FROM i),
    levels AS (SELECT vec_id // 6 AS image_id, vec_id % 6 AS k, unnest(range(64)) AS p, unnest(l) AS r, unnest(list_reverse(l)) AS g
        FROM (SELECT vec_id, list_transform(embedding, lambda e: floor(greatest(0.0::DOUBLE, least(65535.0::DOUBLE, (e::DOUBLE + 0.5::DOUBLE) * 65535)))) AS l FROM embeddings)),
    src AS MATERIALIZED (SELECT image_id, k % columns * 8 + p % 8 AS x, k // columns * 8 + p // 8 AS y, r::DOUBLE AS r, g::DOUBLE AS g, 65535 - r::DOUBLE AS b FROM levels JOIN img USING (image_id)
        WHERE k % columns * 8 + p % 8 < width AND k // columns * 8 + p // 8 < height)"""
JOBS = """, job AS (SELECT *, CASE WHEN o >= 5 THEN height ELSE width END AS dw, CASE WHEN o >= 5 THEN width ELSE height END AS dh, image_id % 11 + 5 AS ow, image_id % 9 + 4 AS oh, image_id % 9 > 1 AS has FROM img),
    jobs AS (SELECT *, CASE WHEN has THEN 0.05::DOUBLE + image_id % 4 * 0.05::DOUBLE ELSE 0 END AS cx, CASE WHEN has THEN 0.1::DOUBLE + image_id % 3 * 0.05::DOUBLE ELSE 0 END AS cy,
        CASE WHEN has THEN 0.6::DOUBLE + image_id % 5 * 0.05::DOUBLE ELSE 1 END AS cw, CASE WHEN has THEN 0.55::DOUBLE + image_id % 6 * 0.05::DOUBLE ELSE 1 END AS ch,
        CASE WHEN has THEN image_id % 31 - 15 ELSE 0 END AS angle, CASE WHEN has THEN image_id % 21 - 10 ELSE 0 END AS px, CASE WHEN has THEN image_id % 17 - 8 ELSE 0 END AS py, CASE WHEN has THEN image_id % 41 - 20 ELSE 0 END AS dist FROM job)"""
#: u, v from the top left to the stored place (su, sv)
PLACE = """, a AS (SELECT *, cx + u * cw AS ax, cy + v * ch AS ay FROM {src}),
    b AS (SELECT *, (ax - (cx + cw / 2)) * dw AS tx, (ay - (cy + ch / 2)) * dh AS ty, radians(-angle::DOUBLE) AS t FROM a),
    c AS (SELECT *, cx + cw / 2 + (cos(t) * tx - sin(t) * ty) / dw AS rx, cy + ch / 2 + (sin(t) * tx + cos(t) * ty) / dh AS ry, rx - 0.5::DOUBLE AS dx, ry - 0.5::DOUBLE AS dy FROM b),
    e AS (SELECT *, greatest(0, least(1, rx + dy * px * 0.002::DOUBLE + dx * (dx * dx + dy * dy) * dist * 0.001::DOUBLE)) AS ex,
        greatest(0, least(1, ry + dx * py * 0.002::DOUBLE + dy * (dx * dx + dy * dy) * dist * 0.001::DOUBLE)) AS ey FROM c),
    f AS (SELECT *, CASE o WHEN 2 THEN 1 - ex WHEN 3 THEN 1 - ex WHEN 5 THEN ey WHEN 6 THEN ey WHEN 7 THEN 1 - ey WHEN 8 THEN 1 - ey ELSE ex END AS su,
        CASE o WHEN 3 THEN 1 - ey WHEN 4 THEN 1 - ey WHEN 5 THEN ex WHEN 8 THEN ex WHEN 6 THEN 1 - ex WHEN 7 THEN 1 - ex ELSE ey END AS sv FROM e)"""
#: qx, qy in source pixels to samples
SAMPLE = """, h AS (SELECT *, greatest(0, least(width - 1, qx)) AS hx, greatest(0, least(height - 1, qy)) AS hy FROM {src}),
    w AS (SELECT *, floor(hx)::BIGINT AS x0, floor(hy)::BIGINT AS y0, hx - floor(hx) AS wx, hy - floor(hy) AS wy FROM h),
    s AS (SELECT w.image_id, w.x, w.y, {each} FROM w JOIN src p ON p.image_id = w.image_id AND p.x = x0 AND p.y = y0 JOIN src q ON q.image_id = w.image_id AND q.x = least(x0 + 1, width - 1) AND q.y = y0
        JOIN src m ON m.image_id = w.image_id AND m.x = x0 AND m.y = least(y0 + 1, height - 1) JOIN src n ON n.image_id = w.image_id AND n.x = least(x0 + 1, width - 1) AND n.y = least(y0 + 1, height - 1))"""
OUT = ", px AS (SELECT *, unnest(range(ow * oh)) % ow AS x, unnest(range(ow * oh)) // ow AS y FROM {src})"


def sampled(src: str, level: str = "{}") -> str:
    v = lambda t, c: level.format(f"{t}.{c}")
    each = ", ".join(f"(({v('p', c)} * (1 - wx) + {v('q', c)} * wx) * (1 - wy) + ({v('m', c)} * (1 - wx) + {v('n', c)} * wx) * wy) AS {c}" for c in "rgb")
    return SAMPLE.format(src=src, each=each)


_SIZED = ", job AS (SELECT *, {w} AS dw, {h} AS dh FROM img), jobs AS (SELECT *, greatest(1, floor(dw * least(1.0::DOUBLE, {edge} / greatest(dw, dh)::DOUBLE) + 0.5::DOUBLE))::BIGINT AS ow, greatest(1, floor(dh * least(1.0::DOUBLE, {edge} / greatest(dw, dh)::DOUBLE) + 0.5::DOUBLE))::BIGINT AS oh FROM job)"
_BYTE = "least(255, floor({} * 255 / 65535 + 0.5::DOUBLE))"


@query(
    "source_windows",
    "WITH" + IMAGES + JOBS + """, step AS (SELECT *, greatest(1, least(8, floor(24 / (greatest(dw / ow::DOUBLE, dh / oh::DOUBLE) * 2))))::BIGINT AS step FROM jobs),
    col AS (SELECT *, unnest(range(0, ow, step)) AS x FROM step), tile AS (SELECT *, unnest(range(0, oh, step)) AS y FROM col),
    sized AS (SELECT *, least(step, ow - x) AS w, least(step, oh - y) AS h FROM tile), k AS (SELECT *, unnest(range(25)) AS k FROM sized),
    uv AS (SELECT *, (greatest(0, x - 1) + (least(ow, x + w + 1) - greatest(0, x - 1)) * (k % 5) / 4.0::DOUBLE) / ow AS u, (greatest(0, y - 1) + (least(oh, y + h + 1) - greatest(0, y - 1)) * (k // 5) / 4.0::DOUBLE) / oh AS v FROM k)"""
    + PLACE.format(src="uv")
    + """, box AS (SELECT image_id, x, y, w, h, width, height, min(su) AS x0, max(su) AS x1, min(sv) AS y0, max(sv) AS y1, any_value((abs(px) + abs(py)) * 0.001::DOUBLE + abs(dist) * 0.00025::DOUBLE) AS mg FROM f GROUP BY ALL)
    SELECT image_id, x::INTEGER AS x, y::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h, greatest(0, floor(round(greatest(0, x0 - mg) * width, 6)) - 1)::INTEGER AS "left", greatest(0, floor(round(greatest(0, y0 - mg) * height, 6)) - 1)::INTEGER AS top,
        least(width, ceil(round(least(1, x1 + mg) * width, 6)) + 1)::INTEGER AS "right", least(height, ceil(round(least(1, y1 + mg) * height, 6)) + 1)::INTEGER AS bottom FROM box""",
)
def source_windows(spark, d):
    return tiles.output_tiles(crops(spark, d), 8, 24).select("image_id", "x", "y", "w", "h", "left", "top", "right", "bottom")


@query(
    "render_tiles",
    "WITH" + IMAGES + JOBS + OUT.format(src="jobs") + ", uv AS (SELECT *, (x + 0.5::DOUBLE) / ow AS u, (y + 0.5::DOUBLE) / oh AS v FROM px)" + PLACE.format(src="uv") + ", g AS (SELECT *, su * width - 0.5::DOUBLE AS qx, sv * height - 0.5::DOUBLE AS qy FROM f)" + sampled("g") + f" SELECT image_id, x::INTEGER AS x, y::INTEGER AS y, {', '.join(f'{s_scaled(f"{c} / 65535")} AS {c}' for c in 'rgb')} FROM s",
)
def render_tiles(spark, d):
    """Cropped, straightened and distorted images in all orientations, in tiles of at most 8 x 8 from tiles of 8 x 8."""
    return drawn(tiles.render(source(spark, d), crops(spark, d), EDGE, 8, 24), lambda v: scaled(v / 65535))


@query(
    "downscale_bytes",
    "WITH" + IMAGES + _SIZED.format(w="width", h="height", edge=10) + OUT.format(src="jobs") + ", g AS (SELECT *, (x + 0.5::DOUBLE) * width / ow - 0.5::DOUBLE AS qx, (y + 0.5::DOUBLE) * height / oh - 0.5::DOUBLE AS qy FROM px)" + sampled("g") + " SELECT image_id, x::INTEGER AS x, y::INTEGER AS y, " + ", ".join(f"{_BYTE.format(c)}::BIGINT AS {c}" for c in "rgb") + " FROM s",
)
def downscale_bytes(spark, d):
    """Images scaled down to an edge of 10, as stored, rounded to bytes last."""
    jobs = tiles.fit_edge(images(spark, d).withColumn("orientation", F.lit(1)), 10).withColumn("crop", F.lit(None).cast(tiles.CROP))
    return drawn(tiles.render(source(spark, d), jobs, EDGE, 8, 24), tiles.to_bytes)


@query(
    "oriented_bytes",
    "WITH" + IMAGES + _SIZED.format(w="CASE WHEN o >= 5 THEN height ELSE width END", h="CASE WHEN o >= 5 THEN width ELSE height END", edge=12) + OUT.format(src="jobs")
    + """, uv AS (SELECT *, (x + 0.5::DOUBLE) / ow AS u, (y + 0.5::DOUBLE) / oh AS v FROM px),
    g AS (SELECT *, CASE WHEN o = 1 THEN (x + 0.5::DOUBLE) * width / ow ELSE (CASE WHEN o IN (2, 3) THEN 1 - u WHEN o IN (5, 6) THEN v WHEN o IN (7, 8) THEN 1 - v ELSE u END) * width END - 0.5::DOUBLE AS qx,
        CASE WHEN o = 1 THEN (y + 0.5::DOUBLE) * height / oh ELSE (CASE WHEN o IN (3, 4) THEN 1 - v WHEN o IN (5, 8) THEN u WHEN o IN (6, 7) THEN 1 - u ELSE v END) * height END - 0.5::DOUBLE AS qy FROM uv)"""
    + sampled("g", _BYTE) + " SELECT image_id, x::INTEGER AS x, y::INTEGER AS y, " + ", ".join(f"floor({c} + 0.5::DOUBLE)::BIGINT AS {c}" for c in "rgb") + " FROM s",
)
def oriented_bytes(spark, d):
    """Upright images in all orientations, scaled down to an edge of 12, from levels rounded to bytes first."""
    eight = source(spark, d).withColumns({p: F.transform(p, lambda v: tiles.to_bytes(v)) for p in tiles.PLANES})
    jobs = tiles.fit_edge(images(spark, d), 12).withColumn("crop", F.lit(None).cast(tiles.CROP))
    return drawn(tiles.render(eight, jobs, EDGE, 8, 24), lambda v: F.floor(v + 0.5).cast("long"))
