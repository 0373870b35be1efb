"""Geometry, curve, color, mask and raster queries, each with its comparison SQL in double precision.

Results are whole numbers of millionths (``scaled``), so that the last bit of a double doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.functions import color, curves, geometry, masks
from silverframe.functions.geometry import Rect
from silverframe.functions.scalars import scaled
from silverframe.operators import rasters
from silverframe.plans import fixtures as fx
from silverframe.plans.fixtures import sql
from silverframe.plans.library_plans import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

C = ("r", "g", "b")


# -- SQL spellings of the shared formulas ----------------------------------------------------------------
def s_clamp(x, lo="0.0::DOUBLE", hi="1.0::DOUBLE"):
    return f"greatest({lo}, least({hi}, {x}))"


def s_step(a, b, x):
    t = s_clamp(f"(({x}) - {a}::DOUBLE) / ({b}::DOUBLE - {a}::DOUBLE)")
    return f"({t} * {t} * (3 - 2 * {t}))"


def s_mix(a, b, t):
    return f"(({a}) * (1 - ({t})) + ({b}) * ({t}))"


def s_luma(r="r", g="g", b="b"):
    return f"({r} * 0.2126::DOUBLE + {g} * 0.7152::DOUBLE + {b} * 0.0722::DOUBLE)"


def s_scaled(x):
    return f"floor(({x}) * 1000000.0::DOUBLE + 0.5001::DOUBLE)::BIGINT"


def s_linear(x):
    return f"(CASE WHEN {x} <= 0.04045::DOUBLE THEN {x} / 12.92::DOUBLE ELSE pow(greatest(({x} + 0.055::DOUBLE) / 1.055::DOUBLE, 0), 2.4::DOUBLE) END)"


def s_encode(x):
    return f"(CASE WHEN {x} <= 0.0031308::DOUBLE THEN {x} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(greatest({x}, 0), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END)"


def rgb_sql(r, g, b, extra="", source="px"):
    return sql(f"{extra} SELECT image_id, x, y, {s_scaled(r)} AS r, {s_scaled(g)} AS g, {s_scaled(b)} AS b FROM {source}", "px")


def pixels(spark, d):
    return rasters.pixels(fx.tiles(spark, d), 8)


def out(px, c):
    return px.select("image_id", "x", "y", *(scaled(v).alias(n) for n, v in zip(C, c, strict=True)))


def rgb():
    return tuple(F.col(c) for c in C)


def pointwise(name, f, *exprs, extra="", source="px"):
    @query(name, rgb_sql(*exprs, extra=extra, source=source))
    def run(spark, d):
        return out(pixels(spark, d), f(rgb()))


# -- pixels ------------------------------------------------------------------------------------------------
pointwise("srgb_roundtrip", lambda c: color.each(c, lambda x: color.encode(color.linearize(x) * 0.5)), *(s_encode(f"({s_linear(c)} * 0.5::DOUBLE)") for c in C))
pointwise("exposure", lambda c: color.exposure(c, 0.7), *(s_encode(f"({s_linear(c)} * pow(2.0::DOUBLE, 0.7::DOUBLE))") for c in C))
pointwise("white_balance", lambda c: color.white_balance(c, 850, -40), "r * (1 + 850 * 0.00008::DOUBLE + -40 * 0.00002::DOUBLE)", "g * (1 - 40 * 0.00003::DOUBLE)", "b * (1 - 850 * 0.00008::DOUBLE - -40 * 0.00002::DOUBLE)")
_LIFT = f", t AS (SELECT *, {s_step(0.7, 0.0, s_luma())} * 30 * 0.0015::DOUBLE + {s_step(0.35, 1.0, s_luma())} * -45 * 0.0012::DOUBLE + {s_step(0.72, 1.0, s_luma())} * 20 * 0.0012::DOUBLE + {s_step(0.25, 0.0, s_luma())} * -10 * 0.0012::DOUBLE AS lift FROM px)"
pointwise("tone_regions", lambda c: color.tone_regions(c, 30, -45, 20, -10, 25), *(f"({c} + lift - 0.5::DOUBLE) * (1 + 25 * 0.0035::DOUBLE) + 0.5::DOUBLE" for c in C), extra=_LIFT, source="t")
_SAT = f", t AS (SELECT image_id, x, y, {', '.join(f'{s_mix(s_luma(), c, 1.3)} AS {c}' for c in C)} FROM px), u AS (SELECT *, greatest(0, 1 + -35 * 0.01::DOUBLE * (1 - {s_clamp('greatest(r, g, b) - least(r, g, b)')})) AS k FROM t)"
pointwise("sat_vibrance", lambda c: color.saturate(c, 30, -35), *(s_mix(s_luma(), c, "k") for c in C), extra=_SAT, source="u")

HSL = """, d AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {src}),
    hsl AS (SELECT image_id, x, y, (hi + lo) * 0.5::DOUBLE AS l,
        CASE WHEN hi - lo <= 0.0001::DOUBLE THEN 0 ELSE (hi - lo) / (1 - abs(2 * ((hi + lo) * 0.5::DOUBLE) - 1)) END AS s,
        CASE WHEN hi - lo <= 0.0001::DOUBLE THEN 0 WHEN hi = r THEN ((((g - b) / (hi - lo)) % 6) + 6) % 6 / 6 WHEN hi = g THEN ((b - r) / (hi - lo) + 2) / 6 ELSE ((r - g) / (hi - lo) + 4) / 6 END AS h FROM d)"""


def s_channel(shift):
    t = f"((h + {shift}) - floor(h + {shift}))"
    return f"(CASE WHEN s <= 0.0001::DOUBLE THEN l WHEN {t} < 1 / 6::DOUBLE THEN p + (q - p) * 6 * {t} WHEN {t} < 0.5::DOUBLE THEN q WHEN {t} < 2 / 3::DOUBLE THEN p + (q - p) * (2 / 3::DOUBLE - {t}) * 6 ELSE p END)"


BACK = ", qq AS (SELECT *, CASE WHEN l < 0.5::DOUBLE THEN l * (1 + s) ELSE l + s - l * s END AS q FROM {src}), pp AS (SELECT *, 2 * l - q AS p FROM qq)"


@query("rgb_hsl", sql(HSL.format(src="px") + f" SELECT image_id, x, y, {s_scaled('h')} AS h, {s_scaled('s')} AS s, {s_scaled('l')} AS l FROM hsl", "px"))
def rgb_hsl(spark, d):
    px = pixels(spark, d)
    return px.select("image_id", "x", "y", *(scaled(v).alias(n) for n, v in zip("hsl", color.to_hsl(rgb()), strict=True)))


_BANDS = [(12, 20, -10), (-8, 0, 5), (0, -30, 0), (25, 10, 10), (-15, 40, 0), (5, -20, -5), (0, 0, 30), (-40, 15, 8)]
_W = [s_step(0.18, 0.0, f"least(abs(h - {m}::DOUBLE), 1 - abs(h - {m}::DOUBLE))") for m in color.BANDS]
_SUM = [" + ".join(f"w{i} * {b[k]} * {unit}" for i, b in enumerate(_BANDS)) for k, unit in enumerate(("(1 / 360::DOUBLE)", "0.01::DOUBLE", "0.005::DOUBLE"))]
_MIX = HSL.format(src="px") + f", w AS (SELECT *, {', '.join(f'{w} AS w{i}' for i, w in enumerate(_W))} FROM hsl), m AS (SELECT image_id, x, y, (h + {_SUM[0]}) - floor(h + {_SUM[0]}) AS h, {s_clamp(f's * (1 + {_SUM[1]})')} AS s, {s_clamp(f'l + {_SUM[2]}')} AS l FROM w)" + BACK.format(src="m")
pointwise("mixer", lambda c: color.mixer(c, _BANDS), s_channel("1 / 3::DOUBLE"), s_channel("0.0::DOUBLE"), s_channel("-1 / 3::DOUBLE"), extra=_MIX, source="pp")

_SHAPE = "(greatest(u, v) * 0.45::DOUBLE + sqrt(u * u + v * v) * 0.70710678::DOUBLE * 0.55::DOUBLE)"
_VIG = f", t AS (SELECT *, abs(((x + 0.5::DOUBLE) / 8 - 0.5::DOUBLE) * 2) AS u, abs(((y + 0.5::DOUBLE) / 8 - 0.5::DOUBLE) * 2) AS v FROM px), k AS (SELECT *, {s_step('(0.15 * (1 - 40 * 0.01::DOUBLE) + 0.8 * 40 * 0.01::DOUBLE)', '((0.15 * (1 - 40 * 0.01::DOUBLE) + 0.8 * 40 * 0.01::DOUBLE) + (0.03 * (1 - 60 * 0.01::DOUBLE) + 0.75 * 60 * 0.01::DOUBLE))', _SHAPE)} * (1 - {s_step(0.45, 1.0, s_luma())} * 50 * 0.01::DOUBLE) AS m FROM t)"
pointwise("vignette", lambda c: color.vignette(c, (F.col("x") + 0.5) / 8, (F.col("y") + 0.5) / 8, -60, 40, 60, 10, 50), *(f"{c} * (1 - m * 60 * 0.008::DOUBLE) + m * 0 * 0.006::DOUBLE" for c in C), extra=_VIG, source="k")

_NEAR = ", n AS (SELECT p.*, " + ", ".join(f"(e.{c} + w.{c} + s.{c} + o.{c}) * 0.25::DOUBLE AS a{c}" for c in C) + " FROM px p JOIN px e ON e.image_id = p.image_id AND e.x = least(p.x + 1, 7) AND e.y = p.y JOIN px w ON w.image_id = p.image_id AND w.x = greatest(p.x - 1, 0) AND w.y = p.y JOIN px s ON s.image_id = p.image_id AND s.x = p.x AND s.y = least(p.y + 1, 7) JOIN px o ON o.image_id = p.image_id AND o.x = p.x AND o.y = greatest(p.y - 1, 0))"


@query("neighbour_average", sql(_NEAR + f" SELECT image_id, x, y, {', '.join(f'{s_scaled(f"a{c}")} AS {c}' for c in C)} FROM n", "px"))
def average(spark, d):
    n = rasters.neighbour_average(fx.tiles(spark, d), 8, 8)
    return n.select("image_id", "x", "y", *(scaled(F.col(f"a{c}")).alias(c) for c in C))


_BL, _TONE = 40 * 0.003 * (1.5 - 50 * 0.01), 30 * 0.003 * (1.5 - 50 * 0.01) * (0.5 + 50 * 0.01)
_S1 = ", s1 AS (SELECT image_id, x, y, ar, ag, ab, am, " + ", ".join(f"{c} + (am - y0) * {_BL}::DOUBLE AS {c}" for c in C) + f" FROM (SELECT *, {s_luma()} AS y0, {s_luma('ar', 'ag', 'ab')} AS am FROM n))"
_S2 = ", s2 AS (SELECT image_id, x, y, ar, ag, ab, am, " + ", ".join(f"{c} + ({c} - a{c}) * {_BL}::DOUBLE * 20 * 0.01::DOUBLE AS {c}" for c in C) + " FROM s1)"
_S3 = ", s3 AS (SELECT image_id, x, y, ar, ag, ab, " + ", ".join(f"yy + {s_mix(f'{c} - yy', f'a{c} - am', f'{_TONE}::DOUBLE')} AS {c}" for c in C) + f" FROM (SELECT *, {s_luma()} AS yy FROM s2))"
_S4 = f", s4 AS (SELECT *, {s_mix('1.0::DOUBLE', s_step('(30 * 0.0015::DOUBLE)', '(30 * 0.0015::DOUBLE + 0.04::DOUBLE)', 'sqrt((r - ar) * (r - ar) + (g - ag) * (g - ag) + (b - ab) * (b - ab))'), '30 * 0.01::DOUBLE')} AS e FROM s3)"


@query("denoise_sharpen", rgb_sql(*(f"{c} + ({c} - a{c}) * 50 * 0.015::DOUBLE * (0.5::DOUBLE + 25 * 0.02::DOUBLE) * e" for c in C), extra=_NEAR + _S1 + _S2 + _S3 + _S4, source="s4"))
def denoise(spark, d):
    n = rasters.neighbour_average(fx.tiles(spark, d), 8, 8)
    return out(n, color.denoise_and_sharpen(rgb(), tuple(F.col(f"a{c}") for c in C), 40, 50, 20, 30, 50, 50, 50, 25, 30))


@query("bilinear_half", sql(" SELECT image_id, (x // 2)::INTEGER AS x, (y // 2)::INTEGER AS y, " + ", ".join(f"{s_scaled(f'((max({c}) FILTER (x % 2 = 0 AND y % 2 = 0) * 0.5::DOUBLE + max({c}) FILTER (x % 2 = 1 AND y % 2 = 0) * 0.5::DOUBLE) * 0.5::DOUBLE + (max({c}) FILTER (x % 2 = 0 AND y % 2 = 1) * 0.5::DOUBLE + max({c}) FILTER (x % 2 = 1 AND y % 2 = 1) * 0.5::DOUBLE) * 0.5::DOUBLE)')} AS {c}" for c in C) + " FROM px GROUP BY image_id, x // 2, y // 2", "px"))
def half(spark, d):
    return out(rasters.bilinear(fx.tiles(spark, d), 8, 8, 4, 4), rgb())


@query("overlay", rgb_sql(*(s_mix(c, f"{t}::DOUBLE", "(x / 7::DOUBLE) * 0.42::DOUBLE") for c, t in zip(C, (0.56, 0.72, 0.88), strict=True))))
def overlay(spark, d):
    return out(pixels(spark, d), color.overlay(rgb(), F.col("x") / 7.0))


@query("luma_hist", sql(f" SELECT image_id, least(15, floor({s_luma()} * 16))::BIGINT AS bin, count(*) AS n FROM px GROUP BY image_id, bin", "px"))
def histogram(spark, d):
    return rasters.luma_histogram(pixels(spark, d), 16)


_ANGLES = [k / 4 for k in range(-60, 61)]
_LINES = ", a AS (SELECT unnest(range(121)) AS angle, tan(radians(unnest(range(121)) / 4::DOUBLE - 15)) AS slope), l AS (SELECT image_id, angle, y - floor(slope * (x - 3.5::DOUBLE) + 0.5::DOUBLE) AS line, ceil(abs(slope) * 3.5::DOUBLE) + 1 AS m, round(r * 255)::BIGINT AS level FROM px, a), s AS (SELECT image_id, angle, line, sum(level)::BIGINT AS s FROM l WHERE line >= m AND line < 8 - m GROUP BY ALL), f AS (SELECT a.image_id, a.angle, sum((b.s - a.s) * (b.s - a.s))::BIGINT AS total, count(*) AS n FROM s a JOIN s b ON a.image_id = b.image_id AND a.angle = b.angle AND b.line = a.line + 1 GROUP BY ALL)"


def _lines(spark, d):
    px = pixels(spark, d).withColumn("level", F.round(F.col("r") * 255).cast("long"))
    return rasters.line_scores(px, 8, 8, _ANGLES)


@query("straighten_score", sql(_LINES + " SELECT image_id, angle::INTEGER AS angle, total, n FROM f", "px"))
def straighten(spark, d):
    return _lines(spark, d).select("image_id", F.col("angle").cast("int").alias("angle"), "total", "n")


@query("straighten_best", sql(_LINES + " SELECT image_id, arg_max(angle, (total / n::DOUBLE, -angle))::INTEGER AS angle FROM f GROUP BY image_id", "px"))
def straighten_best(spark, d):
    return rasters.best_angle(_lines(spark, d)).select("image_id", F.col("angle").cast("int").alias("angle"))


@query("tile_grid", " WITH i AS (SELECT o_orderkey AS image_id, o_orderkey * 7 % 9000 + 1 AS width, o_custkey * 13 % 7000 + 1 AS height FROM orders), t AS (SELECT *, unnest(range(0, ceil(width / 2048.0)::BIGINT)) AS tx FROM i), u AS (SELECT *, unnest(range(0, ceil(height / 2048.0)::BIGINT)) AS ty FROM t) SELECT image_id, tx::INTEGER AS tx, ty::INTEGER AS ty, least(2048, width - tx * 2048)::BIGINT AS w, least(2048, height - ty * 2048)::BIGINT AS h FROM u")
def grid(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") * 7 % 9000 + 1).alias("width"), (F.col("o_custkey") * 13 % 7000 + 1).alias("height"))
    return rasters.tile_grid(o).select("image_id", "tx", "ty", F.col("w").cast("long").alias("w"), F.col("h").cast("long").alias("h"))


# -- masks -------------------------------------------------------------------------------------------------
def s_round(x):
    return f"floor(({x}) + 0.5::DOUBLE)::BIGINT"


_LINEAR = s_round(f"(1 - {s_step(0.0, 1.0, '((x - 0.7::DOUBLE) * 5.6::DOUBLE + (y - 1.4::DOUBLE) * 4.2::DOUBLE) / (5.6::DOUBLE * 5.6::DOUBLE + 4.2::DOUBLE * 4.2::DOUBLE)')}) * 255")
_U, _V = ("((cos(radians(30)) * (x - 3.5::DOUBLE) + sin(radians(30)) * (y - 2.8::DOUBLE)) / 3.5::DOUBLE)", "((cos(radians(30)) * (y - 2.8::DOUBLE) - sin(radians(30)) * (x - 3.5::DOUBLE)) / 2.1::DOUBLE)")
_RADIAL = s_round(f"(1 - {s_step(0.5, 1.0, f'sqrt({_U} * {_U} + {_V} * {_V})')}) * 255")


def _linear():
    return masks.linear_gradient(F.col("x"), F.col("y"), 8, 8, (0.1, 0.2), (0.9, 0.8))


def _radial():
    return masks.radial_gradient(F.col("x"), F.col("y"), 8, 8, (0.5, 0.4), (0.5, 0.3), 30.0, 0.5)


@query("mask_linear", sql(f" SELECT image_id, x, y, {_LINEAR} AS coverage FROM px", "px"))
def mask_linear(spark, d):
    return pixels(spark, d).select("image_id", "x", "y", _linear().alias("coverage"))


@query("mask_radial", sql(f" SELECT image_id, x, y, {_RADIAL} AS coverage FROM px", "px"))
def mask_radial(spark, d):
    return pixels(spark, d).select("image_id", "x", "y", _radial().alias("coverage"))


@query("mask_compose", sql(f", a AS (SELECT *, {_LINEAR} AS c1, {_RADIAL} AS c2, {s_round('r * 255')} AS c3 FROM px), s1 AS (SELECT *, least(255, c1 + {s_round('0 * (255 - c1) / 255.0::DOUBLE')}) AS m FROM a), s2 AS (SELECT *, {s_round('m * (255 - c2) / 255.0::DOUBLE')} AS m2 FROM s1), s3 AS (SELECT *, least(255, c3 + {s_round('m2 * (255 - c3) / 255.0::DOUBLE')}) AS m3 FROM s2) SELECT image_id, x, y, (255 - m3)::BIGINT AS coverage FROM s3", "px"))
def mask_compose(spark, d):
    parts = [(_linear(), "add"), (_radial(), "subtract"), (F.floor(F.col("r") * 255 + 0.5), "add")]
    return pixels(spark, d).select("image_id", "x", "y", masks.compose_all(parts, inverted=True).alias("coverage"))


@query("mask_matte", sql(f" SELECT image_id, x, y, CASE WHEN r < 0.4::DOUBLE THEN 0 ELSE {s_round('r * 255')} END::BIGINT AS coverage FROM px", "px"))
def matte(spark, d):
    return pixels(spark, d).select("image_id", "x", "y", masks.matte_coverage(F.col("r"), 0.4).alias("coverage"))


@query("local_adjustments", sql(f", a AS (SELECT *, {_LINEAR} / 255.0::DOUBLE AS c1, {_RADIAL} / 255.0::DOUBLE AS c2 FROM px) SELECT image_id, x, y, {', '.join(f'{s_scaled(s_encode(f'({s_linear(c)} * pow(2.0::DOUBLE, 0.2::DOUBLE + c1 * 0.8::DOUBLE + c2 * -0.5::DOUBLE))'))} AS {c}' for c in C)} FROM a", "px"))
def local_adjustments(spark, d):
    stops = F.lit(0.2) + _linear() / 255.0 * 0.8 + _radial() / 255.0 * -0.5
    return out(pixels(spark, d), color.exposure(rgb(), stops))


# -- curves ------------------------------------------------------------------------------------------------
def _points():
    r, g = F.col("r"), F.col("g")
    return F.array(*(curves.point(x, y) for x, y in ((r, g), (1.2, 0.9), (-0.1, 0.05), (r * 0.5, g * 0.5 + 0.1), (r, 0.7))))


_POINTS = "SELECT image_id, x, y, list_sort([{'x': %s, 'i': 0, 'y': %s}, {'x': 1.0::DOUBLE, 'i': 1, 'y': 0.9::DOUBLE}, {'x': 0.0::DOUBLE, 'i': 2, 'y': 0.05::DOUBLE}, {'x': %s, 'i': 3, 'y': %s}, {'x': %s, 'i': 4, 'y': 0.7::DOUBLE}]) AS p FROM px" % (s_clamp("r"), s_clamp("g"), s_clamp("r * 0.5::DOUBLE"), s_clamp("g * 0.5::DOUBLE + 0.1::DOUBLE"), s_clamp("r"))
_KEPT = f", q AS ({_POINTS}), e AS (SELECT image_id, x, y, unnest(p) AS t, unnest(range(5)) AS i FROM q), f AS (SELECT image_id, x, y, t.x AS px, t.y AS py, i, lead(t.x) OVER w AS nx FROM e WINDOW w AS (PARTITION BY image_id, x, y ORDER BY i)), k AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY image_id, x, y) AS m FROM f WHERE nx IS NULL OR floor(px * 255 + 0.5::DOUBLE) <> floor(nx * 255 + 0.5::DOUBLE) WINDOW w AS (PARTITION BY image_id, x, y ORDER BY i))"


@query("curve_normalize", sql(_KEPT + f" SELECT image_id, x, y, (n - 1)::INTEGER AS i, {s_scaled('CASE WHEN m < 2 OR n = 1 THEN 0 WHEN n = m THEN 1 ELSE px END')} AS px, {s_scaled('py')} AS py FROM k WHERE m >= 2", "px"))
def curve_normalize(spark, d):
    px = pixels(spark, d).select("image_id", "x", "y", F.posexplode(curves.normalize(_points())).alias("i", "p"))
    return px.select("image_id", "x", "y", "i", scaled(F.col("p.x")).alias("px"), scaled(F.col("p.y")).alias("py"))


_CURVE = ((0.0, 0.1), (0.25, 0.2), (0.5, 0.65), (0.75, 0.7), (1.0, 0.95))


def _fixed():
    return F.array(*(curves.point(x, y) for x, y in _CURVE))


def _hermite_sql(v):
    """The curve's cubic pieces over ``v``, slopes worked out here by the definition."""
    import math

    n = len(_CURVE)
    pieces = []
    for k in range(1, n):
        (x0, y0), (x1, y1) = _CURVE[k - 1], _CURVE[k]
        before, after = _CURVE[max(0, k - 2)], _CURVE[min(n - 1, k + 1)]
        seg = (y1 - y0) / (x1 - x0)
        a, b = (y1 - before[1]) / (x1 - before[0]), (after[1] - y0) / (after[0] - x0)
        a, b = (0 if a * seg <= 0 else a), (0 if b * seg <= 0 else b)
        size = math.hypot(a / seg, b / seg)
        f = min(1, 3 / size) if size else 1
        t = f"(({v} - {x0}) / {x1 - x0}::DOUBLE)"
        h = f"(2 * {t} * {t} * {t} - 3 * {t} * {t} + 1) * {y0} + ({t} * {t} * {t} - 2 * {t} * {t} + {t}) * {(x1 - x0) * a * f}::DOUBLE + (-2 * {t} * {t} * {t} + 3 * {t} * {t}) * {y1} + ({t} * {t} * {t} - {t} * {t}) * {(x1 - x0) * b * f}::DOUBLE"
        pieces.append(f"WHEN {v} <= {x1} THEN {s_clamp(f'({h})::DOUBLE')}")
    return f"CASE {' '.join(pieces)} END"


@query("curve_sample", sql(f" SELECT image_id, x, y, {', '.join(f'{s_scaled(_hermite_sql(c))} AS {c}' for c in C)} FROM px", "px"))
def curve_sample(spark, d):
    return out(pixels(spark, d), tuple(curves.sample(_fixed(), v) for v in rgb()))


_LUT = f", lut AS (SELECT i, {_hermite_sql('(i / 255.0::DOUBLE)')} AS v FROM (SELECT unnest(range(256)) AS i))"


@query("curve_lut", "WITH " + _LUT[2:] + f" SELECT i::INTEGER AS i, {s_scaled('v')} AS v FROM lut")
def curve_lut(spark, d):
    lut = spark.range(1).select(F.posexplode(curves.look_up_table(_fixed())).alias("i", "v"))
    return lut.select("i", scaled(F.col("v")).alias("v"))


@query("lut_apply", sql(_LUT + f", c AS (SELECT *, floor(r * 255)::BIGINT AS k FROM px) SELECT image_id, x, y, {s_scaled('a.v * (1 - (r * 255 - k)) + b.v * (r * 255 - k)')} AS r FROM c JOIN lut a ON a.i = k JOIN lut b ON b.i = least(255, k + 1)", "px"))
def lut_apply(spark, d):
    lut = spark.range(1).select(curves.look_up_table(_fixed()).alias("lut"))  # one table of 256 numbers
    return pixels(spark, d).join(F.broadcast(lut)).select("image_id", "x", "y", scaled(curves.look_up(F.col("lut"), F.col("r"))).alias("r"))


# -- geometry ----------------------------------------------------------------------------------------------
_CROP = "SELECT l_orderkey, l_linenumber, l_discount * 8 - 0.1 AS x, l_tax * 9 - 0.05 AS y, l_quantity / 45 AS w, l_quantity / 60 + l_tax AS h, (l_partkey % 61 - 30)::DOUBLE AS angle, 3000 + l_suppkey % 5 * 500.0::DOUBLE AS iw, 2000 + l_partkey % 7 * 300.0::DOUBLE AS ih FROM lineitem"
_CLAMPED = f"WITH c AS ({_CROP}), d AS (SELECT *, {s_clamp('w', '0.05::DOUBLE')} AS cw, {s_clamp('h', '0.05::DOUBLE')} AS ch FROM c), k AS (SELECT *, greatest(0, least(1 - cw, x)) AS cx, greatest(0, least(1 - ch, y)) AS cy FROM d)"


def _crops(spark, d):
    c = F.col
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") * 8 - 0.1).alias("x"), (c("l_tax") * 9 - 0.05).alias("y"), (c("l_quantity") / 45).alias("w"), (c("l_quantity") / 60 + c("l_tax")).alias("h"), (c("l_partkey") % 61 - 30).cast("double").alias("angle"), (3000 + c("l_suppkey") % 5 * 500.0).alias("iw"), (2000 + c("l_partkey") % 7 * 300.0).alias("ih"))


def _rect():
    return Rect(*(F.col(v) for v in "xywh"))


def _rect_out(df, r):
    return df.select("l_orderkey", "l_linenumber", *(scaled(v).alias(n) for n, v in zip("xywh", (r.x, r.y, r.width, r.height), strict=True)))


def _rect_sql(body, x, y, w, h, source):
    return f"{body} SELECT l_orderkey, l_linenumber, {s_scaled(x)} AS x, {s_scaled(y)} AS y, {s_scaled(w)} AS w, {s_scaled(h)} AS h FROM {source}"


@query("crop_clamp", _rect_sql(_CLAMPED, "cx", "cy", "cw", "ch", "k"))
def crop_clamp(spark, d):
    return _rect_out(_crops(spark, d), geometry.clamp_crop(_rect()))


_ROT = _CLAMPED + ", a AS (SELECT *, abs(cos(radians(abs(angle)))) AS co, abs(sin(radians(abs(angle)))) AS si FROM k), b AS (SELECT *, (co * (cw * iw) + si * (ch * ih)) / 2 AS hw, (si * (cw * iw) + co * (ch * ih)) / 2 AS hh FROM a), s AS (SELECT *, least(1.0::DOUBLE, iw / (hw * 2), ih / (hh * 2)) AS sc FROM b)"


def _keep(still, x):
    return f"CASE WHEN angle = 0 THEN {still} ELSE {x} END"


@query("crop_rotation_fit", _rect_sql(_ROT, _keep("cx", "greatest(hw * sc, least(iw - hw * sc, (cx + cw / 2) * iw)) / iw - cw * sc / 2"), _keep("cy", "greatest(hh * sc, least(ih - hh * sc, (cy + ch / 2) * ih)) / ih - ch * sc / 2"), _keep("cw", "cw * sc"), _keep("ch", "ch * sc"), "s"))
def crop_rotation(spark, d):
    rows = geometry.fit_rotation(_crops(spark, d), _rect(), F.col("angle"), F.col("iw"), F.col("ih"))
    return _rect_out(rows, Rect(*(F.col(f"fitted.{n}") for n in ("x", "y", "width", "height"))))


_FIT = _CLAMPED + f", a AS (SELECT *, 1.5::DOUBLE * ih / iw AS ra FROM k), b AS (SELECT *, greatest(greatest(0.05::DOUBLE, 0.05::DOUBLE * ra), least(least(1.0::DOUBLE, ra), sqrt(cw * ch * ra))) AS nw FROM a), e AS (SELECT *, {s_clamp('nw', '0.05::DOUBLE')} AS fw, {s_clamp('nw / ra', '0.05::DOUBLE')} AS fh FROM b)"


@query("crop_ratio_fit", _rect_sql(_FIT, "greatest(0, least(1 - fw, cx + cw / 2 - nw / 2))", "greatest(0, least(1 - fh, cy + ch / 2 - nw / ra / 2))", "fw", "fh", "e"))
def crop_ratio(spark, d):
    return _rect_out(_crops(spark, d), geometry.fit_ratio(_rect(), 1.5 * F.col("ih") / F.col("iw")))


@query("contained_rect", f"WITH c AS ({_CROP}), a AS (SELECT *, iw / ih > 4 / 3::DOUBLE AS wide FROM c) SELECT l_orderkey, l_linenumber, {s_scaled('(800 - CASE WHEN wide THEN 800 ELSE 600 * (iw / ih) END) / 2')} AS x, {s_scaled('(600 - CASE WHEN wide THEN 800 / (iw / ih) ELSE 600 END) / 2')} AS y, {s_scaled('CASE WHEN wide THEN 800 ELSE 600 * (iw / ih) END')} AS w, {s_scaled('CASE WHEN wide THEN 800 / (iw / ih) ELSE 600 END')} AS h FROM a")
def contained(spark, d):
    return _rect_out(_crops(spark, d), geometry.contained(F.lit(800.0), F.lit(600.0), F.col("iw"), F.col("ih")))


_SIZE = "WITH c AS (SELECT l_orderkey, l_linenumber, 1000 + l_partkey * 37 % 9000 AS w, 800 + l_orderkey * 53 % 11000 AS h, CASE l_linenumber % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'long-edge' ELSE 'fit' END AS mode, 500 + l_suppkey % 4 * 2000 AS edge FROM lineitem), r AS (SELECT *, least(1.0::DOUBLE, CASE mode WHEN 'long-edge' THEN edge / greatest(w, h)::DOUBLE WHEN 'fit' THEN least(edge / w::DOUBLE, (edge - 100) / h::DOUBLE) ELSE 1 END) AS k FROM c), o AS (SELECT *, CASE WHEN k = 1 THEN w ELSE greatest(1, floor(w * k + 0.5::DOUBLE)) END AS ow, CASE WHEN k = 1 THEN h ELSE greatest(1, floor(h * k + 0.5::DOUBLE)) END AS oh FROM r) SELECT l_orderkey, l_linenumber, CASE WHEN ow * oh <= 50000000 THEN ow END::BIGINT AS w, CASE WHEN ow * oh <= 50000000 THEN oh END::BIGINT AS h FROM o"


@query("export_size", _SIZE)
def export_size(spark, d):
    c = F.col
    mode = F.element_at(F.array(*map(F.lit, ("original", "long-edge", "fit"))), c("l_linenumber") % 3 + 1)
    df = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (1000 + c("l_partkey") * 37 % 9000).alias("w"), (800 + c("l_orderkey") * 53 % 11000).alias("h"), mode.alias("mode"), (500 + c("l_suppkey") % 4 * 2000).alias("edge"))
    w, h = geometry.export_size(c("w"), c("h"), c("mode"), c("edge"), c("edge"), c("edge") - 100)
    return df.select("l_orderkey", "l_linenumber", w.alias("w"), h.alias("h"))


_OX = "CASE WHEN o IN (2, 3) THEN 1 - u WHEN o IN (5, 6) THEN v WHEN o IN (7, 8) THEN 1 - v ELSE u END"
_OY = "CASE WHEN o IN (3, 4) THEN 1 - v WHEN o IN (5, 8) THEN u WHEN o IN (6, 7) THEN 1 - u ELSE v END"
_UV = "SELECT l_orderkey, l_linenumber, (l_partkey % 101) / 100.0::DOUBLE AS u, (l_suppkey % 51) / 50.0::DOUBLE AS v, l_orderkey % 9 AS o, ((l_partkey + l_orderkey) % 31 - 15)::DOUBLE AS angle FROM lineitem"


def _uv(spark, d):
    c = F.col
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_partkey") % 101 / 100.0).alias("u"), (c("l_suppkey") % 51 / 50.0).alias("v"), (c("l_orderkey") % 9).alias("o"), ((c("l_partkey") + c("l_orderkey")) % 31 - 15).cast("double").alias("angle"))


@query("exif_orient", f"WITH c AS ({_UV}) SELECT l_orderkey, l_linenumber, {s_scaled(_OX)} AS x, {s_scaled(_OY)} AS y FROM c")
def exif(spark, d):
    x, y = geometry.orient(F.col("u"), F.col("v"), F.col("o"))
    return _uv(spark, d).select("l_orderkey", "l_linenumber", scaled(x).alias("x"), scaled(y).alias("y"))


_TURN = f"WITH c AS ({_UV}), a AS (SELECT *, (0.1::DOUBLE + u * 0.6::DOUBLE - 0.4::DOUBLE) * 3000 AS px, (0.2::DOUBLE + (1 - v) * 0.5::DOUBLE - 0.45::DOUBLE) * 2000 AS py, radians(-angle) AS t FROM c), b AS (SELECT *, 0.4::DOUBLE + (cos(t) * px - sin(t) * py) / 3000 AS x1, 0.45::DOUBLE + (sin(t) * px + cos(t) * py) / 2000 AS y1 FROM a), e AS (SELECT *, x1 - 0.5::DOUBLE AS dx, y1 - 0.5::DOUBLE AS dy FROM b), f AS (SELECT l_orderkey, l_linenumber, o, {s_clamp('x1 + dy * 30 * 0.002::DOUBLE + dx * (dx * dx + dy * dy) * 50 * 0.001::DOUBLE')} AS u, {s_clamp('y1 + dx * -20 * 0.002::DOUBLE + dy * (dx * dx + dy * dy) * 50 * 0.001::DOUBLE')} AS v FROM e)"
_UNIT = (0.1, 0.2, 0.6, 0.5)


def _unit():
    return Rect(*(F.lit(v) for v in _UNIT))


@query("uv_transform", _TURN + f" SELECT l_orderkey, l_linenumber, {s_scaled(_OX)} AS x, {s_scaled(_OY)} AS y FROM f")
def uv(spark, d):
    x, y = geometry.output_to_source(F.col("u"), F.col("v"), _unit(), F.col("angle"), F.lit(3000.0), F.lit(2000.0), F.lit(30), F.lit(-20), F.lit(50), F.col("o"))
    return _uv(spark, d).select("l_orderkey", "l_linenumber", scaled(x).alias("x"), scaled(y).alias("y"))


_FIX = f"WITH RECURSIVE c AS ({_UV}), it AS (SELECT *, 0 AS k, u AS sx, v AS sy FROM c UNION ALL SELECT l_orderkey, l_linenumber, u, v, o, angle, k + 1, u - (sy - 0.5::DOUBLE) * 30 * 0.002::DOUBLE - (sx - 0.5::DOUBLE) * ((sx - 0.5::DOUBLE) * (sx - 0.5::DOUBLE) + (sy - 0.5::DOUBLE) * (sy - 0.5::DOUBLE)) * 50 * 0.001::DOUBLE, v - (sx - 0.5::DOUBLE) * -20 * 0.002::DOUBLE - (sy - 0.5::DOUBLE) * ((sx - 0.5::DOUBLE) * (sx - 0.5::DOUBLE) + (sy - 0.5::DOUBLE) * (sy - 0.5::DOUBLE)) * 50 * 0.001::DOUBLE FROM it WHERE k < 6), e AS (SELECT l_orderkey, l_linenumber, radians(angle) AS t, (sx - 0.4::DOUBLE) * 3000 AS px, (sy - 0.45::DOUBLE) * 2000 AS py FROM it WHERE k = 6), f AS (SELECT *, 0.4::DOUBLE + (cos(t) * px - sin(t) * py) / 3000 AS x, 0.45::DOUBLE + (sin(t) * px + cos(t) * py) / 2000 AS y FROM e)"


@query("uv_inverse", _FIX + f" SELECT l_orderkey, l_linenumber, {s_scaled(s_clamp('(x - 0.1::DOUBLE) / 0.6::DOUBLE'))} AS x, {s_scaled(s_clamp('1 - (y - 0.2::DOUBLE) / 0.5::DOUBLE'))} AS y FROM f")
def uv_inverse(spark, d):
    x, y = geometry.source_to_output(F.col("u"), F.col("v"), _unit(), F.col("angle"), F.lit(3000.0), F.lit(2000.0), F.lit(30), F.lit(-20), F.lit(50))
    return _uv(spark, d).select("l_orderkey", "l_linenumber", scaled(x).alias("x"), scaled(y).alias("y"))
