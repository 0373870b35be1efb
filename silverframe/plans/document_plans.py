"""Queries of crop handles, ratios, encoder options, names, channel curves and edit documents, each with its comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.functions import codecs, color, curves, geometry, masks
from silverframe.functions import scalars as sc
from silverframe.functions.scalars import scaled
from silverframe.operators import documents as docs
from silverframe.operators import rasters
from silverframe.plans import fixtures as fx
from silverframe.plans import image_plans as im
from silverframe.plans.fixtures import sql
from silverframe.plans.library_plans import query

# -- crop handles ------------------------------------------------------------------------------------------
_HANDLES = ["move", "n", "ne", "e", "se", "s", "sw", "w", "nw"]


def _case(of):
    """One SQL value for each handle."""
    return "CASE handle " + " ".join(f"WHEN '{h}' THEN {v}" for h, v in of.items()) + " END"


def _locked_sql():
    """x, y, width and height under a ratio, spelled out for each handle; edges above and below in terms of the height."""
    low, tall = "greatest(0.05::DOUBLE, 0.05::DOUBLE * a)", "greatest(0.05::DOUBLE, 0.05::DOUBLE / a)"
    width, height, fits = {}, {}, {}
    for h in _HANDLES[1:]:
        room_w = "(cx + cw)" if "w" in h else "(1 - cx)"
        room_h = "(cy + ch)" if "n" in h else "(1 - cy)"
        ask_w, ask_h = f"(cw {'-' if 'w' in h else '+'} dx)", f"(ch {'-' if 'n' in h else '+'} dy)"
        if h in "ns":
            most = f"least({room_h}, least(cx + cw / 2, 1 - cx - cw / 2) * 2 / a)"
            height[h] = f"greatest({tall}, least({most}, {ask_h}))"
            width[h], fits[h] = f"{height[h]} * a", f"{tall} <= {most}"
            continue
        most = f"least({room_w}, least(cy + ch / 2, 1 - cy - ch / 2) * 2 * a)" if h in "ew" else f"least({room_w}, {room_h} * a)"
        asked = ask_w if h in "ew" else f"CASE WHEN abs(dx) >= abs(dy) THEN {ask_w} ELSE {ask_h} * a END"
        width[h], fits[h] = f"greatest({low}, least({most}, {asked}))", f"{low} <= {most}"
        height[h] = f"{width[h]} / a"
    return _case(width), _case(height), _case(fits)


def _drag_sql():
    w, h, fits = _locked_sql()
    at_x = {k: "cx + cw / 2 - lw / 2" if k in "ns" else "cx + cw - lw" if "w" in k else "cx" for k in _HANDLES[1:]}
    at_y = {k: "cy + ch / 2 - lh / 2" if k in "ew" else "cy + ch - lh" if "n" in k else "cy" for k in _HANDLES[1:]}
    cut = lambda v: im.s_clamp(v, "0.05::DOUBLE")
    sides = {n: [k for k in _HANDLES[1:] if n in k] for n in "wens"}
    on = lambda n: "handle IN (" + ", ".join(f"'{k}'" for k in sides[n]) + ")"
    return (
        im._CLAMPED
        + f""", p AS (SELECT *, [{', '.join(repr(x) for x in _HANDLES)}][1 + (l_linenumber + l_partkey) % 9] AS handle, (l_suppkey % 21 - 10) / 20.0::DOUBLE AS dx, (l_orderkey % 17 - 8) / 16.0::DOUBLE AS dy,
            CASE WHEN l_partkey % 3 > 0 THEN (1 + l_linenumber % 4) / 2.0::DOUBLE END AS a FROM (SELECT k.*, l.l_partkey, l.l_suppkey FROM k JOIN lineitem l USING (l_orderkey, l_linenumber))),
        q AS (SELECT *, {w} AS lw, {h} AS lh, {fits} AS fits FROM p),
        r AS (SELECT *, {_case(at_x)} AS lx, {_case(at_y)} AS ly,
            CASE WHEN {on('w')} THEN greatest(0, least(cx + cw - 0.05::DOUBLE, cx + dx)) ELSE cx END AS fl, CASE WHEN {on('n')} THEN greatest(0, least(cy + ch - 0.05::DOUBLE, cy + dy)) ELSE cy END AS ft FROM q),
        s AS (SELECT *, CASE WHEN {on('e')} THEN greatest(fl + 0.05::DOUBLE, least(1, cx + cw + dx)) ELSE cx + cw END AS fr, CASE WHEN {on('s')} THEN greatest(ft + 0.05::DOUBLE, least(1, cy + ch + dy)) ELSE cy + ch END AS fb, {cut('lw')} AS kw, {cut('lh')} AS kh FROM r),
        t AS (SELECT *, CASE WHEN handle = 'move' THEN 'move' WHEN a IS NULL THEN 'free' WHEN fits THEN 'kept' ELSE 'still' END AS way FROM s)
        SELECT l_orderkey, l_linenumber, {', '.join(f"{im.s_scaled('CASE way ' + ' '.join(f'WHEN {k!r} THEN {v}' for k, v in of.items()) + ' END')} AS {n}" for n, of in {
            'x': {'move': 'greatest(0, least(1 - cw, cx + dx))', 'free': 'fl', 'kept': 'greatest(0, least(1 - kw, lx))', 'still': 'cx'},
            'y': {'move': 'greatest(0, least(1 - ch, cy + dy))', 'free': 'ft', 'kept': 'greatest(0, least(1 - kh, ly))', 'still': 'cy'},
            'w': {'move': 'cw', 'free': 'fr - fl', 'kept': 'kw', 'still': 'cw'}, 'h': {'move': 'ch', 'free': 'fb - ft', 'kept': 'kh', 'still': 'ch'}}.items())} FROM t"""
    )


@query("crop_drag", _drag_sql())
def crop_drag(spark, d):
    c = F.col
    asked = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, _HANDLES)), (1 + (c("l_linenumber") + c("l_partkey")) % 9).cast("int")).alias("handle"), ((c("l_suppkey") % 21 - 10) / 20.0).alias("dx"), ((c("l_orderkey") % 17 - 8) / 16.0).alias("dy"), F.when(c("l_partkey") % 3 > 0, (1 + c("l_linenumber") % 4) / 2.0).alias("a"))
    rows = im._crops(spark, d).join(asked, ["l_orderkey", "l_linenumber"])
    return im._rect_out(rows, geometry.drag_crop(im._rect(), c("handle"), c("dx"), c("dy"), c("a")))


_PRESETS = ["original", "free", *geometry.RATIOS, "custom", "unknown"]


@query("crop_presets", f""" WITH p AS (SELECT p_partkey, [{', '.join(repr(x) for x in _PRESETS)}][1 + p_partkey % {len(_PRESETS)}] AS preset, (p_size * 100 - 100)::DOUBLE AS iw, 3000.0::DOUBLE AS ih, (p_partkey % 4)::DOUBLE AS cw FROM part)
    SELECT p_partkey, preset, {im.s_scaled("CASE WHEN iw > 0 THEN CASE WHEN preset = 'original' THEN 1.0::DOUBLE WHEN preset = 'custom' THEN CASE WHEN cw > 0 THEN cw / 3 * ih / iw END WHEN preset LIKE '%:%' THEN split_part(preset, ':', 1)::DOUBLE / split_part(preset, ':', 2)::DOUBLE * ih / iw END END")} AS ratio FROM p""")
def presets(spark, d):
    k = F.col("p_partkey")
    p = fx.table(spark, d, "part").select(k, F.element_at(F.array(*map(F.lit, _PRESETS)), (1 + k % len(_PRESETS)).cast("int")).alias("preset"), (F.col("p_size") * 100 - 100).cast("double").alias("iw"), (k % 4).cast("double").alias("cw"))
    ratio = geometry.preset_ratio(F.col("preset"), F.col("iw"), F.lit(3000.0), F.col("cw"), F.lit(3.0))
    return p.select(k, "preset", scaled(ratio).alias("ratio"))


# -- encoders and names ------------------------------------------------------------------------------------
@query("encode_options", """ WITH e AS (SELECT p_partkey, ['jpeg', 'png', 'webp', 'avif', 'tiff', 'gif'][1 + p_partkey % 6] AS fmt, CASE WHEN p_partkey % 5 > 1 THEN (p_partkey % 120) / CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END::DOUBLE END AS q, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS l FROM part),
    f AS (SELECT *, CASE WHEN fmt = 'gif' THEN 'unknown format' WHEN fmt IN ('png', 'tiff') THEN CASE WHEN q IS NOT NULL THEN 'no quality in this format' WHEN l THEN 'no lossless mode in this format' END WHEN q IS NOT NULL AND (q % 1 <> 0 OR q NOT BETWEEN 1 AND 100) THEN 'quality must be a whole number from 1 to 100' WHEN fmt <> 'webp' AND l THEN 'no lossless mode in this format' END AS error FROM e)
    SELECT p_partkey, CASE WHEN error IS NULL THEN coalesce(q, CASE fmt WHEN 'jpeg' THEN 90 WHEN 'webp' THEN 85 WHEN 'avif' THEN 55 END)::INTEGER END AS quality, CASE WHEN error IS NULL THEN coalesce(l, false) END AS lossless, error FROM f""")
def options(spark, d):
    k = F.col("p_partkey")
    quality = F.when(k % 5 > 1, (k % 120) / F.when(k % 7 == 0, 2.0).otherwise(1.0))
    fmt = F.element_at(F.array(*map(F.lit, ("jpeg", "png", "webp", "avif", "tiff", "gif"))), (1 + k % 6).cast("int"))
    return fx.table(spark, d, "part").select(k, sc.encode_options(fmt, quality, F.when(k % 4 == 0, True).when(k % 4 == 1, False)).alias("o")).select("p_partkey", "o.*")


@query("name_parts", r""" WITH n AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || p_name || '.JPG' WHEN 1 THEN p_name || '/x' WHEN 2 THEN '  ' WHEN 3 THEN 'aux.tif' WHEN 4 THEN repeat(p_name, 30) || '.nef' ELSE p_brand || ': "a"?.webp. ' END AS name FROM part),
    s AS (SELECT *, trim(name) AS t, rtrim(translate(name, '<>:"|?*', '_______'), '. ') AS w FROM n)
    SELECT p_partkey, CASE WHEN name LIKE '%/%' THEN 'invalid path' WHEN t = '' THEN 'empty' END AS error, CASE WHEN name NOT LIKE '%/%' AND t <> '' THEN trim(left(t, 240)) END AS value,
        CASE WHEN name NOT LIKE '%/%' AND t <> '' THEN CASE WHEN w = 'aux.tif' THEN '_aux.tif' ELSE trim(left(trim(w), 240)) END END AS windows,
        CASE WHEN lower(name) LIKE '%.jpg' OR lower(name) LIKE '%.tif' THEN left(name, length(name) - 4) ELSE name END AS stem FROM s""")
def name_parts(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 6 == 0, F.concat(F.lit(" "), n, F.lit(".JPG"))).when(k % 6 == 1, F.concat(n, F.lit("/x"))).when(k % 6 == 2, "  ").when(k % 6 == 3, "aux.tif").when(k % 6 == 4, F.concat(F.repeat(n, 30), F.lit(".nef"))).otherwise(F.concat("p_brand", F.lit(': "a"?.webp. ')))
    p = fx.table(spark, d, "part").select(k, name.alias("name"))
    return p.select(k, sc.name_part(F.col("name")).alias("v"), sc.name_part(F.col("name"), windows=True)["value"].alias("windows"), sc.strip_known_extension(F.col("name")).alias("stem")).select(k, "v.error", "v.value", "windows", "stem")


# -- curves of four channels -------------------------------------------------------------------------------
def _through(v, table):
    """A value looked up in a list of 256 numbers."""
    return f"({table}[floor({v} * 255)::INTEGER + 1] * (1 - ({v} * 255 - floor({v} * 255))) + {table}[least(255, floor({v} * 255)::INTEGER + 1) + 1] * ({v} * 255 - floor({v} * 255)))"


@query("curve_channels", sql(f", t AS (SELECT list({im._hermite_sql('(i / 255.0::DOUBLE)')} ORDER BY i) AS m FROM (SELECT unnest(range(256)) AS i)), n AS (SELECT image_id, x, y, m, {', '.join(f'{_through(c, chr(109))} AS {c}' for c in im.C)} FROM px, t) SELECT image_id, x, y, {im.s_scaled(_through('r', 'm'))} AS r, {im.s_scaled('g')} AS g, {im.s_scaled('b')} AS b FROM n", "px"))
def channels(spark, d):
    table = spark.range(1).select(curves.channel_table({"rgb": im._fixed(), "red": im._fixed()}).alias("table"))  # one table of 256 steps
    px = im.pixels(spark, d).join(F.broadcast(table))
    return im.out(px, curves.apply_channels(F.col("table"), im.rgb()))


# -- edit documents ----------------------------------------------------------------------------------------
_DOCS = """ WITH c AS (SELECT l_orderkey AS id, 'm' || l_linenumber % 5 AS mask, 'c' || l_partkey % 50 AS component, CASE l_returnflag WHEN 'R' THEN 'ai' WHEN 'A' THEN 'brush' ELSE 'linear-gradient' END AS kind, 'a' || l_suppkey % 3 AS asset, l_quantity::INTEGER AS points FROM lineitem),
    a AS (SELECT DISTINCT o_orderkey AS id, 'a' || unnest([o_custkey % 5, o_orderkey % 3]) AS asset FROM orders WHERE o_orderkey IN (SELECT id FROM c))"""


def _documents(spark, d):
    li, o, c = fx.table(spark, d, "lineitem"), fx.table(spark, d, "orders"), F.col
    kind = F.when(c("l_returnflag") == "R", "ai").when(c("l_returnflag") == "A", "brush").otherwise("linear-gradient")
    name = lambda prefix, k: F.concat(F.lit(prefix), k.cast("string"))
    short = F.struct(name("m", c("l_linenumber") % 5).alias("mask"), name("c", c("l_partkey") % 50).alias("id"), kind.alias("kind"), name("a", c("l_suppkey") % 3).alias("asset"), c("l_quantity").cast("int").alias("n"))
    # points are made after the shuffle; their number sorts as they do
    stroke = lambda v: F.struct(F.sequence(F.lit(1), v["n"]).alias("points"))
    part = lambda v: F.struct(v["id"].alias("id"), v["kind"].alias("kind"), v["asset"].alias("asset"), F.array(stroke(v)).alias("strokes"))
    mask = lambda v: F.struct(v["mask"].alias("id"), F.array(part(v)).alias("components"))
    masks = li.groupBy(c("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(short)).alias("short")).select("id", F.transform("short", mask).alias("masks"))
    keys = F.array_distinct(F.array(*(F.concat(F.lit("a"), k.cast("string")) for k in (c("o_custkey") % 5, c("o_orderkey") % 3))))
    assets = o.select(c("o_orderkey").alias("id"), F.map_from_arrays(keys, F.transform(keys, lambda k: F.sha2(k, 256))).alias("assets"))
    return masks.join(assets, "id")


@query("document_violations", _DOCS + """, n AS (SELECT id, mask AS name FROM c UNION ALL SELECT id, component FROM c), r AS (SELECT DISTINCT id, asset FROM c WHERE kind = 'ai')
    SELECT id, 'repeated id' AS rule, name AS subject FROM n GROUP BY id, name HAVING count(*) > 1
    UNION ALL SELECT id, 'missing asset', asset FROM r ANTI JOIN a USING (id, asset) UNION ALL SELECT id, 'unused asset', asset FROM a ANTI JOIN r USING (id, asset)""")
def violations(spark, d):
    return docs.violations(_documents(spark, d))


@query("document_totals", _DOCS + ", k AS (SELECT id, count(*) AS k FROM a GROUP BY id) SELECT c.id, count(*)::INTEGER AS n_masks, count(*)::INTEGER AS n_components, count(*) FILTER (kind = 'brush')::INTEGER AS n_strokes, coalesce(sum(points) FILTER (kind = 'brush'), 0)::INTEGER AS n_points, max(k.k)::INTEGER AS n_assets FROM c JOIN k USING (id) GROUP BY c.id")
def totals(spark, d):
    return docs.totals(_documents(spark, d))


@query("document_canonical", _DOCS + " SELECT id, string_agg(asset || '=' || sha256(asset), ',' ORDER BY asset) AS assets, count(*) = 1 OR min(asset) = 'a' || max(o_custkey) % 5 AS unchanged, false AS plain FROM a JOIN orders ON o_orderkey = id GROUP BY id")
def canonical(spark, d):
    sorted_ = docs.canonical_assets(F.col("assets"))
    text = F.array_join(F.transform(F.map_entries(sorted_), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    same = docs.same_document(F.struct(F.col("assets").alias("v")), F.struct(sorted_.alias("v")))
    return _documents(spark, d).select("id", text.alias("assets"), same.alias("unchanged"), docs.is_default_masking().alias("plain"))


@query("mask_diagnostics", _DOCS + """, k AS (SELECT id, mask, component, asset, points % 2 = 0 AS stale FROM c WHERE kind = 'ai'), j AS (SELECT k.*, a.asset IS NOT NULL AS there, right(k.asset, 1) <> '1' AS good FROM k LEFT JOIN a USING (id, asset))
    SELECT id, mask, component, asset, 'stale-ai' AS kind, false AS blocks FROM j WHERE stale UNION ALL SELECT id, mask, component, asset, CASE WHEN there THEN 'corrupt-asset' ELSE 'missing-asset' END, true FROM j WHERE NOT there OR NOT good""")
def diagnostics(spark, d):
    rows = _documents(spark, d)
    m = rows.select("id", F.explode("masks").alias("m")).select("id", F.col("m.id").alias("mask"), F.explode("m.components").alias("c")).where("c.kind = 'ai'")
    parts = m.select("id", "mask", F.col("c.id").alias("component"), F.col("c.asset").alias("asset"), (F.size(F.col("c.strokes")[0]["points"]) % 2 == 0).alias("stale"))
    assets = rows.select("id", F.explode("assets").alias("asset", "content")).select("id", "asset", (F.right("asset", F.lit(1)) != "1").alias("verified"))
    return docs.mask_diagnostics(parts, assets)


_FAULTS = ["", "length", "signature", "header", "digest form", "id", "size", "digest"]


@query("asset_errors", f" SELECT DISTINCT vec_id // 3 AS image_id, nullif([{', '.join(repr(f) for f in _FAULTS)}][1 + (vec_id // 3) % 8], '') AS error FROM embeddings WHERE vec_id // 3 IN (SELECT vec_id // 3 FROM embeddings GROUP BY 1 HAVING count(*) = 3)")
def assets(spark, d):
    fault = F.element_at(F.array(*map(F.lit, _FAULTS)), (1 + F.col("image_id") % 8).cast("int"))
    png = codecs.encode_gray_png(F.lit(8), F.lit(8), F.transform("r", lambda v: (v * 255).cast("int")))
    made = fx.tiles(spark, d).select("image_id", fault.alias("fault"), png.alias("png"))
    # the hexadecimal text of a file, with one part spoilt
    code, is_ = F.hex("png"), lambda f: F.col("fault") == f
    spoilt = F.when(is_("signature"), F.concat(F.lit("88"), F.substring(code, 3, 1 << 20))).when(is_("header"), F.overlay(code, F.lit("00"), 25)).when(is_("digest"), F.overlay(code, F.lit("FFFF"), 81)).otherwise(code)
    digest = F.sha2("png", 256)
    raw = F.unhex(spoilt)
    named = F.when(is_("digest form"), F.upper(digest)).otherwise(digest)
    asset = F.struct(F.when(is_("id"), "other").otherwise(named).alias("id"), named.alias("sha256"), F.when(is_("size"), 9).otherwise(8).alias("width"), F.lit(8).alias("height"), (F.octet_length(raw) + is_("length").cast("int")).alias("byte_length"), F.base64(raw).alias("png"))
    return made.select("image_id", docs.asset_error(asset).alias("error"))


# -- masks and straightening -------------------------------------------------------------------------------
_ABLE = "image_id % 3"


@query("mask_planes", sql(f", a AS (SELECT *, {im.s_round('r * 255')} AS p, {im.s_round('g * 255')} AS q, {im.s_round('b * 255')} AS s FROM px), i AS (SELECT *, {im.s_round('p * (255 - q) / 255.0::DOUBLE')} AS pq FROM a), j AS (SELECT *, least(255, s + {im.s_round('pq * (255 - s) / 255.0::DOUBLE')}) AS ins, least(255, s + {im.s_round('p * (255 - s) / 255.0::DOUBLE')}) AS without_q FROM i) SELECT image_id, x, y, CASE {_ABLE} WHEN 0 THEN 0 WHEN 1 THEN 255 - ins ELSE 255 - without_q END::BIGINT AS adjustment, CASE {_ABLE} WHEN 0 THEN ins ELSE 255 - ins END::BIGINT AS inspection FROM j", "px"))
def planes(spark, d):
    level = lambda c: sc.round_half_up(F.col(c) * 255)
    kind = F.col("image_id") % 3
    a, i = masks.mask_planes([(level("r"), "add", kind > 0), (level("g"), "subtract", kind == 1), (level("b"), "add", kind > 0)], inverted=True)
    return im.pixels(spark, d).select("image_id", "x", "y", a.alias("adjustment"), i.alias("inspection"))


_BOTH = """, a AS (SELECT unnest(range(121)) AS angle, tan(radians(unnest(range(121)) / 4::DOUBLE - 15)) AS slope), z AS (SELECT *, ceil(abs(slope) * 3.5::DOUBLE) + 1 AS m FROM a),
    l AS (SELECT image_id, angle, m, 'h' AS way, y - floor(slope * (x - 3.5::DOUBLE) + 0.5::DOUBLE) AS line, round(r * 255)::BIGINT AS level FROM px, z UNION ALL SELECT image_id, angle, m, 'v', x - floor(-slope * (y - 3.5::DOUBLE) + 0.5::DOUBLE), round(r * 255)::BIGINT FROM px, z),
    s AS (SELECT image_id, angle, way, line, sum(level) / 8::DOUBLE AS s FROM l WHERE line >= m AND line < 8 - m GROUP BY ALL),
    e AS (SELECT *, s - lag(s) OVER (PARTITION BY image_id, angle, way ORDER BY line) AS diff FROM s),
    f AS (SELECT image_id, angle, way, avg(diff * diff) AS score FROM e WHERE diff IS NOT NULL GROUP BY ALL),
    g AS (SELECT image_id, angle, max(score) AS score FROM f GROUP BY ALL)
    SELECT image_id, (CASE WHEN max(score) > 0 AND max(score) >= sum(score) / 121 * 1.08 THEN floor(-(arg_max(angle, (round(score, 9), -angle)) / 4::DOUBLE - 15) * 10 + 0.5::DOUBLE) ELSE 0 END)::INTEGER AS tenths FROM g GROUP BY image_id"""


@query("straighten_angle", sql(_BOTH, "px"))
def straighten(spark, d):
    px = im.pixels(spark, d).withColumn("level", F.round(F.col("r") * 255).cast("long"))
    return rasters.straighten_angle(px, 8, 8).select("image_id", F.round(F.col("degrees") * 10).cast("int").alias("tenths"))


# -- the last steps of a pixel -----------------------------------------------------------------------------
def _overlay(mode, *exprs):
    @query(f"overlay_{mode}", im.rgb_sql(*exprs))
    def run(spark, d):
        return im.out(im.pixels(spark, d), color.overlay(im.rgb(), F.col("x") / 7.0, mode))


_overlay("white", *(im.s_mix(c, "1.0::DOUBLE", "(x / 7::DOUBLE) * 0.42::DOUBLE") for c in im.C))
_overlay("image", *(im.s_mix(c, "(x / 7::DOUBLE)", "0.82::DOUBLE") for c in im.C))


@query("framed_pixels", sql(f" SELECT image_id, x, y, {', '.join(im.s_scaled(f'CASE WHEN image_id % 2 = 1 AND (x = 0 OR y = 7) THEN 0 WHEN image_id % 3 = 0 THEN {c} ELSE least(1, {c} * 1.5::DOUBLE) END') + f' AS {c}' for c in im.C)}, CASE WHEN image_id % 2 = 1 AND (x = 0 OR y = 7) THEN 0 ELSE 1 END::INTEGER AS alpha FROM px", "px"))
def framed(spark, d):
    k = F.col("image_id")
    u, v = (F.col("x") - 1) / F.lit(6.0), F.col("y") / F.lit(6.0)
    *c, alpha = color.framed(tuple(F.col(n) * 1.5 for n in im.C), im.rgb(), u, v, k % 2 == 1, k % 3 == 0)
    return im.pixels(spark, d).select("image_id", "x", "y", *(scaled(p).alias(n) for n, p in zip(im.C, c, strict=True)), alpha.cast("int").alias("alpha"))
