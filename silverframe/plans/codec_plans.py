"""Queries that SQL can't express or only in part: command folds, sidecars, PNG files, grain, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.functions import codecs, color
from silverframe.operators import edits, exports, rasters
from silverframe.plans import fixtures as fx
from silverframe.plans.image_plans import out, pixels, rgb
from silverframe.plans.library_plans import query


def command_log(spark, d):
    """A log of edit commands from the event table: five kinds of events stand for commands, history steps and metadata edits."""
    e = fx.table(spark, d, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    command = (
        F.when(kind == "view", F.to_json(F.struct(F.lit("replace-global").alias("kind"), F.lit("basic").alias("plugin"), F.struct((n % 11).alias("exposure")).alias("value"), F.floor(n / 500).alias("group"))))
        .when(kind == "click", F.to_json(F.struct(F.lit("edit-metadata").alias("kind"), F.struct((n % 6).alias("rating")).alias("value"))))
        .when(kind == "signup", F.to_json(F.struct(F.lit("insert-mask").alias("kind"), F.struct(F.concat(F.lit("m"), (n % 4).cast("string")).alias("id"), F.array(F.struct(F.concat(F.lit("c"), (n % 4).cast("string")).alias("id"), F.lit("add").alias("operation"))).alias("components")).alias("value"))))
        .when(kind == "error", F.to_json(F.struct(F.lit("undo").alias("kind"))))
        .otherwise(F.to_json(F.struct(F.when(n % 2 == 0, "redo").otherwise("remove-mask").alias("kind"), F.concat(F.lit("m"), (n % 4).cast("string")).alias("mask"))))
    )
    return e.select(F.col("user_id").alias("entry"), n.alias("seq"), command.alias("command"))


@query("command_fold")
def command_fold(spark, d):
    return edits.fold_commands(command_log(spark, d))


@query("sidecar_codec", fx.sql(" SELECT id, rating % 6 AS rating, color_label AS label FROM metadata", "metadata"))
def sidecar_codec(spark, d):
    m = fx.metadata(spark, d)
    mark = F.when(F.col("color_label").isNotNull(), F.concat(F.lit(' xmp:Label="'), F.initcap("color_label"), F.lit('"'))).otherwise("")
    text = F.concat(F.lit(f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{codecs.RDF}"><rdf:Description xmlns:xmp="{codecs.XMP}" xmp:Rating="'), F.col("rating").cast("string"), F.lit('"'), mark, F.lit("/></rdf:RDF></x:xmpmeta>"))
    return m.select("id", codecs.sidecar(text).alias("s")).select("id", "s.rating", "s.label")


@query("png_encode", fx.sql(" SELECT image_id, 'png' AS kind, 8::INTEGER AS width, 8::INTEGER AS height FROM px GROUP BY image_id", "px"))
def png_encode(spark, d):
    levels = F.transform("r", lambda v: F.floor(v * 255 + 0.5).cast("int"))
    png = fx.tiles(spark, d).select("image_id", codecs.encode_gray_png(F.lit(8), F.lit(8), levels).alias("png"))
    return png.select("image_id", codecs.image_sizes("png").alias("s")).select("image_id", "s.kind", "s.width", "s.height")


@query("grain")
def grain(spark, d):
    return out(pixels(spark, d), color.grain(rgb(), F.col("x"), F.col("y"), 40))


@query("provenance_tail", " SELECT path, max(pos) AS pos, arg_max(device, pos) AS device, arg_max(inode, pos) AS inode FROM (SELECT event_id AS pos, 'out/' || user_id || '.jpg' AS path, event_id % 3 AS device, event_id * 7 AS inode FROM events ORDER BY event_id DESC LIMIT 4096) GROUP BY path")
def provenance(spark, d):
    e = fx.table(spark, d, "events")
    return exports.provenance_tail(e.select(F.col("event_id").alias("pos"), F.concat(F.lit("out/"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("path"), (F.col("event_id") % 3).alias("device"), (F.col("event_id") * 7).alias("inode")))


_GUARD = """ WITH s AS (SELECT o_orderkey % 997 AS path, o_custkey AS real_path, o_orderkey % 5 AS device, o_orderkey AS inode, o_custkey % 10 AS folder, o_orderkey % 400 AS name, o_orderstatus = 'O' AS selected FROM orders),
    o AS (SELECT DISTINCT o_orderkey % 997 AS path FROM orders WHERE o_orderpriority = '1-URGENT'), g AS (SELECT * FROM s WHERE path NOT IN (SELECT path FROM o) OR selected),
    t AS (SELECT l_orderkey * 10 + l_linenumber AS target, l_partkey % 5003 AS path, l_suppkey + 100000 * (l_partkey % 9) AS real_path, l_suppkey % 5 AS device, l_partkey * 3 AS inode, l_linenumber AS folder, l_partkey % 4000 AS name FROM lineitem)
    SELECT DISTINCT target FROM t WHERE EXISTS (SELECT 1 FROM g WHERE g.path = t.path) OR EXISTS (SELECT 1 FROM g WHERE g.real_path = t.real_path) OR EXISTS (SELECT 1 FROM g WHERE g.device = t.device AND g.inode = t.inode) OR EXISTS (SELECT 1 FROM g WHERE g.folder = t.folder AND g.name = t.name)"""


@query("overwrite_guard", _GUARD)
def guard(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o, li = fx.table(spark, d, "orders"), fx.table(spark, d, "lineitem")
    sources = o.select((k % 997).alias("path"), c.alias("real_path"), (k % 5).alias("device"), k.alias("inode"), (c % 10).alias("folder"), (k % 400).alias("name"), (F.col("o_orderstatus") == "O").alias("selected"))
    outputs = o.where("o_orderpriority = '1-URGENT'").select((k % 997).alias("path")).distinct()
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    targets = li.select((F.col("l_orderkey") * 10 + n).alias("target"), (p % 5003).alias("path"), (s + 100000 * (p % 9)).alias("real_path"), (s % 5).alias("device"), (p * 3).alias("inode"), n.cast("long").alias("folder"), (p % 4000).alias("name"))
    return exports.overwrites_source(targets, sources, outputs)


@query("brush_raster")
def brush(spark, d):
    """A stroke for each vector: from its first two components to the next two."""
    at = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at("embedding", i).cast("double") + 0.5))
    point = lambda i: F.struct(at(i).alias("x"), at(i + 1).alias("y"))
    strokes = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("mask_id"), F.lit(0).alias("stroke"), F.lit(1.5).alias("radius"), F.lit(0.5).alias("feather"), F.lit(0.7).alias("alpha"), F.array(point(1), point(3)).alias("points"))
    return rasters.brush_coverage(strokes, 16, 16)
