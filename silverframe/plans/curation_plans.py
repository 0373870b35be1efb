"""Queries of albums, selection, clocks, date groups, keys and curve points, each with its comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.functions import curves
from silverframe.functions import scalars as sc
from silverframe.operators import albums as al
from silverframe.operators import exports, library
from silverframe.operators.library import LibraryQuery
from silverframe.plans import fixtures as fx
from silverframe.plans.fixtures import sql
from silverframe.plans.library_plans import DYNAMIC, ORDERS, _dynamic, query

NOW = 1_800_000_000_000
ALBUMS = "a AS (SELECT user_id AS album_id, event_type AS name, max(event_id) AS updated_at FROM events WHERE event_type <> 'error' GROUP BY ALL), b AS (SELECT album_id, max(name) AS name, max(updated_at) AS updated_at FROM a GROUP BY album_id)"


def _albums(spark, d):
    e = fx.table(spark, d, "events").where("event_type <> 'error'")
    rows = e.groupBy(F.col("user_id").alias("album_id")).agg(F.max("event_type").alias("name"), F.max("event_id").alias("updated_at"))
    return rows.select("album_id", "name", F.array().cast("array<bigint>").alias("entry_ids"), F.lit(0).cast("long").alias("created_at"), "updated_at")


@query("album_create", f" WITH {ALBUMS} SELECT album_id, name, updated_at FROM b UNION ALL SELECT 1000000 + c_custkey, trim(c_mktsegment), {NOW} FROM customer WHERE trim(c_mktsegment) <> ''")
def created(spark, d):
    new = fx.table(spark, d, "customer").select((F.col("c_custkey") + 1_000_000).alias("album_id"), F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")).alias("name"))
    blank = new.withColumn("name", F.lit("  "))
    return al.create_albums(_albums(spark, d), new.unionByName(blank), NOW).select("album_id", "name", "updated_at")


@query("album_rename", f" WITH {ALBUMS} SELECT album_id, coalesce(nullif(trim(c_name), ''), name) AS name, CASE WHEN c_custkey IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM b LEFT JOIN customer ON c_custkey = album_id")
def renamed(spark, d):
    names = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("album_id"), F.concat(F.lit(" "), "c_name").alias("name"))
    return al.rename_albums(_albums(spark, d), names, NOW).select("album_id", "name", "updated_at")


@query("album_delete", f" WITH {ALBUMS} SELECT b.album_id, o_orderkey AS viewer FROM orders LEFT JOIN b ON b.album_id = o_custkey AND b.album_id NOT IN (SELECT s_suppkey FROM supplier)")
def deleted(spark, d):
    ids = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("album_id"))
    left = al.delete_albums(_albums(spark, d), ids).select("album_id", F.lit(True).alias("there"))
    views = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("viewer"), F.col("o_custkey").alias("album_id"))
    after = al.view_after_delete(views, ids).join(left, "album_id", "left")
    return after.select(F.when(F.col("there"), F.col("album_id")).alias("album_id"), "viewer")


@query("selection_toggle", """ WITH t AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS s, max(l_partkey) AS hit, max(l_suppkey) + 1000000 AS miss FROM lineitem GROUP BY l_orderkey),
    u AS (SELECT l_orderkey, list_filter(s, lambda x: x <> hit) AS without_hit, CASE WHEN list_contains(s, miss) THEN list_filter(s, lambda x: x <> miss) ELSE list_append(s, miss) END AS with_miss FROM t)
    SELECT l_orderkey, array_to_string(without_hit, ',') AS without_hit, without_hit[-1] AS focus, array_to_string(with_miss, ',') AS with_miss FROM u""")
def toggle(spark, d):
    """An entry of the selection and one that is rarely in it, each toggled: out if it is in, else in at the end."""
    li = fx.table(spark, d, "lineitem")
    t = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("s"), F.max("l_partkey").alias("hit"), (F.max("l_suppkey") + 1_000_000).alias("miss"))
    out = t.select("l_orderkey", "hit", al.toggled(F.col("s"), F.col("hit")).alias("a"), al.toggled(F.col("s"), F.col("miss")).alias("b"))
    return out.select("l_orderkey", F.array_join("a", ",").alias("without_hit"), al.focused(F.col("a"), F.col("hit")).alias("focus"), F.array_join("b", ",").alias("with_miss"))


@query("mirror_clocks", """ WITH m AS (SELECT doc_id AS id, quality AS rating, doc_id * 3 AS develop_updated_at, doc_id * 2 AS updated_at FROM labels),
    e AS (SELECT user_id AS id, max(event_id) AS source_updated_at, CASE WHEN max(event_type) = 'view' THEN max(event_id % 6) END AS new_rating FROM events GROUP BY user_id)
    SELECT id, coalesce(new_rating, rating, 0)::INTEGER AS rating, CASE WHEN source_updated_at IS NULL THEN coalesce(develop_updated_at, 0) ELSE greatest(source_updated_at, coalesce(develop_updated_at, 0) + 1) END AS develop_updated_at,
        CASE WHEN new_rating IS NULL THEN coalesce(updated_at, 0) ELSE greatest(source_updated_at, coalesce(updated_at, 0) + 1) END AS updated_at
    FROM m FULL JOIN e USING (id)""")
def mirror(spark, d):
    i = F.col("doc_id")
    m = fx.table(spark, d, "labels").select(i.alias("id"), F.col("quality").cast("int").alias("rating"), (i * 3).alias("develop_updated_at"), (i * 2).alias("updated_at"))
    e = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("source_updated_at"), F.when(F.max("event_type") == "view", F.max(F.col("event_id") % 6)).cast("int").alias("new_rating"))
    return al.mirrored(m, e)


@query("export_metadata", sql(" SELECT e.id, coalesce(m.pick, 'none') AS pick, coalesce(m.rating, 0) AS rating, m.color_label, coalesce(m.updated_at, e.last_modified) AS updated_at FROM entries e LEFT JOIN metadata m USING (id)", "entries", "metadata"))
def export_metadata(spark, d):
    return exports.export_metadata(fx.entries(spark, d), fx.metadata(spark, d))


@query("selected_sources", sql(" SELECT DISTINCT p AS path, CASE WHEN p LIKE '/%' THEN 'outside the library' WHEN p NOT IN (SELECT relative_path FROM entries WHERE profile_id IS NOT NULL) THEN 'not in the approved scan' END AS error FROM (SELECT CASE WHEN pick = 'reject' THEN '/' || relative_path ELSE relative_path END AS p FROM known)", "known"))
def selected(spark, d):
    known = fx.entries(spark, d).join(fx.metadata(spark, d).select("id", "pick"), "id", "left")
    asked = known.select(F.when(F.col("pick") == "reject", F.concat(F.lit("/"), "relative_path")).otherwise(F.col("relative_path")).alias("path"))
    return exports.selected_sources(asked, fx.entries(spark, d).where("profile_id is not null").select(F.col("relative_path").alias("path")))


@query("merged_ratios", sql(" SELECT e.id, coalesce(s.aspect, c.rating + 0.5::DOUBLE) AS ratio FROM entries e LEFT JOIN (SELECT * FROM entries WHERE profile_id = 'standard') s USING (id) LEFT JOIN metadata c ON c.id = e.id WHERE coalesce(s.aspect, c.rating + 0.5::DOUBLE) IS NOT NULL", "entries", "metadata"))
def ratios(spark, d):
    e = fx.entries(spark, d)
    seed = e.where("profile_id = 'standard'").select("id", F.col("aspect").alias("ratio"))
    return al.merged_ratios(e, seed, fx.metadata(spark, d).select("id", (F.col("rating") + F.lit(0.5)).alias("ratio")))


@query("entry_lookup", sql(f" , p AS (SELECT id, name, (row_number() OVER (ORDER BY {ORDERS['name']}) - 1)::BIGINT AS pos FROM shown) SELECT id, name, pos FROM p WHERE id IN (SELECT c_custkey FROM customer)", "shown"))
def lookup(spark, d):
    asked = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return library.visible_entries(fx.library(spark, d), LibraryQuery(sort="name")).join(asked, "id", "left_semi").select("id", "name", "pos")


@query("date_groups", sql(DYNAMIC + """, g AS (SELECT f.folder, f.row, f.pos, (1700000000000 + (f.id % 40) * 86400000) // 86400000 AS day FROM f),
    r AS (SELECT folder, row, arg_min(day, pos) AS day, count(*) AS tiles FROM g GROUP BY folder, row),
    i AS (SELECT *, CASE WHEN day = lag(day) OVER w THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY folder ORDER BY row)),
    j AS (SELECT *, sum(new) OVER (PARTITION BY folder ORDER BY row) AS grp FROM i)
    SELECT folder, min(row)::BIGINT AS first_row, min(day)::BIGINT AS day, count(*) AS n_rows, sum(tiles)::BIGINT AS n_tiles FROM j GROUP BY folder, grp""", "entries").replace("WITH ", "WITH RECURSIVE ", 1))
def groups(spark, d):
    day = fx.entries(spark, d).select("id", F.floor(F.col("last_modified") / fx.DAY).alias("day"))
    return al.date_groups(_dynamic(spark, d).join(day, "id"), "folder", "day").select("folder", "first_row", "day", "n_rows", "n_tiles")


@query("path_keys", sql(" SELECT id, 'D:\\photos\\' || replace(relative_path, '/', '\\') AS windows, '/photos/' || relative_path AS unix, relative_path || ':' || last_modified || CASE WHEN profile_id = 'nef' THEN ':thumb' ELSE ':full' END AS key, relative_path || chr(31) || coalesce(profile_id, '?') AS signature FROM entries", "entries"))
def keys(spark, d):
    e, p = fx.entries(spark, d), F.col("relative_path")
    signature = F.replace(sc.signature_key(p, F.col("profile_id")), F.lit("\u0000"), F.lit("?"))
    return e.select("id", sc.join_root(F.lit("D:\\photos"), p).alias("windows"), sc.join_root(F.lit("/photos"), p).alias("unix"), sc.cache_key(p, F.col("last_modified"), F.coalesce(F.col("profile_id") == "nef", F.lit(False))).alias("key"), signature.alias("signature"))


@query("base64_bytes", " SELECT doc_id, (CASE WHEN n_chars = length(text) AND text = text THEN sha256(text) END) AS digest, source = 'src0' AS broken FROM documents WHERE text IS NOT NULL")
def decoded(spark, d):
    t = fx.table(spark, d, "documents").where("text is not null")
    raw = F.encode("text", "UTF-8")
    text = F.when(F.col("source") == "src0", F.concat(F.base64(raw), F.lit("!"))).otherwise(F.base64(raw))
    back = sc.decoded(text, F.octet_length(raw))
    return t.select("doc_id", F.sha2(F.coalesce(back, raw), 256).alias("digest"), back.isNull().alias("broken"))


@query("panel_rows", """ WITH f AS (SELECT p_partkey AS id, map {'lens': p_brand, 'iso_speed': p_size::VARCHAR, 'type': p_type} AS m FROM part),
    c AS (SELECT unnest(['camera_make', 'camera_model', 'lens', 'focal_len', 'aperture', 'shutter', 'iso_speed', 'timestamp']) AS k, unnest(['Make', 'Model', 'Lens', 'Focal Length', 'Aperture', 'Shutter', 'ISO', 'Date Time']) AS label, unnest(range(8)) AS pos)
    SELECT id, pos::INTEGER AS pos, label, coalesce(m[k], '—') AS value FROM f, c
    UNION ALL SELECT id, (8 + i)::INTEGER, ['iso_speed', 'lens', 'type'][i + 1], m[['iso_speed', 'lens', 'type'][i + 1]] FROM f, unnest(range(3)) AS r(i)""")
def panel(spark, d):
    m = F.create_map(F.lit("lens"), F.col("p_brand"), F.lit("iso_speed"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(sc.panel_rows(m)).alias("r")).select("id", "r.pos", "r.label", "r.value")


@query("line_angles", " SELECT event_id, k - 90 * (CASE WHEN k > 45 THEN ceil((k - 45) / 90) WHEN k < -45 THEN -ceil((-45 - k) / 90) ELSE 0 END) AS folded, CASE WHEN (k + 180 + 36000) % 360 = 0 THEN 180 ELSE (k + 180 + 36000) % 360 - 180 END AS direction FROM (SELECT event_id, (event_id % 1441 - 720)::DOUBLE AS k FROM events)")
def angles(spark, d):
    k = (F.col("event_id") % 1441 - 720).cast("double")
    return fx.table(spark, d, "events").select("event_id", sc.fold_line_angle(k).cast("double").alias("folded"), sc.normalize_degrees(k).cast("double").alias("direction"))


@query("eight_bits", " SELECT event_id, (event_id * 7919 % 65536 >> 8)::INTEGER AS high, floor((event_id * 7919 % 65536) * 255 / 65535.0::DOUBLE + 0.5::DOUBLE)::INTEGER AS nearest FROM events")
def bits(spark, d):
    v = F.col("event_id") * 7919 % 65536
    return fx.table(spark, d, "events").select("event_id", sc.eight_bits(v).alias("high"), sc.eight_bits(v, rounded=True).alias("nearest"))


_POINT = """ WITH t AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS x, (event_id % 7) / 4.0::DOUBLE - 0.25 AS y FROM events),
    a AS (SELECT event_id, least(1, greatest(0, y)) AS cy, x, y, abs(x) < 1 / 255.0::DOUBLE AS first, abs(x - 0.5) < 1 / 255.0::DOUBLE AS middle, abs(x - 1) < 1 / 255.0::DOUBLE AS last FROM t)
    SELECT event_id, CASE WHEN first OR middle OR last THEN 3 ELSE 4 END::INTEGER AS n, CASE WHEN first OR middle OR last THEN cy ELSE y END AS added_y, least(1 - 1 / 255.0::DOUBLE, greatest(1 / 255.0::DOUBLE, x)) AS moved_x, cy AS moved_y, 2::INTEGER AS left_n, 3::INTEGER AS kept_n FROM a"""


@query("curve_points", _POINT)
def points(spark, d):
    start = F.array(curves.point(0.0, 0.0), curves.point(0.5, 0.5), curves.point(1.0, 1.0))
    new = F.struct(((F.col("event_id") % 101) / F.lit(100.0)).alias("x"), ((F.col("event_id") % 7) / F.lit(4.0) - 0.25).alias("y"))
    added = curves.add_point(start, new)
    gap = F.array_sort(F.transform(added, lambda p: F.struct(F.abs(p["x"] - new["x"]).alias("far"), p["y"].alias("y"))))
    moved = F.element_at(curves.move_point(start, F.lit(1), new), 2)
    e = fx.table(spark, d, "events")
    return e.select("event_id", F.size(added).alias("n"), F.element_at(gap, 1)["y"].alias("added_y"), moved["x"].alias("moved_x"), moved["y"].alias("moved_y"), F.size(curves.remove_point(start, F.lit(1))).alias("left_n"), F.size(curves.remove_point(start, F.lit(2))).alias("kept_n"))
