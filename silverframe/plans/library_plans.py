"""Library, roll-up, layout, catalog, log and export queries, each with its comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.functions import scalars as sc
from silverframe.operators import catalog, exports, library, ordered, rollups
from silverframe.operators.library import LibraryQuery, View
from silverframe.operators.positions import with_position
from silverframe.plans import fixtures as fx
from silverframe.plans.fixtures import sql

ORDERS = {"name": "name, relative_path", "date": "last_modified DESC, relative_path", "rating": "rating DESC, name, relative_path", "pick": "CASE pick WHEN 'pick' THEN 0 WHEN 'none' THEN 1 ELSE 2 END, name, relative_path"}
SHOWN = "id, name, pick, rating, color_label"
QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add


@query("visible_entries", sql(f" SELECT id, name, rating, (row_number() OVER (ORDER BY {ORDERS['rating']}) - 1)::BIGINT AS pos FROM shown WHERE profile_id IS DISTINCT FROM 'standard' AND pick = 'none'", "shown"))
def visible(spark, d):
    q = LibraryQuery(curation="unpicked", format="raw", sort="rating")
    return library.visible_entries(fx.library(spark, d), q).select("id", "name", "rating", "pos")


def _curation(name, where):
    @query(f"flt_curation_{name.replace('-', '_')}", sql(f" SELECT {SHOWN} FROM shown WHERE {where}", "shown"))
    def run(spark, d):
        lib = fx.library(spark, d)
        return library.by_curation(library.with_metadata(library.in_view(lib, View()), lib.metadata), name).select(*SHOWN.split(", "))


for _name, _where in {"all": "true", "picked": "pick = 'pick'", "rejected": "pick = 'reject'", "unpicked": "pick = 'none'", "rated": "rating >= 1", **{f"rating-{n}": f"rating = {n}" for n in range(1, 6)}, **{f"label-{c}": f"color_label = '{c}'" for c in library.LABELS}}.items():
    _curation(_name, _where)


def _sort(name):
    @query(f"sort_{name}", sql(f" SELECT id, (row_number() OVER (ORDER BY {ORDERS[name]}) - 1)::BIGINT AS pos FROM shown", "shown"))
    def run(spark, d):
        return library.visible_entries(fx.library(spark, d), LibraryQuery(sort=name)).select("id", "pos")


for _name in ORDERS:
    _sort(_name)


@query("flt_format", sql(" SELECT f AS kind, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT id, 'raw' AS f FROM entries WHERE profile_id IS DISTINCT FROM 'standard' UNION ALL SELECT id, 'standard' FROM entries WHERE profile_id = 'standard') GROUP BY f", "entries"))
def formats(spark, d):
    e = fx.entries(spark, d)
    parts = [library.by_format(e, k).agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(k).alias("kind"), "n", "ids") for k in ("raw", "standard")]
    return parts[0].unionByName(parts[1])


@query("flt_folder", sql(" SELECT id, relative_path FROM shown WHERE folder = (SELECT min(folder) FROM entries)", "shown"))
def folder(spark, d):
    lib = fx.library(spark, d)
    first = lib.entries.agg(F.min("folder")).first()[0]
    return library.in_view(lib, View("folder", first)).select("id", "relative_path")


@query("flt_root_only", sql(" SELECT id, relative_path FROM shown WHERE folder IS NULL", "shown"))
def root(spark, d):
    return library.in_view(fx.library(spark, d), View("folder", "")).select("id", "relative_path")


@query("flt_album", sql(" SELECT id, name FROM shown WHERE id IN (SELECT entry_id FROM album_entries WHERE album_id = 3)", "shown", "album_entries"))
def album(spark, d):
    return library.in_view(fx.library(spark, d), View("album", 3)).select("id", "name")


@query("flt_album_unknown", sql(" SELECT id, name FROM shown", "shown"))
def unknown_album(spark, d):
    return library.in_view(fx.library(spark, d), View("album", -1)).select("id", "name")


@query("flt_archive_hide", sql(" SELECT id, name FROM shown", "shown"))
def hide(spark, d):
    return library.in_view(fx.library(spark, d), View()).select("id", "name")


@query("flt_archive_only", sql(" SELECT id, name FROM entries WHERE id IN (SELECT id FROM archive)", "entries", "archive"))
def only(spark, d):
    return library.in_view(fx.library(spark, d), View("archive")).select("id", "name")


@query("join_default_metadata", sql(" SELECT id, pick, rating, color_label, updated_at FROM known", "known"))
def defaults(spark, d):
    return library.with_metadata(fx.entries(spark, d), fx.metadata(spark, d)).select("id", "pick", "rating", "color_label", "updated_at")


@query("viewer_list", sql(" SELECT id, (row_number() OVER (ORDER BY name, relative_path) - 1)::BIGINT AS pos FROM entries", "entries"))
def viewer(spark, d):
    return with_position(fx.entries(spark, d).select("id", "name", "relative_path"), "name", "relative_path").select("id", "pos")


@query("topk_recent", sql(" SELECT id, last_modified FROM entries ORDER BY last_modified DESC, relative_path LIMIT 50", "entries"))
def recent(spark, d):
    return library.latest(fx.entries(spark, d), 50).select("id", "last_modified")


@query("album_search", " SELECT album_id, name, lower(trim(name)) = 'album 1' AS exact FROM (SELECT DISTINCT conv_id AS album_id, 'Album ' || (conv_id % 20) AS name FROM conversations) WHERE contains(lower(name), 'album 1')")
def album_search(spark, d):
    albums = fx.album_entries(spark, d).select("album_id", F.concat(F.lit("Album "), (F.col("album_id") % 20).cast("string")).alias("name")).distinct()
    return library.search_albums(albums, " Album 1 ")


@query("albums_with_selected", sql(" SELECT DISTINCT album_id FROM album_entries WHERE entry_id IN (SELECT id FROM archive)", "album_entries", "archive"))
def with_selected(spark, d):
    return library.albums_with_any(fx.album_entries(spark, d), fx.archive(spark, d))


FOLDERS = """, own AS (SELECT folder, count(*) AS n FROM entries GROUP BY folder),
    parts AS (SELECT string_split(folder, '/') AS p, n FROM own WHERE folder IS NOT NULL),
    pre AS (SELECT array_to_string(p[1:k], '/') AS path, CASE WHEN k = len(p) THEN n ELSE 0 END AS n FROM (SELECT p, n, unnest(range(1, len(p) + 1)) AS k FROM parts)
            UNION ALL SELECT '', n FROM own WHERE folder IS NULL UNION ALL SELECT '', 0)
    SELECT path, CASE WHEN path = '' THEN NULL ELSE regexp_replace(path, '/?[^/]*$', '') END AS parent,
           (CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END)::INTEGER AS depth, sum(n)::BIGINT AS n FROM pre GROUP BY path"""


@query("folder_tree", sql(FOLDERS, "entries"))
def tree(spark, d):
    return rollups.folder_tree(fx.entries(spark, d))


@query("folder_tree_urls", " WITH e AS (SELECT nullif(regexp_extract(url, '^https?://(.*)/[^/]*$', 1), '') AS folder FROM pages), entries AS (SELECT * FROM e)" + FOLDERS)
def url_tree(spark, d):
    pages = fx.table(spark, d, "pages")
    return rollups.folder_tree(pages.select(F.nullif(F.regexp_extract("url", r"^https?://(.*)/[^/]*$", 1), F.lit("")).alias("folder")))


@query("library_totals", sql(" SELECT count(*) AS n_all, count(*) FILTER (id IN (SELECT id FROM archive)) AS n_archived, count(*) FILTER (id NOT IN (SELECT id FROM archive)) AS n_visible, count(*) FILTER (pick = 'pick') AS n_picked FROM known", "known", "archive"))
def totals(spark, d):
    return rollups.library_totals(fx.entries(spark, d), fx.archive(spark, d), fx.metadata(spark, d))


@query("picked_count", sql(" SELECT count(*) FILTER (pick = 'pick') AS n_picked, count(*) FILTER (pick = 'reject') AS n_rejected, count(*) AS n FROM known", "known"))
def picked(spark, d):
    m = library.with_metadata(fx.entries(spark, d), fx.metadata(spark, d))
    return m.agg(F.count_if(F.col("pick") == "pick").alias("n_picked"), F.count_if(F.col("pick") == "reject").alias("n_rejected"), F.count("*").alias("n"))


@query("album_sizes", sql(" SELECT album_id, count(*) AS n FROM album_entries GROUP BY album_id", "album_entries"))
def sizes(spark, d):
    return rollups.album_sizes(fx.album_entries(spark, d))


@query("date_islands", """ WITH t AS (SELECT o_custkey, o_orderkey, date_trunc('year', o_orderdate) AS day FROM orders),
    f AS (SELECT *, CASE WHEN day IS DISTINCT FROM lag(day) OVER w OR lag(o_orderkey) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM f)
    SELECT o_custkey, island::BIGINT AS island, min(day)::TIMESTAMP AS day, count(*) AS n FROM i GROUP BY o_custkey, island""")
def islands(spark, d):
    rows = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_trunc("year", "o_orderdate").alias("day"))
    out = rollups.date_islands(rows, "o_custkey", ["o_orderkey"], "day")
    return out.select("o_custkey", F.col("island").cast("long").alias("island"), F.col("day").cast("timestamp_ntz").alias("day"), "n")


@query("first_free_number", " WITH t AS (SELECT DISTINCT user_id, event_id % 6 + 1 AS k FROM events WHERE event_type <> 'view'), s AS (SELECT user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY k) AS r FROM t) SELECT user_id, coalesce(max(k) FILTER (k = r), 0)::BIGINT + 1 AS free FROM s GROUP BY user_id")
def free(spark, d):
    e = fx.table(spark, d, "events").where("event_type <> 'view'").select("user_id", (F.col("event_id") % 6 + 1).alias("k"))
    return rollups.first_free_number(e, "user_id", "k")


GRID = ", g AS (SELECT id, pos, pos // 6 AS row, pos % 6 AS col FROM (SELECT id, (row_number() OVER (ORDER BY name, relative_path) - 1)::BIGINT AS pos FROM shown))"


def _grid(spark, d):
    rows = library.visible_entries(fx.library(spark, d), LibraryQuery(sort="name"))
    return ordered.square_rows(rows, 1200, 190, 8)


@query("square_rows", sql(GRID + " SELECT id, pos, row, col, 193::BIGINT AS cell FROM g", "shown"))
def squares(spark, d):
    return _grid(spark, d).withColumn("cell", F.col("cell").cast("long"))


for _dir, _target in {"left": "lag(id) OVER (ORDER BY pos)", "right": "lead(id) OVER (ORDER BY pos)"}.items():

    @query(f"grid_nav_{_dir}", sql(GRID + f" SELECT id, coalesce({_target}, id) AS target FROM g", "shown"))
    def sideways(spark, d, way=_dir):
        return ordered.navigate(_grid(spark, d), way)


for _dir, _step in {"up": -1, "down": 1}.items():

    @query(f"grid_nav_{_dir}", sql(GRID + f", e AS (SELECT row, max(col) AS m FROM g GROUP BY row) SELECT g.id, coalesce(t.id, g.id) AS target FROM g LEFT JOIN e ON e.row = g.row + {_step} LEFT JOIN g t ON t.row = g.row + {_step} AND t.col = least(g.col, e.m)", "shown"))
    def vertical(spark, d, way=_dir):
        return ordered.navigate(_grid(spark, d), way)


@query("range_select", sql(GRID + " SELECT id, pos FROM g WHERE pos BETWEEN (SELECT least(min(pos), max(pos)) FROM g WHERE id IN (23, 144)) AND (SELECT max(pos) FROM g WHERE id IN (23, 144))", "shown"))
def span(spark, d):
    lib = fx.library(spark, d)
    return ordered.range_select(library.visible_entries(lib, LibraryQuery(sort="name")), 23, 144)


DYNAMIC = """, t AS (SELECT coalesce(folder, '') AS folder, id, aspect, row_number() OVER (PARTITION BY folder ORDER BY relative_path) - 1 AS pos FROM entries),
    f AS (SELECT folder, id, pos, aspect, aspect AS total, 1 AS n, 0 AS row FROM t WHERE pos = 0
          UNION ALL SELECT t.folder, t.id, t.pos, t.aspect, CASE WHEN (f.total + t.aspect) * 180 + f.n * 8 > 900 THEN t.aspect ELSE f.total + t.aspect END,
                 CASE WHEN (f.total + t.aspect) * 180 + f.n * 8 > 900 THEN 1 ELSE f.n + 1 END, f.row + CASE WHEN (f.total + t.aspect) * 180 + f.n * 8 > 900 THEN 1 ELSE 0 END
          FROM f JOIN t ON t.folder = f.folder AND t.pos = f.pos + 1)"""


def _dynamic(spark, d):
    from pyspark.sql import Window

    e = fx.entries(spark, d).select(F.coalesce("folder", F.lit("")).alias("folder"), "id", "aspect", "relative_path")
    pos = (F.row_number().over(Window.partitionBy("folder").orderBy("relative_path")) - 1).cast("long")
    return ordered.dynamic_rows(e.select("folder", "id", pos.alias("pos"), "aspect"), "folder", 900, 180, 8)


@query("dynamic_rows", sql(DYNAMIC + " SELECT folder, id, pos, row::BIGINT AS row FROM f", "entries").replace("WITH ", "WITH RECURSIVE ", 1))
def dynamic(spark, d):
    return _dynamic(spark, d).select("folder", "id", "pos", "row")


@query("justify_rows", sql(DYNAMIC + """, h AS (SELECT *, (900.0::DOUBLE - (count(*) OVER r - 1) * 8) / sum(aspect) OVER r AS high, count(*) OVER r AS k FROM f WINDOW r AS (PARTITION BY folder, row)),
    w AS (SELECT *, floor(aspect * high + 0.5::DOUBLE) AS tile FROM h)
    SELECT folder, row::BIGINT AS row, pos, id, floor(high + 0.5::DOUBLE)::BIGINT AS height,
        (CASE WHEN pos = max(pos) OVER r THEN tile + floor(900 - (sum(tile) OVER r + (k - 1) * 8) + 0.5::DOUBLE) ELSE tile END)::BIGINT AS width FROM w WINDOW r AS (PARTITION BY folder, row)""", "entries").replace("WITH ", "WITH RECURSIVE ", 1))
def justified(spark, d):
    return ordered.justify_rows(_dynamic(spark, d), "folder", 900.0, 8).select("folder", "row", "pos", "id", "height", "width")


@query("neighbours", sql(" SELECT album_id, pos, entry_id AS id, lag(entry_id) OVER w AS previous, lead(entry_id) OVER w AS next FROM album_entries WINDOW w AS (PARTITION BY album_id ORDER BY pos)", "album_entries"))
def beside(spark, d):
    return ordered.neighbours(fx.album_entries(spark, d).withColumnRenamed("entry_id", "id"), "album_id")


@query("ranked_visible", sql(GRID + " SELECT id, id <> 23 AS later, abs(row * 200 + 100 - 1500)::DOUBLE AS distance, pos FROM g", "shown"))
def ranked(spark, d):
    g = _grid(spark, d).withColumns({"start": F.col("row") * 200, "row_height": F.lit(200)})
    return ordered.ranked_visible(g, 1500.0, F.col("id") == 23)


@query("prune_metadata", sql(" SELECT m.* FROM metadata m WHERE id IN (SELECT id FROM entries WHERE size >= 500)", "metadata", "entries"))
def pruned(spark, d):
    return catalog.prune(fx.metadata(spark, d), fx.entries(spark, d).where("size >= 500"))


@query("album_union", """ WITH a AS (SELECT conv_id AS album_id, turn AS pos, (conv_id * 31 + turn * 7) % 200 AS e FROM conversations),
    u AS (SELECT album_id, e, min(pos) AS pos FROM (SELECT * FROM a UNION ALL SELECT DISTINCT album_id, 1000000 + k, (album_id * 31 + k * 21) % 200 FROM a, (SELECT unnest(range(3)) AS k)) GROUP BY album_id, e)
    SELECT album_id, string_agg(e::VARCHAR, ',' ORDER BY pos) AS entry_ids, 99::BIGINT AS updated_at FROM u GROUP BY album_id""")
def union(spark, d):
    pairs = fx.album_entries(spark, d)
    albums = pairs.groupBy("album_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry_id"))), lambda x: x["entry_id"]).alias("entry_ids")).withColumn("updated_at", F.lit(1).cast("long"))
    added = albums.select("album_id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.col("album_id") * 31 + k * 21) % 200).alias("ids"))
    out = catalog.album_union(albums, added, 99)
    return out.select("album_id", F.array_join(F.transform("entry_ids", lambda x: x.cast("string")), ",").alias("entry_ids"), F.col("updated_at").cast("long").alias("updated_at"))


@query("album_remove", sql(" SELECT album_id, entry_id, row_number() OVER (PARTITION BY album_id ORDER BY pos) - 1 AS pos FROM album_entries WHERE entry_id NOT IN (SELECT id FROM archive)", "album_entries", "archive"))
def removed(spark, d):
    return catalog.album_remove(fx.album_entries(spark, d), fx.archive(spark, d)).select("album_id", "entry_id", "pos")


@query("archive_add", sql(" SELECT id FROM archive UNION SELECT id FROM metadata WHERE rating = 5", "archive", "metadata"))
def archived(spark, d):
    return catalog.archive_entries(fx.archive(spark, d), fx.metadata(spark, d).where("rating = 5"))


@query("archive_restore", sql(" SELECT id FROM archive WHERE id NOT IN (SELECT id FROM metadata WHERE rating < 3)", "archive", "metadata"))
def restored(spark, d):
    return catalog.restore_entries(fx.archive(spark, d), fx.metadata(spark, d).where("rating < 3"))


@query("upsert_metadata", sql(""" , c AS (SELECT id, CASE WHEN profile_id = 'nef' THEN 'pick' END AS pick, CASE WHEN size > 500 THEN (size % 6)::INTEGER END AS rating, NULL::VARCHAR AS color_label FROM entries WHERE profile_id IS NOT NULL)
    SELECT id, coalesce(c.pick, m.pick, 'none') AS pick, coalesce(c.rating, m.rating, 0) AS rating, coalesce(c.color_label, m.color_label) AS color_label, CASE WHEN c.id IS NOT NULL THEN 1800000000000 ELSE m.updated_at END AS updated_at
    FROM metadata m FULL JOIN c USING (id)""", "entries", "metadata"))
def upserted(spark, d):
    changes = fx.entries(spark, d).where("profile_id is not null").select("id", F.when(F.col("profile_id") == "nef", "pick").alias("pick"), F.when(F.col("size") > 500, (F.col("size") % 6).cast("int")).alias("rating"), F.lit(None).cast("string").alias("color_label"))
    return catalog.upsert_metadata(fx.metadata(spark, d), changes, 1_800_000_000_000)


@query("newest_wins", sql(""", s AS (SELECT id, 1700000000000 + (id % 5) * 200000 AS modified, (id % 4)::INTEGER AS rating FROM entries WHERE folder IS NOT NULL)
    SELECT e.id, CASE WHEN s.modified > coalesce(m.updated_at, 0) THEN 'sidecar' WHEN m.updated_at IS NOT NULL THEN 'catalog' ELSE 'default' END AS origin,
        CASE WHEN s.modified > coalesce(m.updated_at, 0) THEN s.rating ELSE coalesce(m.rating, 0) END AS rating
    FROM entries e LEFT JOIN metadata m USING (id) LEFT JOIN s USING (id)""", "entries", "metadata"))
def newest(spark, d):
    i, e = F.col("id"), fx.entries(spark, d)
    sidecars = e.where("folder is not null").select("id", (fx.EPOCH + (i % 5) * 200_000).alias("modified"), (i % 4).cast("int").alias("rating"))
    return catalog.newest_wins(e, fx.metadata(spark, d), sidecars)


@query("stale_signature", sql(" SELECT id, id % 4 = 1 OR id % 9 = 0 AS stale FROM entries", "entries"))
def stale(spark, d):
    e = fx.entries(spark, d)
    old = e.select("id", "relative_path", F.when(F.col("id") % 4 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "last_modified")
    return catalog.stale_signatures(old, e.where("id % 9 <> 0"))


@query("asset_integrity", " WITH r AS (SELECT DISTINCT user_id AS asset_id FROM events WHERE event_type = 'error'), a AS (SELECT DISTINCT user_id AS asset_id FROM events WHERE event_type = 'signup') SELECT asset_id, 'missing' AS problem FROM r WHERE asset_id NOT IN (SELECT asset_id FROM a) UNION ALL SELECT asset_id, 'orphan' FROM a WHERE asset_id NOT IN (SELECT asset_id FROM r)")
def integrity(spark, d):
    e = fx.table(spark, d, "events").withColumnRenamed("user_id", "asset_id")
    return catalog.missing_and_orphans(e.where("event_type = 'error'"), e.where("event_type = 'signup'"))


@query("debounce_last", """ WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM f)
    SELECT user_id, count(*) AS n, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM i GROUP BY user_id, burst""")
def debounce(spark, d):
    e = fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return catalog.last_values(e, "user_id", 6 * 3_600_000).select("user_id", "n", "value", "ts")


@query("history_merge", sql(" SELECT entry, edit_group, target, arg_min(before, seq) AS before, arg_max(after, seq) AS after, min(seq) AS seq, count(*) AS n FROM edit_log GROUP BY entry, edit_group, target", "edit_log"))
def history(spark, d):
    return catalog.grouped_edits(fx.edit_log(spark, d))


@query("json_props", " SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("sha256_key", sql(" SELECT id, substr(sha256(relative_path), 1, 16) AS key FROM entries", "entries"))
def keys(spark, d):
    return fx.entries(spark, d).select("id", F.substring(F.sha2("relative_path", 256), 1, 16).alias("key"))


@query("encode_id", sql(" SELECT id, replace(url_encode('a b/' || relative_path || '?é(1)~!*'), '%2A', '*') AS entry_id FROM (SELECT id, relative_path FROM entries)", "entries").replace("url_encode('a b/' || relative_path || '?é(1)~!*')", "'a%20b%2F' || replace(relative_path, '/', '%2F') || '%3F%C3%A9(1)~!*'"))
def encoded(spark, d):
    return fx.entries(spark, d).select("id", sc.entry_id(F.concat(F.lit("a b/"), "relative_path", F.lit("?é(1)~!*"))).alias("entry_id"))


@query("path_parts", sql(" SELECT id, folder AS parent, CASE WHEN folder IS NULL THEN NULL ELSE regexp_extract(folder, '([^/]*)$', 1) END AS parent_name, regexp_replace(name, '\\.[^.]+$', '') AS stem, upper(regexp_extract(name, '([^.]*)$', 1)) AS kind, name NOT LIKE '%.tif' AS supported, profile_id AS profile FROM entries", "entries"))
def paths(spark, d):
    p, n = F.col("relative_path"), F.col("name")
    return fx.entries(spark, d).select("id", sc.parent_folder(p).alias("parent"), sc.parent_name(p).alias("parent_name"), sc.strip_extension(n).alias("stem"), sc.file_type(n).alias("kind"), sc.is_supported(n).alias("supported"), sc.profile_of(n).alias("profile"))


@query("sidecar_paths", sql(" SELECT id, CASE WHEN name LIKE '%.nef' THEN replace(relative_path, '.nef', '') ELSE relative_path END || '.xmp' AS sidecar, strftime(make_timestamp(last_modified * 1000), '%d ') || upper(strftime(make_timestamp(last_modified * 1000), '%b')) AS day FROM entries", "entries"))
def sidecars(spark, d):
    return fx.entries(spark, d).select("id", sc.sidecar_path(F.col("relative_path")).alias("sidecar"), sc.row_date(F.col("last_modified")).alias("day"))


@query("export_names", sql(", k AS (SELECT job, base || suffix AS name, extension, row_number() OVER (PARTITION BY base, extension ORDER BY job) AS k FROM export_jobs) SELECT job, CASE WHEN k = 1 THEN name || '.' || extension WHEN k <= 999 THEN name || '-' || k || '.' || extension END AS output_name FROM k", "export_jobs"))
def names(spark, d):
    return exports.export_names(fx.export_jobs(spark, d))


STATUS = ", s AS (SELECT job, CASE WHEN size % 13 = 0 THEN 'error' WHEN size % 4 = 0 AND size % 3 = 0 THEN 'skipped' WHEN size % 5 = 0 THEN 'warning' ELSE 'success' END AS status FROM export_jobs)"


def _statuses(spark, d):
    j, s = fx.export_jobs(spark, d), F.col("size")
    return exports.export_status(j.withColumns({"failed": s % 13 == 0, "exists": s % 4 == 0, "policy": F.when(s % 3 == 0, "skip").otherwise("rename"), "diagnostics": F.when(s % 5 == 0, 1).otherwise(0)}))


@query("export_status", sql(STATUS + " SELECT job, status FROM s", "export_jobs"))
def statuses(spark, d):
    return _statuses(spark, d).select("job", "status")


@query("export_summary", sql(STATUS + " SELECT count(*) AS n_items, count(*) FILTER (status IN ('success', 'warning')) AS n_exported, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'error') AS n_failed, count(*) FILTER (status = 'warning') AS n_warnings FROM s", "export_jobs"))
def summary(spark, d):
    return rollups.export_summary(_statuses(spark, d))
