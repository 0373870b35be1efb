"""A photo library, edit log, rasters and export jobs derived from the driver's tables, in Spark and in SQL.

``SQL`` has the same definitions as common table expressions for comparison queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverframe.operators.library import Library

DAY = 86_400_000
EPOCH = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    stem = F.when(i % 11 == 0, F.concat(F.lit("root_"), i.cast("string"))).otherwise(F.concat(F.lit("img_"), F.lpad((i % 50).cast("string"), 3, "0")))
    ext = F.element_at(F.array(*map(F.lit, (".nef", ".jpg", ".png", ".webp", ".tif"))), (i % 5 + 1).cast("int"))
    bucket = F.concat(F.lit("b"), F.floor(i / 50).cast("string"))
    folder = F.when(i % 11 == 0, F.lit(None)).when(i % 3 == 0, F.concat_ws("/", "source", bucket)).otherwise(F.concat_ws("/", "source", "lang", bucket))
    profile = F.when(i % 5 == 0, "nef").when(i % 5 < 4, "standard")
    out = d.select(i.alias("id"), F.concat(stem, ext).alias("name"), folder.alias("folder"), F.col("n_chars").alias("size"), (EPOCH + (i % 40) * DAY).alias("last_modified"), profile.alias("profile_id"), ((i * 37 % 140 + 60) / 64.0).alias("aspect"))
    return out.withColumn("relative_path", F.concat(F.coalesce(F.concat("folder", F.lit("/")), F.lit("")), "name"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    pick = F.when(i % 3 == 0, "pick").when(i % 3 == 1, "reject").otherwise("none")
    label = F.try_element_at(F.array(*map(F.lit, ("red", "yellow", "green", "blue", "purple"))), (i % 7 + 1).cast("int"))
    rating = ((F.col("quality") * 3 + F.col("toxic") + i) % 6).cast("int")
    return table(spark, sf_dir, "labels").select(i.alias("id"), pick.alias("pick"), rating.alias("rating"), label.alias("color_label"), (EPOCH + i * 1000).alias("updated_at"))


def album_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("album_id"), F.col("turn").alias("pos"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % 200).alias("entry_id"))


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))


def library(spark: SparkSession, sf_dir: str) -> Library:
    return Library(entries(spark, sf_dir), metadata(spark, sf_dir), album_entries(spark, sf_dir), archive(spark, sf_dir))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images from three consecutive vectors; levels of 0 to 255 over 255."""
    e = table(spark, sf_dir, "embeddings")
    level = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((v.cast("double") + 0.5) * 255).cast("double"))) / 255)
    rows = e.select(F.floor(F.col("vec_id") / 3).alias("image_id"), (F.col("vec_id") % 3).alias("c"), level.alias("p"))
    whole = rows.groupBy("image_id").agg(*(F.max(F.when(F.col("c") == k, F.col("p"))).alias(n) for k, n in enumerate("rgb")))
    return whole.where("r is not null and g is not null and b is not null")


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    before = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("user_id").alias("entry"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 50).alias("edit_group"), F.col("event_type").alias("target"), before.alias("before"), (before + F.col("event_id") % 7).alias("after"))


def export_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("job"), F.col("p_name").alias("base"), F.lit("_web").alias("suffix"), F.when(F.col("p_size") % 2 == 0, "jpg").otherwise("png").alias("extension"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))


SQL = {
    "entries": """
        SELECT *, coalesce(folder || '/', '') || name AS relative_path FROM (
        SELECT doc_id AS id,
            CASE WHEN doc_id % 11 = 0 THEN 'root_' || doc_id ELSE 'img_' || lpad((doc_id % 50)::VARCHAR, 3, '0') END
                || CASE doc_id % 5 WHEN 0 THEN '.nef' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.webp' ELSE '.tif' END AS name,
            CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN source || '/b' || (doc_id // 50) ELSE source || '/' || lang || '/b' || (doc_id // 50) END AS folder,
            n_chars AS size, 1700000000000 + (doc_id % 40) * 86400000 AS last_modified,
            CASE WHEN doc_id % 5 = 0 THEN 'nef' WHEN doc_id % 5 < 4 THEN 'standard' END AS profile_id,
            (doc_id * 37 % 140 + 60) / 64.0::DOUBLE AS aspect
        FROM documents)""",
    "metadata": """
        SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'pick' WHEN 1 THEN 'reject' ELSE 'none' END AS pick,
            ((quality * 3 + toxic + doc_id) % 6)::INTEGER AS rating,
            CASE doc_id % 7 WHEN 0 THEN 'red' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' WHEN 3 THEN 'blue' WHEN 4 THEN 'purple' END AS color_label,
            1700000000000 + doc_id * 1000 AS updated_at
        FROM labels""",
    "album_entries": "SELECT conv_id AS album_id, turn AS pos, (conv_id * 31 + turn * 7) % 200 AS entry_id FROM conversations",
    "archive": "SELECT doc_id AS id FROM labels WHERE toxic = 1",
    "known": """
        SELECT e.*, coalesce(m.pick, 'none') AS pick, coalesce(m.rating, 0) AS rating, m.color_label, coalesce(m.updated_at, 0) AS updated_at
        FROM entries e LEFT JOIN metadata m USING (id)""",
    "shown": "SELECT * FROM known WHERE id NOT IN (SELECT id FROM archive)",
    "px": """
        SELECT image_id, (p % 8)::INTEGER AS x, (p // 8)::INTEGER AS y, max(v) FILTER (c = 0) AS r, max(v) FILTER (c = 1) AS g, max(v) FILTER (c = 2) AS b
        FROM (SELECT image_id, c, p, greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor((e::DOUBLE + 0.5::DOUBLE) * 255))) / 255 AS v
              FROM (SELECT vec_id // 3 AS image_id, vec_id % 3 AS c, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings))
        GROUP BY image_id, p HAVING count(*) = 3""",
    "edit_log": """
        SELECT user_id AS entry, event_id AS seq, event_id // 50 AS edit_group, event_type AS target, k AS before, k + event_id % 7 AS after
        FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)""",
    "export_jobs": "SELECT p_partkey AS job, p_name AS base, '_web' AS suffix, CASE WHEN p_size % 2 = 0 THEN 'jpg' ELSE 'png' END AS extension, p_size AS size, p_retailprice AS price FROM part",
}
_NEEDS = {"known": ["entries", "metadata"], "shown": ["entries", "metadata", "known", "archive"]}


def sql(body: str, *names: str) -> str:
    """A query over the fixtures named, with what they need."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + body if order else body
