"""Reading a photo library: file scan, catalog documents, sidecars, settings."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silverframe.functions.scalars import entry_id, is_supported, parent_folder, profile_of, sidecar_path

MAX_SIDECAR = 16 * 1024 * 1024
CATALOG = (
    "version int, rootPath string, entries map<string,struct<pick:string,rating:int,colorLabel:string,developUpdatedAt:double,updatedAt:double>>, "
    "albums array<struct<id:string,name:string,entryIds:array<string>,createdAt:double,updatedAt:double>>, archivedEntryIds array<string>"
)


def _relative(path: Column, root: str) -> Column:
    """A file's path below the root; file sources put a scheme before it."""
    return F.regexp_extract(path, re.escape(root.rstrip("/").lstrip("/")) + "/(.*)$", 1)


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below ``root`` as entries; file contents aren't read.

    Files and folders whose names start with a dot are left out, as are (by Spark) names starting with ``_``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    rel = _relative(F.col("path"), root)
    named = files.select(rel.alias("relative_path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1000.0).alias("last_modified"))
    name = F.substring_index("relative_path", "/", -1)
    kept = named.where(is_supported(name) & ~F.col("relative_path").rlike(r"(^|/)\."))
    return kept.select(entry_id(F.col("relative_path")).alias("id"), name.alias("name"), "relative_path", parent_folder(F.col("relative_path")).alias("folder"), "size", "last_modified", profile_of(name).alias("profile_id"))


def file_heads(spark: SparkSession, root: str, max_bytes: int) -> DataFrame:
    """path and the first bytes of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.substring("content", 1, max(1, max_bytes)).alias("head"), "length")


def catalog_key(root: str) -> str:
    """The name under which a library's catalog is kept."""
    return hashlib.sha256(root.encode()).hexdigest()[:16]


def read_catalog(spark: SparkSession, path: str, root: str) -> DataFrame:
    """A catalog document of ``root``; malformed documents and newer versions fail, another root's gives no row."""
    doc = spark.read.schema(CATALOG).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    known = F.when(F.col("version").isin(1, 2), F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unsupported catalog version "), F.coalesce(F.col("version").cast("string"), F.lit("none")))))
    return doc.withColumn("version", known).where(F.col("rootPath") == root)


def catalog_problems(catalog: DataFrame) -> DataFrame:
    """Broken rules of catalog documents, one row each: rule and entry or album id."""
    e = catalog.select(F.explode("entries").alias("id", "m"))
    rules = {
        "pick": ~F.coalesce(F.col("m.pick").isin("pick", "reject", "none"), F.lit(False)),
        "rating": ~F.coalesce(F.col("m.rating").between(0, 5), F.lit(False)),
        "colorLabel": F.col("m.colorLabel").isNotNull() & ~F.col("m.colorLabel").isin("red", "yellow", "green", "blue", "purple"),
        "updatedAt": F.coalesce(F.isnan("m.updatedAt") | (F.col("m.updatedAt") < 0), F.lit(True)),
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    a = catalog.select(F.explode("albums").alias("a")).where(F.coalesce(F.trim("a.name") == "", F.lit(True)) | (F.size(F.array_distinct("a.entryIds")) < F.size("a.entryIds")))
    return e.select("id", F.explode(broken).alias("rule")).unionByName(a.select(F.col("a.id").alias("id"), F.lit("album").alias("rule")))


def catalog_tables(catalog: DataFrame) -> dict[str, DataFrame]:
    """metadata, album_entries and archive of a catalog document."""
    m = catalog.select(F.explode("entries").alias("id", "m")).select("id", F.col("m.pick").alias("pick"), F.col("m.rating").alias("rating"), F.col("m.colorLabel").alias("color_label"), F.coalesce("m.developUpdatedAt", F.lit(0.0)).alias("develop_updated_at"), F.col("m.updatedAt").alias("updated_at"))
    a = catalog.select(F.explode("albums").alias("a")).select(F.col("a.id").alias("album_id"), F.posexplode("a.entryIds").alias("pos", "entry_id"))
    r = catalog.select(F.explode("archivedEntryIds").alias("id"))
    return {"metadata": m, "album_entries": a, "archive": r}


def read_sidecars(spark: SparkSession, root: str, entries: DataFrame) -> DataFrame:
    """id, modified and text of the sidecars of entries; missing and oversized ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xmp").load(root)
    xmp = files.where(F.col("length") <= MAX_SIDECAR).select(_relative(F.col("path"), root).alias("sidecar"), (F.unix_micros("modificationTime") / 1000.0).alias("modified"), F.decode("content", "UTF-8").alias("text"))
    return entries.select("id", sidecar_path(F.col("relative_path")).alias("sidecar")).join(xmp, "sidecar").select("id", "modified", "text")


def lenient_settings(texts: DataFrame) -> DataFrame:
    """View settings from JSON texts (column ``value``), each field with its default where it is missing or not allowed."""
    s = F.from_json("value", "layout string, sort string, format string, thumbSize double")
    pick = lambda name, allowed, default: F.when(s[name].isin(*allowed), s[name]).otherwise(default)
    return texts.select(pick("layout", ["square", "dynamic"], "dynamic").alias("layout"), pick("sort", ["name", "date", "rating", "pick"], "name").alias("sort"), pick("format", ["all", "raw", "standard"], "all").alias("format"), F.when(s["thumbSize"].between(120, 320), s["thumbSize"]).otherwise(200.0).alias("thumb_size"))


def write_catalog(root: str, metadata: DataFrame, album_entries: DataFrame, archive: DataFrame, path: str) -> None:
    """A library's tables as one catalog document. A document is one value by its format, so its parts are gathered here."""
    spark = metadata.sparkSession
    m = metadata.agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("pick", "rating", F.col("color_label").alias("colorLabel"), F.col("updated_at").alias("updatedAt"))))).alias("entries"))
    albums = album_entries.groupBy("album_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry_id"))), lambda x: x["entry_id"]).alias("entryIds"))
    a = albums.agg(F.collect_list(F.struct(F.col("album_id").cast("string").alias("id"), F.concat(F.lit("Album "), F.col("album_id").cast("string")).alias("name"), "entryIds")).alias("albums"))
    r = archive.agg(F.collect_list("id").alias("archivedEntryIds"))
    base = spark.range(1).select(F.lit(2).alias("version"), F.lit(root).alias("rootPath"))
    base.join(F.broadcast(m)).join(F.broadcast(a)).join(F.broadcast(r)).coalesce(1).write.mode("overwrite").json(path)
