"""Export planning: target names, statuses, overwrite guards, formats."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Formats, their extensions and whether they have lossy quality, lossless mode and bit depths.
FORMATS = [("jpeg", "jpg", True, False, 8), ("png", "png", False, True, 16), ("webp", "webp", True, True, 8), ("avif", "avif", True, True, 12), ("tiff", "tif", False, True, 16)]
MAX_NAMES = 999


def formats(spark) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, extension string, has_quality boolean, has_lossless boolean, max_bits int")


def export_names(jobs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Target names of jobs (job, base, suffix, extension), claimed in the order of ``job``: a name that is taken, by a job or by
    a file of ``existing`` (name, with its extension), gets ``-2`` and on up to the first free number; null past ``-999``.

    Only names that agree but for numbers at their ends can clash, so the claims of each such family are folded
    on their own, as sorted partitions stream by; what is held is the names that one family has taken.
    """
    base = F.concat("base", F.coalesce("suffix", F.lit("")))
    rows = jobs.select("job", base.alias("name"), "extension")
    if existing is not None:
        ext = F.substring_index("name", ".", -1)
        there = existing.select(F.lit(None).cast(rows.schema["job"].dataType).alias("job"), F.expr("left(name, greatest(length(name) - length(substring_index(name, '.', -1)) - 1, 0))").alias("name"), ext.alias("extension"))
        rows = rows.unionByName(there)
    family = F.regexp_replace("name", r"(-[0-9]+)+$", "")
    kind = rows.schema["job"].dataType

    def claim(batches):
        current, taken, tried = None, set(), {}
        for batch in batches:
            found = []
            for job, name, extension, root in zip(*(batch.column(c).to_pylist() for c in ("job", "name", "extension", "family")), strict=True):
                if (root, extension) != current:
                    current, taken, tried = (root, extension), set(), {}
                if job is None:
                    taken.add(name)
                    continue
                k = tried.get(name, 1)  # lower numbers stay taken
                while k <= MAX_NAMES and (name if k == 1 else f"{name}-{k}") in taken:
                    k += 1
                tried[name] = k
                target = name if k == 1 else f"{name}-{k}"
                taken.add(target)
                found.append((job, f"{target}.{extension}" if k <= MAX_NAMES else None))
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in found], batch.schema.field("job").type), pa.array([n for _, n in found], pa.string())], ["job", "output_name"])

    placed = rows.withColumn("family", family).repartition("family", "extension").sortWithinPartitions("family", "extension", F.col("job").asc_nulls_first())
    return placed.mapInArrow(claim, StructType([StructField("job", kind), StructField("output_name", StringType())]))


def export_status(items: DataFrame) -> DataFrame:
    """Status of items (failed, exists, policy, diagnostics): error, skipped, warning or success."""
    status = F.when(F.col("failed"), "error").when(F.col("exists") & (F.col("policy") == "skip"), "skipped").when(F.col("diagnostics") > 0, "warning").otherwise("success")
    return items.withColumn("status", status)


def overwrites_source(targets: DataFrame, sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """Targets that would overwrite a source: the same path, real path, file id or folder and name.

    Four equi-joins instead of one condition with or: targets stream past the guarded keys, which are hashed, so a task
    sorts and holds none of its targets. A source that is an earlier output of ours is allowed, unless it is selected now.
    """
    allowed = outputs.select("path").withColumn("ours", F.lit(True))
    guarded = sources.join(allowed, "path", "left").where(F.col("ours").isNull() | F.col("selected"))
    keys = [["path"], ["real_path"], ["device", "inode"], ["folder", "name"]]
    hits = None
    for k in keys:
        part = targets.join(guarded.select(*k).distinct().hint("shuffle_hash"), k, "left_semi").select("target")
        hits = part if hits is None else hits.unionByName(part)
    return hits.distinct()


def provenance_tail(records: DataFrame, n: int = 4096) -> DataFrame:
    """The last ``n`` valid records (pos, path, device, inode), the last of each path."""
    tail = records.where(F.length(F.trim("path")) > 0).orderBy(F.desc("pos")).limit(n)
    return tail.groupBy("path").agg(F.max_by(F.struct("device", "inode"), "pos").alias("r"), F.max("pos").alias("pos")).select("path", "pos", "r.device", "r.inode")


def export_metadata(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of entries at export: where there is none, defaults whose clock is the file's."""
    rows = entries.select("id", "last_modified").join(metadata.select("id", "pick", "rating", "color_label", "updated_at"), "id", "left")
    return rows.select("id", F.coalesce("pick", F.lit("none")).alias("pick"), F.coalesce("rating", F.lit(0)).alias("rating"), "color_label", F.coalesce("updated_at", "last_modified").alias("updated_at"))


def selected_sources(requested: DataFrame, approved: DataFrame) -> DataFrame:
    """Requested sources (path) with an error for those that aren't inside the library or not in its approved scan (path)."""
    outside = F.col("path").rlike(r"^([/\\]|[A-Za-z]:)|(^|[/\\])\.\.([/\\]|$)")
    scan = approved.select("path").distinct().withColumn("known", F.lit(True))
    rows = requested.select("path").distinct().join(scan, "path", "left")
    return rows.select("path", F.when(F.col("path").isNull() | outside, "outside the library").when(F.col("known").isNull(), "not in the approved scan").alias("error"))
