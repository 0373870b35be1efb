"""Ordered scans with carried state: row packing, navigation, ranges, ranked lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def square_rows(rows: DataFrame, width: float, target: float, gap: float) -> DataFrame:
    """row, col and cell size of entries at ``pos``, in as many columns of about ``target`` as fit."""
    columns = max(1, int((width + gap) // (target + gap)))
    cell = int((width - (columns - 1) * gap) / columns + 0.5)
    return rows.select("id", "pos", F.floor(F.col("pos") / columns).cast("long").alias("row"), (F.col("pos") % columns).cast("long").alias("col"), F.lit(cell).alias("cell"))


def dynamic_rows(rows: DataFrame, key: str, width: float, height: float, gap: float) -> DataFrame:
    """``row`` of each tile (key, pos, id, aspect): a row closes when the next tile would overflow it at ``height``; a column of that name gives way.

    The break depends on all tiles before, so each key is folded in order; tiles stream through sorted
    partitions, and only the sum and count of the open row are held.
    """

    def run(batches):
        last, total, count, row = object(), 0.0, 0, 0
        for batch in batches:
            out = []
            for k, aspect in zip(batch.column(key).to_pylist(), batch.column("aspect").to_pylist(), strict=True):
                if k != last:
                    last, total, count, row = k, 0.0, 0, 0
                if count and (total + aspect) * height + count * gap > width:
                    total, count, row = 0.0, 0, row + 1
                total, count = total + aspect, count + 1
                out.append(row)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "row"])

    tiles = rows.drop("row").withColumn("aspect", F.coalesce("aspect", F.lit(1.0))).repartition(key).sortWithinPartitions(key, "pos")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.schema.fields)
    return tiles.mapInArrow(run, f"{names}, row long")


def justify_rows(tiles: DataFrame, key: str, width: float, gap: float) -> DataFrame:
    """Tile width and height in rows filled to ``width``: whole numbers, the rest added to a row's last tile."""
    row = Window.partitionBy(key, "row")
    after = row.orderBy("pos")
    n, aspects = F.count("*").over(row), F.sum("aspect").over(row)
    high = (F.lit(width) - (n - 1) * gap) / aspects
    out = tiles.withColumn("height", high).withColumn("tile", F.floor(F.col("aspect") * F.col("height") + 0.5))
    used = F.sum("tile").over(row) + (n - 1) * gap
    last = F.lead("pos").over(after).isNull()
    return out.select(key, "row", "pos", "id", F.floor(F.col("height") + 0.5).cast("long").alias("height"), F.when(last, F.col("tile") + F.floor(width - used + 0.5)).otherwise(F.col("tile")).cast("long").alias("width"))


def navigate(grid: DataFrame, direction: str) -> DataFrame:
    """The neighbour of each cell of ``grid`` (id, pos, row, col): left and right run on over rows, up and down keep the column or the row's end; edges stay."""
    if direction in ("left", "right"):
        step = -1 if direction == "left" else 1
        other = grid.select((F.col("pos") - step).alias("pos"), F.col("id").alias("target"))
        return grid.join(other, "pos", "left").select("id", F.coalesce("target", "id").alias("target"))
    step = -1 if direction == "up" else 1
    ends = grid.groupBy("row").agg(F.max("col").alias("end")).withColumn("row", F.col("row") - step)
    aim = grid.join(ends, "row", "left").select("id", (F.col("row") + step).alias("row"), F.least("col", "end").alias("col"))
    return aim.join(grid.select("row", "col", F.col("id").alias("target")), ["row", "col"], "left").select("id", F.coalesce("target", "id").alias("target"))


def range_select(rows: DataFrame, anchor: object, target: object) -> DataFrame:
    """Entries between two ids in the order of ``pos``, both included; the target alone if the anchor isn't there."""
    ends = rows.where(F.col("id").isin(anchor, target)).agg(F.max(F.when(F.col("id") == anchor, F.col("pos"))).alias("a"), F.max(F.when(F.col("id") == target, F.col("pos"))).alias("b"))
    bounds = ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("a").isNull().alias("alone"), "b")
    inside = F.when(F.col("alone"), F.col("pos") == F.col("b")).otherwise(F.col("pos").between(F.col("lo"), F.col("hi")))
    return rows.join(F.broadcast(bounds), inside).select("id", "pos")  # one row of bounds


def neighbours(rows: DataFrame, key: str) -> DataFrame:
    """Previous and next id of each entry in its key's order of ``pos``."""
    w = Window.partitionBy(key).orderBy("pos")
    return rows.select(key, "pos", "id", F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"))


def ranked_visible(rows: DataFrame, centre: float, selected: Column) -> DataFrame:
    """Ids by distance of their row's centre from the viewport's, selected ones first, each id once at its best place."""
    distance = F.abs(F.col("start") + F.col("row_height") / 2 - centre)
    once = rows.withColumn("distance", distance).groupBy("id").agg(F.min(F.struct("distance", "pos")).alias("best"))
    return once.select("id", (~F.coalesce(selected, F.lit(False))).alias("later"), "best.distance", "best.pos")


def restore_selection(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """The selection (id, ord) after a rescan: those of ``previous`` (id, ord) still in ``rows``, else the first row alone."""
    kept = previous.join(rows.select("id"), "id", "left_semi").select("id", "ord")
    first = rows.orderBy("pos").limit(1).select("id", F.lit(0).cast("long").alias("ord"))
    none = kept.limit(1).agg(F.count("*").alias("n"))
    return kept.unionByName(first.join(F.broadcast(none)).where("n = 0").select("id", "ord"))  # one row of a count
