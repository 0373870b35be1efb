"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum (combined before the shuffle) and a join on the same key, so a hub's
edges can be split by adaptive execution; no list of neighbours is ever gathered. Every round's edges
go to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm.common import drop_table, write_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) but the roots; root is the least node reachable.

    Null ends and loops are ignored; an empty table gives no rows. Raises if ``max_rounds`` isn't enough,
    which takes far more nodes than a table can hold.
    """
    spark = edges.sparkSession
    start = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    path = write_table(start.distinct(), "edges")
    schema, before = start.schema, None
    for _ in range(max_rounds):
        current = spark.read.schema(schema).parquet(path)
        now = _state(current)
        if now == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        if not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        after = write_table(_small_star(_large_star(current)), "edges")
        drop_table(spark, path)
        path = after
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
