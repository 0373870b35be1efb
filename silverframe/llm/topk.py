"""Exact top-k by distributed histogram selection.

Every query is scored against every row: the query vectors go out in waves of bounded size, and each task multiplies a
wave, block by block, with its own vectors. The k-th score of each query is located by rounds of histograms: a round
counts the scores of each query in equal bins of its current range, the counts are summed over tasks, and the range
shrinks to the bin that holds the k-th score, until it is one integer. A last scan keeps the scores above it
and, in each task, the k least ids at it, which settles ties exactly however many rows share a score.

A round is one job over all queries of a wave, and a wave's results are written to the shared folder, so neither the
plan nor the driver's state grows with the number of waves.

Components are floor(scale * x) as exact integers of any size. A score beyond the range of a long counts as the end of that range.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverframe.llm.common import keep_until_exit, materialize, shared_dir

BINS, BLOCK = 256, 1024
LEAST, MOST = -(2**63) + 1, 2**63 - 1
FOUND = "q long, query_id long, query_copy long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors as doubles, without those that are null, have no id or hold null or non-finite components."""
    x = F.transform(F.col("embedding"), lambda c: c.cast("double"))
    inf = F.lit(float("inf"))
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < inf), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("x").isNotNull() & fine & F.col("vec_id").isNotNull())


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: as doubles while all are below 2**53, as Python integers beyond."""
    y = np.floor(x * scale)
    if np.abs(y).max(initial=0) < 2**53:
        return y
    exact = [int(v) * scale if abs(v) >= 2**53 else int(np.floor(v * scale)) for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, held within the range of a long."""
    bound = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < 2**53:
        return (left.astype(float) @ right.astype(float).T).astype(np.int64)
    if bound < 2**63:
        return left.astype(np.int64) @ right.astype(np.int64).T
    out = left.astype(object) @ right.astype(object).T
    return np.minimum(np.maximum(out, LEAST), MOST).astype(np.int64)


class Wave:
    """Query vectors of bounded size, the number of each one's own row, and the range that each k-th score is known to lie in."""

    def __init__(self, ids: list[int], copies: list[int], own: list[int], vectors: list[list[float]], scale: int):
        self.dim, self.scale = max(map(len, vectors)), scale
        self.ids, self.copies, self.own = (np.array(v, np.int64) for v in (ids, copies, own))
        x = np.zeros((len(ids), self.dim))
        for row, v in zip(x, vectors, strict=True):
            row[: len(v)] = v
        self.x = scaled(x, scale)
        self.low = self.high = None

    def scores(self, batch: pa.RecordBatch):
        """(slice of queries, slice of rows, others, scores) of blocks of queries and rows; ``others`` is false at a query's own row.

        The batch's columns are row, x and any more; a shorter vector counts as padded with zeros.
        """
        numbers = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(1)
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        inside = place < self.dim
        rows = np.zeros((len(numbers), self.dim))
        rows[np.repeat(np.arange(len(numbers)), sizes)[inside], place[inside]] = flat[inside]
        rows = scaled(rows, self.scale)
        for a in range(0, len(numbers), 2 * BLOCK):
            part = slice(a, a + 2 * BLOCK)
            for q in range(0, len(self.ids), BLOCK):
                block = slice(q, q + BLOCK)
                yield block, part, numbers[None, part] != self.own[block, None], products(self.x[block], rows[part])


def _extremes(rows: DataFrame, wave) -> DataFrame:
    """Least and highest score of each query, and the number of its scores."""

    def run(batches):
        w = wave.value
        low, high, n = np.full(len(w.ids), MOST), np.full(len(w.ids), LEAST), np.zeros(len(w.ids), np.int64)
        for batch in batches:
            for at, _, other, s in w.scores(batch):
                low[at] = np.minimum(low[at], np.where(other, s, MOST).min(1))
                high[at] = np.maximum(high[at], np.where(other, s, LEAST).max(1))
                n[at] += other.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w.ids), dtype=np.int32)), pa.array(low), pa.array(high), pa.array(n)], ["q", "low", "high", "n"])

    return rows.select("row", "x").mapInArrow(run, "q int, low long, high long, n long").groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n"))


def _bin_width(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """ceil((high - low + 1) / BINS), where the difference may need all 64 bits."""
    return (high.astype(np.uint64) - low.astype(np.uint64)) // np.uint64(BINS) + np.uint64(1)


def _round(rows: DataFrame, wave) -> DataFrame:
    """Counts of each query's scores in the bins of its range: (q, bin, n)."""

    def run(batches):
        w = wave.value
        width = _bin_width(w.low, w.high)
        total = np.zeros((len(w.ids), BINS + 1), np.int64)
        for batch in batches:
            for at, _, other, s in w.scores(batch):
                low, high = w.low[at, None], w.high[at, None]
                inside = (s >= low) & (s <= high) & other
                bins = np.where(inside, ((s.astype(np.uint64) - low.astype(np.uint64)) // width[at, None]).astype(np.int64), BINS)
                place = np.arange(len(s))[:, None] * (BINS + 1)
                total[at] += np.bincount((bins + place).ravel(), minlength=len(s) * (BINS + 1)).reshape(len(s), -1)
        for first in range(0, len(total), BLOCK):
            part = total[first : first + BLOCK, :BINS]
            q, k = np.nonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array((first + q).astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(part[q, k])], ["q", "bin", "n"])

    return rows.select("row", "x").mapInArrow(run, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def _thresholds(rows: DataFrame, wave: Wave, k: int) -> np.ndarray:
    """The k-th score of each query of the wave; the least score where there are fewer."""
    spark = rows.sparkSession
    m = len(wave.ids)
    low, high, need = np.zeros(m, np.int64), np.full(m, -1, np.int64), np.zeros(m, np.int64)
    shared = spark.sparkContext.broadcast(wave)
    for q, a, b, n in _extremes(rows, shared).collect():  # a row for each query of the wave
        if n:
            low[q], high[q], need[q] = a, b, min(k, n)
    shared.unpersist()
    after = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows a query
    while (high > low).any():
        wave.low, wave.high = low, high
        shared = spark.sparkContext.broadcast(wave)
        state = spark.createDataFrame([(q, x) for q, x in enumerate(need.tolist())], "q int, need long")
        counts = _round(rows, shared).withColumn("above", F.coalesce(F.sum("n").over(after), F.lit(0)))
        hits = counts.join(F.broadcast(state), "q").where("above < need and above + n >= need").select("q", "bin", "above").collect()
        shared.unpersist()
        width = _bin_width(low, high)
        for q, b, above in hits:
            need[q] -= above
            first = int(low[q]) + b * int(width[q])
            low[q], high[q] = first, min(int(high[q]), first + int(width[q]) - 1)
    return low


def _best(rows: DataFrame, wave: Wave, at: np.ndarray, first: int, k: int) -> DataFrame:
    """In each task, the k best rows of each query from its k-th score: (q, query_id, query_copy, vec_id, score)."""
    shared = rows.sparkSession.sparkContext.broadcast((wave, at))

    def run(batches):
        w, least = shared.value
        out: list[tuple[np.ndarray, ...]] = []

        def best():
            q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((v, -s, q))
            q, v, s = q[order], v[order], s[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            return q[keep], v[keep], s[keep]

        held = 0
        for batch in batches:
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            for block, part, other, s in w.scores(batch):
                q, j = np.nonzero((s >= least[block, None]) & other)
                out.append((q + block.start, ids[part][j], s[q, j]))
                held += len(q)
                if held > 2 * k * len(w.ids) + 100_000:
                    out = [best()]
                    held = len(out[0][0])
        if out:
            q, v, s = best()
            yield pa.RecordBatch.from_arrays([pa.array(first + q), pa.array(w.ids[q]), pa.array(w.copies[q]), pa.array(v), pa.array(s)], ["q", "query_id", "query_copy", "vec_id", "score"])

    return rows.select("row", "x", "vec_id").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, queries: Column | DataFrame, k: int = 10, scale: int = 1024, wave_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score, query_copy: the ``k`` highest integer inner products of each query with all other rows.

    ``vectors`` has vec_id and embedding. ``queries`` is a condition on vec_id, and a query's own row is then no candidate for
    it; or a table of vec_id and embedding from elsewhere, for which all rows are candidates. Ties go to the smaller vec_id; a
    query with fewer other rows gets all. Rows are what is ranked: an id with several rows takes a rank for each, and each
    query row has its own ranks, told apart by ``query_copy``, its place (from 1) among the query rows of its id by vector.
    Vectors of unequal length count as padded with zeros, empty ones as zeros; no queries or no rows give an empty result.

    ``wave_bytes`` bounds what a task holds for a wave: its query vectors as wide as the widest, or its counts, or its finds.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")  # numbers stay as written
    asked = rows.where(queries) if isinstance(queries, Column) else usable(queries).withColumn("row", F.lit(-1).cast("long"))
    path = keep_until_exit(spark, f"{shared_dir(spark)}/silverframe/top-k-{uuid.uuid4().hex}")
    held: list[tuple[int, int, int, list[float]]] = []
    first = widest = copy = 0
    last = None

    def flush():
        wave = Wave(*map(list, zip(*held, strict=True)), scale)
        _best(rows, wave, _thresholds(rows, wave, k), first, k).write.mode("append").parquet(path)

    for r in asked.orderBy("vec_id", "x").toLocalIterator():
        copy = copy + 1 if r.vec_id == last else 1
        last, widest = r.vec_id, max(widest, len(r.x))
        if held and 8 * (len(held) + 1) * max(widest, BINS + 1, 6 * k) > wave_bytes:
            flush()
            first, widest, held = first + len(held), len(r.x), []
        held.append((r.vec_id, copy, r.row, list(r.x)))
    if not held:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, query_copy long")
    flush()
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")  # at most k rows of each task a query
    found = spark.read.schema(FOUND).parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_copy")
