"""Near-duplicate groups by SimHash fingerprints and a binary-trie self-join.

Documents with equal fingerprints are collapsed first. Two fingerprints at ``bits`` or fewer differing
bits agree on one of ``bits + 1`` blocks, so each fingerprint enters one trie per block, rotated so that
the block comes first, and the tries are shuffled by that block. Within a trie, pairs of nodes are
traversed together: each pair carries the differing bits so far and goes when they exceed the budget.
A bucket with more than ``hot`` fingerprints is dealt again by the blocks of the bits that remain, by the
same argument. A task returns a spanning forest of its links, never all pairs, and the forests' components
are found by :mod:`silverframe.llm.components`.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like
any other; a null doc_id keeps its row, with the group's least other id (null if there is none); repeated
rows each keep a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm.common import by_bytes, drop_table, materialize, table_path
from silverframe.llm.components import connected_components
from silverframe.llm.near_copies import near_copy_links, numbered_in, piece_sketches

LEAF_PAIRS, TOGETHER = 64, 200_000


def fingerprint_hashes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash of each document from the hashes of its shingles, laid end to end."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    if not len(some):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones > sizes[some, None], axis=1).view(">u8").ravel()
    return out


def piece_fingerprints(piece: pa.RecordBatch, shingle: int, seed: int) -> pa.Array:
    """The fingerprint of each text of a batch, as a signed long."""
    from xxhash import xxh64_intdigest

    digest = partial(xxh64_intdigest, seed=seed)
    hashes, sizes = [], []
    for raw in piece.column("text").cast(pa.binary()).to_pylist():
        words = (raw or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] if words else ()
        found = np.fromiter(map(digest, grams), np.uint64)
        hashes.append(found)
        sizes.append(len(found))
    return pa.array(fingerprint_hashes(np.concatenate(hashes), np.array(sizes)).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def run(batches):
        for batch in batches:
            for piece in by_bytes(batch, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece_fingerprints(piece, shingle, seed)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def drawn(plain: DataFrame, shingle: int, seed: int, near: int = 5) -> DataFrame:
    """Fingerprints (as node) and MinHash sketches of ``near``-word shingles, in one reading of the texts. plain: _row, doc_id, text."""

    def run(batches):
        for batch in batches:
            for piece in by_bytes(batch, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([piece.column("_row"), piece.column("doc_id"), piece_fingerprints(piece, shingle, seed), *piece_sketches(piece, near)], ["_row", "doc_id", "node", "same", "bands"])

    return plain.select("_row", "doc_id", "text").mapInArrow(run, "_row long, doc_id long, node long, same long, bands array<long>")


class Forest:
    """Least-index labels of linked rows, folded in block by block."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.label, high, low)
            while not np.array_equal(self.label, up := self.label[self.label]):
                self.label = up


def trie_links(values: np.ndarray, bounds: np.ndarray, budget: int, forest: Forest) -> None:
    """Link rows within ``budget`` differing bits. values: sorted in each bucket [bounds[k], bounds[k+1])."""
    ones: dict[int, np.ndarray] = {}

    def count(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        return ones[depth]

    lo, hi = bounds[:-1], bounds[1:]
    keep = hi - lo > 1
    stack = [(0, np.stack([lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(keep.sum(), np.int64)], 1))]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > 100_000:
            stack += [(depth, pairs[:100_000]), (depth, pairs[100_000:])]
            continue
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        leaf = (size <= LEAF_PAIRS) | (depth == 64)
        small = pairs[leaf]
        for at in range(0, len(small), 50_000):
            compare(values, small[at : at + 50_000], budget, forest)
        pairs = pairs[~leaf]
        if not len(pairs):
            continue
        c = count(depth)
        a, b, x, y, err = pairs.T
        am, ym = b - (c[b] - c[a]), y - (c[y] - c[x])
        same = (a == x) & (b == y)
        children = [(a, am, x, ym, err), (am, b, ym, y, err), (a, am, ym, y, err + 1)]
        cross = ~same
        children.append((am[cross], b[cross], x[cross], ym[cross], err[cross] + 1))
        nxt = np.concatenate([np.stack(k, 1) for k in children])
        own = (nxt[:, 0] == nxt[:, 2]) & (nxt[:, 1] == nxt[:, 3])
        nxt = nxt[(nxt[:, 1] > nxt[:, 0]) & (nxt[:, 3] > nxt[:, 2]) & (nxt[:, 4] <= budget) & (~own | (nxt[:, 1] - nxt[:, 0] > 1))]
        if len(nxt):
            stack.append((depth + 1, nxt))


def compare(values: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    """Verify the rows of small node pairs one by one."""
    n, m = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    total = n * m
    which = np.repeat(np.arange(len(pairs)), total)
    k = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
    i, j = pairs[which, 0] + k // m[which], pairs[which, 2] + k % m[which]
    near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
    forest.link(i[near], j[near])


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return x if by % 64 == 0 else (x << np.uint64(by % 64)) | (x >> np.uint64(64 - by % 64))


def _blocks(width: int, parts: int, start: int = 0) -> list[tuple[int, int]]:
    """(first bit, length) of ``parts`` blocks over ``width`` bits."""
    edges = [start + width * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _field(col, first: int, length: int):
    return F.shiftrightunsigned(col, 64 - first - length).bitwiseAND(F.lit((1 << length) - 1))


def near_links(distinct: DataFrame, bits: int = 3, hot: int = 20_000) -> DataFrame:
    """A spanning forest (u, v) of the fingerprints (column fp, distinct) that are within ``bits`` bits."""
    blocks = _blocks(64, bits + 1)
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("b"), _field(F.col("fp"), *block).alias("v")) for k, block in enumerate(blocks)))).alias("k")).select("fp", "k.b", "k.v")
    crowded = dealt.groupBy("b", "v").count().where(F.col("count") > hot).select("b", "v", F.lit(True).alias("crowded"))
    marked = dealt.join(crowded, ["b", "v"], "left")
    again = []
    for k, (first, length) in enumerate(blocks):
        rest = [(a, n) for a, n in _blocks(64, 4 * (bits + 1)) if not first <= a < first + length]
        groups = [rest[i :: bits + 1] for i in range(bits + 1)]
        sub = F.array(*(F.struct(F.lit(g + 1).alias("s"), sum((_field(F.col("fp"), *f) * F.lit(1 << 16 * i) for i, f in enumerate(fields[1:], 1)), _field(F.col("fp"), *fields[0])).alias("w")) for g, fields in enumerate(groups)))
        again.append(F.when((F.col("b") == k) & F.col("crowded"), sub))
    none = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("w")))
    keyed = marked.select("fp", "b", "v", F.explode(F.coalesce(*again, none)).alias("k")).select("fp", "b", "v", "k.s", "k.w")

    def forest_links(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        fp, b, v, s, w = (t.column(i).to_numpy() for i in range(5))
        values = fp.view(np.uint64)
        for k, (first, _) in enumerate(blocks):
            values = np.where(b == k, _rotate(fp.view(np.uint64), first), values)
        new = np.ones(len(fp), bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1]) | (w[1:] != w[:-1])
        bounds = np.append(np.flatnonzero(new), len(fp))
        within = np.lexsort((values, np.cumsum(new)))
        values, fp = values[within], fp[within]
        forest = Forest(len(fp))
        trie_links(values, bounds, bits, forest)
        child = np.flatnonzero(forest.label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[forest.label[child]])], ["u", "v"])

    def run(batches):
        """Buckets come one after another; whole ones are worked off as soon as ``TOGETHER`` rows are there."""
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < TOGETHER:
                continue
            b, v, s, w = (batch.column(i).to_numpy() for i in range(1, 5))
            last = np.flatnonzero((b != b[-1]) | (v != v[-1]) | (s != s[-1]) | (w != w[-1]))
            if len(last):  # the last bucket may go on
                held[-1] = batch.slice(0, int(last[-1]) + 1)
                yield forest_links(held)
                held = [batch.slice(int(last[-1]) + 1)]
                size = held[0].num_rows
        if held:
            yield forest_links(held)

    return keyed.repartition("b", "v", "s", "w").sortWithinPartitions("b", "v", "s", "w").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links of at most ``bits`` bits)."""
    prints = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    roots = connected_components(near_links(distinct.select("fp"), bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-groups")
    drop_table(docs.sparkSession, table_path(distinct))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, bits: int = 3, shingle: int = 3, seed: int = 42, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when each near-duplicate group keeps one: that with the least doc_id.

    Rows are linked by fingerprints within ``bits`` bits and by five-word shingles with a Jaccard similarity of at least ``similarity``. Columns stay as they are. Of rows with the same least doc_id one stays, and a group of rows without ids keeps one.
    """
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    plain = numbered.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = materialize(drawn(plain, shingle, seed), "fingerprints")
    links = near_links(prints.select(F.col("node").alias("fp")).distinct(), bits).unionByName(near_copy_links(prints, plain, similarity))
    roots = connected_components(links)
    grouped = prints.select("_row", F.col("doc_id").alias("id"), "node").join(roots, "node", "left").select("_row", "id", F.coalesce("root", "node").alias("root"))
    kept = grouped.groupBy("root").agg(F.min_by("_row", F.struct(F.col("id").isNull(), "id", "_row")).alias("_row"))
    return numbered_in(numbered, row, kept.select("_row")).select(*docs.columns)
