"""Links between near copies: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

Candidates share a band of a MinHash sketch: with 20 bands of 4, a pair at 0.8 is missed with probability
3 in 100,000, one above it more rarely. Every candidate link is verified on the whole sets, as 64-bit shingle hashes.
Equal sets are collapsed first, and bands that hold the same rows are looked at once. A bucket is streamed in
order of ids and kept as stars: a head, and rows similar to it with their distance from it. A row is compared with each head.
One minus the Jaccard similarity is a metric, so a row further from a head than twice the greatest distance
allowed is similar to none of its star, and else only to rows that lie far enough from the head: these are
compared too, until one is similar. So a large group costs about one comparison a row, and any two similar rows of a bucket end up
linked, directly or through others. A task holds the sets of one bucket.

Defined cases: texts without words have no shingles and no links; a text with fewer words than a shingle has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm import text_hash
from silverframe.llm.common import by_bytes, materialize, small_batches

BANDS, WIDTH = 20, 4
_RNG = np.random.default_rng(20240601)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the shingles with their numbers, and the hash of each band, of texts with at least one shingle."""
    starts = np.cumsum(sizes) - sizes
    same = text_hash.mix(np.add.reduceat(text_hash.mix(hashes ^ _FLIP[0]), starts) + sizes.astype(np.uint64))
    bands = np.zeros((len(sizes), BANDS), np.uint64)
    for k in range(BANDS * WIDTH):
        least = np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], starts)
        bands[:, k // WIDTH] = text_hash.mix(bands[:, k // WIDTH] * _TIMES[0] + least)
    return same, bands


def _texts(piece: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in piece.column("text").cast(pa.binary()).to_pylist()]


def piece_sketches(piece: pa.RecordBatch, shingle: int) -> list[pa.Array]:
    """same and bands of each text of a batch, null where it has no words."""
    hashes, sizes = text_hash.shingles(_texts(piece), shingle)
    some = sizes > 0
    if not some.any():
        return [pa.nulls(len(sizes), pa.int64()), pa.nulls(len(sizes), pa.list_(pa.int64()))]
    same, bands = sketch(hashes, sizes[some])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(same) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
    at = pa.array(np.cumsum(some) - 1, mask=~some)
    return [pa.array(same.view(np.int64)).take(at), lists.take(at)]


def numbered_in(rows: DataFrame, row: str, wanted: DataFrame) -> DataFrame:
    """The rows whose number (column ``row``, from 0) is among those ``wanted`` (_row).

    The numbers are broadcast as bitmaps, a bit for each row in blocks of 32,768, so that wide rows are filtered where they
    are and not shuffled.
    """
    blocks = wanted.select(F.shiftright("_row", 15).alias("block"), F.col("_row").bitwiseAND(F.lit(32767)).alias("at")).repartition("block")
    blocks = blocks.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    at = rows[row].bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(blocks["bits"], F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(blocks), (F.shiftright(rows[row], 15) == blocks["block"]) & held, "left_semi")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """_row and the sorted distinct shingle hashes of each row (_row, text), as bytes."""

    def run(batches):
        for batch in batches:
            for piece in by_bytes(batch, limit=1 << 20):
                hashes, sizes = text_hash.shingles(_texts(piece), shingle)
                parts = np.split(hashes, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays([piece.column("_row"), pa.array([np.unique(p).tobytes() for p in parts], pa.binary())], ["_row", "set"])

    return rows.select("_row", "text").mapInArrow(run, "_row long, set binary")


def distance(x: np.ndarray, y: np.ndarray, most: float) -> float:
    """One minus the Jaccard similarity of two sorted sets, or 1 where their sizes alone put it above ``most``."""
    small, large = sorted((len(x), len(y)))
    if small < (1 - most) * large - 1e-9:
        return 1.0
    both = np.sort(np.concatenate([x, y]))
    shared = int((both[1:] == both[:-1]).sum())
    return 1 - shared / (len(x) + len(y) - shared)


class Bucket:
    """The rows of a bucket seen so far, as stars: a head and the rows within ``reach`` of it."""

    def __init__(self, reach: float):
        self.reach = reach + 1e-9
        self.stars: list[tuple[int, np.ndarray, list[tuple[float, int, np.ndarray]]]] = []

    def links(self, node: int, own: np.ndarray) -> list[int]:
        """The nodes that a row is linked with, one of each star that has any; the row is kept."""
        found, home = [], None
        for head, other, members in self.stars:
            d = distance(own, other, 2 * self.reach)
            if d <= self.reach:
                found.append(head)
                home = home or (members, d)
            elif d <= 2 * self.reach:
                near = (n for far, n, x in members if far >= d - self.reach - 1e-9 and distance(own, x, self.reach) <= self.reach)
                found += [n for n in [next(near, None)] if n is not None]
        if home:
            home[0].append((home[1], node, own))
        else:
            self.stars.append((node, own, []))
        return found


def near_copy_links(drawn: DataFrame, rows: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """Links (u, v) of the nodes of near copies; links of a node with itself are left out.

    drawn: _row, doc_id, a node, and same and bands of :func:`piece_sketches`; rows: _row (a number from 0) and text.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "_row")
    classes = materialize(drawn.where("same is not null").groupBy("same", "node").agg(F.min(order).alias("at"), F.first("bands").alias("bands")), "sketch-classes")
    equal = classes.join(classes.groupBy("same").agg(F.min("node").alias("v")), "same").where("node <> v").select(F.col("node").alias("u"), "v")
    dealt = classes.select("node", "at", F.posexplode("bands").alias("b", "v"))
    buckets = dealt.groupBy("b", "v").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("at._row")).alias("who")).where("n > 1")
    once = buckets.groupBy("n", "who").agg(F.min(F.struct("b", "v")).alias("k")).select("k.b", "k.v")
    members = materialize(dealt.join(once, ["b", "v"]), "sketch-buckets")
    wanted = members.select(F.col("at._row").alias("_row")).distinct()
    sets = materialize(shingle_sets(numbered_in(rows.select("_row", "text"), "_row", wanted), shingle), "shingle-sets")
    streams = members.withColumn("_row", F.col("at._row")).join(sets, "_row").select("b", "v", "at", "node", "set").repartition("b", "v").sortWithinPartitions("b", "v", "at")

    def run(batches):
        key, bucket = None, Bucket(1 - similarity)
        for batch in batches:
            links = []
            for b, v, node, raw in zip(*(batch.column(name) for name in ("b", "v", "node", "set")), strict=True):
                if (b.as_py(), v.as_py()) != key:
                    key, bucket = (b.as_py(), v.as_py()), Bucket(1 - similarity)
                mine = node.as_py()
                links += [(mine, n) for n in bucket.links(mine, np.frombuffer(raw.as_buffer(), np.uint64).copy()) if n != mine]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["u", "v"])

    with small_batches(rows.sparkSession, 256):  # a row has a whole set of shingles
        links = materialize(streams.mapInArrow(run, "u long, v long"), "near-copy-links")
    return links.unionByName(equal)
