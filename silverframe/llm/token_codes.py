"""Token ids in directly addressable codes: any id can be read without decoding those before it.

File format. Documents are range-partitioned by ``doc_id`` and sorted, so partitions in order of their
number hold the ids in ascending order of ``doc_id``. Each row of the Parquet container is one segment
of about ``segment_ids`` ids, with the image below in ``payload``. The container is not compressed and has one
segment a row group, so a reader of one id fetches the segment that holds it and no other, and unpacks nothing:

    "DAC1", then little-endian unsigned 32-bit: number of ids, of levels, of documents
    document starts within the segment, 32 bits each
    for each level: its number of chunks (32 bits), the chunks (8 bits of each id that reaches the
    level, lowest first), and but for the last level a bitmap (bit set: the id goes on in the next
    level) and its rank directory (32 bits for every 512 bits: set bits before them)

To read id ``i``: take its chunk; if its bit is set, ``rank`` (directory entry plus the set bits of one
block) is its place in the next level. :func:`tokens_at` reads ids by their number in the corpus.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverframe.llm.common import batch_texts, by_bytes, write_table
from silverframe.llm.packing import partition_offsets
from silverframe.llm.tokens import encoder

BLOCK = 512
SEGMENT = "part int, segment int, part_start long, n_tokens long, doc_ids array<long>, payload binary"


def encode_segment(ids: np.ndarray, doc_starts: np.ndarray) -> bytes:
    """The image of one segment."""
    out, rest, levels = [], ids.astype(np.uint32), 0
    while True:
        levels += 1
        out += [struct.pack("<I", len(rest)), (rest & 255).astype(np.uint8).tobytes()]
        more = rest > 255
        if not more.any():
            break
        bits = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
        out += [bits.tobytes(), (np.cumsum(counts, dtype=np.uint32) - counts.astype(np.uint32)).astype("<u4").tobytes()]
        rest = rest[more] >> np.uint32(8)
    return b"".join([b"DAC1", struct.pack("<III", len(ids), levels, len(doc_starts)), doc_starts.astype("<u4").tobytes(), *out])


class SegmentReader:
    """Random access to a segment's ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.n, levels, docs = struct.unpack_from("<III", payload, 4)
        at = 16
        self.doc_starts = np.frombuffer(payload, "<u4", docs, at)
        at += 4 * docs
        self.levels = []
        for k in range(levels):
            (n,) = struct.unpack_from("<I", payload, at)
            chunks = np.frombuffer(payload, np.uint8, n, at + 4)
            at += 4 + n
            bits = ranks = None
            if k < levels - 1:
                bits = np.frombuffer(payload, np.uint8, -(-n // 8), at)
                ranks = np.frombuffer(payload, "<u4", -(-n // BLOCK), at + len(bits))
                at += len(bits) + 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        _, bits, ranks = self.levels[level]
        if i == len(self.levels[level][0]):
            return len(self.levels[level + 1][0])
        block = i // BLOCK
        before = bits[block * BLOCK // 8 : i // 8]
        tail = int(bits[i // 8]) & ((1 << i % 8) - 1)
        return int(ranks[block]) + int(np.bitwise_count(before).sum()) + tail.bit_count()

    def access(self, i: int) -> int:
        """Id number ``i`` by one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[i]) << shift
            if bits is None or not (int(bits[i // 8]) >> (i % 8)) & 1:
                return value
            i, level, shift = self._rank(level, i), level + 1, shift + 8

    def decode(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids ``a`` to ``b`` (all by default), level by level."""
        b, value, where = self.n if b is None else b, None, None
        lo, hi = a, b
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            if value is None:
                value, where = part, np.arange(hi - lo)
            else:
                value[where] |= part
            if bits is None or lo == hi:
                break
            more = np.unpackbits(bits[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            where = where[more]
            lo, hi = self._rank(level, lo), self._rank(level, hi)
        return value if value is not None else np.empty(0, np.uint32)


def write_codes(docs: DataFrame, tokenizer_path: str, end_id: int = 0, segment_ids: int = 1 << 20) -> str:
    """Encode documents (doc_id, text) and write their ids in ascending order of doc_id; returns the folder.

    Null texts count as empty (the end id alone), null ids come first, rows with the same id follow each
    other in the order of a hash of their texts, other columns are ignored. A segment closes at ``segment_ids`` ids or more.
    """

    def run(batches):
        enc, part, at, number = encoder(tokenizer_path), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        names: list[int | None] = []
        size = 0

        def close():
            sizes = np.array([len(x) // 4 for x in held], np.int64)
            image = encode_segment(np.frombuffer(b"".join(held), "<u4"), np.cumsum(sizes) - sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([at]), pa.array([int(sizes.sum())]), pa.array([names], pa.list_(pa.int64())), pa.array([image], pa.binary())],
                ["part", "segment", "part_start", "n_tokens", "doc_ids", "payload"],
            )

        for batch in batches:
            for piece in by_bytes(batch):
                for doc, text in zip(piece.column("doc_id").to_pylist(), batch_texts(piece), strict=True):
                    held.append(enc.encode(text) + end)
                    names.append(doc)
                    size += len(held[-1]) // 4
                    if size >= segment_ids:
                        yield close()
                        at, number, size = at + size, number + 1, 0
                        held.clear()
                        names.clear()
        if held:
            yield close()

    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions(*order)
    # a segment exceeds the row group's size, and pages aren't compressed
    return write_table(ordered.mapInArrow(run, SEGMENT), "token-codes", {"compression": "none", "parquet.block.size": str(segment_ids), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"})


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of codes: doc_id, start (ids before it in the corpus), n_tokens, ids (32-bit little-endian)."""
    segments = spark.read.schema(SEGMENT).parquet(path)
    base = spark.sparkContext.broadcast(partition_offsets(segments))  # a number per written partition

    def run(batches):
        for batch in batches:
            for part, at, names, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "doc_ids", "payload")), strict=True):
                seg = SegmentReader(payload)
                ids, starts = seg.decode(), seg.doc_starts.astype(np.int64)
                ends = np.append(starts[1:], seg.n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(base.value[part] + at + starts), pa.array(ends - starts), pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.select("part", "part_start", "doc_ids", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """place and id of some numbers of ids in the corpus, read by rank from the segments that hold them.

    The heads of all segments are looked at, payloads only of row groups that the filter on part and segment leaves.
    Repeated places give one row, places beyond the corpus none.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    begins = sorted((at, part) for part, at in partition_offsets(segments).items())
    first = [at for at, _ in begins]
    inside = [(p, begins[k][1], p - first[k]) for p in sorted(set(places)) if p >= 0 and (k := bisect_right(first, p) - 1) >= 0]
    asked = spark.createDataFrame(inside, "place long, part int, at long")
    heads = segments.select("part", "segment", "part_start", "n_tokens")
    hit = asked.join(heads, (asked.part == heads.part) & (F.col("at") >= F.col("part_start")) & (F.col("at") < F.col("part_start") + F.col("n_tokens")))
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for part, segment, place, at in hit.select(heads.part, "segment", "place", F.col("at") - F.col("part_start")).collect():  # a row for each place
        wanted.setdefault((part, segment), []).append((place, at))

    def run(batches):
        for batch in batches:
            for part, segment, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "segment", "payload")), strict=True):
                reader, asked = SegmentReader(payload), wanted.get((part, segment), [])
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in asked], pa.int64()), pa.array([reader.access(i) for _, i in asked], pa.int64())], ["place", "id"])

    pick = reduce(or_, ((F.col("part") == p) & (F.col("segment") == s) for p, s in wanted), F.lit(False))
    return segments.where(pick).select("part", "segment", "payload").mapInArrow(run, "place long, id long")


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
