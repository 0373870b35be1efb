"""Benchmark decontamination: short test items that occur inside long documents.

Items are partitioned by size (number of distinct word shingles, in powers of two), each partition with an index and bounds of
its own. An item's MinHash sketch holds its ``k`` least shingle hashes, with ``k`` one more than the shingles that an
item of the partition's largest size may lack at the threshold; so an item that a document contains always
has a hash of its sketch among the document's shingles, however long the document is. A document looks only into
the partitions whose smallest item it can contain. The pairs found are verified on the shingles themselves. Nothing is shuffled.

An item of fewer words than a shingle is one short shingle; it is looked up among the document's runs of as many words.

A block's items (at most ``block_bytes`` of text, one item at least) are what is broadcast. A benchmark
of any size is worked off in blocks, one scan each; with several blocks each scan's result is written to the shared folder and its
block released, so that one block is held at a time.

Defined cases: items without words are contained nowhere; null texts count as empty; null ids and repeated rows are kept, a
pair for each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm.common import by_bytes, materialize
from silverframe.llm.text_hash import shingle_strings, shingles

PAIRS = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


class SizeIndex:
    """Sketches of the items of one size partition: hash to items."""

    def __init__(self, members: list[tuple[int, np.ndarray]], threshold: float):
        sizes = [len(own) for _, own in members]
        largest = (1 << max(sizes).bit_length()) - 1  # of the partition
        k = int(np.floor((1 - threshold) * largest + 1e-9)) + 1
        self.least = int(np.ceil(threshold * min(sizes) - 1e-9))  # shingles that a document needs
        key = np.concatenate([own[:k] for _, own in members])
        owner = np.concatenate([np.full(min(k, len(own)), i) for i, own in members])
        order = np.argsort(key, kind="stable")
        self.owner = owner[order]
        self.key, self.first = np.unique(key[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))

    def candidates(self, hashes: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) whose sketch and shingles share a hash."""
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        hit = self.key[at] == hashes
        found = set(zip(text[hit].tolist(), at[hit].tolist(), strict=True))
        return {(d, int(i)) for d, k in found for i in self.owner[self.first[k] : self.last[k]]}


_LOW = (1 << 20) - 1


class ItemBlock:
    """Size partitions and shingles of a bounded block of items."""

    def __init__(self, rows: list[tuple[int | None, bytes]], n: int, threshold: float):
        self.threshold = threshold
        self.ids = [i for i, _ in rows]
        self.sets: list[frozenset] = []
        self.words = [min(n, len(t.split())) for _, t in rows]  # of the item's shingles
        parts: dict[tuple[int, int], list] = {}
        for i, (_, t) in enumerate(rows):
            self.sets.append(frozenset(shingle_strings(t, n)))
            own = np.unique(shingles([t], n)[0])
            if len(own):
                parts.setdefault((self.words[i], len(own).bit_length()), []).append((i, own))
        self.parts = {key: SizeIndex(members, threshold) for key, members in sorted(parts.items())}
        self.low = {}  # cheap first look at the low bits, for each length of shingles
        for (length, _), index in self.parts.items():
            seen = self.low.setdefault(length, np.zeros(_LOW + 1, bool))
            seen[(index.key & np.uint64(_LOW)).astype(np.int64)] = True

    def contained(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all items that a text contains."""
        pairs: set[tuple[int, int]] = set()
        for length, low in self.low.items():
            hashes, sizes = shingles(texts, length)
            maybe = np.flatnonzero(low[(hashes & np.uint64(_LOW)).astype(np.int64)])
            if not len(maybe):
                continue
            text, hashes = np.searchsorted(np.cumsum(sizes), maybe, side="right"), hashes[maybe]
            for (own, _), index in self.parts.items():
                if own == length:
                    enough = sizes[text] >= index.least
                    pairs |= index.candidates(hashes[enough], text[enough])
        out, seen, sets = [], -1, {}
        for d, i in sorted(pairs):
            if d != seen:
                seen, sets = d, {}
            length = self.words[i]
            if length not in sets:
                sets[length] = frozenset(shingle_strings(texts[d], length))
            shared = len(self.sets[i] & sets[length])
            if shared >= self.threshold * len(self.sets[i]) - 1e-9:
                out.append((d, i, shared))
        return out


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items (item_id, text) in blocks of bounded size, read through an iterator."""
    blocks, size = [[]], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).toLocalIterator():
        text = r.t.encode()
        if blocks[-1] and size + len(text) > block_bytes:
            yield blocks.pop()
            blocks, size = [[]], 0
        blocks[-1].append((r.i, text))
        size += len(text)
    yield blocks[-1]


def _released(df: DataFrame, block, name: str, more: bool) -> DataFrame:
    """``df`` itself if its block is the only one; else written and read back, and the block released."""
    if more:
        df = materialize(df, name)
        block.unpersist()
    return df


def _texts(piece: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """Pairs (doc_id, item_id) where the document has at least ``threshold`` of the item's distinct shingles."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sc, found = docs.sparkSession.sparkContext, None
    blocks = item_blocks(items, block_bytes)
    rows = next(blocks)
    while rows is not None:
        after = next(blocks, None)
        block = sc.broadcast(ItemBlock(rows, n, threshold))

        def run(batches, block=block):
            for batch in batches:
                for piece in by_bytes(batch):
                    out = block.value.contained(_texts(piece))
                    if out:
                        size = [len(block.value.sets[i]) for _, i, _ in out]
                        yield pa.RecordBatch.from_arrays(
                            [
                                piece.column("doc_id").take(pa.array([d for d, _, _ in out])),
                                pa.array([block.value.ids[i] for _, i, _ in out], pa.int64()),
                                pa.array(size, pa.int64()),
                                pa.array([s for _, _, s in out], pa.int64()),
                                pa.array([s / k for (_, _, s), k in zip(out, size, strict=True)], pa.float64()),
                            ],
                            ["doc_id", "item_id", "n_shingles", "n_shared", "containment"],
                        )

        part = _released(source.mapInArrow(run, PAIRS), block, "pairs", found is not None or after is not None)
        found = part if found is None else found.unionByName(part)
        rows = after
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item, with the columns as they are and no shuffle."""
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    blocks = item_blocks(items, block_bytes)
    rows, several = next(blocks), False
    while rows is not None:
        after = next(blocks, None)
        block = sc.broadcast(ItemBlock(rows, n, threshold))

        def run(batches, block=block):
            for batch in batches:
                for piece in by_bytes(batch):
                    texts = _texts(piece)
                    keep = np.ones(len(texts), bool)
                    keep[[d for d, _, _ in block.value.contained(texts)]] = False
                    yield piece.filter(pa.array(keep))

        several |= after is not None
        docs, rows = _released(docs.mapInArrow(run, schema), block, "clean", several), after
    return docs
