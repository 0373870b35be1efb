"""Removal of the bytes that repeat elsewhere, by suffix arrays over the parts of the corpus that can repeat.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere else. Suffix arrays of
the whole corpus would sort text that occurs once, so candidates are found first, without loss: every window of
``width`` bytes names an anchor, the ``GRAM`` bytes in it with the least hash. Equal windows have equal anchors,
so only windows whose anchor's hash occurs twice can repeat. Neighbouring windows with one anchor form a block.

1. Equal texts are collapsed (by SHA-256); a text with copies is all repeated, and stays as a source for others.
2. Anchors are counted. An anchor all of whose blocks are equal (64-bit hashes) needs no sorting: its windows repeat.
3. The blocks of the other repeated anchors go to shards by their anchor, equal blocks collapsed to one. Each shard
   sorts its windows (Larsson-Sadakane refinement) and marks those whose common prefix (Kasai) with a neighbour has
   ``width`` bytes. Blocks with copies repeat as a whole; they are all but those that are alone in their class, so
   no join needs a passage's own, possibly hot, key.
4. An anchor with more than ``hot`` distinct blocks is spread over several shards. Each gives its distinct windows as a run sorted by
   128-bit digests; runs are merged two by two, each window of one looked up in the other by binary search.
5. Marked windows go back to their texts, and texts to their documents.

Every step ends in a table in the shared folder. Texts travel zstd-compressed.

Defined cases: null texts count as empty; texts under ``width`` bytes keep all; null ids and repeated rows are
kept (a repeated row is a copy); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverframe.llm.common import by_bytes, drop_table, materialize, table_path
from silverframe.llm.suffix_arrays import repeated_windows
from silverframe.llm.text_hash import _power, mix

GRAM, SHARD_BYTES, CHUNK = 32, 1 << 19, 1 << 19
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_VALUES = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, name: str, base: int) -> np.ndarray:
    """Mixed polynomial hashes of spans of a buffer, from running sums."""
    n = len(values)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _power(name, base, n), dtype=np.uint64)])
    back = _power(name + "-", pow(base, -1, 1 << 64), n)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def text_blocks(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, start in it, windows, anchor hash, block hash) of the blocks of all texts, in order.

    Texts are taken in groups of at most ``CHUNK`` bytes and a bit; a longer text in pieces that share ``width - 1`` bytes, so
    that each window is in one piece.
    """
    parts, group, size = [], [], 0

    def close():
        if group:
            owner, offset, pieces = zip(*group, strict=True)
            k, start, *rest = _blocks(list(pieces), width)
            parts.append((np.array(owner, np.int64)[k], np.array(offset, np.int64)[k] + start, *rest))
            group.clear()

    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - width + 1, 1), CHUNK):
            piece = t if len(t) <= CHUNK else t[at : at + CHUNK + width - 1]
            if group and size + len(piece) > CHUNK + width - 1:
                close()
                size = 0
            group.append((k, at, piece))
            size += len(piece)
    close()
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else tuple(np.empty(0, np.int64) for _ in range(5))


def _blocks(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = len(buf)
    if n < width:
        return tuple(np.empty(0, d) for d in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h, k = buf.astype(np.uint64) + np.uint64(1), 1
    for m in _STEPS:
        h = h[:-k] * np.uint64(m) + h[k:]
        h ^= h >> np.uint64(31)
        k *= 2
    low = 24  # bits of the place in the buffer, which is shorter
    key = ((h >> np.uint64(low)) << np.uint64(low)) | np.arange(len(h), dtype=np.uint64)
    grams, step = width - GRAM + 1, 1
    while 2 * step <= grams:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    key = np.minimum(key[: len(key) - (grams - step)], key[grams - step :])
    anchor = (key & np.uint64((1 << low) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + width <= (begin + sizes)[owner]
    new = inside & ((np.diff(anchor, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    start = np.flatnonzero(new)
    which = np.cumsum(new)[inside] - 1
    windows = np.bincount(which, minlength=len(start))
    block = _span_hash(_VALUES[buf], start, start + windows + width - 1, "block", _BASE)
    return owner[start], start - begin[owner[start]], windows, h[anchor[start]], block


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def _unzip(batch: pa.RecordBatch) -> list[bytes]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return [d.decompress(z) for z in batch.column("z").to_pylist()]


def _by_size(batch: pa.RecordBatch, limit: int = 4 << 20):
    """Slices of a batch of about ``limit`` unpacked bytes (column n), one row at least."""
    n = batch.column("n").to_numpy(zero_copy_only=False)
    part = (np.cumsum(n) - n) // limit
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.empty(0, int)
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def _texts(docs: DataFrame, width: int) -> DataFrame:
    """One row per distinct text: rid, sha, copies, n, z (compressed), and its blocks' hashes (anchors g, blocks b)."""

    def squeeze(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for piece in by_bytes(batch):
                raw = piece.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([piece.column("sha"), piece.column("k"), pa.array([len(x) for x in raw], pa.int64()), pa.array([c.compress(x) for x in raw], pa.binary())], ["sha", "k", "n", "z"])

    def analyse(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in _by_size(batch):
                texts = _unzip(piece)
                doc, _, _, g, b = text_blocks(texts, width)
                edge = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(v.view(np.int64))) for v in (g, b)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(texts))), piece.column("sha"), piece.column("copies"), piece.column("n"), piece.column("z"), *lists],
                    ["rid", "sha", "copies", "n", "z", "g", "b"],
                )
                at += len(texts)

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    one = keyed.groupBy("sha").agg(F.min("k").alias("k"), F.count("*").alias("copies"))
    squeezed = keyed.select("sha", "k", "text").mapInArrow(squeeze, "sha binary, k long, n long, z binary")
    return squeezed.join(one, ["sha", "k"]).select("sha", "copies", "n", "z").mapInArrow(analyse, "rid long, sha binary, copies long, n long, z binary, g array<long>, b array<long>")


def _sort_shard(rows: list[tuple], width: int):
    """Marked runs of windows of a shard's single blocks, and the distinct windows of its spread anchors."""
    blocks = [r["block"] for r in rows]
    counts = np.array([len(b) - width + 1 for b in blocks], np.int64)
    marked, cls = repeated_windows(blocks, counts, width)
    edge = np.append(0, np.cumsum(counts))
    single = np.array([r["c"] == 1 for r in rows])
    runs = _runs(marked & np.repeat(single, counts), edge)
    spread = np.array([r["shards"] > 1 for r in rows])
    windows = None
    if spread.any():
        _, pick = np.unique(cls, return_index=True)
        pick = pick[np.repeat(spread, counts)[pick]]
        owner = np.searchsorted(edge, pick, side="right") - 1
        data = np.frombuffer(b"".join(blocks), np.uint8)
        start = pick - edge[owner] + (edge[owner] + owner * (width - 1))
        f = [_span_hash(_VALUES[data] ^ np.uint64(salt), start, start + width, name, base) for salt, name, base in ((0, "block", _BASE), (0xABCDEF, "two", _BASE2))]
        windows = (f[0].view(np.int64), f[1].view(np.int64), owner, pick - edge[owner], marked[pick] | ~single[owner])
    return runs, windows


def _runs(flags: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first window, end) of the runs of set flags, cut at block edges."""
    starts = np.zeros(len(flags) + 1, bool)
    starts[edge[:-1]] = True
    on = flags & (starts[:-1] | ~np.concatenate([[False], flags[:-1]]))
    off = flags & (starts[1:] | ~np.concatenate([flags[1:], [False]]))
    off[-1:] |= flags[-1:]
    a, z = np.flatnonzero(on), np.flatnonzero(off) + 1
    owner = np.searchsorted(edge, a, side="right") - 1
    return owner, a - edge[owner], z - edge[owner]


SORTED = "rid long, ord int, w0 int, w1 int, f1 long, f2 long, marked boolean, shard long"


def _shard_windows(blocks: DataFrame, width: int, hot: int) -> DataFrame:
    """Marked windows (rid, ord, w0, w1) of the single blocks among ``blocks`` (g, b, c, rid, ord, block)."""
    # written first: a table of few rows is broadcast by its measured size, and otherwise a hot anchor's side of the join can be split
    crowded = materialize(blocks.groupBy("g").count().where(F.col("count") > hot).select("g", F.ceil(F.col("count") / hot).alias("shards")), "crowded-anchors")
    dealt = blocks.join(crowded, "g", "left").withColumn("shards", F.coalesce("shards", F.lit(1).cast("long"))).withColumn("shard", F.pmod(F.col("b"), F.col("shards")))

    def run(batches):
        held, size, last, number = [], 0, None, TaskContext.get().partitionId() << 32

        def close():
            runs, windows = _sort_shard(held, width)
            rid, ords = (np.array([r[c] for r in held], np.int64) for c in ("rid", "ord"))
            o, a, z = runs
            k = len(o)
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rid[o]), pa.array(ords[o].astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32)), none, none, pa.nulls(k, pa.bool_()), none], ["rid", "ord", "w0", "w1", "f1", "f2", "marked", "shard"])
            if windows:
                f1, f2, o, w, m = windows
                yield pa.RecordBatch.from_arrays([pa.array(rid[o]), pa.array(ords[o].astype(np.int32)), pa.array(w.astype(np.int32)), pa.array((w + 1).astype(np.int32)), pa.array(f1), pa.array(f2), pa.array(m), pa.array(np.full(len(o), number))], ["rid", "ord", "w0", "w1", "f1", "f2", "marked", "shard"])

        for batch in batches:
            for r in batch.to_pylist():
                key = (r["g"], r["shard"])
                if held and key != last and size >= SHARD_BYTES:
                    yield from close()
                    held, size, number = [], 0, number + 1
                held.append(r)
                size += len(r["block"])
                last = key
        if held:
            yield from close()

    # a shard's suffix arrays sort several anchors at once; those of one anchor and shard number stay together
    placed = dealt.repartition("g", "shard").sortWithinPartitions("g", "shard")
    done = materialize(placed.select("g", "shard", "shards", "c", "rid", "ord", "block").mapInArrow(run, SORTED), "sorted-windows")

    def merge(batches):
        rows = [pa.Table.from_batches([b]) for b in batches]
        if not rows:
            return
        t = pa.concat_tables(rows)
        f1, f2, shard = (t.column(c).to_numpy() for c in ("f1", "f2", "shard"))
        edge = np.append(np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)), len(shard))
        seen = np.zeros(len(f1), bool)
        runs = [np.arange(a, b) for a, b in zip(edge, edge[1:], strict=False)]
        while len(runs) > 1:
            runs = [merged(*pair, f1, f2, seen) if len(pair) > 1 else pair[0] for pair in (runs[k : k + 2] for k in range(0, len(runs), 2))]
        hit = np.flatnonzero(seen & ~t.column("marked").to_numpy(zero_copy_only=False).astype(bool))
        yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().take(pa.array(hit)) for c in ("rid", "ord", "w0", "w1")], ["rid", "ord", "w0", "w1"])

    across = done.where("f1 is not null").select("rid", "ord", "w0", "w1", "f1", "f2", "marked", "shard").repartition("f1", "f2").sortWithinPartitions("shard", "f1", "f2").mapInArrow(merge, "rid long, ord int, w0 int, w1 int")
    return done.where("f1 is null").select("rid", "ord", "w0", "w1").unionByName(across)


def merged(a: np.ndarray, b: np.ndarray, f1: np.ndarray, f2: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Two runs (row numbers, sorted by f1) as one. Each row of the second is looked up in the first by binary search; rows with equal digests are marked in ``seen``."""
    left, right = (np.searchsorted(f1[a], f1[b], side) for side in ("left", "right"))
    one = np.flatnonzero(right - left == 1)
    same = one[f2[a[left[one]]] == f2[b[one]]]
    seen[a[left[same]]] = seen[b[same]] = True
    for k in np.flatnonzero(right - left > 1):  # merged rows that share the digest's first half
        group = a[left[k] : right[k]]
        equal = group[f2[group] == f2[b[k]]]
        seen[equal] = True
        seen[b[k]] |= len(equal) > 0
    out = np.empty(len(a) + len(b), np.int64)
    place = left + np.arange(len(b))
    other = np.ones(len(out), bool)
    other[place] = False
    out[place], out[other] = b, a
    return out


def without_repeats(docs: DataFrame, width: int = 200, hot: int = 2000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    texts = materialize(_texts(docs, width), "texts")
    _release(spark)

    repeated = materialize(texts.select(F.explode(F.arrays_zip("g", "b")).alias("x")).groupBy("x.g").agg(F.count("*").alias("n"), (F.min("x.b") != F.max("x.b")).alias("mixed")).where("n > 1").select("g", "mixed"), "anchors")
    _release(spark)
    found = texts.select("rid", F.posexplode("g").alias("ord", "g")).join(repeated, "g").groupBy("rid").agg(F.collect_list(F.struct("ord", "mixed")).alias("x"), F.max("mixed").alias("any_mixed"))
    found = materialize(found.select("rid", "any_mixed", F.col("x.ord").alias("ords"), F.col("x.mixed").alias("mixed")), "text-anchors")
    drop_table(spark, table_path(repeated))
    _release(spark)

    def cut(batches):
        for batch in batches:
            for piece in _by_size(batch):
                data = _unzip(piece)
                doc, start, windows, g, b = text_blocks(data, width)
                first = np.searchsorted(doc, np.arange(len(data)))
                at = np.concatenate([np.empty(0, np.int64), *(first[k] + np.array(o, np.int64)[np.array(m, bool)] for k, (o, m) in enumerate(zip(piece.column("ords").to_pylist(), piece.column("mixed").to_pylist(), strict=True)))])
                rid = piece.column("rid").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[doc[at]]), pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(g[at].view(np.int64)), pa.array(b[at].view(np.int64)), pa.array([data[d][s : s + w + width - 1] for d, s, w in zip(doc[at].tolist(), start[at].tolist(), windows[at].tolist(), strict=True)], pa.binary())],
                    ["rid", "ord", "g", "b", "block"],
                )

    blocks = texts.select("rid", "n", "z").join(found.where("any_mixed").select("rid", "ords", "mixed"), "rid").mapInArrow(cut, "rid long, ord int, g long, b long, block binary")
    blocks = materialize(blocks, "blocks")
    _release(spark)
    classes = materialize(blocks.groupBy("g", "b").agg(F.count("*").alias("c"), F.min_by(F.struct("rid", "ord", "block"), F.col("rid")).alias("x")).select("g", "b", "c", "x.rid", "x.ord", "x.block"), "block-classes")
    _release(spark)
    marked = _shard_windows(classes, width, hot)
    alone = classes.where("c = 1").select("rid", "ord")
    equal = blocks.select("rid", "ord").join(alone, ["rid", "ord"], "left_anti").select("rid", "ord", F.lit(0).alias("w0"), F.lit(-1).alias("w1"))
    plain = found.select("rid", F.explode(F.arrays_zip("ords", "mixed")).alias("x")).where("not x.mixed").select("rid", F.col("x.ords").alias("ord"), F.lit(0).alias("w0"), F.lit(-1).alias("w1"))
    runs = marked.unionByName(equal).unionByName(plain).groupBy("rid").agg(F.collect_list(F.struct("ord", "w0", "w1")).alias("x"))
    runs = materialize(runs.select("rid", F.col("x.ord").alias("ords"), F.col("x.w0").alias("w0"), F.col("x.w1").alias("w1")), "runs")
    for t in (found, blocks, classes):
        drop_table(spark, table_path(t))
    _release(spark)

    def keep(batches):
        for batch in batches:
            for piece in _by_size(batch):
                data = _unzip(piece)
                doc, start, windows, _, _ = text_blocks(data, width)
                first = np.searchsorted(doc, np.arange(len(data)))
                removed, spans, kept = [], [], []
                for k, (text, o, w0, w1) in enumerate(zip(data, *(piece.column(c).to_pylist() for c in ("ords", "w0", "w1")), strict=True)):
                    at = first[k] + np.array(o, np.int64)
                    a, z = start[at] + np.array(w0), start[at] + np.where(np.array(w1) < 0, windows[at], w1) + width - 1
                    cover = np.zeros(len(text) + 1, np.int64)
                    np.add.at(cover, a, 1)
                    np.add.at(cover, z, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                    kept.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays([piece.column("sha"), piece.column("n"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)], ["sha", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    copied = (F.col("copies") > 1) & (F.col("n") >= width)
    shape = "sha binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut_texts = texts.where(~copied).select("rid", "sha", "n", "z").join(runs, "rid").select("sha", "n", "z", "ords", "w0", "w1").mapInArrow(keep, shape)
    whole = texts.where(copied).select("sha", F.col("n").alias("n_bytes"), F.col("n").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    other = texts.where(~copied).select("rid", "sha", "n").join(runs.select("rid"), "rid", "left_anti").select("sha", F.col("n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256"))
    result = materialize(cut_texts.unionByName(whole).unionByName(other).dropDuplicates(["sha"]), "text-results")
    for t in (texts, runs):
        drop_table(spark, table_path(t))
    _release(spark)
    named = docs.select(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)).alias("sha"))
    return named.join(result, "sha").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
