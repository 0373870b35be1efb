"""Approximate nearest neighbours by largest inner product: NN-descent builds a graph, queries walk it greedily.

Graph. Equal vectors are one node, which keeps the ``k + 1`` least ids of its rows; no further row of it can be in a result of ``k``. A node's
first neighbours are the best of two random blocks; then each round joins neighbours of neighbours: every node takes its
neighbours and some of the nodes that it is a neighbour of (``reverse``, fresh links first), compares them with each other, and sends each
what it found. The best ``degree`` are kept. Rounds end when few lists change. Links are joined with vectors by id, and a vector is
sent once to each block of nodes that needs it, not once for each pair.

Search. A query is a row of the table, so its own node's neighbours are where it starts, with the best for it of the ``entries`` nodes of
largest norm: a vector of small norm has only such neighbours, and is far from what it looks for. A round expands the best ``front`` nodes of its
beam (the best ``ef`` seen) that weren't expanded yet, by joins with the graph and then with blocks of vectors, and
keeps the best; it ends when all of each beam is expanded, or after ``rounds``. The beam is scored again on the original vectors.

Inner products of vectors of unequal norm don't make a good graph, so the graph compares vectors scaled by the largest norm, with one
component more that fills them up to norm one: among these, the nearest to (query, 0) are those of largest inner product. The graph is
built on 16-bit floats, searched on 32-bit ones, and results are doubles.

Work per node is bounded by parameters: a node is asked at most once by a query in a round, is in a list at most
once, and takes at most ``degree + reverse`` links. Each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from silverframe.llm.common import drop_table, materialize, table_path

SEED_BLOCK, NODE_BLOCK = 1024, 4096
STATE = "node long, v binary, ids binary, sims binary, fresh binary, worst float, changed int"
FOUND = "home int, nodes binary, sizes binary, ids binary, sims binary"
LISTS = "node long, ids binary, sims binary"
BEAM = "node long, v binary, ids binary, sims binary, fresh binary, open binary"
NONE = -2.0  # below any similarity of vectors of norm one


def _blob(a: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``a`` cut before each of ``cuts`` and at its end, as bytes."""
    data, width = a.tobytes(), a.itemsize
    ends = np.append(cuts[1:], len(a))[: len(cuts)]
    return pa.array([data[i * width : j * width] for i, j in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of blobs, and how many each row has; null counts as empty."""
    blobs = [b or b"" for b in column.to_pylist()]
    values = np.frombuffer(b"".join(blobs), kind)
    return values, np.array([len(b) for b in blobs], np.int64) // np.dtype(kind).itemsize


def _best(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, last: np.ndarray, keep: int):
    """Places of the ``keep`` most similar distinct ids of each owner, sorted; of a repeated id the one with the least ``last`` counts."""
    order = np.lexsort((last, ids, owner))
    o, i = owner[order], ids[order]
    order = order[np.concatenate([[True], (o[1:] != o[:-1]) | (i[1:] != i[:-1])]) if len(o) else slice(0)]
    order = order[np.lexsort((ids[order], -sims[order], owner[order]))]
    o = owner[order]
    return order[np.arange(len(o)) - np.searchsorted(o, o) < keep]


def _packed(home: np.ndarray, node: np.ndarray, sizes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.Table:
    """Lists of nodes (``sizes`` of ``ids`` and ``sims`` each) as a row for each home block of the nodes."""
    order = np.argsort(home, kind="stable")
    starts = np.cumsum(sizes) - sizes
    place = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(ids))
    home, node, sizes, ids, sims = home[order], node[order], sizes[order], ids[place], sims[place]
    cuts = np.flatnonzero(np.diff(home, prepend=-1))
    inner = np.append(0, np.cumsum(sizes))[cuts]
    blobs = [_blob(node.astype("<i8"), cuts), _blob(sizes.astype("<i4"), cuts), _blob(ids.astype("<i8"), inner), _blob(sims.astype("<f4"), inner)]
    return pa.table([pa.array(home[cuts].astype(np.int32)), *blobs], ["home", "nodes", "sizes", "ids", "sims"])


def points(vectors: DataFrame, asked: Column) -> DataFrame:
    """(vec_id, x, norm, asked): vectors as doubles without closing zeros; those that are null, zero, without id or not finite are left out."""

    def run(batches):
        for batch in batches:
            out = []
            for i, x, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if None in x:
                    continue
                x = np.trim_zeros(np.array(x, "<f8"), "b") + 0.0
                if len(x) and np.isfinite(x).all():
                    most = np.abs(x).max()
                    out.append((i, x.tobytes(), float(min(most * np.linalg.norm(x / most), np.finfo(float).max)), bool(q)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.float64(), pa.bool_()), strict=True)], ["vec_id", "x", "norm", "asked"])

    x = F.transform(F.col("embedding"), lambda c: c.cast("double")).alias("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x, asked.alias("asked")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    return rows.mapInArrow(run, "vec_id long, x binary, norm double, asked boolean")


def nodes(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(node, x, y, v, members, norm, asked) of each distinct vector, and their number: scaled as 32-bit floats (y), filled up as 16-bit ones (v)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("rank") <= k + 1)
    members = ranked.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("members"), F.first("norm").alias("norm"))
    wanted = rows.where("asked").select("x").distinct().withColumn("asked", F.lit(True))
    distinct = members.join(wanted, "x", "left").withColumn("node", F.monotonically_increasing_id())
    raw = materialize(distinct, "nodes-raw")
    count, most, dim = raw.agg(F.count("*"), F.max("norm"), F.max(F.length("x"))).first()
    dim = (dim or 0) // 8

    def run(batches):
        for batch in batches:
            xs = batch.column("x").to_pylist()
            y = np.zeros((len(xs), dim + 1))
            for row, x in zip(y, xs, strict=True):
                row[: len(x) // 8] = np.frombuffer(x, "<f8") / most
            v = y.copy()
            v[:, dim] = np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
            cuts = np.arange(len(xs)) * (dim + 1)
            yield batch.append_column("y", _blob(y.astype("<f4").ravel(), cuts)).append_column("v", _blob(v.astype("<f2").ravel(), cuts))

    kinds = "node long, x binary, members array<long>, norm double, asked boolean"
    table = materialize(raw.select("node", "x", "members", "norm", F.coalesce("asked", F.lit(False)).alias("asked")).mapInArrow(run, f"{kinds}, y binary, v binary"), "nodes")
    drop_table(rows.sparkSession, table_path(raw))
    return table, count


def _blocks(count: int, size: int) -> int:
    return max(1, -(-count // size))


def _block(column: str, count: int, size: int, salt: int = 1) -> Column:
    """The block that a node is dealt to. Node ids number the rows of each of some partitions, which start apart."""
    blocks = _blocks(count, size)
    return F.pmod(F.shiftright(column, 33) * 7919 + F.floor(F.col(column) / salt), F.lit(blocks)).cast("int")


def _block_of(node: np.ndarray, count: int) -> np.ndarray:
    """:func:`_block` of NODE_BLOCK."""
    return ((node >> 33) * 7919 + node) % _blocks(count, NODE_BLOCK)


def _first_neighbours(base: DataFrame, count: int, degree: int, salt: int) -> DataFrame:
    """The best of each node's random block, as ``FOUND``."""

    def run(block: pa.Table) -> pa.Table:
        ids = block["node"].to_numpy()
        v = np.frombuffer(b"".join(block["v"].to_pylist()), "<f2").reshape(len(ids), -1).astype(np.float32)
        k = min(degree, len(ids) - 1)
        found, sims = [], []
        for a in range(0, len(ids) if k else 0, 512):
            s = v[a : a + 512] @ v.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = NONE
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found.append(ids[best])
            sims.append(np.take_along_axis(s, best, 1))
        none = np.empty(0)
        return _packed(block["home"].to_numpy(), ids, np.full(len(ids), k), np.concatenate([none.astype(np.int64), *(f.ravel() for f in found)]), np.concatenate([none, *(x.ravel() for x in sims)]))

    return base.select("node", "v", _block("node", count, NODE_BLOCK).alias("home"), _block("node", count, SEED_BLOCK, salt).alias("block")).groupBy("block").applyInArrow(run, FOUND)


def _whole_owners(batches, key: str):
    """The batches cut anew, so that rows of one owner, which follow each other, are in one."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        owner = table[key].to_numpy()
        cut = int(np.searchsorted(owner, owner[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None:
        yield rest.combine_chunks()


def _merged(state: DataFrame, found: DataFrame, count: int, degree: int) -> DataFrame:
    """The graph with what was found: the best ``degree`` of a node's old and new neighbours; ``fresh`` marks new ones.

    A task merges one block of nodes after another; what was found for it is bounded as the lists of its nodes are.
    """

    def run(batches):
        for t in _whole_owners(batches, "home"):
            heads = np.flatnonzero(t["side"].to_numpy() == 0)
            rows = t.take(pa.array(heads)).sort_by("node")
            more = t.filter(pa.compute.equal(t["side"], 1))
            node = rows["node"].to_numpy()
            old, sizes = _flat(rows["ids"], "<i8")
            got, _ = _flat(more["ids"], "<i8")
            to, _ = _flat(more["nodes"], "<i8")
            counts, _ = _flat(more["sizes"], "<i4")
            owner = np.concatenate([np.repeat(np.arange(len(node)), sizes), np.repeat(np.searchsorted(node, to), counts)])
            ids, new = np.concatenate([old, got]), np.repeat([0, 1], [len(old), len(got)])
            sims = np.concatenate([_flat(x["sims"], "<f4")[0] for x in (rows, more)])
            keep = _best(owner, ids, sims, new, degree)
            owner, ids, sims, new = owner[keep], ids[keep], sims[keep], new[keep]
            cuts = np.searchsorted(owner, np.arange(len(node)))
            full = np.diff(cuts, append=len(owner)) == degree
            worst = np.full(len(node), NONE, np.float32)
            worst[full] = sims[cuts[full] + degree - 1]
            columns = [node, rows["v"].combine_chunks(), _blob(ids, cuts), _blob(sims, cuts), _blob(new.astype(np.uint8), cuts), worst, np.bincount(owner, new, len(node)).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in STATE.split(", ")])

    none = F.lit(None).cast("binary")
    old = state.select(_block("node", count, NODE_BLOCK).alias("home"), F.lit(0).alias("side"), "node", "v", "ids", "sims", none.alias("nodes"), none.alias("sizes"))
    rows = old.unionByName(found.select("home", F.lit(1).alias("side"), F.lit(None).cast("long").alias("node"), none.alias("v"), "ids", "sims", "nodes", "sizes"))
    return rows.repartition("home").sortWithinPartitions("home").mapInArrow(run, STATE)


def _links(state: DataFrame, reverse: int) -> DataFrame:
    """(center, member, fresh): each node's neighbours, and at most ``reverse`` of the nodes that it is a neighbour of."""

    def run(batches):
        for batch in batches:
            ids, sizes = _flat(batch.column("ids"), "<i8")
            fresh, _ = _flat(batch.column("fresh"), "u1")
            owner = np.repeat(batch.column("node").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids), pa.array(fresh.astype(np.int32))], ["center", "member", "fresh"])

    own = state.select("node", "ids", "fresh").mapInArrow(run, "center long, member long, fresh int")
    back = own.select(F.col("member").alias("center"), F.col("center").alias("member"), "fresh")
    order = Window.partitionBy("center").orderBy(F.desc("fresh"), F.xxhash64("center", "member"), "member")
    return own.unionByName(back.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reverse).drop("rank"))


def _local_join(state: DataFrame, count: int, degree: int, reverse: int) -> DataFrame:
    """What neighbours of a node are to each other, as ``FOUND``: better than the worst that a node has."""
    none = F.lit(None)
    own = state.select(_block("node", count, NODE_BLOCK).alias("home"), F.lit(0).alias("side"), "node", "v", "worst", none.cast("long").alias("center"))
    links = _links(state, reverse).select(_block("member", count, NODE_BLOCK).alias("home"), F.lit(1).alias("side"), F.col("member").alias("node"), none.cast("binary").alias("v"), none.cast("float").alias("worst"), (F.col("center") * 2 + F.col("fresh")).alias("center"))

    def send(batches):
        """A block's vectors to each block whose nodes they are linked with: a row for each pair of blocks."""
        for t in _whole_owners(batches, "home"):
            side = t["side"].to_numpy()
            rows, more = t.filter(pa.array(side == 0)).sort_by("node"), t.filter(pa.array(side == 1))
            node, link = rows["node"].to_numpy(), more["center"].to_numpy()
            v = np.array(rows["v"].to_pylist(), object)
            row, to = np.searchsorted(node, more["node"].to_numpy()), _block_of(link >> 1, count)
            order = np.lexsort((row, to))
            link, row, to = link[order], row[order], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            out = []
            for i, j in zip(cuts, np.append(cuts[1:], len(to)), strict=False):
                some, sizes = np.unique(row[i:j], return_counts=True)
                out.append((int(to[i]), int(t["home"][0].as_py()), node[some].tobytes(), b"".join(v[some]), rows["worst"].to_numpy()[some].tobytes(), sizes.astype("<i4").tobytes(), link[i:j].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 5), strict=True)], ["block", "home", "nodes", "v", "worst", "sizes", "centers"])

    dealt = own.unionByName(links).repartition("home").sortWithinPartitions("home")
    rows = dealt.mapInArrow(send, "block int, home int, nodes binary, v binary, worst binary, sizes binary, centers binary")

    def run(block: pa.Table) -> pa.Table:
        (ids, counts), (worst, _), (sizes, _), (link, _) = (_flat(block[c], k) for c, k in (("nodes", "<i8"), ("worst", "<f4"), ("sizes", "<i4"), ("centers", "<i8")))
        home = np.repeat(block["home"].to_numpy(), counts)
        v = np.frombuffer(b"".join(block["v"].to_pylist()), "<f2").reshape(len(ids), -1)
        row = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(link >> 1, kind="stable")
        link, row = link[order], row[order]
        starts = np.flatnonzero(np.diff(link >> 1, prepend=-1))
        sizes = np.diff(starts, append=len(link))
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def best():
            u, w, s = (np.concatenate(x) for x in zip(*held, strict=True))
            keep = _best(u, w, s, np.zeros(len(u), np.int8), degree)
            return u[keep], w[keep], s[keep]

        for a in range(0, len(starts), 128):
            n, at = sizes[a : a + 128], starts[a : a + 128]
            place = at[:, None] + np.arange(n.max())
            there = np.arange(n.max()) < n[:, None]
            place = np.where(there, place, 0)
            m, new = row[place], (link[place] & 1 == 1) & there
            x = v[m].astype(np.float32)
            s = x @ x.transpose(0, 2, 1)
            good = (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :] & (m[:, :, None] != m[:, None, :]) & (s > worst[m][:, :, None])
            c, i, j = np.nonzero(good)
            held.append((m[c, i], m[c, j], s[c, i, j]))
            size += len(c)
            if size > 4_000_000:
                held = [best()]
                size = len(held[0][0])
        u, w, s = best() if held else (np.empty(0, int),) * 3
        cuts = np.flatnonzero(np.diff(u, prepend=-1))
        return _packed(home[u[cuts]], ids[u[cuts]], np.diff(cuts, append=len(u)), ids[w], s)

    return rows.groupBy("block").applyInArrow(run, FOUND)


def descent(base: DataFrame, count: int, degree: int = 40, reverse: int = 32, iterations: int = 6, least_change: float = 0.1) -> DataFrame:
    """The neighbour graph (columns of ``STATE``) of ``base`` (node, v), after the last round that changed ``least_change`` of all links."""
    spark = base.sparkSession
    none = F.lit(None).cast("binary")
    state = base.select("node", "v", none.alias("ids"), none.alias("sims"))
    found = _first_neighbours(base, count, degree, 1).unionByName(_first_neighbours(base, count, degree, SEED_BLOCK))
    state = materialize(_merged(state, found, count, degree), "graph")
    for _ in range(iterations if count > SEED_BLOCK else 1):
        after = materialize(_merged(state, _local_join(state, count, degree, reverse), count, degree), "graph")
        drop_table(spark, table_path(state))
        state = after
        if (state.agg(F.sum("changed")).first()[0] or 0) <= least_change * count * degree:
            break
    return state


def _asked_blocks(asks: DataFrame, askers: DataFrame, count: int) -> DataFrame:
    """(block, node, v, worst, ids): what ``asks`` (node, ids) ask, by block, with the vectors and worst of ``askers`` (node, v, worst)."""

    def run(batches):
        for t in _whole_owners(batches, "node"):
            side = t["side"].to_numpy()
            heads, place = np.flatnonzero(side == 0), np.cumsum(side == 0) - 1
            ids, sizes = _flat(t["ids"], "<i8")
            owner = np.repeat(place, sizes)
            order = np.lexsort((ids, owner))
            owner, ids = owner[order], ids[order]
            first = np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]))[: len(ids)]
            owner, ids = owner[first], ids[first]
            block = _block_of(ids, count)
            order = np.lexsort((ids, block, owner))
            owner, ids, block = owner[order], ids[order], block[order]
            cuts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            to = pa.array(heads[owner[cuts]])
            columns = [pa.array(block[cuts].astype(np.int32)), *(t[c].take(to).combine_chunks() for c in ("node", "v", "worst")), _blob(ids, cuts)]
            yield pa.RecordBatch.from_arrays(columns, ["block", "node", "v", "worst", "ids"])

    none = F.lit(None)
    left = askers.select("node", F.lit(0).alias("side"), "v", "worst", none.cast("binary").alias("ids"))
    right = asks.select("node", F.lit(1).alias("side"), none.cast("binary").alias("v"), none.cast("float").alias("worst"), "ids")
    return left.unionByName(right).repartition("node").sortWithinPartitions("node", "side").mapInArrow(run, "block int, node long, v binary, worst float, ids binary")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _longs(blobs):
    import pandas as pd

    return pd.Series([np.frombuffer(b or b"", "<i8") for b in blobs])


def _at_blocks(asks: DataFrame, values: DataFrame, count: int, answer, schema: str) -> DataFrame:
    """``answer`` of each block's vectors and of the rows of ``asks`` (block, node, v, worst, ids) that ask it, streamed.

    ``values`` has node, vector and members. A task holds one block's vectors and a batch of asks.
    """
    left = values.select(_block("node", count, NODE_BLOCK).alias("block"), F.lit(0).alias("side"), "node", F.col("vector").alias("v"), F.lit(None).cast("float").alias("worst"), F.lit(None).cast("binary").alias("ids"), "members")
    right = asks.select("block", F.lit(1).alias("side"), "node", "v", "worst", "ids", F.lit(None).cast("array<long>").alias("members"))
    rows = left.unionByName(right).repartition("block").sortWithinPartitions("block", "side", "node")

    def run(batches):
        current, held, block = None, [], None
        for batch in batches:
            kinds = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            cuts = np.flatnonzero(np.diff(kinds, prepend=-1))
            for i, j in zip(cuts, np.append(cuts[1:], len(kinds)), strict=True):
                part = batch.slice(i, j - i)
                if kinds[i] >> 1 != current:
                    current, held, block = kinds[i] >> 1, [], None
                if kinds[i] % 2 == 0:
                    held.append(part)
                    continue
                if block is None:
                    block = pa.Table.from_batches(held).combine_chunks()
                yield from answer(block, part)

    return rows.mapInArrow(run, schema)


def _matrix(column, kind: str) -> np.ndarray:
    """Vectors as rows, closed with zeros."""
    blobs = [np.frombuffer(b, kind) for b in column.to_pylist()]
    out = np.zeros((len(blobs), max(map(len, blobs), default=0)), kind)
    for row, b in zip(out, blobs, strict=True):
        row[: len(b)] = b
    return out


def _scores(block: pa.Table, part: pa.RecordBatch):
    """Similarities of asked nodes that beat the asker's worst: (node, ids, sims)."""
    ids, y = block["node"].to_numpy(), np.frombuffer(b"".join(block["v"].to_pylist()), "<f4").reshape(block.num_rows, -1)
    out = []
    for q, v, worst, asked in zip(part.column("node").to_pylist(), part.column("v").to_pylist(), part.column("worst").to_pylist(), part.column("ids").to_pylist(), strict=True):
        w = np.frombuffer(asked, "<i8")
        s = y[np.searchsorted(ids, w)] @ np.frombuffer(v, "<f4")
        better = (s > worst) & (w != q)
        out.append((q, w[better].tobytes(), s[better].tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "ids", "sims"])


def _beams(beams: DataFrame, found: DataFrame, ef: int, front: int) -> DataFrame:
    """Beams with what was found. ``open`` has the next nodes to expand, ``fresh`` marks those that neither are nor were expanded."""

    def run(batches):
        for t in _whole_owners(batches, "node"):
            side = t["side"].to_numpy()
            heads, place = np.flatnonzero(side == 0), np.cumsum(side == 0) - 1
            ids, sizes = _flat(t["ids"], "<i8")
            sims, _ = _flat(t["sims"], "<f4")
            fresh, _ = _flat(t["fresh"], "u1")
            owner, new = np.repeat(place, sizes), np.repeat(side, sizes)
            unseen = np.ones(len(ids), np.uint8)
            unseen[new == 0] = fresh
            keep = _best(owner, ids, sims, new, ef)
            owner, ids, sims, unseen = owner[keep], ids[keep], sims[keep], unseen[keep]
            cuts = np.searchsorted(owner, np.arange(len(heads)))
            before = np.cumsum(unseen, dtype=np.int64) - unseen
            next_ = (unseen == 1) & (before - np.append(before, 0)[cuts][owner] < front)
            opened = np.searchsorted(owner[next_], np.arange(len(heads)))
            unseen[next_] = 0
            columns = [t["node"].take(pa.array(heads)), t["v"].take(pa.array(heads)), _blob(ids, cuts), _blob(sims, cuts), _blob(unseen, cuts), _blob(ids[next_], opened)]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [f.split()[0] for f in BEAM.split(", ")])

    old = beams.select("node", F.lit(0).alias("side"), "v", "ids", "sims", "fresh")
    none = F.lit(None).cast("binary")
    rows = old.unionByName(found.select("node", F.lit(1).alias("side"), none.alias("v"), "ids", "sims", none.alias("fresh")))
    return rows.repartition("node").sortWithinPartitions("node", "side").mapInArrow(run, BEAM)


def _entries(base: DataFrame, entries: int, degree: int) -> DataFrame:
    """(node, ids): for each asked node, the best ``degree`` of the ``entries`` nodes of largest norm."""
    first = base.orderBy(F.desc("norm"), "node").limit(entries).select("node", "y").collect()  # at most ``entries`` rows
    ids = np.array([r.node for r in first], np.int64)
    y = np.array([np.frombuffer(r.y, "<f4") for r in first])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                k = min(degree, len(ids))
                asked = np.frombuffer(b"".join(batch.column("y").to_pylist()), "<f4").reshape(batch.num_rows, -1)
                best = np.argpartition(-(asked @ y.T), k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([batch.column("node"), _blob(ids[best].ravel(), np.arange(batch.num_rows) * k)], ["node", "ids"])

    return base.where("asked").select("node", "y").mapInArrow(run, "node long, ids binary")


def search(base: DataFrame, graph: DataFrame, count: int, ef: int, front: int, rounds: int, entries: int) -> DataFrame:
    """The beam (columns of ``BEAM``) of each asked node of ``base``."""
    spark = base.sparkSession
    none = F.lit(None).cast("binary")
    beams = base.where("asked").select("node", F.col("y").alias("v"), none.alias("ids"), none.alias("sims"), none.alias("fresh"), none.alias("open"))
    asks = graph.select("node", "ids").join(base.where("asked").select("node"), "node", "left_semi").unionByName(_entries(base, entries, front))
    values = base.select("node", F.col("y").alias("vector"), F.lit(None).cast("array<long>").alias("members"))
    old = None
    for _ in range(rounds):
        full = F.length("sims") >= 4 * ef
        last = F.when(full, F.expr(f"substring(sims, {4 * ef - 3}, 4)"))
        targets = _asked_blocks(asks, beams.select("node", "v", _float(last).alias("worst")), count)
        found = _at_blocks(targets, values, count, _scores, LISTS)
        after = materialize(_beams(beams, found, ef, front), "beams")
        if old:
            drop_table(spark, old)
        beams, old = after, table_path(after)
        opened = beams.where(F.length("open") > 0).select("node", F.explode(_longs("open")).alias("at"))
        if opened.isEmpty():
            break
        asks = opened.join(graph.select(F.col("node").alias("at"), "ids"), "at").select("node", "ids")
    return beams


@F.pandas_udf(T.FloatType())
def _float(blobs):
    import pandas as pd

    return pd.Series([np.frombuffer(b, "<f4")[0] if b else np.float32(NONE * 1e3) for b in blobs])


def _results(base: DataFrame, beams: DataFrame, count: int, k: int) -> DataFrame:
    """(node, found): the ``k + 1`` best rows for each asked node, by products of the original vectors; its own rows are among them."""

    def answer(block: pa.Table, part: pa.RecordBatch):
        ids, x = block["node"].to_numpy(), _matrix(block["v"], "<f8")
        members = block["members"].to_pylist()
        out = []
        for q, v, asked in zip(part.column("node").to_pylist(), part.column("v").to_pylist(), part.column("ids").to_pylist(), strict=True):
            w, v = np.frombuffer(asked, "<i8"), np.frombuffer(v, "<f8")
            size = min(len(v), x.shape[1])
            rows = [(-float(x[i, :size] @ v[:size]), m, int(n == q)) for n, i in zip(w.tolist(), np.searchsorted(ids, w).tolist(), strict=True) for m in members[i]]
            out += [(q, -s, m, same) for s, m, same in sorted(rows)[: k + 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.float64(), pa.int64(), pa.int32()), strict=True)], ["node", "score", "vec_id", "same"])

    best = beams.select("node", "ids")
    own = base.where("asked").select("node", _bytes("node").alias("ids"))
    targets = _asked_blocks(best.unionByName(own), base.where("asked").select("node", F.col("x").alias("v"), F.lit(None).cast("float").alias("worst")), count)
    rows = _at_blocks(targets, base.select("node", F.col("x").alias("vector"), "members"), count, answer, "node long, score double, vec_id long, same int")
    order = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id", "same")  # k + 1 rows of each block at most
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    return top.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score", "same"))).alias("found"))


@F.pandas_udf(T.BinaryType())
def _bytes(ids):
    import pandas as pd

    return pd.Series([int(i).to_bytes(8, "little", signed=True) for i in ids])


def nearest(vectors: DataFrame, asked: Column, k: int = 20, degree: int = 40, reverse: int = 32, ef: int = 160, front: int = 64, rounds: int = 12, entries: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows found nearest to each row of ``vectors`` for which ``asked`` holds, nearest first.

    ``vectors`` has vec_id and embedding; score is the inner product in doubles. Ties go to the smaller vec_id; all other rows are
    candidates, and where there are fewer, all are returned. Rows are what is ranked: a repeated id takes a rank for each row, and each row
    asked has its own ranks. Vectors of unequal length count as closed with zeros. Null, empty and zero vectors and
    those with null or non-finite components take no part, nor do rows without an id; no queries or no rows give an empty result.
    """
    spark = vectors.sparkSession
    rows = materialize(points(vectors, asked), "points")
    base, count = nodes(rows, k)
    ef = max(ef, 4 * k)
    graph = descent(base.select("node", "v"), count, max(degree, k + 1), reverse)
    beams = search(base, graph, count, ef, front, rounds, entries)
    results = materialize(_results(base, beams, count, k), "nearest")
    for table in (graph, beams):
        drop_table(spark, table_path(table))
    # rows of one vector share its list; each leaves itself out where the list holds it
    own = F.array_position(F.transform("found", lambda e: (e["same"] == 1) & (e["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("found", lambda e, i: i + 1 != F.col("own")), 1, k)
    lists = results.join(base.where("asked").select("node", "x"), "node").select("x", "found")
    queries = rows.where("asked").select(F.col("vec_id").alias("query_id"), "x").join(lists, "x").select("query_id", "found").withColumn("own", own)
    ranked = queries.select("query_id", F.posexplode(others).alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")
