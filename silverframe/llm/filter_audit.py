"""Audit of how document filters act on one another, over every order in which they can be applied.

A filter fails a document or not, whatever the order, so all that an order can change is told by how many documents of a
part fail exactly which filters. Documents are therefore counted into *mask cells* (part, set of failed filters) on
Spark, and each part's cells, at most 2 to the number of filters, are walked by one small task: permutations are
visited by single swaps of neighbours (Steinhaus, Johnson, Trotter), a swap changes only its own two steps,
and the Shapley sums grow along the walk.

The one filter that looks beyond a document, identical texts, is settled in the same counts. All copies of a text fail the
same other filters, so copies shrink to a row for each (text digest, part, labels) before they are shuffled, however
many there are, and only the copy of the least id is held apart.

Null texts are empty and null parts the empty string. Rows are what is counted: a repeated row counts again, and rows that share
the least id of a text all pass as its first. A document without an id is neither a later nor an earlier copy.
Several label rows of an id are joined by "any of them is 1"; without one, or with null labels, a document is neither
good nor toxic. Empty tables give no rows, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silverframe.llm.common import by_bytes

LETTERS = "ABCDE"
FEW_WORDS, FEW_DISTINCT, MANY_CAPITALS, ODD_SIGNS, LATER_COPY = (1 << i for i in range(len(LETTERS)))
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))


def text_failures(text: bytes, words_least: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> int:
    """The mask of the filters that a text fails by itself. Words are runs without ASCII white space, which is how ``bytes.split`` cuts."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    mask = FEW_WORDS * (len(words) < words_least)
    mask |= FEW_DISTINCT * (100 * len(set(words)) < distinct_percent * len(words))
    mask |= MANY_CAPITALS * (100 * capitals > capital_percent * len(text.translate(None, FOLLOWING)))
    return mask | ODD_SIGNS * (len(text.translate(None, SIGNS)) < len(text))


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each row of ``docs``: filters failed by the text alone, and the SHA-256 of the text."""

    def run(batches):
        for batch in batches:
            for rows in by_bytes(batch):
                texts = rows.column("text").to_pylist()
                masks = pa.array([text_failures(t) for t in texts], pa.int32())
                digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), masks, digests], ["doc_id", "part", "mask", "digest"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), text)
    return rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of each part fail exactly the filters of a mask, and how many of these are labelled so."""

    def is_one(name: str) -> Column:
        return F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name)

    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    known = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("quality", "toxic")]
    rows = failures(docs).join(marks, "doc_id", "left").select("doc_id", "part", "mask", "digest", *known)
    kind = ["digest", "mask", "part", "quality", "toxic"]
    ids = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("c"))
    groups = ids.groupBy(F.col("doc_id").isNull().alias("nameless"), *kind).agg(F.sum("c").alias("n"), F.min(F.struct("doc_id", "c")).alias("first"))
    # a digest has at most a row for each part, pair of labels and kind of id
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.when(F.col("nameless"), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    split = F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(LATER_COPY)).alias("mask"), (F.col("n") - passing).alias("n")),
    )
    cells = groups.withColumn("least", least).select("part", "quality", "toxic", F.inline(split)).where("n > 0")
    counted = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic_n"))]
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counted).withColumnRenamed("toxic_n", "toxic")


def adjacent_orders(size: int) -> Iterator[tuple[list[int], int | None]]:
    """Every order of ``range(size)``, each one swap of neighbours from the one before: (order, place of the swap, None at first)."""
    order, leftward = list(range(size)), [True] * size
    yield order, None
    while True:
        place = {x: i for i, x in enumerate(order)}
        for mover in reversed(range(size)):  # the largest that faces a smaller neighbour
            i = place[mover]
            j = i - 1 if leftward[mover] else i + 1
            if 0 <= j < size and order[j] < mover:
                break
        else:
            return
        order[i], order[j] = order[j], order[i]
        for larger in range(mover + 1, size):
            leftward[larger] = not leftward[larger]
        yield order, min(i, j)


def walk(masks: np.ndarray, counts: np.ndarray, letters: str = LETTERS) -> list[tuple]:
    """(order, step, measures, shapley) of each order and step, from the cells of one part.

    ``counts`` has a row for each of ``masks``: all documents, good ones, toxic ones.
    """
    size = len(letters)
    failing = [counts[(masks >> f) & 1 == 1].sum(0) for f in range(size)]
    alone = [counts[masks == 1 << f].sum(0) for f in range(size)]

    def step(before: int, f: int) -> tuple:
        left = (masks & before) == 0
        gone = counts[left & ((masks >> f) & 1 == 1)].sum(0)
        kept = counts[left, 0].sum() - gone[0]
        return int(kept), int(gone[0]), int(failing[f][0] - gone[0]), int(alone[f][0]), int(gone[1]), int(gone[2])

    found, shapley = [], [0] * size
    steps: list[tuple] = [()] * size
    for order, swap in adjacent_orders(size):
        for i in range(size) if swap is None else (swap, swap + 1):
            steps[i] = step(sum(1 << f for f in order[:i]), order[i])
        for f, s in zip(order, steps, strict=True):
            shapley[f] += s[1]
        found.append((list(order), list(steps)))
    return [("".join(letters[f] for f in order), i + 1, *s, shapley[order[i]]) for order, steps in found for i, s in enumerate(steps)]


def filter_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, zeros included; columns as in ``REPORT``.

    ``docs`` has doc_id, text and lang, ``labels`` has doc_id, quality and toxic. kept: documents left after the step; removed:
    by it; redundant: failing its filter but removed before; unique_fails: failing no other filter; good_lost and
    toxic_lost: labelled documents among the removed; shapley: the removed of the step's filter over all orders.
    """

    def run(cells: pa.Table) -> pa.Table:
        columns = cells.to_pydict()
        counts = np.array([columns["n"], columns["good"], columns["toxic"]], np.int64).T
        rows = [(columns["part"][0], *row) for row in walk(np.array(columns["mask"]), counts)]
        types = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * (len(MEASURES) + 1)
        names = ["part", "filter_order", "step", *MEASURES, "shapley"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return mask_cells(docs, labels).groupBy("part").applyInArrow(run, REPORT)  # a part has 32 cells at most
