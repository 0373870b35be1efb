"""Concatenate-and-cut packing of documents into fixed-length token sequences.

The corpus is one long run of ids, cut every ``seq_len`` ids. Pass one tokenizes each document once
and writes ids, the task's partition and the document's offset in it into a shared table; the totals
of the partitions (one number each) are summed up to give every partition its global offset. Pass two
cuts each document at the global multiples of ``seq_len``. Neither pass shuffles: a document's place
follows from its partition's offset, so no key can be hot, and only the very last sequence has padding.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` is kept; repeated rows are
packed once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm.common import batch_texts, by_bytes, drop_table, materialize, table_path
from silverframe.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, is_boundary boolean"


def tokenize_partitions(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """One row per document: ids (16 bits each where the vocabulary allows it) with partition and offset in it."""

    def run(batches):
        enc, part, at = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for piece in by_bytes(batch):
                ids = [np.frombuffer(enc.encode(x) + end, "<u4") for x in batch_texts(piece)]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                wide = [bool(len(x)) and int(x.max()) > 65535 for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(wide),
                        pa.array([x.tobytes() if w else x.astype("<u2").tobytes() for x, w in zip(ids, wide, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "wide", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, wide boolean, ids binary")


def partition_offsets(tokens: DataFrame, size: str = "n_tokens") -> dict[int, int]:
    """Global offset of each partition. Only one total per partition reaches the driver."""
    totals = sorted(tuple(r) for r in tokens.groupBy("part").agg(F.sum(size)).collect())
    return dict(zip([p for p, _ in totals], itertools.accumulate([0, *(int(n) for _, n in totals)]), strict=False))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, seq_len: int = 2048) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most ``seq_len`` ids.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit integers; ``start`` counts the ids of
    the document before it, ``offset`` its place in the sequence; ``is_boundary`` marks records that
    continue into the next sequence or come from the previous one.
    """
    tokens = materialize(tokenize_partitions(docs, tokenizer_path, end_id), "packed-ids")
    base = docs.sparkSession.sparkContext.broadcast(partition_offsets(tokens))  # a number per input partition

    def cut(batches):
        for batch in batches:
            doc, part, begin, size, wide, ids = (batch.column(i) for i in range(6))
            size = size.to_numpy(zero_copy_only=False)
            begin = begin.to_numpy(zero_copy_only=False) + np.array([base.value[p] for p in part.to_pylist()], np.int64)
            first, last = begin // seq_len, (begin + size - 1) // seq_len
            pieces = last - first + 1
            row = np.repeat(np.arange(len(size)), pieces)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[row]
            left = np.maximum(begin[row], seq * seq_len)
            right = np.minimum((begin + size)[row], (seq + 1) * seq_len)
            start = left - begin[row]
            raw, is_wide = ids.to_pylist(), wide.to_pylist()
            values = [np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(raw, is_wide, strict=True)]
            cuts = [values[r][a:b].astype("<u4").tobytes() for r, a, b in zip(row.tolist(), start.tolist(), (right - begin[row]).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row)), pa.array(start), pa.array(right - left), pa.array(cuts, pa.binary()), pa.array(size[row]), pa.array(seq), pa.array(left - seq * seq_len), pa.array(pieces[row] > 1)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_boundary"],
            )

    return tokens.select("doc_id", "part", "part_start", "n_tokens", "wide", "ids").mapInArrow(cut, PIECES)


def assemble_sequences(pieces: DataFrame, pad_id: int = 0, seq_len: int = 2048) -> DataFrame:
    """Whole sequences: ids joined in order of offset and padded to ``seq_len``, except at a power of two.

    A sequence has at most ``seq_len`` pieces, so the lists that are gathered are bounded.
    """
    joined = (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
        .withColumn("body", F.aggregate("p", F.unhex(F.lit("")), lambda acc, x: F.concat(acc, x["ids"])))
    )
    pad = F.when(F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0, 0).otherwise(F.lit(seq_len) - F.col("n_tokens"))
    word = F.unhex(F.lit(pad_id.to_bytes(4, "little").hex()))
    padding = F.aggregate(F.when(pad > 0, F.sequence(F.lit(1).cast("long"), pad)).otherwise(F.array().cast("array<bigint>")), F.unhex(F.lit("")), lambda acc, _: F.concat(acc, word))
    return joined.select("sequence_id", "n_tokens", F.concat("body", padding).alias("ids"))


def drop_ids(pieces: DataFrame) -> None:
    """Remove the token table behind ``pieces`` once they are written."""
    drop_table(pieces.sparkSession, table_path(pieces))
