"""Alignment of two tokenizers over a corpus, by a cogroup of postings on one side's ids.

Both tokenizers see the same bytes, a space and the text. Offsets at which a token of each ends cut the tokens into groups, and the
two tokens that end there are linked. How often a pair of ids is linked in the whole corpus, and whether that is the most for its
B id, needs the corpus; all the rest needs one document. So the work is

1. one scan that encodes each document twice and writes its totals, and its *postings*: how often the document
   links which ids, in blocks of bounded size that belong to one B id;
2. counts of id pairs, added up in each task before they are shuffled;
3. a cogroup on the B id: counts and postings are dealt by it and sorted (Spark spills what doesn't fit), so a task
   streams an id's counts, takes their maximum, and then works off its postings block by block;
4. document contributions, added up in each task, shuffled in blocks of documents and added up by document.

An id with many postings is dealt to several tasks by ``split``, each with that id's counts; only ids, at
most as many as the vocabulary has, are broadcast.

Neither vocabulary joins text over the end of a word: the byte-level one splits there before merging, and no piece of the
other has its space sign after another character. So each distinct word is encoded and aligned once per worker and
remembered within a bound; beyond the bound it is done again. A vocabulary for which that isn't so is used on whole texts.

Texts that are null, empty or not given back by the joined tokens (the space sign itself in a text) have no tokens. Rows are what is
counted: repeated rows, ids and null ids count for themselves. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm.common import batch_texts, by_bytes, keep_until_exit, shared_dir
from silverframe.llm.tokens import byte_letters

SPACE_SIGN = "▁"
MEMO_ENTRIES, MEMO_LENGTH, BULK, SLICE = 200_000, 64, 500, 1 << 20
POSTINGS, BLOCK, ROWS = 1 << 20, 1 << 10, 1 << 10
_WORD_END, _WHITE_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )"), re.compile(r"\s ")
_LOADED: dict[tuple[str, str], "PairEncoder"] = {}


class Aligned(NamedTuple):
    """Two encodings of one stretch of text."""

    n_a: int
    n_b: int
    groups: bytes  # a1,a2|b1;a3|b2
    links: tuple[int, ...]  # b << 16 | a of the tokens that end together


class PairEncoder:
    """Encodes texts by a byte-level vocabulary (A) and by a piece vocabulary with byte fallback (B), and aligns them."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        raw = {letter: byte for byte, letter in byte_letters().items()}
        self.bytes_a = {i: bytes(map(raw.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        if max(self.bytes_a) >= 1 << 16:
            raise ValueError("ids of the first vocabulary must be below 65536")
        self.by_word = not any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in pieces)
        self.sizes_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.sizes_b = np.array(list(map(len, self.bytes_b)))
        most = max(len(self.sizes_a), len(self.sizes_b))
        self.digits = np.array([f"{i:<8}".encode() for i in range(most)]).view(np.uint8).reshape(most, 8)
        self.digit_counts = np.array([len(str(i)) for i in range(most)])
        self.memo: dict[str, Aligned | None] = {}

    def _ids_b(self, text: str) -> list[int]:
        """Ids of a space and ``text``; the library adds that space to all but an empty text."""
        return self.b.encode(text) if text else self.b.encode("a ")[len(self.b.encode("a")) :]

    def aligned(self, text: str) -> Aligned | None:
        """A space and ``text`` by both; None if either's bytes differ from it."""
        whole = f" {text}".encode()
        ids_a, ids_b = self.a.encode(f" {text}", add_special_tokens=False).ids, self._ids_b(text)
        parts_a, parts_b = [self.bytes_a.get(i, b"") for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return None
        groups, links = [], []
        i = j = first_i = first_j = end_a = end_b = 0
        while i < len(ids_a) or j < len(ids_b):
            if end_a <= end_b:
                end_a += len(parts_a[i])
                i += 1
            else:
                end_b += len(parts_b[j])
                j += 1
            if end_a == end_b:
                groups.append(f"{','.join(map(str, ids_a[first_i:i]))}|{','.join(map(str, ids_b[first_j:j]))}")
                links.append(ids_b[j - 1] << 16 | ids_a[i - 1])
                first_i, first_j = i, j
        return Aligned(len(ids_a), len(ids_b), ";".join(groups).encode(), tuple(links))

    def _bulk(self, words: list[str]) -> list[Aligned] | None:
        """:meth:`aligned` of many words, which stand behind each other in one text; None if either's bytes differ from it."""
        text = " ".join(words)
        whole = f" {text}".encode()
        ids_a, ids_b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != whole or b"".join(map(self.bytes_b.__getitem__, ids_b)) != whole:
            return None
        a, b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        # a group's A ids and then its B ids
        place_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
        place_b = np.arange(len(b)) + last_a[group_b] + 1
        ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        signs[place_a[last_a]], signs[place_b[last_b]] = ord("|"), ord(";")
        rows, sizes = self.digits[ids], self.digit_counts[ids]
        rows[np.arange(len(ids)), sizes] = signs
        written = rows[np.arange(rows.shape[1]) <= sizes[:, None]].tobytes()
        # each word ends with a group
        last = np.searchsorted(common, np.cumsum([len(w.encode()) + 1 for w in words]))
        cuts = np.append(0, np.cumsum(sizes + 1)[place_b[last_b[last]]]).tolist()
        n_a, n_b = (np.diff(x[last] + 1, prepend=0).tolist() for x in (last_a, last_b))
        links, firsts = (b[last_b] << 16 | a[last_a]).tolist(), np.append(0, last + 1).tolist()
        return [Aligned(x, y, written[i : j - 1], tuple(links[f:t])) for x, y, i, j, f, t in zip(n_a, n_b, cuts, cuts[1:], firsts, firsts[1:], strict=False)]

    def encoded(self, words: list[str]) -> dict[str, Aligned | None]:
        """:meth:`aligned` of each word. Those that end with a sign other than white space can stand before another."""
        found: dict[str, Aligned | None] = {}
        plain = [w for w in words if self.by_word and w and not w[-1].isspace()]
        for i in range(0, len(plain), BULK):
            some = plain[i : i + BULK]
            found.update(zip(some, self._bulk(some) or map(self.aligned, some), strict=True))
        return found | {w: self.aligned(w) for w in words if w not in found}

    def words(self, text: str) -> list[str]:
        """The stretches of a space and ``text`` that are encoded by themselves, each without its first space."""
        if not self.by_word:
            return [text]
        spaced = f" {text}"
        return [w[1:] for w in _WORD_END.split(spaced)] if _WHITE_BEFORE_SPACE.search(spaced) else text.split(" ")

    def documents(self, texts: list[str]) -> list[tuple[Aligned, Counter] | None]:
        """Each whole text's alignment (its links left out) and how often it has which link; None without tokens."""
        words = [self.words(t) if t and SPACE_SIGN not in t else [] for t in texts]
        memo, distinct = self.memo, set().union(*words)
        known = {w: memo[w] for w in distinct if w in memo}
        new = self.encoded([w for w in distinct if w not in known])
        for w in itertools.islice(new, max(0, MEMO_ENTRIES - len(memo))):
            if len(w) <= MEMO_LENGTH:
                memo[w] = new[w]
        known |= new
        out: list[tuple[Aligned, Counter] | None] = []
        for some in words:
            found = [known[w] for w in some]
            if not found or None in found:
                out.append(None)
                continue
            n_a, n_b, groups, links = zip(*found, strict=True)
            out.append((Aligned(sum(n_a), sum(n_b), b";".join(groups), ()), Counter(itertools.chain.from_iterable(links))))
        return out


def pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    """One encoder per pair of vocabulary files and worker process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = PairEncoder(path_a, path_b)
    return _LOADED[path_a, path_b]


DOCUMENT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
POSTING = "b int, postings int, rows binary, a binary, times binary"
_TYPES = [("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())]
_TYPES += [("b", pa.int32()), ("postings", pa.int32()), ("rows", pa.binary()), ("a", pa.binary()), ("times", pa.binary())]


def _batch(kind: str, columns: dict) -> pa.RecordBatch:
    """A batch of documents or of postings; the columns of the other kind are null."""
    size = len(next(iter(columns.values())))
    arrays = [pa.array([kind] * size), *(pa.array(columns[n], t) if n in columns else pa.nulls(size, t) for n, t in _TYPES)]
    return pa.RecordBatch.from_arrays(arrays, ["kind", *(n for n, _ in _TYPES)])


def _posting_blocks(rows: np.ndarray, links: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """Postings sorted by B id and cut into blocks of one id and of at most ``BLOCK`` postings."""
    order = np.argsort(links, kind="stable")
    rows, links, times = rows[order], links[order], times[order]
    b = links >> 16
    starts = np.flatnonzero(np.diff(b, prepend=-1))
    sizes = np.diff(starts, append=len(b))
    cuts = np.concatenate([np.arange(s, s + n, BLOCK) for s, n in zip(starts, sizes, strict=True)])
    ends = np.append(cuts[1:], len(b))
    a = (links & 0xFFFF).astype("<u2")
    blobs = {n: [x[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)] for n, x in (("rows", rows.astype("<i8")), ("a", a), ("times", times.astype("<i4")))}
    return _batch("postings", {"b": b[cuts].astype(np.int32), "postings": (ends - cuts).astype(np.int32), **blobs})


def _scan(docs: DataFrame, path_a: str, path_b: str, groups: bool) -> DataFrame:
    """Rows of both kinds. ``row`` numbers the documents of a task after the task's own number."""

    def run(batches):
        encoder = pair_encoder(path_a, path_b)
        row = TaskContext.get().partitionId() << 36
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for part in by_bytes(batch, limit=SLICE):
                found = []
                for doc_id, done in zip(part.column("doc_id").to_pylist(), encoder.documents(batch_texts(part)), strict=True):
                    row += 1
                    if done is None:
                        found.append((row, doc_id, 0, 0, 0, 0, "", ""))
                        continue
                    whole, links = done
                    n = links.total()
                    found.append((row, doc_id, whole.n_a, whole.n_b, n, n, hashlib.sha256(whole.groups).hexdigest(), whole.groups.decode() if groups else ""))
                    held.append((np.full(len(links), row), np.fromiter(links.keys(), np.int64, len(links)), np.fromiter(links.values(), np.int64, len(links))))
                    size += len(links)
                    if size >= POSTINGS:
                        yield _posting_blocks(*map(np.concatenate, zip(*held, strict=True)))
                        held, size = [], 0
                if found:
                    yield _batch("documents", dict(zip((n for n, _ in _TYPES), zip(*found, strict=True), strict=False)))
        if held:
            yield _posting_blocks(*map(np.concatenate, zip(*held, strict=True)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"kind string, {DOCUMENT}, {POSTING}")


def pair_counts(postings: DataFrame) -> DataFrame:
    """(b, a, n): how many links of the corpus hold the two ids linked."""

    def run(batches):
        links, times = np.empty(0, np.int64), np.empty(0, np.int64)

        def summed(parts):
            link, place = np.unique(np.concatenate([links, *(p[0] for p in parts)]), return_inverse=True)
            total = np.zeros(len(link), np.int64)
            np.add.at(total, place, np.concatenate([times, *(p[1] for p in parts)]))
            return link, total

        def rows():
            return pa.RecordBatch.from_arrays([pa.array((links >> 16).astype(np.int32)), pa.array((links & 0xFFFF).astype(np.int32)), pa.array(times)], ["b", "a", "n"])

        for batch in batches:
            b = np.repeat(batch.column("b").to_numpy().astype(np.int64) << 16, batch.column("postings").to_numpy())
            a = np.frombuffer(b"".join(batch.column("a").to_pylist()), "<u2")
            n = np.frombuffer(b"".join(batch.column("times").to_pylist()), "<i4")
            links, times = summed([(b | a, n.astype(np.int64))])
            if len(links) > 4 * POSTINGS:
                yield rows()
                links, times = links[:0], times[:0]
        yield rows()

    parts = postings.select("b", "postings", "a", "times").mapInArrow(run, "b int, a int, n long")
    return parts.groupBy("b", "a").agg(F.sum("n").alias("n"))


def _contributions(counts: DataFrame, postings: DataFrame, split: int) -> DataFrame:
    """What each B id's links add to documents, in blocks of ``ROWS`` documents, several of each, from the cogroup on the B id."""
    # an entry for each id of the B vocabulary at most
    shares = F.broadcast(postings.groupBy("b").agg(F.ceil(F.sum("postings") / split).cast("int").alias("shares")))
    left = counts.join(shares, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("side"), "a", "n", *(F.lit(None).cast("binary").alias(c) for c in ("rows", "as", "times")))
    share = F.pmod(F.xxhash64("rows", "b"), F.col("shares")).cast("int")
    right = postings.join(shares, "b").select("b", share.alias("share"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("long").alias("n"), "rows", F.col("a").alias("as"), "times")
    both = left.unionByName(right).repartition("b", "share").sortWithinPartitions("b", "share", "side")

    def run(batches):
        count, filled = np.zeros(1 << 16, np.int64), np.empty(0, np.int64)
        key, most = None, 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def sums():
            row, best, total = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(row, kind="stable")
            row, best, total = row[order], best[order], total[order]
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            row, best, total = row[starts], np.add.reduceat(best, starts), np.add.reduceat(total, starts)
            cuts = np.flatnonzero(np.diff(row // ROWS, prepend=-1))
            ends = np.append(cuts[1:], len(row))
            blobs = [pa.array([x[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary()) for x in ((row % ROWS).astype("<u2"), best.astype("<i8"), total.astype("<i8"))]
            return pa.RecordBatch.from_arrays([pa.array(row[cuts] // ROWS), *blobs], ["block", "rows", "n_best", "count_sum"])

        for batch in batches:
            b, share, side = (batch.column(c).to_numpy() for c in ("b", "share", "side"))
            kind = b.astype(np.int64) << 32 | share.astype(np.int64) << 1 | side
            cuts = np.flatnonzero(np.diff(kind, prepend=-1))
            for i, j in zip(cuts, np.append(cuts[1:], len(kind)), strict=True):
                if key != kind[i] >> 1:
                    count[filled] = 0
                    key, most, filled = kind[i] >> 1, 0, np.empty(0, np.int64)
                if side[i] == 0:
                    a, n = (batch.column(c).slice(i, j - i).to_numpy() for c in ("a", "n"))
                    count[a] = n
                    most, filled = max(most, int(n.max())), np.concatenate([filled, a])
                    continue
                row, a, m = (np.frombuffer(b"".join(batch.column(c).slice(i, j - i).to_pylist()), t) for c, t in (("rows", "<i8"), ("as", "<u2"), ("times", "<i4")))
                n = count[a]
                held.append((row, np.where(n == most, m, 0).astype(np.int64), m * n))
                size += len(row)
                if size >= POSTINGS:
                    yield sums()
                    held, size = [], 0
        if held:
            yield sums()

    return both.mapInArrow(run, "block long, rows binary, n_best binary, count_sum binary")


def _by_document(contributions: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): contributions added up, block after block of documents."""

    def run(batches):
        current, sums, seen = None, np.zeros((2, ROWS), np.int64), np.zeros(ROWS, bool)

        def rows():
            at = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays([pa.array(current * ROWS + at), *map(pa.array, sums[:, at])], ["row", "n_best", "count_sum"])

        for batch in batches:
            for block, at, *values in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "n_best", "count_sum")), strict=True):
                if block != current:
                    if current is not None:
                        yield rows()
                    current, sums[:], seen[:] = block, 0, False
                at = np.frombuffer(at, "<u2")
                seen[at] = True
                for total, more in zip(sums, values, strict=True):
                    total[at] += np.frombuffer(more, "<i8")
        if current is not None:
            yield rows()

    return contributions.repartition("block").sortWithinPartitions("block").mapInArrow(run, "row long, n_best long, count_sum long")


def token_alignment(docs: DataFrame, path_a: str, path_b: str, groups: bool = True, split: int = 1 << 20) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, unless ``groups`` is off, groups.

    ``path_a`` is a byte-level vocabulary of ``tokenizers``, ``path_b`` a ``sentencepiece`` model; strings of special tokens are plain text.
    n_best: links whose pair is the commonest of its B id in the corpus, ties included; count_sum: the corpus-wide counts of
    the pairs, added up over links; groups: ``a1,a2|b1;a3|b2``. ``split`` is the number of postings from which an id is
    dealt to more tasks. The scan's rows are written to the shared folder once, so a lost executor costs a re-read.
    """
    spark = docs.sparkSession
    path = keep_until_exit(spark, f"{shared_dir(spark)}/silverframe/alignment-{uuid.uuid4().hex}")
    _scan(docs, path_a, path_b, groups).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    written = spark.read.schema(f"{DOCUMENT}, {POSTING}, kind string").parquet(path)
    postings = written.where("kind = 'postings'")
    found = _by_document(_contributions(pair_counts(postings), postings, split))
    sums = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256", *(["groups"] if groups else [])]
    return written.where("kind = 'documents'").join(found, "row", "left").select(*columns)
