"""Packing and token codes against the tokenizers library itself."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from silverframe.llm import queries as Q
from silverframe.llm.packing import assemble_sequences, pack_documents
from silverframe.llm.token_codes import SegmentReader, encode_segment, read_codes, tokens_at, write_codes
from silverframe.llm.tokens import encoder

ODD = ["", " ", "  ", "a  b", " a", "a ", "a   b", "a\n  b", "\n \n", "a\xa0 b", "don't it's 's", "<|endoftext|> x", "a<|endoftext|>b", "x <|ENDOFTEXT|> y", "<|startoftext|>", "<|endoftext| >", "é é ½ ²", "日本語 テキスト", "🙂 🙃!!", "ΣΑΣ Σ", "a\x1cb c\x85d"]


def library(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_library_ids(name):
    ids, enc = library(name), encoder(P.path(name))
    for x in ODD:
        assert np.frombuffer(enc.encode(x), "<u4").tolist() == ids(x), x


def odd_docs(spark):
    rows = [(i, x, "clash") for i, x in enumerate(ODD)] + [(100, None, None), (None, "no id", "x"), (101, "long " * 9000, "x"), (0, "", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def check_pieces(rows, texts, ids, seq_len):
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for doc, pieces in docs.items():
        want = [ids(x) + [1] for x in texts[doc]]
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces)
        if len(want) == 1:
            at = 0
            for start, length, crc, n in got:
                assert start == at and n == len(want[0])
                assert crc == zlib.crc32(np.array(want[0][at : at + length], "<u4").tobytes())
                at += length
            assert at == len(want[0])
    for k, pieces in seqs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == seq_len or k == max(seqs) and at <= seq_len
    assert sorted(seqs) == list(range(len(seqs)))
    assert set(docs) == set(texts)


def test_packing_query(spark, sf_dir):
    texts = {r.doc_id: [r.text] for r in Q.table(spark, sf_dir, "documents").collect()}
    check_pieces(Q.op1_packing(spark, sf_dir).collect(), texts, library("word_bpe_49k.json"), 2048)


def test_packing_odd_rows(spark):
    df = odd_docs(spark)
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    pieces = pack_documents(df.repartition(3), P.path("word_bpe_49k.json"), seq_len=64)
    check_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, library("word_bpe_49k.json"), 64)
    whole = assemble_sequences(pieces, seq_len=64).collect()
    for r in whole:
        assert len(r.ids) == (4 * r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 256)
    assert pack_documents(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_segment_random_access():
    rng = np.random.default_rng(1)
    for high in (200, 50_000, 1 << 31):
        ids = rng.integers(0, high, 5000).astype(np.uint32)
        seg = SegmentReader(encode_segment(ids, np.array([0, 10])))
        assert np.array_equal(seg.decode(), ids)
        for i in [0, 1, 511, 512, 513, 4999, *rng.integers(0, 5000, 200)]:
            assert seg.access(int(i)) == ids[i]
        for a, b in ((0, 0), (3, 700), (512, 1024), (4999, 5000)):
            assert np.array_equal(seg.decode(a, b), ids[a:b])
    assert SegmentReader(encode_segment(np.empty(0, np.uint32), np.empty(0))).decode().size == 0


def check_codes(rows, docs, ids):
    at = 0
    for r, (doc, text) in zip(sorted(rows, key=lambda r: r.start), docs, strict=True):
        want = np.array(ids(text) + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_token_codes_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in Q.table(spark, sf_dir, "documents").collect())
    check_codes(Q.op5_token_codes(spark, sf_dir).collect(), docs, library("byte_bpe_50k.json"))


def test_random_access_by_place(spark):
    df = odd_docs(spark).where("doc_id is null or doc_id > 0")
    path = write_codes(df, P.path("byte_bpe_50k.json"), segment_ids=50)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(read_codes(spark, path).collect(), key=lambda r: r.start)])
    places = [0, 1, 49, 50, 51, 100, len(ids) - 1, 7, 7]
    got = {r.place: r.id for r in tokens_at(spark, path, [*places, -1, len(ids)]).collect()}
    assert got == {p: int(ids[p]) for p in places}
    assert tokens_at(spark, path, []).count() == 0
    for f in spark.read.parquet(path).inputFiles():
        held = pq.ParquetFile(f.removeprefix("file://")).metadata
        assert held.num_row_groups == held.num_rows and held.row_group(0).column(held.num_columns - 1).compression == "UNCOMPRESSED"


def test_repeated_ids_have_one_order(spark):
    rows = [(1, t) for t in ("b", "a c", "", "a c", "zz z")] + [(2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {tuple(sorted((r.start, r.doc_id, bytes(r.ids)) for r in read_codes(spark, write_codes(df.repartition(n), P.path("byte_bpe_50k.json"))).collect())) for n in (1, 3, 6)}
    assert len(seen) == 1


def test_token_codes_odd_rows(spark):
    df = odd_docs(spark).where("doc_id is null or doc_id > 0")
    path = write_codes(df, P.path("byte_bpe_50k.json"), segment_ids=50)
    docs = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: -1 if x[0] is None else x[0])
    check_codes(read_codes(spark, path).withColumn("ids_crc32", F.crc32("ids")).collect(), docs, library("byte_bpe_50k.json"))
    assert read_codes(spark, write_codes(df.limit(0), P.path("byte_bpe_50k.json"))).count() == 0
