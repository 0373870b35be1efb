"""Token alignment against both libraries on whole texts and plain counting."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from silverframe.llm import alignment
from silverframe.llm import queries as Q
from silverframe.llm.alignment import PairEncoder, token_alignment

A, B = Q.tokenizer("byte_bpe_50k.json"), Q.tokenizer("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def whole():
    """Tokens (id, bytes) of a whole text by each library, or None."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def encode(text):
        if not text:
            return None
        one = a.encode(f" {text}", add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        joined = [b"".join(x for _, x in side) for side in (left, right)]
        return (left, right) if joined == [f" {text}".encode()] * 2 else None

    return encode


def ends(tokens):
    out, at = [], 0
    for i, x in tokens:
        at += len(x)
        out.append((at, i))
    return out


def brute(docs, whole):
    links, rows = [], []
    for doc_id, text in docs:
        sides = whole(text)
        if sides is None:
            links.append([])
            rows.append((doc_id, 0, 0, 0, ""))
            continue
        a, b = map(ends, sides)
        common = sorted({e for e, _ in a} & {e for e, _ in b})
        groups = [f"{','.join(str(i) for e, i in a if lo < e <= hi)}|{','.join(str(i) for e, i in b if lo < e <= hi)}" for lo, hi in zip([0, *common], common, strict=False)] if len(a) < 3000 else None
        if groups is None:  # the same, in one pass
            where = {e: k for k, e in enumerate(common)}
            sides = []
            for x in (a, b):
                cut, out = [], []
                for e, i in x:
                    cut.append(str(i))
                    if e in where:
                        out.append(",".join(cut))
                        cut = []
                sides.append(out)
            groups = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
        ids_a, ids_b = dict(a), dict(b)
        links.append([(ids_a[e], ids_b[e]) for e in common])
        rows.append((doc_id, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for d in links for x in d)
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [(*r[:4], len(d), sum(count[x] == top[x[1]] for x in d), sum(count[x] for x in d), r[4]) for r, d in zip(rows, links, strict=True)]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_query_matches_the_libraries(spark, sf_dir, whole):
    docs = [tuple(r) for r in Q.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert order(tuple(r) for r in Q.op11_alignment(spark, sf_dir).select(*COLUMNS).collect()) == order(brute(docs, whole))


def test_odd_texts_repeats_nulls_and_clashes(spark, whole, monkeypatch):
    docs = [(1, None), (2, ""), (3, " "), (4, "a"), (4, "a"), (None, "a b"), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "a▁b"), (7, "x" * 300_000), (8, "the same words " * 40_000), (9, "  two  spaces \n\t here  "), (10, "日本語 \U0001f600\U0001f468‍\U0001f469 café é ­\u0000"), (11, "\x1c\x1d \x85 \xa0   x"), (12, "don't 123 4567 '''s ﬁ ①")]
    df = spark.createDataFrame([(*d, "clash", 1, "x") for d in docs], "doc_id long, text string, groups string, row int, kind string").repartition(3)
    want = order(brute(docs, whole))
    assert order(tuple(r) for r in token_alignment(df, A, B).select(*COLUMNS).collect()) == want
    monkeypatch.setattr(alignment, "POSTINGS", 4)
    monkeypatch.setattr(alignment, "BLOCK", 2)
    got = token_alignment(df, A, B, split=3)  # ids dealt to several tasks
    assert order(tuple(r) for r in got.select(*COLUMNS).collect()) == want
    assert {hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "" for r in got.collect()} == {r[-1] for r in want}
    assert token_alignment(df.limit(0), A, B).count() == 0
    assert token_alignment(df.where("doc_id < 3"), A, B).where("n_a + n_links + count_sum > 0").count() == 0


def test_words_by_themselves_equal_whole_texts(whole):
    encoder, draw = PairEncoder(A, B), random.Random(5)
    alphabet = ["a", "b", "th", "ing", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "'s", "'", "7", "42", "é", "́", "中", "\U0001f600", "‍", "<s>", "<|endoftext|>", "\x00", "ﬁ", ".", "A"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 14))) for _ in range(6000)]
    for text, done in zip(texts, [x for i in range(0, 6000, 50) for x in encoder.documents(texts[i : i + 50])], strict=True):
        sides = whole(text)
        assert (done is None) == (sides is None)
        if done:
            a, b = map(ends, sides)
            ids_a, ids_b = dict(a), dict(b)
            assert (done[0].n_a, done[0].n_b) == (len(a), len(b))
            assert done[0].groups.replace(b"|", b";").replace(b";", b",").count(b",") + 1 == len(a) + len(b)
            assert done[1] == Counter(ids_b[e] << 16 | ids_a[e] for e in ids_a.keys() & ids_b.keys())
