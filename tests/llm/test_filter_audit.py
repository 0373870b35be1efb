"""The filter audit against every order applied in turn, document by document, and against its SQL."""

import itertools
import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from silverframe.llm import queries as Q
from silverframe.llm.filter_audit import adjacent_orders, filter_orders, text_failures

DOCS, LABELS = "doc_id long, text string, lang string, mask string, n int", "doc_id long, quality int, toxic int, text string"


def fails(doc, docs):
    i, text, _ = doc
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 3 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    return out | ({"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set())


def brute(docs, labels):
    """Each order applied to each part, one document after another."""
    failed = [(d[2] or "", fails(d, docs), d[0]) for d in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    out, removed = [], Counter()
    for part, order in itertools.product({p for p, _, _ in failed}, itertools.permutations("ABCDE")):
        left = [(f, i) for p, f, i in failed if p == part]
        everyone = left
        for step, letter in enumerate(order, 1):
            gone = [(f, i) for f, i in left if letter in f]
            left = [(f, i) for f, i in left if letter not in f]
            redundant = sum(letter in f for f, _ in everyone) - len(gone)
            removed[part, letter] += len(gone)
            out.append((part, "".join(order), step, len(left), len(gone), redundant, sum(f == {letter} for f, _ in everyone), sum(i in good for _, i in gone), sum(i in bad for _, i in gone)))
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


def found(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    docs = [tuple(r) for r in Q.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in Q.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()]
    got = found(Q.op12_filter_orders(spark, sf_dir))
    assert got == brute(docs, labels)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert got == sorted(con.sql(Q.oracle_sql()["op12_filter_orders"]).fetchall())


def test_nulls_copies_ties_labels_and_clashing_columns(spark):
    long, wide = "word " * 90_000 + "#", " ".join(f"w{i}" for i in range(250))
    docs = [(1, "a", "en"), (2, "a", None), (2, "a", "en"), (1, "a", ""), (3, None, "en"), (4, "", "fr"), (5, long, "en"), (6, long, "en"), (7, wide, "fr"), (8, wide + " É ÀB", "fr"), (None, "a", "en"), (None, wide, None), (9, " x\x1cy\x0bz", "en"), (10, "X" * 7 + "é" * 200, "en"), (11, wide, "fr"), (11, wide, "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (5, 1, None), (7, 0, 0), (None, 1, 1), (11, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], DOCS).repartition(3)
    marks = spark.createDataFrame([(*x, "clash") for x in labels], LABELS)
    assert found(filter_orders(df, marks)) == brute(docs, labels)
    assert found(filter_orders(df, marks.limit(0))) == brute(docs, [])
    assert found(filter_orders(df.limit(0), marks)) == []


def test_many_copies_shrink_before_the_shuffle(spark):
    df = spark.range(3000).selectExpr("id + 5 AS doc_id", "'same text' AS text", "if(id % 3 = 0, 'de', 'en') AS lang")
    rows = {(r.part, r.step, r.filter_order): r for r in filter_orders(df, spark.createDataFrame([], LABELS)).collect()}
    assert (rows["de", 1, "EABCD"].removed, rows["en", 1, "EABCD"].removed, rows["de", 2, "EABCD"].removed) == (999, 2000, 1)


def test_orders_are_all_and_each_is_one_swap_from_the_last():
    for size in range(1, 6):
        seen = [(tuple(o), s) for o, s in adjacent_orders(size)]
        assert sorted(o for o, _ in seen) == sorted(itertools.permutations(range(size)))
        for (a, _), (b, s) in itertools.pairwise(seen):
            assert b == a[:s] + (a[s + 1], a[s]) + a[s + 2 :]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAéÉ #|\t\x0b\x1c\x85 \U0001f600Z"), max_size=60))
def test_masks_of_odd_texts(text):
    letters = fails((1, text, ""), [])
    assert {c for i, c in enumerate("ABCDE") if text_failures(text.encode()) >> i & 1} == letters
