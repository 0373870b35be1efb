"""The pipeline's stages against brute-force versions, each on its own input."""

import itertools

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp
from silverframe.llm import pii
from silverframe.llm.near_copies import Bucket, numbered_in
from silverframe.llm import queries as Q
from silverframe.llm import toxicity as tox
from silverframe.llm.simhash import one_per_group
from tests.llm.test_decontamination import grams
from tests.llm.test_simhash import brute_print
from tests.llm.test_tokens import check_pieces, library


def brute_kept(rows):
    """Least ids of the groups linked by three bits of three-word fingerprints or by a five-word similarity of 0.8, all pairs compared."""
    sets = {d: grams(t) for d, t in rows.items()}
    prints = {d: brute_print(t) for d, t in rows.items()}
    up = {d: d for d in rows}

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for x, y in itertools.combinations(sorted(rows), 2):
        a, b = sets[x], sets[y]
        near = a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)
        if near or (prints[x] ^ prints[y]).bit_count() <= 3:
            x, y = sorted((top(x), top(y)))
            up[y] = x
    return {top(d) for d in rows}


def test_every_stage(spark, sf_dir):
    docs = Q.table(spark, sf_dir, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [grams(r.text) for r in Q.table(spark, sf_dir, "benchmark").collect()]
    model = tox.fit(docs, Q.table(spark, sf_dir, "labels"))
    scores = dict(zip(rows, model.probability(tox.WordScores(model).highest(list(rows.values()))), strict=True))
    steps = [cp.drop_toxic, cp.drop_near_duplicates, cp.drop_contaminated, cp.redact_personal_data]
    assert [f for _, f in cp.STAGES[:-1]] == steps
    rows = {d: t for d, t in rows.items() if scores[d] < 0.7}
    docs = cp.materialize(cp.drop_toxic(spark, docs, sf_dir), "t")
    assert {r.doc_id: r.text for r in docs.collect()} == rows
    rows = {d: rows[d] for d in brute_kept(rows)}
    docs = cp.materialize(cp.drop_near_duplicates(spark, docs, sf_dir), "t")
    assert {r.doc_id: r.text for r in docs.collect()} == rows
    rows = {d: t for d, t in rows.items() if not any(i and len(i & grams(t)) >= 0.8 * len(i) - 1e-9 for i in items)}  # every item has five words
    docs = cp.materialize(cp.drop_contaminated(spark, docs, sf_dir), "t")
    assert {r.doc_id: r.text for r in docs.collect()} == rows
    rows = {d: pii.redacted(t, pii.all_spans([t], pii.tagger())[0][1]) for d, t in rows.items()}
    docs = cp.materialize(cp.redact_personal_data(spark, docs, sf_dir), "t")
    assert {r.doc_id: r.text for r in docs.collect()} == rows
    assert docs.columns == Q.table(spark, sf_dir, "documents").columns
    check_pieces(cp.pack(spark, docs, sf_dir).collect(), {d: [t] for d, t in rows.items()}, library("word_bpe_49k.json"), 2048)


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "x"), (None, "x"), (1, None), (2, "")]
    df = spark.createDataFrame([(d, t, "l", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, _row long")
    got = cp.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("1", None), ("7", "a b c d"), ("None", "x")]
    assert cp.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_no_near_copy_stays(spark):
    docs = Q.table(spark, "/root/testdata/sf0.01", "documents")
    words = [f"w{i}" for i in range(200)]
    sparse = [" ".join("x" if i in (20, 60, 100, 140)[:k] else w for i, w in enumerate(words)) for k in range(5)]
    more = spark.createDataFrame([(10_000_000 + k, t, "l", "s", 1) for k, t in enumerate(sparse)], docs.schema)
    before = {r.doc_id: grams(r.text) for r in docs.unionByName(more).collect()}
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, docs.unionByName(more), "").collect()}
    by = {}
    for d in sorted(before):
        for g in before[d]:
            by.setdefault(g, []).append(d)
    pairs = {(x, y) for ds in by.values() if len(ds) <= 60 for i, x in enumerate(ds) for y in ds[i + 1 :]}
    near = {(x, y) for x, y in pairs if len(before[x] & before[y]) >= 0.8 * len(before[x] | before[y])}
    assert len(near) > 5 and not [p for p in near if kept.issuperset(p)]
    assert kept & set(range(10_000_000, 10_000_005)) == {10_000_000}


def test_copies_of_copies_are_linked():
    """Of any rows of a bucket, those linked with each other are those that similarity joins, however long the chain."""
    draw = np.random.default_rng(2)
    for _ in range(60):
        sets = [np.arange(60, dtype=np.uint64)]
        for _ in range(40):
            base = sets[draw.integers(len(sets))].copy()
            base[draw.integers(0, 60, draw.integers(1, 10))] += np.uint64(1000 * draw.integers(1, 50))
            sets.append(np.unique(base))
        order = draw.permutation(len(sets))
        bucket, group = Bucket(0.2), list(range(len(sets)))

        def top(i, group=group):
            while group[i] != i:
                i = group[i]
            return i

        for i in order.tolist():
            for j in bucket.links(i, sets[i]):
                assert len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
                group[top(i)] = top(j)
        for i, j in itertools.combinations(range(len(sets)), 2):
            if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                assert top(i) == top(j)


def test_texts_are_not_shuffled_to_be_filtered(spark):
    """Each filter by row numbers shuffled all texts where its numbers weren't few."""
    numbers = [*range(0, 70_000, 7), *(3 * 2**33 + n for n in (0, 1, 32_767, 32_768, 40_000)), 2**45]
    rows = spark.createDataFrame([(n, "b", n % 5) for n in numbers], "n long, bits string, block int")
    wanted = [n for n in numbers if n % 3 == 0 or n > 2**40] + [1, 2**33]
    kept = numbered_in(rows, "n", spark.createDataFrame([(n,) for n in wanted], "_row long"))
    assert kept.columns == rows.columns and sorted(r.n for r in kept.collect()) == sorted(set(numbers) & set(wanted))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stays = one_per_group(spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, "other words")], "doc_id long, text string"))
        assert sorted(r.doc_id for r in stays.collect()) == [1, 3, 4]
        joins = [x for x in stays._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x]
        assert "BroadcastHashJoin" in joins[0] and "LeftSemi" in joins[0]  # the uppermost, of whole rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
