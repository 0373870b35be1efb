"""Graph search against full scoring: exact where all nodes are seen, recall where they are not."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from silverframe.llm import queries as Q
from silverframe.llm.neighbour_graph import nearest


def brute(rows, asked, k):
    """rows: (vec_id, vector). Each row asked against every other row."""
    vec = [(i, np.array(x, float)) for i, x in rows if i is not None and x and None not in x and np.isfinite(np.array(x, float)).all() and any(x)]
    out = []
    for a, (q, x) in enumerate(vec):
        if asked(q):
            scored = sorted((-float(x[: len(y)] @ y[: len(x)]), i) for b, (i, y) in enumerate(vec) if b != a)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def same(got, want):
    got, want = sorted(got), sorted(want)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-12)


def test_query_recall_and_scores(spark, sf_dir):
    rows = [tuple(r) for r in Q.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    got = [tuple(r) for r in Q.op13_nearest(spark, sf_dir).collect()]
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert len(got) == len(want)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.95 * len(want)
    vector = {i: np.array(x, float) for i, x in rows}
    assert all(abs(vector[q] @ vector[i] - s) < 1e-12 for q, _, i, s in got)


def test_recall_over_several_blocks_of_unequal_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24)) * rng.uniform(0.2, 3, size=(6000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(6)
    got = defaultdict(list)
    for r in nearest(df, F.col("vec_id") % 50 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q in range(0, 6000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:10].tolist()) & set(got[q]))
        assert len(got[q]) == 10
    assert hits >= 0.95 * 1200


def test_copies_ties_nulls_and_clashes(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 3).tolist()) for i in range(200)] + [(i, [1.0, 2.0, 0.0]) for i in range(200, 300)] + [(400, None), (401, []), (402, [0.0, -0.0]), (403, [1.0, None]), (404, [nan]), (405, [inf, 1.0]), (None, [1.0]), (406, [2.0]), (407, [2.0, 0.0]), (408, [-1.0, 5.0, 2.0, 7.0]), (200, [1.0, 2.0, 0.0]), (220, [5.0, 5.0, 5.0]), (220, [-0.0, 3.0])]
    rows = [(i, x and [c if c is None else float(c) for c in x]) for i, x in rows]
    df = spark.createDataFrame([(i, x, 7, "clash") for i, x in rows], "vec_id long, embedding array<double>, node int, x string").repartition(5)
    same([tuple(r) for r in nearest(df, F.col("vec_id") % 20 == 0, k=7).collect()], brute(rows, lambda i: i % 20 == 0, 7))
    few = df.where("vec_id in (406, 408)")
    same([tuple(r) for r in nearest(few, F.lit(True), k=7).collect()], brute([r for r in rows if r[0] in (406, 408)], lambda i: True, 7))
    assert nearest(df.where("vec_id = 406"), F.lit(True)).count() == 0
    assert nearest(df, F.lit(False)).count() == 0
    assert nearest(df.limit(0), F.lit(True)).count() == 0
