"""Top-k against full scoring."""

import math
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from silverframe.llm import queries as Q
from silverframe.llm import topk
from silverframe.llm.topk import top_k


def brute(rows, ids, k):
    """rows: (vec_id, vector); ids: the query ids, each of whose rows is a query and no candidate for itself."""
    vec = [(i, [math.floor(1024 * Fraction(c)) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for at, (q, x) in enumerate(vec):
        if q in ids:
            hold = lambda s: min(max(s, -(2**63) + 1), 2**63 - 1)
            scored = sorted((-hold(sum(a * b for a, b in zip(x, y, strict=False))), i) for n, (i, y) in enumerate(vec) if n != at)
            before = sum(i == q and (y, n) < (x, at) for n, (i, y) in enumerate(vec))
            out += [(q, n + 1, i, -s, before + 1) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_query_matches_full_scores_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in Q.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in Q.op7_topk(spark, sf_dir).collect())
    assert got == brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.sql(Q.oracle_sql()["op7_topk"]).fetchall())


def test_ties_nulls_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(40)] + [(100, None), (101, [None, 1.0]), (102, [nan, 1.0]), (103, [inf, 0.0]), (104, []), (105, [-3.0, 2.5]), (106, [3000000.0, -1.0]), (107, [2.0]), (108, [1e13, -0.3]), (109, [-3e30, 2e30]), (110, [1e30, 1e-30]), (7, [2.0, -1.5]), (111, [0.25, 1.0]), (111, [0.25, 1.0]), (112, [1.5e12, 7.0]), (113, [1.0, 4.0]), (113, [0.5, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    rows = [(i, x and [c and float(np.float32(c)) for c in x]) for i, x in rows]
    ids = [0, 7, 100, 103, 104, 105, 106, 107, 108, 109, 110, 111, 113]
    for size in (32 << 20, 40):
        got = top_k(df, F.col("vec_id").isin(ids), k=5, wave_bytes=size)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, ids, 5)
    few = df.where("vec_id in (0, 105)")
    assert sorted(tuple(r) for r in top_k(few, F.lit(True), k=5).collect()) == brute(rows[:1] + [(105, [-3.0, 2.5])], [0, 105], 5)
    one = df.where("vec_id = 105")
    assert top_k(one, F.lit(True)).count() == 0
    assert top_k(df.limit(0), F.lit(True)).count() == 0


def test_queries_from_elsewhere_and_waves_of_short_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 4)]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(3, [1.0])], df.schema)
    assert [r.vec_id for r in top_k(df, asked, k=5).orderBy("rank").collect()] == [3, 7, 11, 15, 19]
    waves = []
    made = topk.Wave.__init__
    monkeypatch.setattr(topk.Wave, "__init__", lambda self, ids, *rest: (waves.append(len(ids)), made(self, ids, *rest))[1])
    assert top_k(df, F.lit(True), k=5, wave_bytes=8 * (topk.BINS + 1) * 8).count() == 100
    assert waves == [8, 8, 4]
