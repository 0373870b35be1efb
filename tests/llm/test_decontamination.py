"""Decontamination against exact containment of every pair."""

import duckdb

from silverframe.llm import queries as Q
from silverframe.llm.decontamination import contaminated, without_contaminated


def grams(text, n=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({b" ".join(w)} if w else set())


def brute(docs, items, t=0.8):
    out = []
    for i, x in items:
        n = min(5, len((x or "").encode().split()))
        a = grams(x, n or 5)
        out += [(d, i, len(a), len(a & grams(y, n))) for d, y in docs if a and len(a & grams(y, n)) >= t * len(a) - 1e-9]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect()), key=str)


def test_query_matches_brute_force_and_sql(spark, sf_dir):
    docs = [tuple(r) for r in Q.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in Q.table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert want and got(Q.op8_decontamination(spark, sf_dir)) == want
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    assert sorted((tuple(r[:4]) for r in con.sql(Q.oracle_sql()["op8_decontamination"]).fetchall()), key=str) == want


def test_odd_rows_and_blocks(spark):
    item = "a b c d e f g h i j k l m n o p"
    gap = item.replace(" p", " q")  # 11 of 12 shingles
    far = item.replace(" h", " x")  # 7 of 12
    filler = " ".join(f"w{i}" for i in range(30000))
    docs = [(1, f"{filler} {item.upper()}\n{filler}"), (2, gap), (3, far), (4, None), (None, item), (5, ""), (6, "short one"), (1, item), (7, "z " * 500 + "short one")]
    items = [(10, item), (11, None), (12, ""), (13, "short one"), (None, item), (14, item), (15, filler)]
    d = spark.createDataFrame([(i, x, "clash") for i, x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 40):
        assert got(contaminated(d, b, block_bytes=size)) == brute(docs, items)
        kept = without_contaminated(d, b, block_bytes=size)
        bad = {d for d, *_ in brute(docs, items)}
        assert {6, 7} <= bad
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - bad
    assert contaminated(d.limit(0), b).count() == 0 and contaminated(d, b.limit(0)).count() == 0
