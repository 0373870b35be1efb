"""SimHash groups against all pairs."""

import numpy as np
import xxhash

from silverframe.llm import queries as Q
from silverframe.llm import simhash
from silverframe.llm.components import connected_components
from silverframe.llm.simhash import near_duplicates, near_links


def brute_print(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, bits=3):
    vals = sorted({v for _, v in prints})
    up = {v: v for v in vals}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, x in enumerate(vals):
        for y in vals[i + 1 :]:
            if (x ^ y).bit_count() <= bits:
                up[top(y)] = top(x)
    least = {}
    for d, v in prints:
        if d is not None:
            least[top(v)] = min(d, least.get(top(v), d))
    return sorted(((d, f"{v:016x}", least.get(top(v))) for d, v in prints), key=str)


def test_query_matches_all_pairs(spark, sf_dir):
    prints = [(r.doc_id, brute_print(r.text)) for r in Q.table(spark, sf_dir, "documents").collect()]
    assert sorted((tuple(r) for r in Q.op6_simhash(spark, sf_dir).collect()), key=str) == brute_groups(prints)


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (None, "a b c d"), (7, "a b c d"), (7, "A B C D"), (2, "é ü"), (1, "word " * 20000), (4, "x")]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == brute_groups([(d, brute_print(t)) for d, t in rows])
    assert near_duplicates(df.limit(0)).count() == 0


def test_links_with_crowded_buckets(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False))) for b in base for _ in range(12)]
    vals = np.unique(np.concatenate([base, np.array(near)])).astype(np.uint64)
    df = spark.createDataFrame([(int(v),) for v in vals.view(np.int64)], "fp long")
    want = {d: c for d, _, c in brute_groups([(int(v), int(v)) for v in vals])}
    for hot, together in ((20_000, 200_000), (3, 5)):
        monkeypatch.setattr(simhash, "TOGETHER", together)
        links = near_links(df, 3, hot)
        roots = {r.node: r.root for r in connected_components(links).collect()}
        groups = {}
        for v in vals:
            s = int(v.view(np.int64))
            groups.setdefault(roots.get(s, s), set()).add(int(v))
        expect = {}
        for v, c in want.items():
            expect.setdefault(c, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 160)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
