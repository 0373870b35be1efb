"""Removal of repeated bytes against all windows of the corpus."""

import hashlib
from collections import Counter

import numpy as np

from silverframe.llm import queries as Q
from silverframe.llm import repeats
from silverframe.llm.repeats import merged, without_repeats
from silverframe.llm.suffix_arrays import ShardSuffixes


def brute(docs, width=200):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[i : i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in Q.table(spark, sf_dir, "documents").collect()]
    want = brute(docs)
    assert sum(w[2] for w in want) and got(Q.op9_repeats(spark, sf_dir)) == want


def test_odd_rows_and_spread_anchors(spark):
    rng = np.random.default_rng(11)

    def text(n):
        return "".join(rng.choice(list("abcdefgh é\n"), n))

    shared, line = text(420), text(150)
    rows = [(i, text(int(rng.integers(0, 150))) + shared[int(rng.integers(0, 60)) : 420 - int(rng.integers(0, 60))] + text(100)) for i in range(25)]
    rows += [(100, None), (101, ""), (102, text(199)), (None, shared), (103, shared), (103, shared), (104, line + "x" + line), (105, line * 2 + line), (106, "z" * 900), (107, "ab" * 300 + text(50) + "ab" * 300), (108, text(3000)), (109, shared[:210] + text(30) + shared[-210:])]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(3)
    want = brute(rows)
    for hot in (2000, 3):
        assert got(without_repeats(df, hot=hot)) == want
    assert without_repeats(df.limit(0)).count() == 0


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    blocks = [rng.integers(97, 99, 300, dtype=np.uint8).tobytes(), b"ab" * 150, rng.integers(97, 99, 120, dtype=np.uint8).tobytes(), b"ab" * 40, rng.integers(97, 100, 41, dtype=np.uint8).tobytes()]
    data, depth = np.frombuffer(b"".join(blocks), np.uint8), 40
    raw = data.tobytes()
    counts = np.array([len(b) - depth + 1 for b in blocks])
    begin = np.cumsum([0, *map(len, blocks)])[:-1]
    starts = np.concatenate([b + np.arange(n) for b, n in zip(begin, counts, strict=True)])
    s = ShardSuffixes(data, depth)
    sa = s.order(starts, depth)
    keys = [raw[i : i + depth] for i in sa]
    assert keys == sorted(keys)
    lcp = s.common_prefixes(sa, begin, counts, depth)
    assert lcp[0] == 0
    for a, b, n in zip(sa, sa[1:], lcp[1:], strict=False):
        assert n == next((k for k in range(depth) if raw[a + k] != raw[b + k]), depth)


def test_merging_of_sorted_runs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        runs, rows, at = [], [], 0
        for _ in range(rng.integers(1, 6)):
            run = sorted({(int(x), int(y)) for x, y in rng.integers(0, 6, (rng.integers(0, 12), 2))})
            runs.append(np.arange(at, at + len(run)))
            rows, at = rows + run, at + len(run)
        f1, f2 = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        seen, order = np.zeros(len(rows), bool), runs[0]
        for run in runs[1:]:
            order = merged(order, run, f1, f2, seen)
        assert sorted(order) == list(range(len(rows))) and (np.diff(f1[order]) >= 0).all()
        assert seen.tolist() == [rows.count(r) > 1 for r in rows]


def test_long_texts_in_pieces(spark):
    """A text of 20 MB with known repeats."""
    rng = np.random.default_rng(5)
    big = rng.integers(33, 127, 20_000_000, dtype=np.uint8)
    for at in (1_000, 524_000, 9_999_990, 19_999_600):
        big[at : at + 300] = big[5_000_000:5_000_300]
    big[[999, 1_300, 523_999, 524_300, 4_999_999, 5_000_300, 9_999_989, 10_000_290, 19_999_599, 19_999_900]] = np.arange(40, 50)  # copies go no further
    text = big.tobytes().decode()
    df = spark.createDataFrame([(1, text), (2, text[:400]), (3, "x" * 100)], "doc_id long, text string")
    kept = {r.doc_id: r for r in without_repeats(df).collect()}
    assert kept[2].n_removed == 400 and kept[3].n_removed == 0
    gone = np.zeros(len(big), bool)
    gone[:400] = True
    for at in (1_000, 524_000, 5_000_000, 9_999_990, 19_999_600):
        gone[at : at + 300] = True
    assert (kept[1].n_bytes, kept[1].n_removed, kept[1].n_spans) == (len(big), 1_900, 6)
    assert kept[1].kept_sha256 == hashlib.sha256(big[~gone].tobytes()).hexdigest()


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 101, n, dtype=np.uint8).tobytes() for n in (0, 199, 200, 699, 700, 701, 898, 899, 900, 1399, 1400, 5000, 3)]
    doc, start, windows, g, _ = repeats.text_blocks(texts, 200)
    got = sorted((d, s + k) for d, s, w in zip(doc.tolist(), start.tolist(), windows.tolist(), strict=True) for k in range(w))
    assert got == [(d, k) for d, t in enumerate(texts) for k in range(len(t) - 199)]
    by = {}
    for d, s, w, a in zip(doc.tolist(), start.tolist(), windows.tolist(), g.tolist(), strict=True):
        for k in range(w):
            assert by.setdefault(texts[d][s + k : s + k + 200], a) == a
