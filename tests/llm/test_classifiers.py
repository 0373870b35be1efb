"""Held-out accuracy of the toxicity and quality classifiers, their folds and odd rows."""

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silverframe.llm import quality as quality_op
from silverframe.llm import queries as Q
from silverframe.llm import toxicity as toxicity_op
from silverframe.llm import string_kernel as sk
from silverframe.llm.labelled import labelled_sample


@pytest.mark.parametrize(("query", "label", "folds", "left", "threshold"), [(Q.op2_toxicity, "toxic", 3, 1, 0.7), (Q.op4_quality, "quality", 5, 0, 0.3)])
def test_queries_over_whole_tables(spark, query, label, folds, left, threshold):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    assert len(rows) == Q.table(spark, sf, "documents").count()
    labels = {r.doc_id: r[label] for r in Q.table(spark, sf, "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == left)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(p == y for p, y in held) / len(held)
    assert right > (0.9 if label == "toxic" else 0.97), right


def test_kernel_tolerates_gaps_and_insertions():
    plain = ["^idiot$"]
    near = sk.landmark_kernel(["^idiot$", "^i.d.i.o.t$", "^idioot$", "^xidiotx$", "^thereof$"], plain)[:, 0]
    assert near[2] > 0.4 and near[3] > 0.2 and near[1] > 0.02 and near[4] < 0.02 and near[0] == max(near)
    assert sk.words("you i d i o t now") == ["you", "idiot", "now"]


def test_kernel_against_all_subsequences():
    def brute(w):
        out = {}
        for n, base in sk.LENGTHS.items():
            for at in itertools.combinations(range(len(w)), n):
                if all(b - a <= max(sk.REACH) for a, b in itertools.pairwise(at)):
                    out.setdefault("".join(w[i] for i in at), []).append(base * sk.DECAY ** (at[-1] - at[0] - n + 1))
        return out

    a, b = "^abcab$", "^xaybcab$"
    left, right = brute(a), brute(b)
    norm = [math.sqrt(sum(x * x for v in side.values() for x in v)) for side in (left, right)]
    want = sum(sum(v) * sum(right[u]) for u, v in left.items() if u in right) / norm[0] / norm[1]
    assert sk.landmark_kernel([b], [a])[0, 0] == pytest.approx(want, rel=1e-3)
    table = np.zeros(sk.SLOTS)
    for _, slot, weight in sk.feature_blocks([a]):
        np.add.at(table, slot[0], weight)
    assert sk.table_scores([b], table)[0] == pytest.approx(want, rel=1e-3)


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "hello there."), (4, "x" * 100000), (5, "word " * 30000), (5, "word " * 30000), (6, "🙂 ñ 日本語 . ! a b c")]
    return spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")


def test_odd_rows_and_labels(spark):
    df = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    mixed = spark.createDataFrame([(2, 1, 0), (5, 0, 1), (6, 1, 0), (None, 1, 1), (4, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    for op in (toxicity_op.toxicity, quality_op.quality):
        for labels in (none, mixed):
            rows = op(df, labels).collect()
            assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
            same = [r.score for r in rows if r.doc_id == 5]
            assert same[0] == same[1]
        assert op(df.limit(0), none).count() == 0
    model = toxicity_op.fit(df, none)
    kept = toxicity_op.with_scores(df, model, "p")
    assert kept.columns == [*df.columns, "p"] and kept.where(F.col("p") >= 0.7).count() == 0


GAPPED = ["i d i o t", "i.d.i.o.t", "i . d . i . o . t", "idi0t", "id-iot", "stuuupid", "s.t.u.p.i.d", "m0ron", "mo*ron", "xmoronx", "i--d--i--o--t", "ixdxixoxt", "i*_*d*_*i*_*o*_*t", "l0ser", "tr@sh", "clooown", "w0rthless", "sc-um"]


def test_recall_of_insults_and_their_spellings(spark):
    """Held-out rows of sf0.1: every plain insult is found, false alarms stay under one in two hundred, spellings count as the word."""
    sf = "/root/testdata/sf0.1"
    docs, labels = Q.table(spark, sf, "documents"), Q.table(spark, sf, "labels")
    model = toxicity_op.fit(docs, labels)
    held = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    words = toxicity_op.WordScores(model)
    p = model.probability(words.highest([r.text for r in held])) >= 0.7
    plain = re.compile("trash|idiot|pathetic|worthless|scum|loser|stupid|disgusting|moron|clown")
    insulting = np.array([bool(plain.search(r.text)) and r.toxic == 1 for r in held])
    clean = np.array([r.toxic == 0 for r in held])
    assert insulting.sum() > 70 and p[insulting].all()
    assert p[clean].sum() < 0.005 * clean.sum()
    scores = model.probability(words.highest([f"the {g} of that" for g in GAPPED]))
    assert (scores >= 0.7).all(), dict(zip(GAPPED, scores, strict=True))
    assert model.probability(words.highest(["the title of the patio", "a cartoon thereof", ""])).max() < 0.5


def test_spread_words_are_joined():
    for word in ("idiot", "moron", "scum"):
        for sign in ("-", "--", "---", ".", "*_*", "_", "x", "xyz"):
            assert f"^{word}$" in sk.windows(sign.join(word))
        for sign in (" . ", " - ", ". ", " -- ", "  "):
            assert toxicity_op._LETTERS.search(f"you {sign.join(word)} now") and word in sk.words(f"you {sign.join(word)} now")


def test_sample_takes_one_bounded_row_per_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c" * 50), (3, "d"), (4, None), (None, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)], "doc_id long, toxic int")
    got = labelled_sample(docs, labels, "toxic", 1, 5, 10, 20)
    assert len(got) == 2 and {t for t, _ in got} <= {"a", "b", "d"} and ("d", 1) in got


def test_filter_keeps_columns(spark):
    df = odd(spark).withColumn("_toxicity", F.lit("x"))
    model = toxicity_op.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    kept = toxicity_op.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == df.count()
