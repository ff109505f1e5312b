"""The factorisation machine: identity against all pairs, held-out accuracy, and edge cases."""

import itertools
import random

import numpy as np
import pytest

from spanfit.llm.quality import BUCKETS, RANK, STATS, Model, features, fit, quality_filter, quality_report, score, sigmoid


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        bad = k % 4 == 0
        w = r.choices(words, k=r.choice([20, 80]))
        rows.append((k, " ".join(f"{x}$$$" if bad else x for x in w) + ("" if bad else "."), k, "x"))
        labels.append((k, int(not bad)))
    rows += [(1000, None, None, "x"), (1001, "", None, "x"), (1002, "z " * 40_000, 1, None), (None, "w1 w2.", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string").selectExpr("*", "1 AS label", "2 AS row", "3 AS label_id"), spark.createDataFrame([*labels, (None, 1), (3, None), (5, 1), (99999, 0)], "doc_id long, quality int")


def test_identity_is_all_pairs():
    rng = np.random.default_rng(0)
    m = Model(0.3, rng.normal(size=BUCKETS + STATS), rng.normal(size=(BUCKETS + STATS, RANK)) * 0.3, np.zeros(STATS), np.ones(STATS))
    buckets, stats = features(b"One two, three 4 five!\nsix")
    z = m.standard(np.array([stats]))
    x = {**{int(b): 1 / np.sqrt(len(buckets)) for b in buckets}, **{BUCKETS + k: v for k, v in enumerate(z[0])}}
    want = 0.3 + sum(m.w[i] * v for i, v in x.items()) + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    assert np.isclose(m.raw(buckets, np.array([len(buckets)]), z)[0], want)
    assert len(stats) == STATS and len(features(b"")[1]) == STATS


def test_report_and_filter(spark, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in quality_report(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.where("doc_id < 900 and quality is not null").collect()}
    held = [r for i, r in got.items() if r.held_out and i in truth]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == docs.count()
    again = {r.doc_id: r.score for r in quality_report(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(np.isclose(again[i], r.score) for i, r in got.items())
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_nothing_to_learn_or_score(corpus):
    docs, labels = corpus
    assert fit(docs, labels.limit(0)) is None
    assert {r.s for r in score(docs, None, "s").collect()} == {0.5}
    assert quality_report(docs.limit(0), labels).count() == 0 and quality_filter(docs.limit(0), labels).count() == 0
    assert fit(docs, labels, max_train=50) is not None and sigmoid(np.array([-900.0, 900.0])).tolist() == [0, 1]


def test_held_out_rows_of_the_sample_are_ranked(spark):
    """On real tables: area under the curve of held-out rows, and how many are right."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_report(docs, labels).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 20 and len(bad) > 5
    area = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert area >= 0.98 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.9
