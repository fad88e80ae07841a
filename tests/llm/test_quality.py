import zlib

import numpy as np
import pytest

from remembrix.llm import quality as q


@pytest.fixture(scope="module")
def data():
    return "/root/testdata/sf0.01"


def test_query_and_held_out_accuracy(spark, data):
    rows = {r.doc_id: r for r in q.op9_quality(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(rows) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [i for i in labels if rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i] for i in held]) > 0.95
    other = [i for i in labels if not rows[i].held_out]
    assert np.mean([rows[i].score >= 0.7 for i in other]) > 0.5


def test_features_are_those_of_the_words():
    assert len(q.features(None)) == len(q.features(" \n")) == 0
    assert set(q.features("a b")) == set(q.features("a\n  b "))
    assert set(q.features("The cat")) != set(q.features("the cat"))
    long = "ab cd. " * 400_000
    assert set(q.features(long)) == set(q.features("ab cd. " * 5))


def test_fit_without_both_classes():
    assert q.fit([], np.array([], int)).score(q.features("x")) == pytest.approx(0.5)
    assert q.fit([q.features("x")], np.array([1])).score(q.features("y")) > 0.99


def test_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame([(i, f"good words here {i}" if i % 2 else f"BAD!! JUNK!! {i}!!", 0.5) for i in range(40)] + [(None, None, 0.1), (3, "good words here 3", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = q.train(docs, labels)
    got = docs.select("text", q.scorer(spark, model)(docs.text).alias("score")).collect()
    assert len(got) == 42 and all(r.score > 0.5 for r in got if r.text and "good" in r.text)
    assert q.train(docs.limit(0), labels.limit(0)).score(q.features("x")) == pytest.approx(0.5)


def test_solver_by_its_duality_gap():
    """The weights' objective against the dual bound, both written out."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 60, 12)).astype(np.int32) + 100 * int(y) * (rng.random() < 0.6) for y in rng.integers(0, 2, 120)]
    labels = np.array([int(r.min() >= 100) if rng.random() < 0.9 else int(rng.random() < 0.5) for r in rows])
    scale = rng.normal(1, 0.3, q.BUCKETS)
    w, bias = q.dual_coordinate_descent(rows, labels, scale, rounds=500)
    sign, share = 2 * labels - 1, labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    x = np.zeros((len(rows), q.BUCKETS + 1))
    for i, r in enumerate(rows):
        x[i, r], x[i, -1] = scale[r] / np.sqrt(len(r)), 1
    full = np.r_[w, bias]
    primal = full @ full / 2 + (cost * np.maximum(0, 1 - sign * (x @ full))).sum()
    # dual variables from the weights: least squares within their box is not unique, so descend on them from scratch
    gram, alpha = (x * sign[:, None]) @ (x * sign[:, None]).T, np.zeros(len(rows))
    for _ in range(4000):
        for i in range(len(rows)):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1) / gram[i, i], 0), cost[i])
    dual = alpha.sum() - alpha @ gram @ alpha / 2
    assert dual <= primal + 1e-9 and primal - dual <= 0.01 * abs(primal)


def test_log_ratios_by_hand():
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([3])]
    got = q.log_ratios([r.astype(np.int32) for r in rows], np.array([1, 1, 0]))
    n = q.BUCKETS
    for f, one, none in ((1, 1, 0), (2, 2, 0), (3, 1, 1), (4, 0, 0)):
        assert np.isclose(got[f], np.log(((one + 1) / (4 + n)) / ((none + 1) / (1 + n))))


def test_sample_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "good words " * 5 if i % 2 else "BAD!!! " * 5) for i in range(40)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, quality int")
    whole = []
    monkeypatch.setattr(q, "fit", lambda rows, y: whole.append(len(rows)))
    q.train(docs, labels)
    q.train(docs, labels, sample=7)
    monkeypatch.setattr(q, "SAMPLE_BYTES", 10 * 60 * 4)
    q.train(docs, labels)
    open_ = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    assert whole[0] == open_ and whole[1] == 7 and 3 <= whole[2] <= 8
