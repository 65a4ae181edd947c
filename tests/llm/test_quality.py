import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomix.llm import quality


def test_trees_learn_and_walk_like_single_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.NAMES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] < -0.2)).astype(float)
    forest = quality.fit(x[:2000], y[:2000], trees=60)
    score = forest.score(x[2000:])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.95
    for row, expected in zip(x[2000:2010], score):
        odds = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while forest.feature[t, node] >= 0 and node < 15:
                below = row[forest.feature[t, node]] <= forest.threshold[t, node]
                node = forest.left[t, node] if below else forest.right[t, node]
            odds += forest.value[t, node]
        assert 1 / (1 + np.exp(-odds)) == pytest.approx(expected)


@pytest.fixture
def labelled(spark, documents):
    random.seed(0)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(300):
        text = " ".join(random.choices(words, k=80)) + "."
        rows.append((i, text if i % 4 else " ".join(w + "!!" for w in text.upper().split())))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    return documents(rows), labels


def test_held_out_rows_are_told_apart(labelled):
    rows = quality.scores(*labelled).collect()
    assert len(rows) == 300 and {r.held_out for r in rows} == {True, False}
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(quality.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    assert first == {r.doc_id: r.score for r in quality.scores(docs, turned).collect()}


def test_the_sample_is_bounded(labelled, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or quality.Forest(
        *[np.zeros((0, 1))] * 5, 0.0, 0))
    quality.scores(*labelled, sample_rows=50).count()
    assert 30 <= seen[0] <= 50


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.scores(odd, none).collect()
    assert len(rows) == 10 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    odd_labels = spark.createDataFrame([(2, 0), (2, None), (None, 1), (7, 1), (3, 0), (8, 1)], "doc_id long, quality int")
    rows = quality.scores(odd, odd_labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert quality.scores(empty, odd_labels).count() == 0
    assert quality.keep_good(odd, none).count() == 10
    assert quality.keep_good(odd, none).columns == odd.columns
    bad = spark.createDataFrame([(i, 0) for i in range(9)], "doc_id long, quality int")
    assert quality.keep_good(odd, bad).count() == 0


def test_statistics_are_finite():
    for text in (b"", b"\n\n", b"a", b"\xc3\xa9" * 5, b"a\tb\r\n" * 1000):
        found = quality.statistics(text)
        assert len(found) == len(quality.NAMES) and np.isfinite(found).all()
