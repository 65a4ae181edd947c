import math
import random
import zlib
from collections import Counter

import pytest

from fathomix.llm import kneser_ney, quality


def plain_scores(docs, trained):
    """The model's formulas over dictionaries of tokens."""
    texts = [(d, (t or "").encode().lower().split() + ["end"]) for d, t in docs]
    pairs, single, begun = Counter(), Counter(), 0
    for (_, words), use in zip(texts, trained):
        if use:
            begun += 1
            single.update(words)
            pairs.update(zip(["begin", *words], words))
    total = {w: n for w, n in single.items() if w != "end"} | {"begin": begun}
    kinds = [Counter() for _ in range(3)]
    left = Counter()
    for (h, w), n in pairs.items():
        kinds[min(n, 3) - 1][h] += 1
        left[w] += 1
    d = [0, *kneser_ney.discounts([sum(v == k for v in pairs.values()) for k in (1, 2, 3, 4)])]
    e = [0, *kneser_ney.discounts([sum(v == k for v in left.values()) for k in (1, 2, 3, 4)])]
    size, n_all = len(single), sum(single.values())
    freed = sum(e[min(v, 3)] for v in left.values()) / len(pairs) if pairs else 1

    def low(w):
        return (max(left[w] - e[min(left[w], 3)], 0) / len(pairs) if pairs else 0) + freed / (size + 1)

    def share(h, w):
        if not total.get(h):
            return low(w)
        n = pairs[h, w]
        mass = sum(d[k + 1] * kinds[k][h] for k in range(3)) / total[h]
        return max(n - d[min(n, 3)], 0) / total[h] + mass * low(w)

    rows = {}
    for doc, words in texts:
        base = sum(math.log10((single[w] + .5) / (n_all + .5 * (size + 1))) for w in words)
        score = sum(math.log10(share(h, w)) for h, w in zip(["begin", *words], words))
        rows.setdefault(doc, []).append((len(words), sum(single[w] > 0 for w in words), base, score))
    vocabulary = [*single, "never seen"]
    for h in ["begin", "a1", "nowhere"]:
        assert sum(share(h, w) for w in vocabulary) == pytest.approx(1)
    return rows, n_all


def check(docs, frame, monkeypatch, block=200):
    monkeypatch.setattr(kneser_ney, "BLOCK_TOKENS", block)
    trained = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in docs]
    expected, tokens = plain_scores(docs, trained)
    got = kneser_ney.scores(frame, quality.fold(folds=5) != 1).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.train_tokens == tokens
        assert any(
            (r.n_tokens, r.n_known) == (n, k) and r.base_score == pytest.approx(b) and r.score == pytest.approx(s)
            for n, k, b, s in expected[r.doc_id]), r


def test_scores_equal_the_plain_model(documents, monkeypatch):
    random.seed(5)
    words = [f"a{int(random.paretovariate(0.8))}" for _ in range(4000)]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 60)))) for i in range(120)]
    check(docs, documents(docs).repartition(3), monkeypatch)


def test_odd_rows(odd, empty, monkeypatch):
    from tests.llm.conftest import ODD

    check(ODD, odd, monkeypatch, block=10)
    assert kneser_ney.scores(empty, quality.fold(folds=5) != 1).count() == 0


def test_without_training_texts_every_word_is_the_unknown_one(documents):
    from pyspark.sql import functions as F

    got = kneser_ney.scores(documents([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}


def test_packed_arrays_come_back(monkeypatch):
    import numpy as np

    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (kneser_ney.unpack_sorted(kneser_ney.pack_sorted(values)) == values).all()
    numbers = np.array([0, 1, 255, 256, 2**32 - 1])
    assert (kneser_ney.unpack_numbers(kneser_ney.pack_numbers(numbers)) == numbers).all()
    bounds = kneser_ney.shard_bounds(values, 7)
    assert bounds[0] == 0 and bounds[-1] == len(values) and (np.diff(bounds) > 0).all()


def test_blocks_leave_no_table_in_the_catalog(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    assert kneser_ney.scores(documents([(1, "a b"), (2, "a c")]), quality.fold(folds=5) != 1).count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before
