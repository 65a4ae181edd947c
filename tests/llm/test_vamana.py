import numpy as np
import pytest

from fathomix.llm import vamana


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows],
                                 "vec_id long, embedding array<float>, shard string")


def exact(rows, every, k):
    used = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for q, a in used:
        if q % every == 0:
            scored = sorted((-(a @ b) / np.sqrt((a @ a) * (b @ b)), i) for i, b in used if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [300, 5000])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    rows = [(i, centres[i % 20] + rng.normal(size=24) * 0.5) for i in range(2000)]
    got = vamana.nearest(frame(spark, rows), every=20, k=5, shard_rows=shard_rows).collect()
    expected = exact(rows, 20, 5)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == set(expected) and all(len(v) == 5 for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.95 * 5 * len(expected)
    lookup = dict(rows)
    for q, answers in found.items():
        assert [s for _, s in answers] == sorted((s for _, s in answers), reverse=True)
        for i, s in answers:
            a, b = (np.array(lookup[x], np.float32).astype(float) for x in (q, i))
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_copies_are_returned_by_id(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1, 2, 3, 4]) for i in range(400)] + [(400 + i, rng.normal(size=4)) for i in range(200)]
    got = [r for r in vamana.nearest(frame(spark, rows), every=100, k=5, shard_rows=150).collect()]
    for q in (0, 100, 200, 300):
        answers = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert answers == [i for i in range(7) if i != q][:5]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [0, 0]), (2, None), (3, [nan, 1]), (4, [inf, 1]), (5, [None, 1]), (6, [1, 1, 1]),
            (None, [1, 0]), (50, [1e-30, 0]), (7, [0, 2]), (7, [0, 2]), (100, [])]
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in vamana.nearest(frame(spark, rows)).collect()}
    assert got == {(0, 1): (50, 1.0), (0, 2): (7, 0.0), (0, 3): (7, 0.0), (50, 1): (0, 1.0), (50, 2): (7, 0.0), (50, 3): (7, 0.0)}
    assert vamana.nearest(frame(spark, [(0, [1, 0])])).count() == 0
    assert vamana.nearest(frame(spark, [])).count() == 0


def test_pruning_keeps_the_nearest_and_diverse_ones():
    angles = np.array([0, 0.1, 0.2, 0.25, np.pi / 2, -0.3])
    points = np.stack([np.cos(angles), np.sin(angles)], axis=1).astype(np.float32)
    kept = vamana.pruned(points, np.array([0]), np.array([[1, 2, 3, 4, 5, 5, -1, 0]]), 3, 1.2)[0]
    assert kept[0] == 1 and 5 in kept and 2 not in kept and 3 not in kept


def test_scores_at_any_magnitude(spark):
    import math

    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 10.0 ** p).tolist()) for i, p in enumerate([200, -200, 0, 300, -300, 150, -160, 1] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in vamana.nearest(df, every=10, k=5).collect()}
    assert len(got) == 20

    def plain(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return math.fsum(x * y for x, y in zip(a, b)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(x * x for x in b))

    vectors = dict(rows)
    for q in range(0, 40, 10):
        best = sorted(((-plain(vectors[q], vectors[i]), i) for i in vectors if i != q))[:5]
        for score, i in best:
            assert got[q, i] == pytest.approx(-score, abs=1e-12)
