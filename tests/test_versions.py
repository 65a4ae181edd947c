import random

import pytest

from fathomix.operators.conversation import latest_entries
from fathomix.operators.coverage import observed_coverage
from fathomix.sources.tables import read_observations
from fathomix.sources.versions import CoverageView, Registry


def rows(spark, seed, n):
    draw = random.Random(seed)
    return spark.createDataFrame(
        [(draw.choice(["a", "b", None]), i, f"2021-03-{draw.randint(1, 28):02d}T00:00:00Z", draw.choice([None, float("nan"), draw.uniform(-9, 9)]),
          draw.uniform(-9, 9)) for i in range(n)], "dataset_id string, row_idx long, time string, lat double, lon double")


def test_coverage_follows_its_files(spark, tmp_path):
    source, view = tmp_path / "in", CoverageView(spark, str(tmp_path / "in"), str(tmp_path / "view"))

    def same():
        found = sorted(view.coverage().collect(), key=repr)
        assert found == sorted(observed_coverage(read_observations(spark, str(source))).collect(), key=repr)

    with pytest.raises(ValueError):
        view.coverage()
    for part in range(3):
        rows(spark, part, 30).coalesce(1).write.parquet(str(source / f"f={part}"))
    assert view.refresh() == 3
    same()
    assert view.refresh() == 0
    same()
    rows(spark, 9, 5).coalesce(1).write.parquet(str(source / "f=9"))
    rows(spark, 10, 4).coalesce(1).write.mode("overwrite").parquet(str(source / "f=1"))
    assert view.refresh() == 2
    same()
    rows(spark, 11, 0).coalesce(1).write.mode("overwrite").parquet(str(source / "f=0"))
    assert view.refresh() <= 1
    same()
    assert view.refresh() == 0


def test_registry_equals_all_history(spark, tmp_path):
    registry, history = Registry(spark, str(tmp_path / "r"), ("k",), "s"), None
    draw = random.Random(3)
    with pytest.raises(ValueError):
        registry.read()
    for turn in range(6):
        changes = spark.createDataFrame(
            [(draw.choice("abcdef"), turn * 100 + i if draw.random() < 0.8 else None, f"v{turn}-{i}") for i in range(4)],
            "k string, s long, v string")
        changes = latest_entries(changes, ["k"], "s")
        history = changes if history is None else history.unionByName(changes)
        registry.apply(changes)
        if turn in (2, 4):
            registry.compact()
            registry.compact()
        known = {r["k"]: r for r in latest_entries(history.filter("s IS NOT NULL"), ["k"], "s").collect()}
        got = {r["k"]: r for r in registry.read().collect()}
        assert {k: tuple(r) for k, r in known.items()} == {k: tuple(r) for k, r in got.items() if r["s"] is not None}
        assert set(got) == {r["k"] for r in history.select("k").distinct().collect()}
