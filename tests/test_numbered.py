import random
import uuid

import pytest
from pyspark.sql import functions as F

from fathomix.operators.sampling import thin
from fathomix.sources import numbered


@pytest.fixture(scope="module")
def observations(spark):
    draw = random.Random(3)
    rows = [(None if d == 7 else f"d{d}", i * 3, draw.random() if draw.random() < 0.8 else None)
            for d in range(12) for i in range(400 if d == 0 else draw.randint(0, 60))]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "dataset_id string, row_idx long, temp double")


@pytest.fixture(scope="module")
def store(observations, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    return path, numbered.write_numbered(observations, path, f"t_{uuid.uuid4().hex}", parts=4, buckets=3, block_rows=32)


@pytest.mark.parametrize("step", [1, 2, 7, 50, 1000])
def test_thinning_equals_thin(store, observations, rows_of, step):
    names = ("dataset_id", "row_idx")
    assert rows_of(numbered.thin_all(store[1], step), *names) == rows_of(thin(observations, step), *names)
    some = numbered.thin_stored(store[1].rows.filter("temp > 0.3"), step)
    assert rows_of(some, *names) == rows_of(thin(observations.filter("temp > 0.3"), step), *names)


def test_no_row_is_shuffled(spark, store):
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = store[1].rows.filter("temp > 0.3")
        plan = numbered.thin_stored(rows, 5)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in numbered.thin_all(store[1], 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    # Whatever moves is counts per block: every exchange is above a scan of those alone.
    observed = plan.index("temp#")
    above = plan[:observed].count("Exchange")
    counted = plan[observed:].count("Exchange")
    assert "_local" in plan and above == 0, plan
    assert counted <= 2, plan


def test_datasets_read_their_folders_only(spark, store, observations, rows_of):
    asked = spark.createDataFrame([("d1",), (None,), ("unknown",), ("d1",)], "dataset_id string")
    found = store[1].of_datasets(asked)
    expected = observations.filter("dataset_id = 'd1' OR dataset_id IS NULL")
    assert rows_of(found, "dataset_id", "row_idx") == rows_of(expected, "dataset_id", "row_idx")
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_blocks_and_reopening(spark, store, rows_of):
    path, made = store
    again = numbered.open_numbered(spark, path, f"t_{uuid.uuid4().hex}")
    names = ("dataset_id", "row_idx", "position", "store_block")
    assert rows_of(again.rows, *names) == rows_of(made.rows, *names)
    firsts = made.blocks.join(made.rows, ["store_key", "store_block"]).groupBy("store_key", "store_block").agg(
        F.min("position").alias("p"), F.first("first").alias("f"), F.count("*").alias("n"), F.first("n_rows").alias("m"))
    assert firsts.filter("p <> f OR n <> m").count() == 0
    plan = numbered.thin_stored(again.rows, 3)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    with pytest.raises(ValueError):
        numbered.thin_stored(again.rows, 0)


def test_empty_table(spark, observations, tmp_path):
    made = numbered.write_numbered(observations.limit(0), str(tmp_path / "s"), f"t_{uuid.uuid4().hex}", parts=2, buckets=2)
    assert numbered.thin_stored(made.rows, 3).count() == 0 and numbered.thin_all(made, 3).count() == 0
