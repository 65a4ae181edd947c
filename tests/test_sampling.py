import random

import pytest
from pyspark.sql import Window, functions as F

from fathomix.operators import sampling
from fathomix.operators.skew import lookup_join


@pytest.fixture(scope="module")
def skewed(spark):
    """One dataset with well over a third of the rows, with gaps and far-off row numbers."""
    random.seed(7)
    rows = [("hot", i) for i in random.sample(range(3000), 900)] + [("hot", 10**9 + 1), ("hot", 10**9 + 5)]
    rows += [(f"d{i % 40}", i) for i in range(1200)]
    random.shuffle(rows)
    return spark.createDataFrame(rows, "dataset_id string, row_idx long").repartition(7).cache()


def by_window(rows, order="row_idx"):
    w = Window.partitionBy("dataset_id").orderBy(order)
    return rows.withColumn("position", F.row_number().over(w) - 1)


@pytest.mark.parametrize("block_rows", [1, 16, 1000, sampling.BLOCK_ROWS])
def test_position_in_blocks_equals_one_window(skewed, rows_of, block_rows):
    got = sampling.with_position(skewed, block_rows=block_rows)
    assert rows_of(got, "dataset_id", "row_idx", "position") == rows_of(by_window(skewed))


def test_no_task_sees_more_than_a_block(skewed):
    blocked = skewed.withColumn("b", sampling._block("row_idx", 64))
    assert blocked.groupBy("dataset_id", "b").count().agg(F.max("count")).first()[0] <= 64


@pytest.mark.parametrize("step", [1, 2, 7, 100_000])
def test_thin_keeps_the_first_and_every_nth(skewed, rows_of, step):
    got = sampling.thin(skewed, step, block_rows=50)
    expected = by_window(skewed).filter(F.col("position") % step == 0).drop("position")
    assert rows_of(got) == rows_of(expected)
    counts = skewed.groupBy("dataset_id").count().collect()
    assert got.count() == sum(-(-r["count"] // step) for r in counts)


def test_thin_refuses_steps_below_one(skewed):
    with pytest.raises(ValueError, match="step"):
        sampling.thin(skewed, 0)


def test_thin_of_one_needs_no_shuffle(skewed):
    assert sampling.thin(skewed, 1) is skewed


def test_dense_row_index_equals_one_window(skewed, rows_of):
    # Many rows share a time; the tie-break makes the order total.
    timed = skewed.withColumn("time", F.floor(F.col("row_idx") / 500)).withColumnRenamed("row_idx", "id")
    got = sampling.dense_row_index(timed, ["time", "id"])
    expected = by_window(timed.withColumn("o", F.struct("time", "id")), "o").drop("o")
    assert rows_of(got, "dataset_id", "id", "row_idx") == rows_of(expected, "dataset_id", "id", "position")


@pytest.mark.parametrize("block_rows", [1, 10, 10_000])
def test_last_known_before_equals_one_window(skewed, rows_of, block_rows):
    marked = skewed.withColumn("v", F.when(F.xxhash64("row_idx") % 5 == 0, F.col("row_idx").cast("string")))
    got = sampling.last_known_before(marked, "v", ["dataset_id"], "row_idx", "before", block_rows)
    w = Window.partitionBy("dataset_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    expected = marked.withColumn("before", F.last("v", ignorenulls=True).over(w))
    assert rows_of(got, "dataset_id", "row_idx", "v", "before") == rows_of(expected)


def test_sparse_row_numbers_are_made_dense_first(skewed, rows_of, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_BLOCKS", 3)
    blocks = sampling._keyed(skewed, ["dataset_id"]).groupBy(
        "_keys", sampling._block("row_idx", 2).alias("_block")
    ).agg(F.count("*").alias("_rows"))
    assert sampling._poor_blocks(blocks, 2)
    got = sampling.with_position(skewed, block_rows=2)
    assert rows_of(got, "dataset_id", "row_idx", "position") == rows_of(by_window(skewed))
    marked = skewed.withColumn("v", F.when(F.col("row_idx") % 7 == 0, F.col("row_idx").cast("string")))
    monkeypatch.setattr(sampling, "MAX_BLOCKS", 30)
    got = sampling.last_known_before(marked, "v", ["dataset_id"], "row_idx", "before", 40)
    w = Window.partitionBy("dataset_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    assert rows_of(got, "dataset_id", "row_idx", "v", "before") == rows_of(marked.withColumn("before", F.last("v", ignorenulls=True).over(w)))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, skewed, rows_of, how):
    dim = spark.createDataFrame([("hot", 1), ("d3", 2), ("d3", 3), ("none", 4)], "dataset_id string, v int")
    salted = lookup_join(skewed, dim, ["dataset_id"], how, broadcast_rows=2, key_rows=20)
    assert rows_of(salted) == rows_of(skewed.join(dim, "dataset_id", how))
    plan = salted._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_lookup_join_broadcasts_only_what_fits(spark, skewed):
    dim = spark.range(10).select(F.concat(F.lit("d"), "id").alias("dataset_id"))
    small = lookup_join(skewed, dim, ["dataset_id"])._jdf.queryExecution().optimizedPlan().toString()
    large = lookup_join(skewed, dim, ["dataset_id"], broadcast_rows=9)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in small and "broadcast" not in large
    with pytest.raises(ValueError, match="right"):
        lookup_join(skewed, dim, ["dataset_id"], "right")


def test_salts_spread_the_hot_key(skewed):
    shares = skewed.filter("dataset_id = 'hot'").groupBy(F.pmod(F.xxhash64("dataset_id", "row_idx"), F.lit(8))).count()
    assert shares.count() == 8


def test_unique_cap_and_preview(spark, rows_of, monkeypatch):
    found = spark.createDataFrame([("b", 2), ("a", 5), ("b", 1), ("c", 3)], "dataset_id string, rank int")
    unique = sampling.unique_results(found, ["dataset_id"])
    assert rows_of(unique) == [("a", 5), ("b", 1), ("c", 3)]
    for direct in (10_000, 0):
        monkeypatch.setattr(sampling, "DIRECT_LIMIT", direct)
        assert rows_of(sampling.first_ranked(unique, 2)) == [("b", 1, 0), ("c", 3, 1)]
    shown = sampling.preview(unique, 2, ["rank"])
    assert rows_of(shown) == [("b", 1, 3, 1), ("c", 3, 3, 1)]
    with pytest.raises(ValueError, match="cap"):
        sampling.first_ranked(unique, 0)


@pytest.fixture
def with_nulls(spark):
    rows = [("a", 0), ("a", 1), ("a", 5), (None, 0), (None, 1), (None, 3), ("b", None), ("b", 2), ("c", None)]
    return spark.createDataFrame(rows, "dataset_id string, row_idx long").repartition(3)


def test_null_keys_and_numbers_are_kept_on_every_path(with_nulls, rows_of, monkeypatch):
    blocks = rows_of(sampling.with_position(with_nulls, block_rows=2))
    monkeypatch.setattr(sampling, "MAX_BLOCKS", 0)
    dense = rows_of(sampling.with_position(with_nulls, block_rows=2))
    assert blocks == dense and len(blocks) == 9
    assert (None, 3, 2) in blocks and ("b", None, 0) in blocks and ("b", 2, 1) in blocks


@pytest.mark.parametrize("step, kept", [(1, 9), (2, 6), (100, 4)])
def test_thin_counts_null_keys_as_a_dataset(with_nulls, step, kept):
    assert sampling.thin(with_nulls, step).count() == kept


def test_last_known_keeps_null_keys(spark, rows_of):
    rows = spark.createDataFrame([(None, 0, "x"), (None, 1, None), (None, 2, None), ("k", 0, None)],
                                 "c string, t long, v string")
    got = sampling.last_known_before(rows, "v", ["c"], "t", "before", block_rows=2)
    assert rows_of(got, "c", "t", "before") == sorted(
        [(None, 0, None), (None, 1, "x"), (None, 2, "x"), ("k", 0, None)], key=repr)


def test_wide_lookups_are_not_broadcast(spark):
    from fathomix.operators.skew import fits_broadcast

    paths = spark.range(1000).select("id", F.array_repeat(F.repeat(F.lit("x"), 1000), 100).alias("path"))
    assert not fits_broadcast(paths)
    assert fits_broadcast(paths.select("id"))


def test_numbering_moves_the_rows_once(skewed):
    """One exchange for the rows and one for the counts; the small counts are then broadcast."""
    plan = sampling.with_position(skewed, block_rows=64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Exchange SinglePartition" not in plan


def test_pages_are_cut_by_rank(spark, rows_of, monkeypatch):
    found = spark.createDataFrame([("b", 2), ("a", 5), ("c", 3), ("d", 9)], "dataset_id string, rank int")
    for direct in (10_000, 0):
        monkeypatch.setattr(sampling, "DIRECT_LIMIT", direct)
        assert rows_of(sampling.first_page(found, 2)) == [("b", 2), ("c", 3)]
        assert rows_of(sampling.first_page(found, 9)) == rows_of(found)
    with pytest.raises(ValueError, match="preview"):
        sampling.preview(found, 1_000_000, ["rank"])


def test_many_thin_blocks_are_made_dense(skewed, rows_of, monkeypatch):
    monkeypatch.setattr(sampling, "MANY_BLOCKS", 10)
    called = []
    plain = sampling.dense_row_index
    monkeypatch.setattr(sampling, "dense_row_index", lambda *a: called.append(1) or plain(*a))
    assert rows_of(sampling.with_position(skewed, block_rows=2), "dataset_id", "row_idx", "position") == rows_of(by_window(skewed))
    assert called
