import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomix.operators import constraints, discovery
from fathomix.operators.constraints import Bounds
from fathomix.operators.conversation import latest_entries
from fathomix.operators.skew import lookup_join

REQUEST = "min_time string, max_time string, min_lat double, max_lat double, min_lon double, max_lon double"
START = datetime(2021, 3, 1)


@pytest.fixture(scope="module")
def observations(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), i, START + timedelta(minutes=draw.randint(0, 5000)) if i % 11 else None,
             draw.uniform(-20, 20) if i % 13 else None, draw.uniform(100, 140)) for i in range(600)]
    return spark.createDataFrame(rows, "dataset_id string, row_idx long, time timestamp_ntz, lat double, lon double")


@pytest.fixture(scope="module")
def requests(spark):
    draw = random.Random(2)

    def moment():
        return (START + timedelta(minutes=draw.randint(-500, 5500))).isoformat() + "Z"

    rows = [(i, draw.choice(["a", "b", None, "unknown"]), *(moment() if draw.random() < 0.7 else None for _ in "ab"),
             *(draw.uniform(-25, 25) if draw.random() < 0.7 else None for _ in "ab"),
             *(draw.uniform(95, 145) if draw.random() < 0.7 else None for _ in "ab")) for i in range(80)]
    rows += [(100, "a", "soon", None, None, None, None, None), (101, "a", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, f"request_id int, dataset_id string, {REQUEST}")


def coverage(spark, blank):
    times = ("", "") if blank else (START.isoformat() + "Z", (START + timedelta(minutes=4000)).isoformat() + "Z")
    return spark.createDataFrame([(d, *times, -18.0, 18.0, 101.0, 139.0) for d in ("a", "b", None)],
                                 "dataset_id string, time_start string, time_end string, lat_min double, lat_max double, "
                                 "lon_min double, lon_max double")


@pytest.mark.parametrize("blank", [True, False])
def test_many_requests_equal_one_by_one(spark, observations, requests, blank, monkeypatch):
    resolved = constraints.bound_requests(requests, coverage(spark, blank))
    bounds = {r["request_id"]: r for r in constraints.typed_bounds(resolved, keep=["request_id"]).collect()}
    assert {i for i, r in bounds.items() if r["status"] == "no_coverage"} == {
        r["request_id"] for r in requests.filter("dataset_id = 'unknown'").collect()}
    expected = []
    for r in observations.collect():
        for i, b in bounds.items():
            timed = (b["from_time"] is None or (r["time"] is not None and r["time"] >= b["from_time"])) and (
                b["to_time"] is None or (r["time"] is not None and r["time"] <= b["to_time"]))
            if b["status"] == "ok" and b["dataset_id"] == r["dataset_id"] and timed and r["lat"] is not None and (
                    b["from_lat"] <= r["lat"] <= b["to_lat"] and b["from_lon"] <= r["lon"] <= b["to_lon"]):
                expected.append((i, r["row_idx"]))
    assert len(expected) > 500
    for bins in (1, 8, 200):
        monkeypatch.setattr(constraints, "WINDOW_BINS", bins)
        found = constraints.rows_for_requests(observations, resolved)
        assert found.columns[:5] == observations.columns
        assert sorted((r["request_id"], r["row_idx"]) for r in found.collect()) == sorted(expected)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_no_requests_and_no_rows(spark, observations, requests):
    resolved = constraints.bound_requests(requests, coverage(spark, True))
    assert constraints.rows_for_requests(observations.limit(0), resolved).count() == 0
    assert constraints.rows_for_requests(observations, resolved.limit(0)).count() == 0


def test_unknown_datasets_are_listed(spark, requests):
    resolved = constraints.bound_requests(requests, coverage(spark, True))
    listed = {(r["dataset_id"], r["reason"]) for r in constraints.unreadable_bounds(resolved).collect()}
    assert listed == {("unknown", "the dataset has no coverage"), ("a", "from_time soon cannot be read")}


def test_rows_without_a_dataset_are_a_dataset(spark, observations):
    cover = coverage(spark, True)
    found = constraints.rows_in_bounds(observations, constraints.coverage_bounds(cover))
    inside = observations.filter("lat BETWEEN -18 AND 18 AND lon BETWEEN 101 AND 139")
    assert found.count() == inside.count() and found.filter("dataset_id IS NULL").count() > 50


def test_null_keys_meet_in_salted_joins(spark):
    rows = spark.createDataFrame([(None, i) for i in range(50)] + [("x", 1)], "k string, i int")
    lookup = spark.createDataFrame([(None, "n"), ("x", "v"), ("y", "w")], "k string, name string")
    for limits in ({"broadcast_rows": 10}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "key_rows": 7}):
        joined = lookup_join(rows, lookup, ["k"], nulls=True, **limits)
        assert sorted((r["name"], r["i"]) for r in joined.collect()) == sorted([("n", i) for i in range(50)] + [("v", 1)])
        assert lookup_join(rows, lookup, ["k"], "left_anti", nulls=True, **limits).count() == 0
        assert lookup_join(rows, lookup, ["k"], **limits).count() == 1


def test_regions_equal_single_searches(spark):
    draw = random.Random(8)

    def box():
        sides = []
        for low, high in ((-100, 100), (-200, 200)):
            a = draw.uniform(low, high)
            size = draw.choice([0, 0.01, 3, 40, 400])
            sides += [a if draw.random() < 0.8 else None, a + size if draw.random() < 0.8 else None]
        if draw.random() < 0.1:
            sides[0], sides[1] = sides[1], sides[0]
        return sides

    def times():
        a = draw.randint(0, 40)
        return [START + timedelta(days=a), START + timedelta(days=a + draw.randint(0, 20))] if draw.random() < 0.8 else [None, None]

    index = spark.createDataFrame(
        [(str(i), i, *times(), *box()) for i in range(120)],
        "dataset_id string, rank long, time_min timestamp_ntz, time_max timestamp_ntz, lat_min double, lat_max double, "
        "lon_min double, lon_max double")
    asked = []
    for i in range(60):
        low, high = times()
        asked.append((i, draw.choice([None, "", "soon", low and low.isoformat()]), high and high.isoformat(), *box()))
    regions = spark.createDataFrame(asked, f"region_id int, {REQUEST}")
    found = discovery.search_regions(index, regions)
    expected = []
    for i, *bounds in asked:
        expected += [(i, r["rank"]) for r in discovery.search_index(index, bounds=Bounds(*bounds)).collect()]
    assert sorted((r["region_id"], r["rank"]) for r in found.collect()) == sorted(expected)
    assert len(expected) > 300
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_datasets_without_coverage_meet_open_regions_only(spark, monkeypatch):
    index = spark.createDataFrame(
        [(str(i), i, None, None, None, None, None, None) for i in range(50)] + [("half", 50, START, None, None, 9.0, 1.0, None)],
        "dataset_id string, rank long, time_min timestamp_ntz, time_max timestamp_ntz, lat_min double, lat_max double, "
        "lon_min double, lon_max double")
    asked = [(i, None, None, float(i), None, None, None) for i in range(50)] + [
        (50, None, None, None, None, None, None), (51, None, "2030-01-01", 3.0, None, None, 2.0), (52, "soon", None, None, None, None, None),
        (53, None, None, 200.0, -200.0, None, None)]
    found = discovery.search_regions(index, spark.createDataFrame(asked, f"region_id int, {REQUEST}"))
    got = sorted((r["region_id"], r["dataset_id"]) for r in found.collect())
    assert got == sorted([(50, str(i)) for i in range(50)] + [(i, "half") for i in (*range(10), 50, 51)])
    # No pair is made for a region and a dataset that cannot meet.
    asked = spark.createDataFrame(asked[:50], f"region_id int, {REQUEST}")
    joined = []
    monkeypatch.setattr(discovery, "lookup_join", lambda *a, **k: joined.append(lookup_join(*a, **k)) or joined[-1])
    assert discovery.search_regions(index.limit(50), asked).collect() == []
    assert joined and sum(pairs.count() for pairs in joined) == 0


def test_regions_of_one_cell_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(discovery, "SIDE", 10)
    monkeypatch.setattr(discovery, "TASK_PAIRS", 100)
    index = spark.createDataFrame(
        [(str(i), i, START, START, *((float("nan"), float("nan")) if i == 7 else (-80.0, 80.0 - i)), -170.0, 170.0) for i in range(90)],
        "dataset_id string, rank long, time_min timestamp_ntz, time_max timestamp_ntz, lat_min double, lat_max double, "
        "lon_min double, lon_max double")
    asked = [(i, None, None, -90.0 if i % 2 else None, None if i % 3 else 90.0, -180.0, 180.0) for i in range(110)]
    found = discovery.search_regions(index, spark.createDataFrame(asked, f"region_id int, {REQUEST}"))
    got = [(r["region_id"], r["rank"], r["p"]) for r in found.withColumn("p", F.spark_partition_id()).collect()]
    # NaN is above all numbers: no given end in the north reaches it.
    assert sorted(g[:2] for g in got) == [(i, k) for i in range(110) for k in range(90) if k != 7 or i % 3]
    parts = [g[2] for g in got]
    assert max(parts.count(p) for p in set(parts)) < len(got) / 8


def test_an_update_without_a_sequence_is_the_oldest(spark):
    rows = spark.createDataFrame([("k", "v", None), ("m", "old", None), ("m", "new", 1), ("m", "newer", 2)], "k string, v string, s int")
    got = {r["k"]: (r["v"], r["s"]) for r in latest_entries(rows, ["k"], "s").collect()}
    assert got == {"k": ("v", None), "m": ("newer", 2)}
