from datetime import datetime

import pytest

from fathomix.operators import nested
from fathomix.operators.constraints import Bounds
from fathomix.sources.tables import NESTED_SCHEMA

NAN = float("nan")
# Three, one, one and no observations; the third profile has no latitude.
PROFILES = [
    (datetime(2020, 6, 10), -4.0, 151.0, [(2.5, 27.1, 34.2), (5.0, 26.4, NAN), (7.5, NAN, 34.4)]),
    (datetime(2020, 6, 12, 6), -3.25, 150.0, [(2.5, 27.9, 34.1)]),
    (datetime(2020, 6, 14), NAN, 149.0, [(2.5, 28.3, 34.0)]),
    (datetime(2020, 6, 15), -2.0, 148.0, []),
]
ALL = ["time", "latitude", "longitude", "depth", "temperature"]


@pytest.fixture(scope="module")
def glider(spark):
    return spark.createDataFrame([("d", "drift-3", PROFILES)], NESTED_SCHEMA)


def test_flatten_gives_one_row_per_observation(glider, rows_of):
    flat = nested.flatten(glider, ALL)
    assert flat.columns == ["trajectory", "profile", "obs_no", "time", "lat", "lon", "depth", "temperature"]
    assert rows_of(flat, "profile", "obs_no", "lat", "depth", "temperature") == sorted([
        (0, 0, -4.0, 2.5, 27.1), (0, 1, -4.0, 5.0, 26.4), (0, 2, -4.0, 7.5, None), (1, 0, -3.25, 2.5, 27.9),
        (2, 0, None, 2.5, 28.3)], key=repr)


def test_profile_variables_alone_give_one_row_per_profile(glider, rows_of):
    assert rows_of(nested.flatten(glider, ["latitude"]), "profile", "lat") == [(0, -4.0), (1, -3.25), (2, None), (3, -2.0)]


def test_profile_rows_flatten_like_trajectory_rows(glider, rows_of):
    assert rows_of(nested.flatten(nested.to_profiles(glider), ALL)) == rows_of(nested.flatten(glider, ALL))


def test_several_trajectories(spark, rows_of):
    two = spark.createDataFrame([("d", "north", PROFILES), ("d", "south", PROFILES), ("e", "west", PROFILES)], NESTED_SCHEMA)
    assert nested.flatten(two, ALL).count() == 15
    with pytest.raises(ValueError, match="several"):
        nested.flatten(two, ALL, strict=True)
    assert rows_of(nested.mixed_datasets(two)) == [("d",)]


def test_unknown_variable(glider):
    with pytest.raises(ValueError, match="fake"):
        nested.flatten(glider, ["fake"])


@pytest.mark.parametrize(
    ("bounds", "profiles"),
    [
        (None, [0, 1, 2, 3]),
        (Bounds(min_lat=-3.5), [1, 3]),
        (Bounds(max_lat=90.0), [0, 1, 3]),
        (Bounds(min_lat=-3.0, max_lat=-4.5), [0, 1]),
        (Bounds(min_time="2020-06-15", max_time="2020-06-11"), [0, 1, 2, 3]),
        (Bounds(min_time="2020-06-12", max_time="2020-06-14"), [1, 2]),
        (Bounds(max_time="2020-06-12"), [0]),
        (Bounds(min_lon=149.5), [0, 1]),
    ],
)
def test_bounds_act_on_whole_profiles(glider, bounds, profiles):
    kept = nested.flatten(glider, ["time"], bounds)
    assert sorted(r["profile"] for r in kept.collect()) == profiles
    assert nested.flatten(glider, ALL, bounds).count() == sum(len(PROFILES[p][3]) for p in profiles)


def test_only_the_needed_fields_are_read(spark, glider, tmp_path):
    glider.write.parquet(str(tmp_path / "n"))
    flat = nested.flatten(spark.read.parquet(str(tmp_path / "n")), ["latitude"])
    scan = flat._jdf.queryExecution().executedPlan().toString()
    assert "temperature" not in scan.split("ReadSchema")[1] and "salinity" not in scan.split("ReadSchema")[1]


def test_row_order(glider):
    rows = nested.with_row_order(nested.flatten(glider, ALL)).orderBy("row_idx").collect()
    assert [(r["profile"], r["obs_no"]) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (2, 0)]
