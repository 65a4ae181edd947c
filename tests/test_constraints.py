from datetime import datetime
from itertools import product

import pytest
from pyspark.sql import functions as F

from fathomix.operators import constraints
from fathomix.operators.constraints import Bounds

COVER = ("2021-03-05T06:00:00Z", "2021-04-20T18:30:00Z", -12.5, 7.25, 101.0, 119.5)
SCHEMA = "dataset_id string, time_start string, time_end string, lat_min double, lat_max double, lon_min double, lon_max double"
REQUEST = "min_time string, max_time string, min_lat double, max_lat double, min_lon double, max_lon double"


@pytest.fixture
def cover(spark):
    return spark.createDataFrame([("buoy-7", *COVER)], SCHEMA)


def changed(**ends):
    names = dict(zip(constraints.RESOLVED_COLUMNS, COVER))
    return tuple({**names, **ends}.values())


def plain_times(low, high):
    """The table-server rule for times, one pair at a time."""
    def whole(text, clock):
        return text if "T" in text or not text[0].isdigit() else text + clock

    first, last = whole(low or COVER[0], "T00:00:00Z"), whole(high or COVER[1], "T23:59:59Z")
    both = first[0].isdigit() and last[0].isdigit()
    return (*COVER[:2], True) if both and first > last else (first, last, False)


def plain_axis(low, high, least, most):
    """The rule for a coordinate: what is missing comes from the coverage, then the ends sort."""
    return tuple(sorted((least if low is None else low, most if high is None else high)))


LOWS = [None, "", "2021-03-05", "2021-04-01", "2021-04-01T12:00:00Z", "2020-12-31", "2021-06-01T00:00:00Z", "now-7days"]
HIGHS = [None, "", "2021-03-05", "2021-04-01", "2021-04-01T12:00:00Z", "2021-03-01T00:00:00Z", "2022-01-01"]
ENDS = [None, -80.0, -12.5, 0.0, 7.25, 33.0]
FAR = [None, -179.0, 101.0, 110.25, 119.5, 170.0]


def test_table_server_rules(spark, cover):
    """Every mix of times, and of ends per coordinate, against the rules written plainly."""
    asked = [(low, high, None, None, None, None) for low, high in product(LOWS, HIGHS)]
    asked += [("2021-04-01", None, a, b, c, d) for (a, b), (c, d) in zip(product(ENDS, ENDS), reversed(list(product(FAR, FAR))))]
    rows = spark.createDataFrame([(i, "buoy-7", *row) for i, row in enumerate(asked)], f"n int, dataset_id string, {REQUEST}")
    got = {r["n"]: r for r in constraints.bound_requests(rows, cover).collect()}
    assert len(got) == len(asked)
    for i, (low, high, a, b, c, d) in enumerate(asked):
        first, last, reset = plain_times(low, high)
        expected = (first, last, *plain_axis(a, b, *COVER[2:4]), *plain_axis(c, d, *COVER[4:]))
        assert tuple(got[i][name] for name in constraints.RESOLVED_COLUMNS) == expected, asked[i]
        assert got[i]["time_reset"] is reset


def test_fixed_request_equals_request_columns(spark, cover):
    bounds = Bounds(min_time="2021-03-20", max_lat=-30.0, min_lon=118.0)
    rows = spark.createDataFrame([("buoy-7", "2021-03-20", None, None, -30.0, 118.0, None)], f"dataset_id string, {REQUEST}")
    one = constraints.resolve_bounds(cover, bounds).select(*constraints.RESOLVED_COLUMNS).first()
    assert one == constraints.bound_requests(rows, cover).select(*constraints.RESOLVED_COLUMNS).first()
    assert tuple(one) == ("2021-03-20T00:00:00Z", COVER[1], -30.0, -12.5, 118.0, 119.5)


def test_no_constraints_leave_coverage_unpadded(spark):
    bare = spark.createDataFrame([("d", "2021-03-05", "2021-04-20", *COVER[2:])], SCHEMA)
    untouched = constraints.coverage_bounds(bare).first()
    assert untouched["to_time"] == "2021-04-20"
    padded = constraints.resolve_bounds(bare, Bounds()).first()
    assert (padded["from_time"], padded["to_time"]) == ("2021-03-05T00:00:00Z", "2021-04-20T23:59:59Z")
    reset = constraints.resolve_bounds(bare, Bounds(min_time="2022-01-01")).first()
    assert (reset["from_time"], reset["to_time"], reset["time_reset"]) == ("2021-03-05", "2021-04-20", True)


def test_requests_join_their_own_dataset(spark, cover, rows_of):
    asked = spark.createDataFrame(
        [(1, "buoy-7", None, None, 2.5, None, None, None), (2, "elsewhere", None, None, 1.0, None, None, None)],
        f"request_id int, dataset_id string, {REQUEST}",
    )
    got = constraints.bound_requests(asked, cover)
    assert rows_of(got, "request_id", "status", "from_lat", "to_lat") == [(1, "ok", 2.5, 7.25), (2, "no_coverage", 1.0, 1.0)]


def test_require_box():
    box = Bounds(min_lat=1.0, max_lat=2.0, min_lon=3.0, max_lon=4.0)
    assert box.require_box() is box
    with pytest.raises(ValueError, match="max_lon"):
        Bounds(min_lat=1.0, max_lat=2.0, min_lon=3.0).require_box()


@pytest.mark.parametrize(
    ("asked", "expected"),
    [
        (Bounds(min_time="2021-01-01", max_time="2021-12-31"), changed()),
        (Bounds(min_time="2021-04-10", max_time="2021-03-10"), changed()),
        (Bounds(min_time="2021-03-08", max_time="2021-03-09"), changed(from_time="2021-03-08T00:00:00Z", to_time="2021-03-09T23:59:59Z")),
        (Bounds(min_lat=50.0, max_lat=-40.0), changed()),
        (Bounds(min_lat=1.5, max_lon=150.0), changed(from_lat=1.5)),
    ],
)
def test_clamped_rules(cover, asked, expected):
    got = constraints.clamp_bounds(cover, asked).select(*constraints.RESOLVED_COLUMNS).first()
    assert tuple(got) == expected


ROWS = [
    ("d", 0, datetime(2021, 3, 6), -10.0, 110.0),
    ("d", 1, datetime(2021, 4, 2, 23, 59, 59), -3.0, 110.0),
    ("d", 2, datetime(2021, 4, 3), 5.0, 110.0),
    ("d", 3, datetime(2021, 3, 15), None, 110.0),
    ("e", 0, datetime(2021, 3, 15), -3.0, 110.0),
]


@pytest.fixture
def observed(spark):
    return spark.createDataFrame(ROWS, "dataset_id string, row_idx long, time timestamp_ntz, lat double, lon double")


@pytest.mark.parametrize("limit", [0, 200_000])
def test_rows_in_bounds_with_and_without_broadcast(spark, observed, rows_of, limit, monkeypatch):
    monkeypatch.setattr(constraints, "lookup_join", lambda *a, **k: _join(*a, broadcast_rows=limit, **k))
    both = spark.createDataFrame([("d", *COVER), ("e", *COVER)], SCHEMA)
    resolved = constraints.resolve_bounds(both, Bounds(max_time="2021-04-02", min_lat=-5.0))
    assert rows_of(constraints.rows_in_bounds(observed, resolved), "dataset_id", "row_idx") == [("d", 1), ("e", 0)]


def _join(*arguments, **options):
    from fathomix.operators.skew import lookup_join

    return lookup_join(*arguments, **options)


def test_blank_time_coverage_does_not_bound(spark, observed, rows_of):
    open_ended = spark.createDataFrame([("d", "", "", -90.0, 90.0, -180.0, 180.0)], SCHEMA)
    got = constraints.rows_in_bounds(observed, constraints.coverage_bounds(open_ended))
    assert rows_of(got, "row_idx") == [(0,), (1,), (2,)]


def test_unreadable_time_is_reported_not_ignored(spark, observed):
    odd = spark.createDataFrame([("d", "long ago", "", -90.0, 90.0, -180.0, 180.0)], SCHEMA)
    resolved = constraints.coverage_bounds(odd)
    assert constraints.typed_bounds(resolved).first()["status"] == "bad_time"
    assert constraints.rows_in_bounds(observed, resolved).count() == 0
    with pytest.raises(ValueError, match="unreadable"):
        constraints.dataset_in_bounds(observed, odd, "d")


def test_single_dataset_filters_reach_the_scan(spark, observed, tmp_path):
    observed.write.parquet(str(tmp_path / "obs"))
    stored = spark.read.parquet(str(tmp_path / "obs"))
    both = spark.createDataFrame([("d", *COVER), ("e", *COVER)], SCHEMA)
    got = constraints.dataset_in_bounds(stored, both, "d", Bounds(min_lat=-5.0))
    assert sorted(r["row_idx"] for r in got.collect()) == [1, 2]
    plan = got._jdf.queryExecution().executedPlan().toString()
    for pushed in ("EqualTo(dataset_id,d)", "GreaterThanOrEqual(lat,-5.0)", "LessThanOrEqual(time,"):
        assert pushed in plan


def test_relative_bounds_use_the_given_moment(spark, observed, rows_of):
    both = spark.createDataFrame([("d", *COVER)], SCHEMA)
    as_of = F.lit("2021-04-04 00:00:00").cast("timestamp_ntz")
    resolved = constraints.resolve_bounds(both, Bounds(min_time="now-2days", max_time="now"))
    assert rows_of(constraints.rows_in_bounds(observed, resolved, as_of), "row_idx") == [(1,), (2,)]


@pytest.mark.parametrize(
    ("asked", "expected"),
    [
        (None, [0, 1, 2, 3]),
        (Bounds(), [0, 1, 2, 3]),
        (Bounds(min_lat=-5.0), [1, 2]),
        (Bounds(min_lat=-1.0, max_lat=-5.0), [1]),
        (Bounds(min_lat=50.0), []),
        (Bounds(max_time="2021-04-03"), [0, 1, 2, 3]),
        (Bounds(max_time="2021-04-02"), [0, 3]),
        (Bounds(min_time="2022-01-01"), []),
        (Bounds(min_time="2021-03-30", max_time="2021-03-10"), [0, 1, 2, 3]),
        (Bounds(min_time="2021-04-03", max_time="2021-04-03"), [2]),
    ],
)
def test_file_server_rules(observed, asked, expected):
    got = constraints.mask_rows(observed.filter("dataset_id = 'd'"), asked)
    assert sorted(r["row_idx"] for r in got.collect()) == expected


def test_file_server_refuses_unreadable_times(observed):
    with pytest.raises(ValueError, match="soon"):
        constraints.mask_rows(observed, Bounds(min_time="soon"))


def _by_hand(cover, asked):
    """The table-server rules, one value at a time."""
    start, end, lat_min, lat_max, lon_min, lon_max = cover

    def padded(value, clock):
        return value + clock if value[:1].isdigit() and "T" not in value else value

    def moment(value):
        return datetime.fromisoformat(value.replace("Z", "")) if value[:1].isdigit() else None

    low = padded(asked.min_time or start, "T00:00:00Z")
    high = padded(asked.max_time or end, "T23:59:59Z")
    if moment(low) and moment(high) and moment(low) > moment(high):
        low, high = start, end
    sides = []
    for a, b, first, last in (
        (asked.min_lat, asked.max_lat, lat_min, lat_max), (asked.min_lon, asked.max_lon, lon_min, lon_max),
    ):
        sides += sorted((first if a is None else a, last if b is None else b))
    return (low, high, *sides)


def test_random_requests_against_the_rules_by_hand(spark):
    import random

    random.seed(3)
    times = [None, "", "now", "now-3days", "2021-04-01", "2021-04-15", "2021-04-15T12:00:00Z", "2021-05-01", "2019-01-01T00:00:00Z"]
    starts = ["", "2021-04-01", "2021-04-01T00:00:00Z", "2021-04-20T06:00:00Z"]
    side = lambda: random.choice([None, 0.0, round(random.uniform(-90, 90), 2)])
    cases = []
    for i in range(400):
        cover = (random.choice(starts), random.choice([*starts, "2021-04-30"]), *sorted(round(random.uniform(-90, 90), 2) for _ in range(2)),
                 *sorted(round(random.uniform(-180, 180), 2) for _ in range(2)))
        cases.append((i, cover, Bounds(random.choice(times), random.choice(times), side(), side(), side(), side())))
    rows = [(str(i), *cover, *(getattr(b, n) for n in constraints.REQUEST_COLUMNS)) for i, cover, b in cases]
    got = constraints.resolve_bounds(spark.createDataFrame(rows, f"{SCHEMA}, {REQUEST}"))
    found = {r["dataset_id"]: tuple(r[c] for c in constraints.RESOLVED_COLUMNS) for r in got.collect()}
    assert found == {str(i): _by_hand(cover, asked) for i, cover, asked in cases}


def test_few_datasets_and_outer_bounds_reach_the_scan(spark, observed, tmp_path):
    observed.write.parquet(str(tmp_path / "obs"))
    stored = spark.read.parquet(str(tmp_path / "obs"))
    both = spark.createDataFrame([("d", *COVER), ("e", *COVER)], SCHEMA)
    got = constraints.rows_in_bounds(stored, constraints.resolve_bounds(both, Bounds(min_lat=-5.0)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    for pushed in ("In(dataset_id, [d,e])", "GreaterThanOrEqual(lat,-5.0)", "LessThanOrEqual(time,"):
        assert pushed in plan


def test_no_dataset_in_bounds(spark, observed):
    none = spark.createDataFrame([], SCHEMA)
    assert constraints.rows_in_bounds(observed, constraints.resolve_bounds(none, Bounds())).count() == 0


def test_relative_times_in_the_older_rule(cover):
    as_of = F.lit("2021-04-11 00:00:00").cast("timestamp_ntz")
    got = constraints.clamp_bounds(cover, Bounds(min_time="now-7days", max_time="now"), as_of).first()
    assert (got["from_time"][:19], got["to_time"][:19], got["time_reset"]) == ("2021-04-04T00:00:00", "2021-04-11T00:00:00", False)
    late = constraints.clamp_bounds(cover, Bounds(min_time="now-400days"), as_of).first()
    assert late["from_time"] == COVER[0]


def test_skipped_datasets_are_named(spark, rows_of):
    both = spark.createDataFrame([("d", *COVER), ("e", "long ago", *COVER[1:])], SCHEMA)
    resolved = constraints.resolve_bounds(both, Bounds(max_time="now"))
    assert rows_of(constraints.unreadable_bounds(resolved)) == [("e", "from_time long ago cannot be read")]


def test_nan_never_passes_a_bound(spark):
    from fathomix.operators.coverage import observed_coverage

    nan = float("nan")
    rows = spark.createDataFrame([("d", 0, datetime(2021, 4, 1), nan, 1.0), ("d", 1, datetime(2021, 4, 1), 2.0, nan)],
                                 "dataset_id string, row_idx long, time timestamp_ntz, lat double, lon double")
    cover = observed_coverage(rows).first()
    assert (cover["lat_min"], cover["lat_max"], cover["lon_min"], cover["lon_max"]) == (2.0, 2.0, 1.0, 1.0)
