import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomix.operators import summaries
from fathomix.operators.constraints import Bounds
from fathomix.operators.coverage import observed_coverage, profile_datasets
from fathomix.plans import export, plotdata
from fathomix.sources.tables import ATTRIBUTE_SCHEMA

SCHEMA = "dataset_id string, row_idx long, time timestamp_ntz, lat double, lon double, depth double, temperature double, salinity double"
START = datetime(2016, 9, 10)


@pytest.fixture(scope="module")
def observed(spark):
    rows = []
    for dataset, size, north in (("a", 30, 40.0), ("b", 5, 10.0), ("c", 3, 40.2)):
        for i in range(size):
            rows.append((dataset, i, START + timedelta(hours=i), None if dataset == "a" and i == 3 else north + i / 100, -70.0 + i / 100,
                         float(i), None if i == 2 else 10.0 + i, 35.0))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def attributes(spark):
    return spark.createDataFrame(
        [("a", "attribute", "NC_GLOBAL", "institution", "I" * 60), ("a", "attribute", "temperature", "units", "Celsius")], ATTRIBUTE_SCHEMA)


def test_scatter_drops_then_thins(observed, rows_of):
    points = plotdata.timeseries(observed.filter("dataset_id = 'b'"), "temp", step=2).points
    assert rows_of(points, "row_idx") == [(0,), (3,)]


def test_map_thins_then_drops(observed, rows_of):
    points = plotdata.map_points(observed.filter("dataset_id = 'a' AND row_idx < 8"), step=3)
    assert rows_of(points, "row_idx") == [(0,), (6,)]


def test_color_nulls_are_kept(observed, rows_of):
    points = plotdata.custom(observed.filter("dataset_id = 'b'"), "depth", "salinity", "temperature").points
    assert ("b", 2, 2.0, 35.0, None) in rows_of(points)


def test_summaries(observed, attributes):
    job = plotdata.timeseries(observed, "temperature", step=5, attributes=attributes)
    row = job.summary.filter("dataset_id = 'a'").first()
    assert (row["x_min"], row["title"], row["institution"], row["invert_y"]) == (START, "temperature vs time", "I" * 35, False)
    assert row["n_points"] == 6
    assert plotdata.profile(observed, "temperature").summary.first()["invert_y"] is True


def test_trajectory_map(observed, attributes):
    job = plotdata.trajectory_map(observed, "temperature", step=10, attributes=attributes)
    hover = {(r["dataset_id"], r["row_idx"]): r["hover"] for r in job.points.collect()}
    assert hover["a", 0] == "(40.0, -70.0)<br>temperature (Celsius): 10.0"
    assert hover["b", 0] == "(10.0, -70.0)<br>temperature: 10.0"
    center = job.summary.filter("dataset_id = 'a'").first()
    assert (center["zoom"], center["n_points"], round(center["center_lat"], 6)) == (5, 3, 40.1)


@pytest.fixture
def index(spark, observed):
    cover = observed.groupBy("dataset_id").agg(
        *(f(c).alias(f"{c}_{n}") for c in ("time", "lat", "lon") for n, f in (("min", F.min), ("max", F.max))))
    ghost = cover.filter("dataset_id = 'a'").withColumn("dataset_id", F.lit("ghost"))
    return cover.unionByName(ghost).withColumn("title", F.col("dataset_id")).withColumn(
        "rank", F.expr("CASE dataset_id WHEN 'ghost' THEN 1 WHEN 'c' THEN 2 WHEN 'a' THEN 3 ELSE 4 END"))


BOX = Bounds(min_lat=39.0, max_lat=41.0, min_lon=-75.0, max_lon=-65.0)


def region(observed, index, **options):
    return plotdata.region_map(index, observed_coverage(observed), observed, BOX, **options)


def test_region_map(observed, index, rows_of):
    result = region(observed, index, step=2)
    # The ghost is found but has no rows: skipped, and it takes no slot.
    assert rows_of(result.tracks, "dataset_id", "slot") == [("a", 1), ("c", 0), ("ghost", None)]
    assert rows_of(result.points, "dataset_id", "row_idx", "slot")[-1] == ("c", 2, 0)
    # Row 3 of a has no latitude and is outside any box before thinning starts.
    assert [r["row_idx"] for r in result.points.filter("dataset_id = 'a'").orderBy("row_idx").collect()][:4] == [0, 2, 5, 7]
    row = result.summary.first()
    assert (row["total_found"], row["plotted"], row["skipped"], row["n_drawn"], row["capped"], row["error"]) == (3, 2, 1, 2, False, None)


def test_region_map_cap_comes_before_skipping(observed, index):
    result = region(observed, index, max_datasets=1)
    row = result.summary.first()
    assert (row["total_found"], row["plotted"], row["skipped"], row["capped"]) == (3, 0, 1, True)
    assert "none" in row["error"] and result.points.count() == 0


def test_region_map_needs_a_box(observed, index):
    with pytest.raises(ValueError, match="max_lat"):
        plotdata.region_map(index, observed_coverage(observed), observed, Bounds(min_lat=1.0, min_lon=1.0, max_lon=2.0))


def test_pooled_view_weighs_points_not_tracks(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0)] * 3 + [("b", 4.0, 10.0)], "dataset_id string, lat double, lon double")
    row = summaries.pooled_view(points).first()
    assert (row["center_lat"], row["center_lon"], row["n_drawn"]) == (1.0, 2.5, 2)
    assert row["span"] == 10.0 * 0.7 and row["zoom"] == math.log2(360 / row["span"]) - 1
    single = summaries.pooled_view(points.filter("dataset_id = 'a'")).first()
    assert (single["span"], single["zoom"]) == (0.01, 12.0)
    wide = spark.createDataFrame([("a", -90.0, 0.0), ("a", 90.0, 0.0)], "dataset_id string, lat double, lon double")
    assert summaries.pooled_view(wide).first()["zoom"] == 1.0


def test_profiles_count_valid_rows(observed, rows_of):
    got = profile_datasets(observed.drop("salinity"))
    assert rows_of(got, "dataset_id", "total_rows", "valid_rows") == [("a", 30, 29), ("b", 5, 4), ("c", 3, 2)]
    with pytest.raises(ValueError, match="temperature"):
        profile_datasets(observed.select("dataset_id", "time", "lat", "lon"))


def test_export(observed, rows_of):
    cover = observed_coverage(observed)
    assert export.export_subset(observed, cover).count() == 37
    assert export.export_subset(observed, cover, bounds=Bounds(max_lat=20.0, min_lat=0.0)).count() == 5
    assert rows_of(export.export_subset(observed, cover, ["salinity"], distinct=True)) == [(35.0,)]
    with pytest.raises(ValueError, match="fake"):
        export.export_subset(observed, cover, ["fake"])


def test_older_plots_drop_on_the_colour_only(observed, rows_of):
    holes = observed.filter("dataset_id = 'a' AND row_idx < 5").withColumn("depth", F.when(F.col("row_idx") != 1, F.col("depth")))
    assert rows_of(plotdata.colored_depth(holes, "temperature").points, "row_idx", "y") == [(0, 0.0), (1, None), (3, 3.0), (4, 4.0)]
    track = plotdata.colored_track(holes).points.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in track] == [0, 1, 3, 4]
    assert track[0]["hover"] == "Time: 0:00<br>10-Sep<br>Temp:10.0°C       Depth:0.0(m)"
