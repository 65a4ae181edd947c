import pytest

from fathomix.operators import columns

HEADERS = {
    "time (UTC)": "time", "temperature (Celsius)": "temperature", "depth (m)": "depth", "salinity (1)": "salinity",
    "latitude (degrees_north)": "lat", "longitude (degrees_east)": "lon",
}


def test_clean_headers(spark):
    df = spark.createDataFrame([("2016-09-10T00:00:00Z", 12.3, 1.0, 35.1, 39.0, -70.0)], list(HEADERS))
    assert columns.clean_headers(df).columns == list(HEADERS.values())


def test_headers_without_units_stay(spark):
    df = spark.createDataFrame([(1, 2)], ["time", "odd (name) here"])
    assert columns.strip_units(df).columns == ["time", "odd (name) here"]


def test_headers_that_collapse_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], ["depth (m)", "depth (ft)"])
    with pytest.raises(ValueError, match="depth"):
        columns.strip_units(df)


def test_resolve_column():
    names = ["time", "Temperature", "lat", "Chlorophyll"]
    assert columns.resolve_column(names, "time") == "time"
    assert columns.resolve_column(names, "TEMPERATURE") == "Temperature"
    assert columns.resolve_column(names, "temp") == "Temperature"
    assert columns.resolve_column(names, "Latitude") == "lat"
    assert columns.resolve_column(["temp", "temperature"], "temp") == "temp"
    assert columns.resolve_column(["Temp", "TEMP"], "temp") == "TEMP"
    with pytest.raises(ValueError, match="salt"):
        columns.resolve_column(names, "salt")


def test_pick_keeps_names_apart_that_differ_by_case(spark):
    df = spark.createDataFrame([(1, 2)], ["temp", "TEMP"])
    assert columns.pick(df, a="temp", b="TEMP").first().asDict() == {"a": 1, "b": 2}


@pytest.mark.parametrize(
    ("arguments", "expected"),
    [
        ({"plot": "timeseries", "y": "temp", "color": "salt"}, ["time", "temp", "salt"]),
        ({"plot": "profile", "x": "temp"}, ["temp", "depth"]),
        ({"plot": "map", "color": "temp"}, ["longitude", "latitude", "temp"]),
        ({"plot": "custom", "x": "temp"}, ["temp", "time"]),
        ({"plot": "region"}, ["longitude", "latitude"]),
        ({"plot": "timeseries", "y": "temp", "file_server": True}, ["time", "latitude", "longitude", "temp"]),
        ({"plot": "profile", "x": "temp", "file_server": True}, ["latitude", "longitude", "temp", "depth"]),
        ({"plot": "custom", "x": "latitude", "y": "temp", "file_server": True}, ["latitude", "longitude", "temp"]),
    ],
)
def test_needed_columns(arguments, expected):
    assert columns.needed_columns(**arguments) == expected


def test_check_columns():
    columns.check_columns(["a", "b"], ["a"])
    with pytest.raises(ValueError, match="fake"):
        columns.check_columns(["a", "b"], ["a", "fake"])


def test_drop_missing_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (float("nan"), 2.0), (None, None)], "a double, b double")
    assert columns.drop_missing(df, "a", "b").count() == 1
    assert columns.drop_missing(df, "a", "b", how="all").count() == 3


def test_unknown_variables(spark, rows_of):
    asked = spark.createDataFrame([("d", "temperature"), ("d", "fake"), ("d", "fake"), ("e", "depth")], "dataset_id string, variable_name string")
    known = spark.createDataFrame([("d", "temperature"), ("d", "depth")], "dataset_id string, variable_name string")
    assert rows_of(columns.unknown_variables(asked, known), "dataset_id", "variable_name") == [("d", "fake"), ("e", "depth")]
