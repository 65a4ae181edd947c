import re

import pytest

from fathomix.operators import attributes as describe
from fathomix.sources.tables import ATTRIBUTE_SCHEMA

MOORING = {
    "time_coverage_start": "2019-11-03T12:00:00Z", "time_coverage_end": "2020-02-17T00:00:00Z", "geospatial_lat_min": "-55.25",
    "geospatial_lat_max": "-54.0", "geospatial_lon_min": "3.5", "geospatial_lon_max": "4.75", "contributor_name": "Ada Example",
    "institution": "Bureau of Invented Seas", "platform": "mooring", "license": "public domain",
}


@pytest.fixture(scope="module")
def attributes(spark):
    rows = [("station_9", "attribute", "NC_GLOBAL", name, value) for name, value in MOORING.items()]
    rows += [
        ("station_9", "attribute", "temperature", "standard_name", "sea_water_temperature"),
        ("station_9", "attribute", "temperature", "units", "Celsius"),
        ("station_9", "attribute", "temperature", "valid_min", "-2"),
        ("station_9", "attribute", "temperature_qc", "long_name", "flags"),
        ("bare", "attribute", "salinity_flag", "units", "1"),
        ("odd", "attribute", "NC_GLOBAL", "geospatial_lat_min", "north"),
        ("odd", "attribute", "NC_GLOBAL", "cdm_data_type", "Grid"),
        ("odd", "attribute", "NC_GLOBAL", "creator_name", "C. Reator"),
        ("odd", "attribute", "NC_GLOBAL", "time_coverage_start", "2016"),
    ]
    return spark.createDataFrame(rows, ATTRIBUTE_SCHEMA)


def test_describe_bounds(attributes, rows_of):
    assert rows_of(describe.describe_bounds(attributes)) == [
        ("bare", "", "", -90.0, 90.0, -180.0, 180.0, ""),
        ("odd", "2016", "", -90.0, 90.0, -180.0, 180.0, "geospatial_lat_min"),
        ("station_9", MOORING["time_coverage_start"], MOORING["time_coverage_end"], -55.25, -54.0, 3.5, 4.75, ""),
    ]


def test_variable_dictionary_leaves_globals_and_other_attributes_out(attributes, rows_of):
    rows = describe.variable_dictionary(attributes)
    assert rows_of(rows) == [
        ("bare", "salinity_flag", None, None, "1", None),
        ("station_9", "temperature", "sea_water_temperature", None, "Celsius", None),
        ("station_9", "temperature_qc", None, "flags", None, None),
    ]
    assert describe.variable_dictionary(attributes, describe.FILE_FIELDS).columns[-1] == "units"


def test_filter_variables(attributes):
    rows = describe.variable_dictionary(attributes)
    names = lambda df: sorted(r["variable_name"] for r in df.collect())
    assert names(describe.filter_variables(rows)) == ["temperature"]
    assert names(describe.filter_variables(rows, exclude_qc=False)) == ["salinity_flag", "temperature", "temperature_qc"]
    assert names(describe.filter_variables(rows, "CELSIUS")) == ["temperature"]
    assert names(describe.filter_variables(rows, "temperature sea_water")) == ["temperature"]
    assert names(describe.filter_variables(rows, "salinity")) == []


def test_describe_lines(attributes, rows_of):
    lines = describe.describe_lines(describe.variable_dictionary(attributes))
    assert ("- `temperature` (standard_name: sea_water_temperature, units: Celsius)",) in rows_of(lines, "line")
    ranges = describe.coverage_lines(describe.describe_bounds(attributes))
    assert rows_of(ranges, "dataset_id", "time_range")[0] == ("bare", "not specified in metadata")


def test_label_records(attributes, rows_of):
    assert rows_of(describe.label_records(attributes), "dataset_id", "author", "institution", "platform", "license") == [
        ("bare", "N/A", "N/A", "N/A", "N/A"), ("odd", "N/A", "N/A", "N/A", "N/A"),
        ("station_9", "Ada Example", "Bureau of Invented Seas", "mooring", "public domain"),
    ]
    assert rows_of(describe.label_records(attributes, file_server=True), "author") == [("Ada Example",), ("C. Reator",), ("N/A",)]


def test_units_and_grids(spark, attributes, rows_of):
    asked = spark.createDataFrame([("station_9", "temperature"), ("station_9", "time")], "dataset_id string, variable_name string")
    joined = describe.with_units(asked, describe.variable_units(attributes))
    assert rows_of(joined, "variable_name", "units") == [("temperature", "Celsius"), ("time", None)]
    assert rows_of(describe.reject_grids(attributes), "dataset_id", "supported") == [("bare", True), ("odd", False), ("station_9", True)]


def test_groupings_sort_a_bounded_number_of_rows_a_task(spark, attributes, rows_of, monkeypatch):
    unnamed = spark.createDataFrame(
        [(None, "attribute", "NC_GLOBAL", "license", f"L{i}") for i in range(20)] + [(None, "attribute", None, "units", "m")],
        ATTRIBUTE_SCHEMA)
    rows = attributes.unionByName(unnamed)
    jobs = (describe.describe_bounds, describe.variable_dictionary, describe.label_records, describe.variable_units, describe.reject_grids)
    expected = [rows_of(job(rows)) for job in jobs]
    monkeypatch.setattr(describe, "TASK_ROWS", 4, raising=False)
    for job, found in zip(jobs, expected):
        dealt = job(rows)
        assert rows_of(dealt) == found
        if job is not describe.variable_units:  # two rows only
            assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()


def test_pieces_are_never_so_many_that_senders_sort(spark, monkeypatch):
    rows = spark.range(300).selectExpr(
        "CAST(id AS string) AS dataset_id", "'attribute' AS row_type", "'NC_GLOBAL' AS variable_name",
        "'license' AS attribute_name", "'L' AS value")
    monkeypatch.setattr(describe, "TASK_ROWS", 1)
    dealt = describe.label_records(rows)
    plan = dealt._jdf.queryExecution().toString()
    assert set(re.findall(r"hashpartitioning\(_task#\d+L, (\d+)\)", plan)) == {"200"}
    assert dealt.filter("license = 'L'").count() == 300
