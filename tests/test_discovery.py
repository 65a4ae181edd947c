from datetime import datetime

import pytest

from fathomix.operators import discovery
from fathomix.operators.constraints import Bounds
from fathomix.sources.tables import INDEX_SCHEMA


def row(dataset_id, title, rank, **more):
    fields = [f.strip().split(" ")[0] for f in INDEX_SCHEMA.split(", ")]
    values = {"dataset_id": dataset_id, "title": title, "rank": rank, **more}
    return tuple(values.get(f) for f in fields)


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(
        [
            row("station_9", "Station 9 glider", 1, institution="invented_seas_bureau", ioos_category="Temperature",
                cdm_data_type="TrajectoryProfile", standard_names=["sea_water_temperature", "temperature_status_flag"],
                variable_names=["temperature", "temperature_qc"], keywords=["glider", "qartod_flags"], tabledap="url",
                time_min=datetime(2016, 9, 1), time_max=datetime(2016, 9, 30), lat_min=38.0, lat_max=41.0, lon_min=-72.0, lon_max=-69.0),
            row("drift-3", "Delayed sea water survey", 2, institution="seas", cdm_data_type="Grid",
                standard_names=["sea_water_salinity"], variable_names=["salinity"], keywords=["glider", " "], griddap="",
                time_min=datetime(2020, 1, 1), time_max=datetime(2020, 2, 1), lat_min=-10.0, lat_max=-5.0, lon_min=10.0, lon_max=20.0),
            row("odd", "100% sea_water", 3, keywords=[]),
            row("allDatasets", "* The List of All *", 0, institution="hidden_one", keywords=["hidden"], wms=""),
        ],
        INDEX_SCHEMA,
    )


def ids(df):
    return sorted(r["dataset_id"] for r in df.collect())


def test_search_terms():
    assert discovery.search_terms("all") == ([], [])
    assert discovery.search_terms("") == ([], [])
    assert discovery.search_terms('glider -delayed "sea water temperature"') == (["glider", "sea water temperature"], ["delayed"])
    assert discovery.search_terms('-"not this" all x-y') == (["all", "x-y"], ["not this"])


def test_keyword_search(index):
    assert len(ids(discovery.search_index(index))) == 4
    assert ids(discovery.search_index(index, "GLIDER -delayed")) == ["station_9"]
    assert ids(discovery.search_index(index, '"sea water"')) == ["drift-3"]
    assert ids(discovery.search_index(index, "100%")) == ["odd"]


def test_variable_search(index):
    assert ids(discovery.search_index(index, variables=["temperature"])) == ["station_9"]
    assert ids(discovery.search_index(index, variables=["Temperature"])) == []
    assert ids(discovery.search_index(index, "station", variables=["TEMPERATURE", "temperature_qc"])) == ["station_9"]


def test_facets_match_exactly(index):
    assert ids(discovery.search_index(index, institution="seas", cdm_data_type="Grid")) == ["drift-3"]
    assert ids(discovery.search_index(index, institution="SEAS")) == []
    assert ids(discovery.search_index(index, standard_name="sea_water_salinity")) == ["drift-3"]
    with pytest.raises(ValueError, match="color"):
        discovery.search_index(index, color="red")


def test_region_and_time_overlap(index):
    touching = Bounds(min_lat=41.0, max_lat=45.0)
    assert ids(discovery.search_index(index, bounds=touching)) == ["station_9"]
    assert ids(discovery.search_index(index, bounds=Bounds(min_time="2016-09-30"))) == ["drift-3", "station_9"]
    assert ids(discovery.search_index(index, bounds=Bounds(min_time="2016-10-01", max_time="2019-01-01"))) == []


def test_page_size_keeps_the_first_by_rank(index):
    assert ids(discovery.search_index(index, items_per_page=2)) == ["allDatasets", "station_9"]


def test_search_any_unions_and_filters_titles(index):
    assert ids(discovery.search_any(index, ["glider", "station"])) == ["drift-3", "station_9"]
    assert ids(discovery.search_any(index, ["glider", "station"], title_pattern="DELAYED|nothing")) == ["drift-3"]
    assert ids(discovery.search_any(index, ["all"], variable=" Temp ")) == ["station_9"]
    got = discovery.search_any(index, ["drift-3", "glider"])
    assert {r["dataset_id"]: r["query_no"] for r in got.collect()} == {"drift-3": 0, "station_9": 1}


def test_facet_values(index):
    values = lambda *a: sorted(r["value"] for r in discovery.facet_values(index, *a).collect())
    assert values("institution") == ["hidden_one", "invented_seas_bureau", "seas"]
    assert values("institution", "INVENTED") == ["invented_seas_bureau"]
    assert values("standard_name") == ["sea_water_salinity", "sea_water_temperature"]
    assert values("cdm_data_type", "zzz") == []


def test_facet_checks(spark, index, rows_of):
    discovery.check_facet(index, "institution", "seas")
    with pytest.raises(ValueError, match="Seas.*invented_seas_bureau"):
        discovery.check_facet(index, "institution", "Seas")
    asked = spark.createDataFrame(
        [("institution", "seas"), ("institution", "seas"), ("institution", "Seas"), ("keywords", "glider")], "facet string, value string")
    assert rows_of(discovery.check_facets(asked, index), "facet", "value", "valid") == [
        ("institution", "Seas", False), ("institution", "seas", True), ("keywords", "glider", True)]


def test_server_summary(index, rows_of):
    assert rows_of(discovery.server_summary(index)) == [
        ("dataset_count", "3"), ("institution", "Invented Seas Bureau"), ("institution", "Seas"),
        ("keyword", "Glider"), ("protocol", "griddap"), ("protocol", "tabledap"),
    ]
    assert tuple(discovery.protocol_flags(index).first()) == (True, True, False)
