from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomix.functions import numbers, text, times

HOST = "https://data.example.org"


def test_table_server_base(evaluate):
    cases = {
        f"{HOST}/erddap/search?q=temp#frag": f"{HOST}/erddap",
        f"{HOST}/erddap/tabledap/float_7.html": f"{HOST}/erddap",
        f"{HOST}/erddap/index.html": f"{HOST}/erddap",
        f"{HOST}/erddap/": f"{HOST}/erddap",
        f"{HOST}/ERDDAP/index.html": f"{HOST}/ERDDAP",
        "https://other.org/data/index.html": "https://other.org/data",
        "https://other.org/data//": "https://other.org/data",
        "": "",
    }
    assert evaluate(text.table_server_base, cases) == list(cases.values())


def test_catalog_address(evaluate):
    base = f"{HOST}/thredds/catalog"
    cases = {
        f"{base}/catalog.xml?dataset=x#frag": f"{base}/catalog.xml",
        f"{base}/catalog.html": f"{base}/catalog.xml",
        base: f"{base}/catalog.xml",
        f"{base}/": f"{base}/catalog.xml",
        f"{base}/catalog.xml": f"{base}/catalog.xml",
        f"{base}/other.html": f"{base}/other.html",
    }
    assert evaluate(text.catalog_address, cases) == list(cases.values())


def test_clean_title_matches_title_case(evaluate):
    raw = ["bureau_of_invented_seas", "_seas_ ", None, "", "u.s. NAVY o'neil 3d", "école_d'été", "straße ßx", "a__b", "日本abc"]
    expected = ["" if r is None else r.strip("_ ").replace("_", " ").title() for r in raw]
    assert evaluate(text.clean_title, raw) == expected


def test_quality_control_names(evaluate):
    variables = ["temperature_qc", "salinity_flag", "pressure_qartod_flag", "TEMP_QC", "temperature", "salinity", "depth"]
    assert evaluate(text.is_qc_variable, variables) == [True] * 4 + [False] * 3
    keywords = ["QARTOD", "qartod_flags", "Red Flag Warning", "Storm Flag", "Temperature"]
    assert evaluate(text.is_qc_keyword, keywords) == [True] * 2 + [False] * 3


def test_contains_text_takes_wildcards_literally(evaluate):
    values = ["a%b_c", "A%B_C", "axbyc"]
    assert evaluate(lambda c: text.contains_text(c, "%B_"), values) == [True, True, False]


def test_numeric_value(evaluate):
    values = ["38.0", " -2 ", "1e3", "unknown", "", None, "1d", "2.0F"]
    assert evaluate(text.numeric_value, values) == [38.0, -2.0, 1000.0, None, None, None, None, None]


def test_listed_dataset_count(evaluate):
    pages = ["<a>View a List of All 42 Datasets</a>", "View a List of All 8,893 Datasets", "nothing here"]
    assert evaluate(text.listed_dataset_count, pages) == [42, 8893, None]


def test_labels(spark):
    row = spark.range(1).select(
        text.short_label(F.lit("x" * 50)),
        text.path_text(F.array().cast("array<string>")),
        text.path_text(F.array(F.lit("a"), F.lit("b"))),
        text.color_label(F.lit("temperature"), F.lit("Celsius")),
        text.color_label(F.lit("temperature"), F.lit(None).cast("string")),
        text.color_label(F.lit("temperature"), F.lit("")),
        text.time_range_text(F.lit(""), F.lit("x")),
        text.detail_text(units=F.lit("m"), long_name=F.lit(None).cast("string"), standard_name=F.lit("depth")),
    ).first()
    assert list(row) == [
        "x" * 35, "(root)", "a > b", "temperature (Celsius)", "temperature", "temperature",
        "not specified in metadata", "units: m, standard_name: depth",
    ]


def test_as_utc_ignores_the_session_zone(spark, evaluate):
    values = [
        "2016-09-10T00:00:00Z", "2016-09-10T00:00:00", "2016-09-10", "2016-09-10T02:00:00+02:00",
        "2016-03-13T02:30:00.123456Z", "2016", "2016-09-09T19:00:00-0500", "2016-09-10 00:00:00 UTC", "garbage", "05:00:00", "", None,
    ]
    midnight = datetime(2016, 9, 10)
    expected = [midnight] * 4 + [datetime(2016, 3, 13, 2, 30, 0, 123456), datetime(2016, 1, 1), midnight, midnight, None, None, None, None]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert evaluate(times.as_utc, values) == expected
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_iso_text_reads_back_in_any_session_zone(spark, evaluate):
    # The second time does not exist on New York clocks.
    values = [datetime(2024, 1, 1, 0, 0, 7, 179500), datetime(2024, 3, 10, 2, 30), datetime(2024, 7, 1, 23, 59, 59, 1)]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            texts = evaluate(times.iso_text, values, "timestamp_ntz")
            assert texts[0] == "2024-01-01T00:00:07.179500Z"
            assert evaluate(lambda c: times.as_utc(times.iso_text(c)), values, "timestamp_ntz") == values
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_pad_bare_date(evaluate):
    values = ["2016-09-24", "2016-09-24T01:00:00Z", "now-7days", "", None]
    end = evaluate(lambda c: times.pad_bare_date(c, True), values)
    assert end == ["2016-09-24T23:59:59Z", *values[1:]]
    assert evaluate(lambda c: times.pad_bare_date(c, False), values[:1]) == ["2016-09-24T00:00:00Z"]


def test_relative_times(evaluate):
    as_of = F.lit("2024-03-31 12:00:00").cast("timestamp_ntz")
    cases = {
        "now": datetime(2024, 3, 31, 12), "now-7days": datetime(2024, 3, 24, 12), "now-1day": datetime(2024, 3, 30, 12),
        "now+4hours": datetime(2024, 3, 31, 16), "now-1month": datetime(2024, 2, 29, 12), "now-2years": datetime(2022, 3, 31, 12),
        "now-30minutes": datetime(2024, 3, 31, 11, 30), "now-90seconds": datetime(2024, 3, 31, 11, 58, 30),
        "now+250millis": datetime(2024, 3, 31, 12, 0, 0, 250000),
        "2024-01-02T00:00:00Z": datetime(2024, 1, 2), "": None, "soon": None, "now-7": None,
    }
    assert evaluate(lambda c: times.resolve_time(c, as_of), cases) == list(cases.values())


def test_short_time(spark):
    time = F.lit("2016-09-05 07:03:00").cast("timestamp_ntz")
    assert spark.range(1).select(times.short_time(time)).first()[0] == "7:03<br>5-Sep"


@pytest.mark.parametrize("places", [2, 6])
def test_rounding_is_half_even_on_the_scaled_double(evaluate, places):
    import numpy as np

    values = [0.125, 0.375, 2.5, -0.125, 51.716389123456, -128.073358654321, 15.2691, 1e-7]
    got = evaluate(lambda c: numbers.rounded(c, places), values, "double")
    assert got == list(np.round(np.array(values), places))


def test_number_text_matches_shortest_repr(evaluate):
    values = [0.0, -0.0, 15.27, -128.073359, 5.0, 0.0001, 0.00012, 1e-05, -3.4e-05, 12345678.9, 1e15, 1e16, 2.5e17, 100.0]
    assert evaluate(numbers.number_text, values, "double") == [repr(v) for v in values]
    assert evaluate(numbers.number_text, [None, float("nan")], "double") == ["nan", "nan"]


def test_hover_text(spark):
    row = spark.range(1).select(
        numbers.hover_text(
            F.lit(51.716389123456), F.lit(-128.073358654321),
            F.lit("2016-09-10 00:00:00").cast("timestamp_ntz"), F.lit(15.2691), F.lit("temperature (C)"),
        )
    ).first()[0]
    assert row == "(51.716389, -128.073359)<br>2016-09-10 00:00:00+00:00<br>temperature (C): 15.27"
