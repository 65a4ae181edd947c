from fathomix.operators import mixed
from fathomix.operators.columns import resolve_column
from fathomix.plans import plotdata

DATASETS = {
    "a": ["temp", "TEMPERATURE"], "b": ["Temp", "TEMP"], "c": ["temperature (Celsius)", "latitude (deg)"], "d": ["water"],
    "e": ["temperature (C)", "temperature (F)"], None: ["TEMP (K)"],
}


def rows(spark):
    data = [(d, i, names, [float(10 * k + i) for k in range(len(names))]) for d, names in DATASETS.items() for i in range(3)]
    data += [("a", 9, None, None), ("b", 9, ["TEMP"], [float("nan")])]
    # Maps made by Spark keep the order of their keys.
    return spark.createDataFrame(data, "dataset_id string, row_idx long, k array<string>, v array<double>").selectExpr(
        "dataset_id", "row_idx", "map_from_arrays(k, v) AS values")


def test_names_are_found_as_in_one_table(spark):
    found = mixed.resolved_names(mixed.variables_of(rows(spark)), ["temp", "lat", "Temperature"]).collect()
    got = {(r["dataset_id"], r["wanted"]): (r["column"], r["reason"]) for r in found}
    assert len(got) == len(found) == 3 * len(DATASETS)
    plain = {"temperature (Celsius)": "temperature", "latitude (deg)": "lat", "TEMP (K)": "TEMP"}
    for dataset in ("a", "b", "c", "d", None):
        for wanted in ("temp", "lat", "Temperature"):
            names = {plain.get(n, n): n for n in DATASETS[dataset]}
            try:
                expected = (names[resolve_column(list(names), wanted)], None)
            except ValueError:
                expected = (None, f"no column matches {wanted}")
            assert got[dataset, wanted] == expected
    assert got["e", "temp"] == (None, "several columns are named temperature")


def test_pick_keeps_resolved_datasets(spark):
    table = rows(spark)
    names = mixed.resolved_names(mixed.variables_of(table), ["temp"])
    got = sorted(((r["dataset_id"], r["row_idx"], r["t"]) for r in mixed.pick_mixed(table, names, t="temp").collect()), key=repr)
    assert got == sorted([(d, i, v + i) for d, v in (("a", 0.0), ("b", 10.0), ("c", 0.0), (None, 0.0)) for i in range(3)]
                         + [("a", 9, None), ("b", 9, None)], key=repr)


def test_plot_lists_what_it_leaves_out(spark):
    timed = rows(spark).selectExpr("*", "timestamp_ntz'2024-01-01' AS time")
    job, left = plotdata.mixed_timeseries(timed, "temp", step=2)
    assert sorted((r["dataset_id"] or "", r["row_idx"], r["y"]) for r in job.points.collect()) == [
        ("", 0, 0.0), ("", 2, 2.0), ("a", 0, 0.0), ("a", 2, 2.0), ("b", 0, 10.0), ("b", 2, 12.0), ("c", 0, 0.0), ("c", 2, 2.0)]
    assert {r["dataset_id"]: r["reason"] for r in left.collect()} == {
        "d": "no column matches temp", "e": "several columns are named temperature"}
