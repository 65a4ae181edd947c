import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathomix.operators.coverage import observed_coverage
from fathomix.session import materialize
from fathomix.sources import output, tables
from fathomix.streaming import arrivals

CSV = """dataset_id,time (UTC),temperature (Celsius),depth (m),latitude (degrees_north),longitude (degrees_east)
d,2016-09-10T00:00:00Z,12.3,1.0,39.0,-70.0
d,2016-09-10T01:00:00Z,NaN,2.0,39.1,
e,2016-09-10T02:00:00Z,,3.0,x,-70.2
"""


@pytest.fixture
def csv_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text(CSV)
    return tables.read_observations(spark, str(tmp_path / "in.csv"), "csv")


def test_read_observations_normalizes(csv_rows, rows_of):
    assert dict(csv_rows.dtypes) == {
        "dataset_id": "string", "time": "timestamp_ntz", "temperature": "double", "depth": "double", "lat": "double", "lon": "double"}
    assert rows_of(csv_rows) == [
        ("d", datetime(2016, 9, 10, 0), 12.3, 1.0, 39.0, -70.0), ("d", datetime(2016, 9, 10, 1), None, 2.0, 39.1, None),
        ("e", datetime(2016, 9, 10, 2), None, 3.0, None, -70.2)]


def test_nan_never_passes_a_bound(spark):
    raw = spark.createDataFrame([("d", float("nan"))], "dataset_id string, lat double")
    assert tables.normalize_observations(raw).filter("lat >= 3").count() == 0


def test_index_rows(csv_rows, rows_of):
    assert rows_of(tables.index_rows(csv_rows), "dataset_id", "row_idx") == [("d", 0), ("d", 1), ("e", 0)]
    kept = csv_rows.withColumn("row_idx", F.lit(9))
    assert tables.index_rows(kept) is kept


@pytest.mark.parametrize("fmt", ["csv", "csv0", "csvp", "tsv", "tsv0", "tsvp", "json", "jsonlKVP", "parquet", "orc"])
def test_written_formats_read_back(spark, csv_rows, rows_of, tmp_path, fmt):
    path = str(tmp_path / "out")
    output.write_subset(csv_rows, path, fmt, {"temperature": "Celsius", "lat": "degrees_north"})
    separator = {"csv": ",", "tsv": "\t"}.get(fmt[:3])
    if fmt.endswith("0"):
        raw = spark.read.option("sep", separator).csv(path).toDF(*csv_rows.columns)
        back = tables.normalize_observations(raw)
    elif separator:
        header = spark.read.option("sep", separator).option("header", "true").csv(path).columns
        assert ("temperature (Celsius)" in header) == fmt.endswith("p")
        back = tables.read_observations(spark, path, fmt[:3])
    else:
        back = tables.normalize_observations(spark.read.format(output.PLAIN_FORMATS[fmt]).load(path))
    assert rows_of(back, *csv_rows.columns) == rows_of(csv_rows)


def test_unknown_format(csv_rows, tmp_path):
    with pytest.raises(ValueError, match="wav"):
        output.write_subset(csv_rows, str(tmp_path / "x"), "wav")


def test_store_splits_one_long_dataset(spark, tmp_path):
    rows = spark.range(4000).select(F.lit("hot").alias("dataset_id"), F.col("id").alias("row_idx"))
    previous = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        output.store_observations(rows, str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", previous)
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 4000 and len(stored.inputFiles()) == 4


def test_typed_readers(spark, tmp_path):
    rows = spark.createDataFrame([("d", "attribute", "depth", "units", "m"), ("e", "attribute", "depth", "units", "km")], tables.ATTRIBUTE_SCHEMA)
    rows.write.option("header", "true").csv(str(tmp_path / "a"))
    assert tables.read_attributes(spark, str(tmp_path / "a"), "csv", "e").count() == 1
    assert tables.header_units(rows, "d", ["depth"]) == {"depth": "m"}
    (tmp_path / "i.json").write_text(json.dumps({"dataset_id": "d", "title": "t", "keywords": ["k"]}))
    assert tables.read_index(spark, str(tmp_path / "i.json"), "json").first()["keywords"] == ["k"]


def test_materialize_cuts_lineage(spark):
    cut = materialize(spark.range(5).withColumn("x", F.lit(1)))
    assert "Range" not in cut._jdf.queryExecution().optimizedPlan().toString() and cut.count() == 5


def test_arriving_files(spark, csv_rows, rows_of, tmp_path):
    landing, store, kept = (str(tmp_path / n) for n in ("landing", "store", "coverage"))
    csv_rows.filter("dataset_id = 'd'").write.parquet(landing)
    stream = lambda: arrivals.follow_observations(spark, landing, csv_rows.schema, files_per_batch=1)
    arrivals.store_arrivals(stream(), store, str(tmp_path / "c1")).awaitTermination()
    csv_rows.filter("dataset_id = 'e'").write.mode("append").parquet(landing)
    arrivals.store_arrivals(stream(), store, str(tmp_path / "c1")).awaitTermination()
    assert rows_of(spark.read.parquet(store)) == rows_of(csv_rows)
    arrivals.follow_coverage(stream(), kept, str(tmp_path / "c2")).awaitTermination()
    assert rows_of(arrivals.latest_coverage(spark, kept)) == rows_of(observed_coverage(csv_rows))
