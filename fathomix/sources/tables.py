"""Reading the input tables in the form the operators expect."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fathomix.functions.numbers import null_if_nan
from fathomix.functions.times import zoneless_time
from fathomix.operators.attributes import GLOBAL, dataset_attributes
from fathomix.operators.columns import clean_headers
from fathomix.operators.sampling import dense_row_index

ATTRIBUTE_SCHEMA = (
    "dataset_id string, row_type string, variable_name string, attribute_name string, value string"
)
EDGE_SCHEMA = "parent_url string, ref_name string, child_url string, pos int"
LEAF_SCHEMA = "catalog_url string, name string, access_urls map<string,string>, pos int"
CATALOG_SCHEMA = "catalog_url string, catalog_name string"
INDEX_SCHEMA = (
    "dataset_id string, title string, rank long, summary string, institution string, "
    "ioos_category string, cdm_data_type string, standard_names array<string>, "
    "variable_names array<string>, keywords array<string>, griddap string, tabledap string, "
    "wms string, time_min timestamp_ntz, time_max timestamp_ntz, lat_min double, "
    "lat_max double, lon_min double, lon_max double"
)
NESTED_SCHEMA = (
    "dataset_id string, trajectory string, profiles array<struct<time: timestamp_ntz, "
    "latitude: double, longitude: double, obs: array<struct<depth: double, "
    "temperature: double, salinity: double>>>>"
)

_TEXT_COLUMNS = ("dataset_id", "trajectory")


def normalize_observations(raw: DataFrame, text: Sequence[str] = ()) -> DataFrame:
    """Clean headers, zone-less UTC ``time``, numbers as doubles, NaN as null.

    Text columns other than identifiers and ``text`` are read as numbers where they hold them.
    """
    named = clean_headers(raw)
    columns = []
    for field in named.schema:
        # Backquotes keep names with dots or spaces whole.
        column = F.col(f"`{field.name}`")
        if field.name == "time":
            column = zoneless_time(column, field.dataType)
        elif field.name == "row_idx":
            column = column.cast("long")
        elif field.name in (*_TEXT_COLUMNS, *text):
            column = column.cast("string")
        elif isinstance(field.dataType, T.StringType):
            column = null_if_nan(column.try_cast("double"))
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = null_if_nan(column.cast("double"))
        columns.append(column.alias(field.name))
    return named.select(*columns)


def read_observations(
    spark: SparkSession, path: str, fmt: str = "parquet", options: Mapping[str, str] | None = None
) -> DataFrame:
    """Observation rows of any number of datasets from Parquet, ORC, CSV, TSV or JSON.

    Text formats are read as text and converted, so no pass over the data infers types.
    """
    settings = dict(options or {})
    if fmt in ("csv", "tsv"):
        settings = {"header": "true", "sep": "\t" if fmt == "tsv" else ",", **settings}
        raw = spark.read.options(**settings).csv(path)
    else:
        raw = spark.read.options(**settings).format(fmt).load(path)
    return normalize_observations(raw)


def index_rows(observations: DataFrame, *tie_break: str) -> DataFrame:
    """Number the rows of each dataset by time where the data brings no ``row_idx``."""
    if "row_idx" in observations.columns:
        return observations
    return dense_row_index(observations, ["time", *tie_break])


def _read(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def read_attributes(
    spark: SparkSession, path: str, fmt: str = "parquet", dataset_id: str | None = None
) -> DataFrame:
    """The long attribute table, or the part of one dataset."""
    rows = _read(spark, path, fmt, ATTRIBUTE_SCHEMA)
    return rows if dataset_id is None else dataset_attributes(rows, dataset_id)


def read_index(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The dataset index."""
    return _read(spark, path, fmt, INDEX_SCHEMA)


def read_tree(
    spark: SparkSession, catalogs: str, edges: str, leaves: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of a catalog tree."""
    return (
        _read(spark, catalogs, fmt, CATALOG_SCHEMA),
        _read(spark, edges, fmt, EDGE_SCHEMA),
        _read(spark, leaves, fmt, LEAF_SCHEMA),
    )


def read_nested(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Nested trajectory data; only the fields a job uses are read from Parquet."""
    return spark.read.format(fmt).load(path)


def header_units(attributes: DataFrame, dataset_id: str, columns: Sequence[str]) -> dict[str, str]:
    """Units of an export's own columns, for its header."""
    rows = dataset_attributes(attributes, dataset_id).filter(
        (F.col("attribute_name") == "units")
        & (F.col("variable_name") != GLOBAL)
        & F.col("variable_name").isin(list(columns))
    )
    return {r["variable_name"]: r["value"] for r in rows.collect()}
