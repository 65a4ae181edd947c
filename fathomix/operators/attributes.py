"""Dataset descriptions from the long attribute table.

Input rows are ``dataset_id, row_type, variable_name, attribute_name, value``; global
attributes sit under the pseudo-variable ``NC_GLOBAL``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.functions.text import (
    contains_text,
    detail_text,
    is_qc_variable,
    numeric_value,
    short_label,
    time_range_text,
)
from fathomix.operators.constraints import DEFAULT_LAT, DEFAULT_LON
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize

GLOBAL = "NC_GLOBAL"

# The attributes that describe a variable, in display order. File-server
# data has no category attribute.
TABLE_FIELDS = ("standard_name", "long_name", "units", "ioos_category")
FILE_FIELDS = ("standard_name", "long_name", "units")

MISSING_LABEL = "N/A"

# Rows that one task sorts for a grouping.
TASK_ROWS = 1_000_000
# To more tasks than this, Spark by default sorts rows in memory before it sends them.
MOST_TASKS = 200


def _dealt(attributes: DataFrame, wanted: Column, *keys: str) -> DataFrame:
    """Attribute rows in pieces that a task can sort, the ``wanted`` ones with their values.

    The largest text of a group needs sorted rows, and a small file unfolds into many rows in one
    task. What one task holds of a group stays together, so that grouping shrinks the rows as
    before; a group that many tasks hold goes to as many. Beyond ``MOST_TASKS`` pieces, pieces
    grow instead of their number.
    """
    rows = attributes.select("dataset_id", "variable_name", *(
        F.when(wanted, F.col(name)).alias(name) for name in ("attribute_name", "value")))
    tasks = min(-(-attributes.count() // TASK_ROWS), MOST_TASKS)
    if tasks <= 1:
        return rows
    return rows.withColumn("_task", F.xxhash64(*keys, F.spark_partition_id())).repartition(tasks, "_task")


def _dealt_globals(attributes: DataFrame, *names: str) -> DataFrame:
    wanted = (F.col("variable_name") == GLOBAL) & F.col("attribute_name").isin(*names)
    return _dealt(attributes, wanted, "dataset_id")


def _attribute(name: str) -> Column:
    return F.max(F.when(F.col("attribute_name") == name, F.col("value")))


def _global(name: str) -> Column:
    here = (F.col("variable_name") == GLOBAL) & (F.col("attribute_name") == name)
    return F.max(F.when(here, F.col("value")))


def dataset_attributes(attributes: DataFrame, dataset_id: str) -> DataFrame:
    """Attribute rows of one dataset."""
    return attributes.filter(F.col("dataset_id") == dataset_id)


def describe_bounds(attributes: DataFrame) -> DataFrame:
    """Declared coverage of every dataset, with defaults where nothing is declared.

    A coordinate attribute that is not a number takes the default too, and is named in
    ``warnings``; times stay text as written.
    """
    corners = {
        "lat_min": ("geospatial_lat_min", DEFAULT_LAT[0]),
        "lat_max": ("geospatial_lat_max", DEFAULT_LAT[1]),
        "lon_min": ("geospatial_lon_min", DEFAULT_LON[0]),
        "lon_max": ("geospatial_lon_max", DEFAULT_LON[1]),
    }
    sources = ("time_coverage_start", "time_coverage_end", *(source for source, _ in corners.values()))
    raw = _dealt_globals(attributes, *sources).groupBy("dataset_id").agg(
        _global("time_coverage_start").alias("time_start"),
        _global("time_coverage_end").alias("time_end"),
        *(_global(source).alias(name) for name, (source, _) in corners.items()),
    )
    unreadable = [
        F.when(F.col(name).isNotNull() & numeric_value(F.col(name)).isNull(), F.lit(source))
        for name, (source, _) in corners.items()
    ]
    return raw.select(
        "dataset_id",
        F.coalesce("time_start", F.lit("")).alias("time_start"),
        F.coalesce("time_end", F.lit("")).alias("time_end"),
        *(
            F.coalesce(numeric_value(F.col(name)), F.lit(default)).alias(name)
            for name, (_, default) in corners.items()
        ),
        F.concat_ws(", ", *unreadable).alias("warnings"),
    )


def variable_dictionary(attributes: DataFrame, fields: Sequence[str] = TABLE_FIELDS) -> DataFrame:
    """One row per real variable with its describing attributes (null where absent)."""
    variables = attributes.filter(F.col("variable_name") != GLOBAL)
    return (
        _dealt(variables, F.col("attribute_name").isin(*fields), "dataset_id", "variable_name")
        .groupBy("dataset_id", "variable_name")
        .agg(*(_attribute(name).alias(name) for name in fields))
    )


def filter_variables(
    variables: DataFrame,
    query: str | None = None,
    exclude_qc: bool = True,
    fields: Sequence[str] = TABLE_FIELDS,
) -> DataFrame:
    """Drop quality-control variables; keep those whose name or attributes hold ``query``.

    The name and the attribute values are searched as one text joined by spaces.
    """
    if exclude_qc:
        variables = variables.filter(~is_qc_variable(F.col("variable_name")))
    if query:
        text = F.concat_ws(" ", "variable_name", *fields)
        variables = variables.filter(contains_text(text, query))
    return variables


def describe_lines(variables: DataFrame, fields: Sequence[str] = TABLE_FIELDS) -> DataFrame:
    """Variables with the one-line text that lists their attributes."""
    details = detail_text(**{name: F.col(name) for name in fields})
    named = F.format_string("- `%s`", F.col("variable_name"))
    line = F.when(details != "", F.format_string("%s (%s)", named, details)).otherwise(named)
    return variables.withColumn("line", line)


def coverage_lines(bounds: DataFrame) -> DataFrame:
    """Coverage with its time range as text."""
    text = time_range_text(F.col("time_start"), F.col("time_end"))
    return bounds.withColumn("time_range", text)


def label_records(attributes: DataFrame, file_server: bool = False) -> DataFrame:
    """Author, institution, platform and licence of every dataset, ``N/A`` where unknown.

    File-server data falls back from the contributor to the creator; the project is the
    older record's extra field.
    """
    author = _global("contributor_name")
    if file_server:
        author = F.coalesce(author, _global("creator_name"))
    columns = {
        "author": author,
        "institution": _global("institution"),
        "platform": _global("platform"),
        "license": _global("license"),
        "project": _global("project"),
    }
    sources = ("contributor_name", "creator_name", "institution", "platform", "license", "project")
    return _dealt_globals(attributes, *sources).groupBy("dataset_id").agg(
        *(F.coalesce(c, F.lit(MISSING_LABEL)).alias(name) for name, c in columns.items())
    )


def info_box(labels: DataFrame) -> DataFrame:
    """Label records as an info box shows them: author and institution cut to fit."""
    return labels.select(
        "dataset_id",
        short_label(F.col("author")).alias("author"),
        short_label(F.col("institution")).alias("institution"),
        "platform",
        "license",
    )


def variable_units(attributes: DataFrame) -> DataFrame:
    """Units of every variable that declares them."""
    declared = attributes.filter((F.col("attribute_name") == "units") & (F.col("variable_name") != GLOBAL))
    return (
        _dealt(declared, F.lit(True), "dataset_id", "variable_name")
        .groupBy("dataset_id", "variable_name")
        .agg(F.max("value").alias("units"))
    )


def with_units(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Add ``units`` to rows that carry ``dataset_id`` and ``variable_name``."""
    stored = materialize(units)
    return lookup_join(rows, stored, ["dataset_id", "variable_name"], "left")


def reject_grids(attributes: DataFrame) -> DataFrame:
    """Datasets with ``supported`` false (and why) where the data type is exactly ``Grid``."""
    kind = _dealt_globals(attributes, "cdm_data_type").groupBy("dataset_id").agg(_global("cdm_data_type").alias("cdm_data_type"))
    grid = F.coalesce(F.col("cdm_data_type") == "Grid", F.lit(False))
    return kind.withColumn("supported", ~grid).withColumn(
        "error", F.when(grid, F.lit("gridded data cannot be read as trajectories"))
    )
