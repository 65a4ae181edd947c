"""Per-dataset coverage and profile, straight from the observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fathomix.functions.numbers import without_nan
from fathomix.functions.times import iso_text
from fathomix.operators.columns import any_present, value_columns

PROFILE_WORDS = ("temperature", "salinity")


def observed_coverage(observations: DataFrame) -> DataFrame:
    """Time and coordinate ranges of each dataset, in the form constraints expect; NaN is missing."""
    ranges = without_nan(observations, "lat", "lon").groupBy("dataset_id").agg(
        F.min("time").alias("first"),
        F.max("time").alias("last"),
        *(
            end(axis).alias(f"{axis}_{name}")
            for axis in ("lat", "lon")
            for name, end in (("min", F.min), ("max", F.max))
        ),
    )
    return coverage_of_ranges(ranges)


def coverage_of_ranges(ranges: DataFrame) -> DataFrame:
    """Coverage from ``dataset_id, first, last`` and the ranges of the coordinates; what is missing is the whole world."""
    return ranges.select(
        "dataset_id",
        F.coalesce(iso_text(F.col("first")), F.lit("")).alias("time_start"),
        F.coalesce(iso_text(F.col("last")), F.lit("")).alias("time_end"),
        F.coalesce("lat_min", F.lit(-90.0)).alias("lat_min"),
        F.coalesce("lat_max", F.lit(90.0)).alias("lat_max"),
        F.coalesce("lon_min", F.lit(-180.0)).alias("lon_min"),
        F.coalesce("lon_max", F.lit(180.0)).alias("lon_max"),
    )


def profile_datasets(observations: DataFrame) -> DataFrame:
    """Row counts and the ranges of the rows that hold any temperature or salinity.

    All temperature and salinity columns count, quality flags included; NaN is missing.
    """
    targets = value_columns(observations.columns, *PROFILE_WORDS)
    if not targets:
        raise ValueError("the table has no temperature or salinity column")
    observations = without_nan(observations, "lat", "lon", *targets)
    valid = any_present(targets)

    def of_valid(end, column: str):
        return end(F.when(valid, F.col(column)))

    return observations.groupBy("dataset_id").agg(
        F.count("*").alias("total_rows"),
        F.count_if(valid).alias("valid_rows"),
        of_valid(F.min, "time").alias("time_min"),
        of_valid(F.max, "time").alias("time_max"),
        of_valid(F.min, "lat").alias("lat_min"),
        of_valid(F.max, "lat").alias("lat_max"),
        of_valid(F.min, "lon").alias("lon_min"),
        of_valid(F.max, "lon").alias("lon_max"),
    )
