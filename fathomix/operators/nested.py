"""Nested trajectory -> profile -> observation data.

Two layouts are read: one row per trajectory, with ``profiles`` an array of
``struct<time, latitude, longitude, obs: array<struct<depth, …>>>``, and one row per profile
with the struct's fields as columns and ``profile`` as its number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fathomix.functions.numbers import null_if_nan, without_nan
from fathomix.functions.times import zoneless_time
from fathomix.operators.columns import check_columns
from fathomix.operators.constraints import Bounds, mask_rows

PROFILE_FIELDS = ("time", "latitude", "longitude")

# An array holds fewer elements than this, so profiles never share row numbers.
OBS_STRIDE = 1 << 31


def to_profiles(nested: DataFrame) -> DataFrame:
    """One row per profile, numbered from 0 within its trajectory."""
    if "profiles" not in nested.columns:
        return nested
    others = [c for c in nested.columns if c != "profiles"]
    exploded = nested.select(*others, F.posexplode("profiles").alias("profile", "_p"))
    return exploded.select(*others, "profile", "_p.*")


def observed_fields(nested: DataFrame) -> list[str]:
    """Names of the variables held per observation."""
    return to_profiles(nested).schema["obs"].dataType.elementType.names


def mixed_datasets(nested: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Datasets that hold more than one trajectory, which strict flattening refuses."""
    return (
        nested.groupBy(key)
        .agg(F.min("trajectory").alias("first"), F.max("trajectory").alias("last"))
        .filter("first <> last")
        .select(key)
    )


def flatten(
    nested: DataFrame,
    variables: Sequence[str],
    bounds: Bounds | None = None,
    keys: Sequence[str] = ("trajectory",),
    strict: bool = False,
) -> DataFrame:
    """Rows of the chosen ``variables`` inside ``bounds``, with short coordinate names.

    Profile variables alone give one row per profile; any observation variable gives one
    row per observation with the profile's values repeated. NaN is missing and so outside
    every bound. Bounds act on whole profiles, before observations are unpacked. ``strict`` refuses more than one trajectory.
    """
    per_obs = observed_fields(nested)
    check_columns([*PROFILE_FIELDS, *per_obs], variables)
    if strict and nested.select("trajectory").distinct().limit(2).count() > 1:
        raise ValueError("the data holds several trajectories; one is expected")
    profiles = to_profiles(nested)
    kept = mask_rows(
        profiles.select(
            *keys,
            "profile",
            zoneless_time(F.col("time"), profiles.schema["time"].dataType).alias("time"),
            null_if_nan(F.col("latitude").cast("double")).alias("lat"),
            null_if_nan(F.col("longitude").cast("double")).alias("lon"),
            "obs",
        ),
        bounds,
    )
    short = {"latitude": "lat", "longitude": "lon"}
    chosen = list(dict.fromkeys(variables))
    if not any(v in per_obs for v in chosen):
        return kept.select(*keys, "profile", *(short.get(v, v) for v in chosen))
    rows = kept.select(*keys, "profile", "time", "lat", "lon", F.posexplode("obs").alias("obs_no", "_o"))
    picked = rows.select(
        *keys,
        "profile",
        "obs_no",
        *(F.col(f"_o.{v}").alias(v) if v in per_obs else F.col(short.get(v, v)) for v in chosen),
    )
    return without_nan(picked, *(v for v in chosen if v in per_obs))


def with_row_order(rows: DataFrame, name: str = "row_idx") -> DataFrame:
    """A unique, order-keeping row number from the profile and observation numbers."""
    number = F.col("profile").cast("long")
    if "obs_no" in rows.columns:
        number = number * OBS_STRIDE + F.col("obs_no").cast("long")
    return rows.withColumn(name, number)
