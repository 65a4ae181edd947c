"""Extents, centres and zoom of prepared points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.functions.numbers import without_nan

# Fixed values of the map view.
SINGLE_TRACK_ZOOM = 5
SMALLEST_SPAN = 0.01
LON_TO_LAT = 0.7
ZOOM_RANGE = (1.0, 12.0)


def extents(points: DataFrame, x: str = "x", keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """Lowest and highest ``x`` and the number of points, per key."""
    return without_nan(points, x).groupBy(*keys).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.count("*").alias("n_points")
    )


def track_centers(points: DataFrame) -> DataFrame:
    """Centre of each dataset's own map."""
    return without_nan(points, "lat", "lon").groupBy("dataset_id").agg(
        F.avg("lat").alias("center_lat"),
        F.avg("lon").alias("center_lon"),
        F.count("*").alias("n_points"),
        F.lit(SINGLE_TRACK_ZOOM).alias("zoom"),
    )


def zoom_for(span: Column) -> Column:
    low, high = ZOOM_RANGE
    return F.least(F.greatest(F.log2(F.lit(360.0) / span) - 1.0, F.lit(low)), F.lit(high))


def pooled_view(points: DataFrame) -> DataFrame:
    """One row: centre over all points of all tracks, their span and the zoom that fits it.

    The centre weighs every point alike; it is not a mean of track means.
    """
    pooled = without_nan(points, "lat", "lon").agg(
        F.avg("lat").alias("center_lat"),
        F.avg("lon").alias("center_lon"),
        (F.max("lat") - F.min("lat")).alias("lat_span"),
        (F.max("lon") - F.min("lon")).alias("lon_span"),
        F.count("*").alias("n_points"),
        F.count_distinct("dataset_id").alias("n_drawn"),
    )
    span = F.greatest(F.col("lat_span"), F.col("lon_span") * LON_TO_LAT, F.lit(SMALLEST_SPAN))
    return pooled.select("center_lat", "center_lon", "n_points", "n_drawn", span.alias("span")).withColumn(
        "zoom", zoom_for(F.col("span"))
    )
