"""Nested trajectories stored with their envelopes, so that bounds decide which files are read.

Every trajectory gets the ranges of its profiles' times and coordinates. Rows are laid along a
space-filling curve over the ranges' lower ends, so a file covers a small part of the world
and time, and a table beside the files holds each file's envelope. Reading with bounds opens
the files whose envelope meets them and, in those, the trajectories whose own does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathomix.functions.numbers import null_if_nan
from fathomix.functions.times import as_utc, zoneless_time
from fathomix.operators.constraints import Bounds
from fathomix.operators.nested import flatten

_FIELDS = {"time": "time", "lat": "latitude", "lon": "longitude"}
ENVELOPE = tuple(f"{axis}_{end}" for axis in _FIELDS for end in ("min", "max"))
# Bits of each axis on the curve.
_CURVE_BITS = 10


def with_envelopes(nested: DataFrame) -> DataFrame:
    """``nested`` (one row per trajectory) and its ``ENVELOPE``; null and NaN count as missing."""
    kinds = {f.name: f.dataType for f in nested.schema["profiles"].dataType.elementType}

    def values(axis: str) -> Column:
        name = _FIELDS[axis]
        return F.transform("profiles", lambda p: zoneless_time(p[name], kinds[name]) if axis == "time"
                           else null_if_nan(p[name].cast("double")))

    return nested.withColumns({f"{axis}_{end}": pick(values(axis)) for axis in _FIELDS
                               for end, pick in (("min", F.array_min), ("max", F.array_max))})


def _curve(rows: DataFrame) -> Column:
    """Place on a space-filling curve: the bits of the three lower ends in turn."""
    first, last = rows.agg(F.min("time_min"), F.max("time_min")).first()
    start, stop = (F.lit(None if t is None else str(t)).cast("timestamp_ntz") for t in (first, last))
    span = F.greatest(F.timestamp_diff("SECOND", start, stop), F.lit(1))
    shares = [F.timestamp_diff("SECOND", start, F.col("time_min")) / span, (F.col("lat_min") + 90) / 180, (F.col("lon_min") + 180) / 360]
    top = (1 << _CURVE_BITS) - 1
    cells = [F.greatest(F.least(F.floor(F.coalesce(s, F.lit(0.0)) * top), F.lit(top)), F.lit(0)).cast("long") for s in shares]
    place = F.lit(0).cast("long")
    for bit in range(_CURVE_BITS):
        for axis, cell in enumerate(cells):
            place = place + F.shiftleft(F.shiftright(cell, bit).bitwiseAND(1), 3 * bit + axis)
    return place


def store_nested(nested: DataFrame, path: str, files: int | None = None) -> None:
    """Write trajectories and the table of file envelopes below ``path``."""
    enveloped = with_envelopes(nested)
    placed = enveloped.withColumn("_place", _curve(enveloped))
    by = [F.col("_place")]
    ranged = placed.repartitionByRange(files, *by) if files else placed.repartitionByRange(*by)
    ranged.sortWithinPartitions("_place").drop("_place").write.parquet(f"{path}/rows")
    nested.sparkSession.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(
        *[(F.min if c.endswith("min") else F.max)(c).alias(c) for c in ENVELOPE],
        *[F.count_if(F.col(f"{axis}_min").isNull()).alias(f"{axis}_missing") for axis in _FIELDS],
    ).write.parquet(f"{path}/zones")


def meets(bounds: Bounds | None) -> Column:
    """Whether an envelope can hold a profile inside file-server bounds; their tests on constants."""
    if bounds is None:
        return F.lit(True)
    test = F.lit(True)
    low, high = (as_utc(F.lit(t)) if t else None for t in (bounds.min_time, bounds.max_time))
    ends = [(F.col("time_max") >= low) if low is not None else None, (F.col("time_min") <= high) if high is not None else None]
    inside = [e for e in ends if e is not None]
    if len(inside) == 2:
        test = test & ((low > high) | (inside[0] & inside[1]))
    elif inside:
        test = test & inside[0]
    for axis in ("lat", "lon"):
        a, b = getattr(bounds, f"min_{axis}"), getattr(bounds, f"max_{axis}")
        if a is not None and b is not None:
            a, b = min(a, b), max(a, b)
        if a is not None:
            test = test & (F.col(f"{axis}_max") >= a)
        if b is not None:
            test = test & (F.col(f"{axis}_min") <= b)
    return test


def files_in(spark: SparkSession, path: str, bounds: Bounds | None) -> list[str]:
    """The files that bounds leave; the list is no longer than the one a scan of all files keeps."""
    zones = spark.read.parquet(f"{path}/zones").filter(meets(bounds))
    return [r["file"] for r in zones.select("file").collect()]


def flatten_stored(
    spark: SparkSession, path: str, variables: Sequence[str], bounds: Bounds | None = None, keys: Sequence[str] = ("trajectory",),
) -> DataFrame:
    """What ``flatten`` gives for the stored trajectories, read from the files that ``bounds`` meet."""
    files = files_in(spark, path, bounds)
    everything = spark.read.parquet(f"{path}/rows")
    near = spark.read.schema(everything.schema).parquet(*files) if files else everything.limit(0)
    return flatten(near.filter(meets(bounds)).drop(*ENVELOPE), variables, bounds, keys)
