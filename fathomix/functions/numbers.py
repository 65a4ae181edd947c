"""Displayed numbers and the hover text of map points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fathomix.functions.times import clock_text, microseconds, short_time


def null_if_nan(column: Column) -> Column:
    """NaN compares as the largest number in Spark; as null it fails every bound."""
    return F.nanvl(column, F.lit(None).cast("double"))


def without_nan(rows: DataFrame, *columns: str) -> DataFrame:
    """NaN as null in those of ``columns`` that hold floating-point numbers."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    numbers = [c for c in columns if kinds.get(c) in ("double", "float")]
    return rows.withColumns({c: null_if_nan(F.col(f"`{c}`").cast("double")) for c in numbers}) if numbers else rows


def rounded(column: Column, places: int) -> Column:
    """Round half to even after scaling, staying in double arithmetic."""
    scale = float(10**places)
    return F.rint(column * scale) / scale


def number_text(column: Column) -> Column:
    """Shortest decimal text of a number rounded to at most six places.

    Plain digits from 1e-4 up to 1e16 and an exponent outside that range, which is where
    spreadsheets and scripts switch too; ``nan`` stands for a missing number.
    """
    size = F.abs(column)
    digits = F.regexp_replace(column.try_cast("decimal(24,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    java = F.regexp_replace(column.cast("string"), r"\.0E", "E")
    exponent = F.regexp_extract(java, r"E(-?)(\d+)$", 1)
    power = F.regexp_extract(java, r"E(-?)(\d+)$", 2)
    scientific = F.concat(
        F.regexp_extract(java, r"^(.*)E", 1),
        F.when(exponent == "-", F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power),
    )
    return (
        F.when(column.isNull() | F.isnan(column), F.lit("nan"))
        .when((size >= 1e-4) & (size < 1e16), digits)
        .when(java.contains("E"), scientific)
        .otherwise(F.lower(java))
    )


def hover_text(
    lat: Column,
    lon: Column,
    time: Column | None = None,
    color: Column | None = None,
    label: Column | None = None,
) -> Column:
    """``(lat, lon)``, then the time and the labelled colour value where given."""
    where = F.format_string(
        "(%s, %s)", number_text(rounded(lat, 6)), number_text(rounded(lon, 6))
    )
    parts = [where]
    if time is not None:
        fraction = microseconds(time)
        stamp = F.concat(
            clock_text(time),
            F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
            F.lit("+00:00"),
        )
        parts.append(F.coalesce(stamp, F.lit("NaT")))
    if color is not None:
        name = label if label is not None else F.lit("value")
        parts.append(F.concat(name, F.lit(": "), number_text(rounded(color, 2))))
    return F.concat_ws("<br>", *parts)


def fixed_hover_text(time: Column, temperature: Column, depth: Column) -> Column:
    """The older fixed label: time, temperature and depth on two lines."""
    # Fixed value: the wording and spacing of the label.
    return F.concat(
        F.lit("Time: "), short_time(time),
        F.lit("<br>Temp:"), number_text(rounded(temperature, 2)),
        F.lit("°C       Depth:"), number_text(rounded(depth, 2)), F.lit("(m)"),
    )
