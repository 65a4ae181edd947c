"""Column names: units suffixes, short coordinate names, lookup and validation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Short names people use for common variables.
VARIABLE_ALIASES = {
    "temp": "temperature",
    "salt": "salinity",
    "chl": "chlorophyll",
    "lat": "lat",
    "latitude": "lat",
    "lon": "lon",
    "longitude": "lon",
    "oxygen": "dissolved_oxygen",
    "cond": "conductivity",
    "turb": "turbidity",
}

# Fixed value.
AVAILABLE_SHOWN = 30


def _relabel(df: DataFrame, names: Sequence[str]) -> DataFrame:
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"several columns would be named {repeated}")
    return df.toDF(*names)


def strip_units(df: DataFrame) -> DataFrame:
    """Rename ``temperature (Celsius)`` to ``temperature`` in every header."""
    # Fixed value: the units pattern.
    return _relabel(df, [re.sub(r"\s*\([^)]*\)$", "", name) for name in df.columns])


def add_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """Rename ``temperature`` to ``temperature (Celsius)`` where units are known."""
    return _relabel(df, [f"{n} ({units[n]})" if units.get(n) else n for n in df.columns])


def short_coordinates(df: DataFrame) -> DataFrame:
    """Rename latitude and longitude to lat and lon."""
    short = {"latitude": "lat", "longitude": "lon"}
    return _relabel(df, [short.get(name, name) for name in df.columns])


def clean_headers(df: DataFrame) -> DataFrame:
    return short_coordinates(strip_units(df))


def resolve_column(columns: Sequence[str], name: str) -> str:
    """Find ``name`` among ``columns``: as written, then in any case, then by alias.

    Of columns that differ only by case the last one wins.
    """
    if name in columns:
        return name
    any_case = {column.lower(): column for column in columns}
    wanted = name.lower()
    for candidate in (wanted, VARIABLE_ALIASES.get(wanted)):
        if candidate in any_case:
            return any_case[candidate]
    raise ValueError(f"no column matches {name!r}; the table has {sorted(columns)}")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select ``alias=name`` columns, resolving each name as ``resolve_column`` does.

    Columns are addressed by place, so names that differ only by case stay apart.
    """
    places = {column: f"_c{i}" for i, column in enumerate(df.columns)}
    numbered = df.toDF(*places.values())
    return numbered.select(
        *(F.col(places[resolve_column(df.columns, name)]).alias(alias) for alias, name in wanted.items())
    )


def needed_columns(plot: str, x: str | None = None, y: str | None = None,
                   color: str | None = None, file_server: bool = False) -> list[str]:
    """Columns a plot reads, each once, in the order the plot uses them."""
    by_plot = {
        "timeseries": ["time", y],
        "profile": [x, "depth"],
        "map": ["latitude", "longitude"] if file_server else ["longitude", "latitude"],
        "custom": [x, y or "time"],
        "region": ["longitude", "latitude"],
    }
    if plot not in by_plot:
        raise ValueError(f"unknown plot {plot!r}")
    names = by_plot[plot]
    if file_server and plot == "timeseries":
        names = ["time", "latitude", "longitude", y]
    elif file_server and plot != "map":
        names = ["latitude", "longitude", *names]
    wanted = [*names, color] if color else names
    if None in wanted:
        raise ValueError(f"plot {plot!r} needs a variable that was not given")
    return list(dict.fromkeys(wanted))


def check_columns(available: Iterable[str], requested: Iterable[str]) -> None:
    """Raise when a requested variable does not exist, listing some that do."""
    known = set(available)
    missing = [name for name in requested if name not in known]
    if missing:
        shown = sorted(known)[:AVAILABLE_SHOWN]
        raise ValueError(f"unknown variables {missing}; available are {shown}")


def unknown_variables(requests: DataFrame, variables: DataFrame) -> DataFrame:
    """Requested ``(dataset_id, variable_name)`` pairs that no dataset variable backs."""
    known = variables.select("dataset_id", "variable_name").distinct()
    return requests.select("dataset_id", "variable_name").distinct().join(
        known, ["dataset_id", "variable_name"], "left_anti"
    )


def drop_missing(df: DataFrame, *columns: str, how: str = "any") -> DataFrame:
    """Drop rows where any (or, with ``how='all'``, every) named column is null or NaN."""
    return df.na.drop(how=how, subset=list(dict.fromkeys(columns)))


def value_columns(columns: Sequence[str], *words: str) -> list[str]:
    """Columns whose name contains one of ``words``, in any case."""
    return [c for c in columns if any(word in c.lower() for word in words)]


def any_present(columns: Sequence[str]) -> Column:
    """Whether at least one of ``columns`` holds a value."""
    test = F.lit(False)
    for column in columns:
        test = test | F.col(column).isNotNull()
    return test
