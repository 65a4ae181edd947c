"""User bounds on time, latitude and longitude.

Table-server and file-server data follow two different rule sets, and both are kept:

* table server: a missing bound comes from the dataset's coverage, a bare date covers its
  whole day, inverted times fall back to the coverage, inverted coordinates swap;
* file server: a missing bound does not filter, a bare date is midnight, inverted times are
  dropped, inverted coordinates swap - and inversion is only looked at when the user gave
  both ends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Row, functions as F

from fathomix.functions.times import (
    absolute_time,
    as_utc,
    iso_text,
    pad_bare_date,
    readable_time,
    resolve_time,
)
from fathomix.operators.skew import lookup_join
from fathomix.session import materialize

# Bins that an average request's window covers, the least width of one in microseconds, and the
# bin of rows without a time.
WINDOW_BINS = 8
SHORTEST_BIN = 1_000_000
NO_TIME = -(1 << 62)

# The identifiers of up to this many datasets are given to the scan as constants.
PUSHED_IDS = 100

DEFAULT_LAT = (-90.0, 90.0)
DEFAULT_LON = (-180.0, 180.0)

COVERAGE_COLUMNS = ("time_start", "time_end", "lat_min", "lat_max", "lon_min", "lon_max")
REQUEST_COLUMNS = ("min_time", "max_time", "min_lat", "max_lat", "min_lon", "max_lon")
NO_COVERAGE = "no_coverage"
RESOLVED_COLUMNS = ("from_time", "to_time", "from_lat", "to_lat", "from_lon", "to_lon")


@dataclass(frozen=True)
class Bounds:
    """What the user asked for; every field is optional."""

    min_time: str | None = None
    max_time: str | None = None
    min_lat: float | None = None
    max_lat: float | None = None
    min_lon: float | None = None
    max_lon: float | None = None

    def columns(self) -> dict[str, Column]:
        kinds = {"min_time": "string", "max_time": "string"}
        return {
            f.name: F.lit(getattr(self, f.name)).cast(kinds.get(f.name, "double"))
            for f in fields(self)
        }

    def require_box(self) -> Bounds:
        """Return self, or raise when the latitude/longitude box is incomplete."""
        box = ("min_lat", "max_lat", "min_lon", "max_lon")
        absent = [name for name in box if getattr(self, name) is None]
        if absent:
            raise ValueError(f"a region needs all four sides; missing {absent}")
        return self


def incomplete_boxes(requests: DataFrame) -> DataFrame:
    """Region requests that lack a side, with the names of the absent sides."""
    sides = ("min_lat", "max_lat", "min_lon", "max_lon")
    absent = F.concat_ws(", ", *(F.when(F.col(s).isNull(), F.lit(s)) for s in sides))
    return requests.withColumn("missing", absent).filter("missing <> ''")


def _filled(text: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def _resolve_axis(low: Column, high: Column, cover_low: Column, cover_high: Column) -> tuple:
    a, b = F.coalesce(low, cover_low), F.coalesce(high, cover_high)
    return F.least(a, b), F.greatest(a, b)


def resolve_bounds(coverage: DataFrame, request: Bounds | None = None) -> DataFrame:
    """Resolve table-server bounds for every row of ``coverage``.

    With ``request`` the same bounds apply to all datasets; without it the rows must carry
    request columns of their own (join coverage and requests first). Adds ``from_*``,
    ``to_*`` and the ``time_reset`` flag.
    """
    asked = request.columns() if request else {c: F.col(c) for c in REQUEST_COLUMNS}
    start, end = F.col("time_start"), F.col("time_end")
    # One step per layer of the rules, so that no step repeats the expressions below it.
    padded = coverage.withColumns({
        "_low": _filled(asked["min_time"], start), "_high": _filled(asked["max_time"], end),
    }).withColumns({
        "_low": pad_bare_date(F.col("_low"), end_of_day=False),
        "_high": pad_bare_date(F.col("_high"), end_of_day=True),
    })
    dated = padded.withColumns({
        "_from": absolute_time(F.col("_low")), "_to": absolute_time(F.col("_high")),
    })
    flagged = dated.withColumn("time_reset", F.coalesce(F.col("_from") > F.col("_to"), F.lit(False)))
    reset = F.col("time_reset")
    from_lat, to_lat = _resolve_axis(
        asked["min_lat"], asked["max_lat"], F.col("lat_min"), F.col("lat_max")
    )
    from_lon, to_lon = _resolve_axis(
        asked["min_lon"], asked["max_lon"], F.col("lon_min"), F.col("lon_max")
    )
    resolved = flagged.withColumns({
        "from_time": F.when(reset, start).otherwise(F.col("_low")),
        "to_time": F.when(reset, end).otherwise(F.col("_high")),
        "from_lat": from_lat, "to_lat": to_lat, "from_lon": from_lon, "to_lon": to_lon,
    })
    return resolved.drop("_low", "_high", "_from", "_to")


def coverage_bounds(coverage: DataFrame) -> DataFrame:
    """Coverage taken as bounds untouched, as when the user gives no constraints at all."""
    pairs = zip(RESOLVED_COLUMNS, COVERAGE_COLUMNS)
    return coverage.withColumns(
        {**{to: F.col(name) for to, name in pairs}, "time_reset": F.lit(False)}
    )


def bound_requests(requests: DataFrame, coverage: DataFrame) -> DataFrame:
    """Resolve many requests, each against the coverage of its own dataset.

    No request is lost: one for a dataset without coverage has the ``status`` ``no_coverage``
    instead of ``ok``, and gives no rows.
    """
    cover = coverage.select("dataset_id", *COVERAGE_COLUMNS, F.lit(True).alias("_covered"))
    joined = lookup_join(requests, cover, ["dataset_id"], "left", nulls=True)
    status = F.when(F.col("_covered"), F.lit("ok")).otherwise(F.lit(NO_COVERAGE))
    return resolve_bounds(joined.withColumn("status", status).drop("_covered"))


def clamp_bounds(
    coverage: DataFrame, request: Bounds | None = None, as_of: Column | None = None
) -> DataFrame:
    """The older rule: bounds never reach outside the coverage.

    Inverted times leave the coverage as it is; inverted coordinates swap and then clamp.
    Relative times become the instant they mean at ``as_of``. A time that cannot be read
    stays as it is, and ``unreadable_bounds`` names its dataset.
    """
    moment = as_of if as_of is not None else F.localtimestamp()
    asked = request.columns() if request else {c: F.col(c) for c in REQUEST_COLUMNS}
    start, end = F.col("time_start"), F.col("time_end")

    def full(text: Column, clock: str) -> Column:
        relative = iso_text(resolve_time(text, moment))
        dated = F.when(text.contains("T") | ~text.rlike("^[0-9]"), text).otherwise(F.concat(text, F.lit(clock)))
        return F.when(text.startswith("now"), F.coalesce(relative, text)).otherwise(dated)

    dated = coverage.withColumns({
        "_low": _filled(asked["min_time"], start), "_high": _filled(asked["max_time"], end),
    }).withColumns({
        "_low": full(F.col("_low"), "T00:00:00Z"), "_high": full(F.col("_high"), "T23:59:59Z"),
    }).withColumns({
        "_from": as_utc(F.col("_low")), "_to": as_utc(F.col("_high")),
        "_first": as_utc(start), "_last": as_utc(end),
    })
    inverted, early, late = (
        F.coalesce(F.col(a) > F.col(b), F.lit(False))
        for a, b in (("_from", "_to"), ("_first", "_from"), ("_to", "_last"))
    )
    resolved = {
        "from_time": F.when(inverted | early, start).otherwise(F.col("_low")),
        "to_time": F.when(inverted | late, end).otherwise(F.col("_high")),
        "time_reset": inverted,
    }
    for axis in ("lat", "lon"):
        cover_low, cover_high = F.col(f"{axis}_min"), F.col(f"{axis}_max")
        low, high = _resolve_axis(asked[f"min_{axis}"], asked[f"max_{axis}"], cover_low, cover_high)
        resolved[f"from_{axis}"] = F.greatest(low, cover_low)
        resolved[f"to_{axis}"] = F.least(high, cover_high)
    return dated.withColumns(resolved).drop("_low", "_high", "_from", "_to", "_first", "_last")


def typed_bounds(resolved: DataFrame, as_of: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Resolved bounds with real times: ``dataset_id``, the ``keep`` columns and the six ends.

    A blank time end stays null, which means "no bound". An end that is neither ISO text
    nor a relative time bounds nothing it could be compared with, so ``status`` says so.
    """
    moment = as_of if as_of is not None else F.localtimestamp()
    ends = {name: F.col(name) for name in RESOLVED_COLUMNS}
    bad = F.lit(False)
    for name in ("from_time", "to_time"):
        text = F.col(name)
        given = F.coalesce(text != "", F.lit(False))
        bad = bad | (given & ~F.coalesce(readable_time(text), F.lit(False)))
        ends[name] = F.when(given, resolve_time(text, moment))
    given = F.col("status") if "status" in resolved.columns else F.lit("ok")
    return resolved.select(
        "dataset_id", *keep,
        *(column.alias(name) for name, column in ends.items()),
        F.when(bad, F.lit("bad_time")).otherwise(given).alias("status"),
    )


def unreadable_bounds(resolved: DataFrame) -> DataFrame:
    """Requests that give no rows: ``dataset_id, reason``.

    A time bound cannot be read, or the dataset has no coverage.
    """
    reasons = [
        F.when((F.col(name) != "") & ~F.coalesce(readable_time(F.col(name)), F.lit(False)),
               F.concat(F.lit(f"{name} "), F.col(name), F.lit(" cannot be read")))
        for name in ("from_time", "to_time")
    ]
    if "status" in resolved.columns:
        reasons.append(F.when(F.col("status") == NO_COVERAGE, F.lit("the dataset has no coverage")))
        resolved = resolved.select("dataset_id", "from_time", "to_time", "status")
    else:
        resolved = resolved.select("dataset_id", "from_time", "to_time")
    stored = materialize(resolved)
    return stored.select("dataset_id", F.concat_ws("; ", *reasons).alias("reason")).filter("reason <> ''")


def _constant(value: object, kind: str) -> Column:
    return F.lit(str(value)).cast(kind)


_KINDS = {"time": "timestamp_ntz", "lat": "double", "lon": "double"}


def _envelope(ends: Row) -> Column:
    """Constant bounds no wanted row is outside of; the scan can skip by them."""
    test = F.lit(True)
    for column, kind in _KINDS.items():
        low, high = ends[f"from_{column}"], ends[f"to_{column}"]
        if low is not None:
            test = test & (F.col(column) >= _constant(low, kind))
        if high is not None:
            test = test & (F.col(column) <= _constant(high, kind))
    return test


def _widest(ends: DataFrame) -> Row:
    """Row count and outermost ends over all datasets; an open end stays open."""
    outer = [F.count("*").alias("n")]
    for column in _KINDS:
        for name, pick in ((f"from_{column}", F.min), (f"to_{column}", F.max)):
            closed = F.count(name) == F.count("*")
            outer.append(F.when(closed, pick(name)).alias(name))
    return ends.agg(*outer).first()


def _inside() -> Column:
    time, low, high = F.col("time"), F.col("from_time"), F.col("to_time")
    return (
        (low.isNull() | (time >= low))
        & (high.isNull() | (time <= high))
        & F.col("lat").between(F.col("from_lat"), F.col("to_lat"))
        & F.col("lon").between(F.col("from_lon"), F.col("to_lon"))
    )


def rows_in_bounds(
    observations: DataFrame, resolved: DataFrame, as_of: Column | None = None
) -> DataFrame:
    """Observations of every dataset inside that dataset's resolved bounds, ends included.

    Rows without a coordinate are outside. Datasets whose status is not ``ok`` give no rows.
    The bounds are written once; their outermost ends, and the identifiers of few datasets,
    go to the scan as constants before the bounds of each dataset are joined.
    """
    ends = materialize(typed_bounds(resolved, as_of).filter("status = 'ok'").drop("status"))
    widest = _widest(ends)
    near = observations.filter(_envelope(widest))
    if widest["n"] <= PUSHED_IDS:
        ids = {row["dataset_id"] for row in ends.select("dataset_id").collect()}
        wanted = F.col("dataset_id").isin(sorted(ids - {None}))
        near = near.filter(wanted | F.col("dataset_id").isNull() if None in ids else wanted)
    joined = lookup_join(near, ends, ["dataset_id"], salt_by=["dataset_id", "row_idx"], nulls=True)
    return joined.filter(_inside()).drop(*RESOLVED_COLUMNS)


def rows_for_requests(
    observations: DataFrame, resolved: DataFrame, request: str = "request_id", as_of: Column | None = None
) -> DataFrame:
    """Observations inside each request's resolved bounds, ends included, with the ``request`` column.

    A dataset may have any number of requests; a row in several of them returns with each. The
    join is on the dataset and a bin of time: a row falls into one bin, a request into all that
    its window meets. Bins are as wide as the average window over ``WINDOW_BINS``, so requests
    are copied that often, and a dataset's rows are spread over tasks even where it holds most
    of them. A window open on a side reaches to the end of the rows; rows without a time are
    inside where both sides are open. Requests whose status is not ``ok`` give no rows.
    """
    boxes = materialize(typed_bounds(resolved, as_of, [request]).filter("status = 'ok'").drop("status"))
    near = observations.filter(_envelope(_widest(boxes)))
    span = near.agg(F.min("time").alias("first"), F.max("time").alias("last")).first()
    first, last = (F.lit(None if t is None else str(t)).cast("timestamp_ntz") for t in span)
    windows = boxes.withColumns({
        "_low": _micros(F.greatest("from_time", first)), "_high": _micros(F.least("to_time", last)),
    })
    seen = windows.filter("_low <= _high")
    mean = seen.agg(F.avg(F.col("_high") - F.col("_low"))).first()[0] or 0
    width = max(int(mean) // WINDOW_BINS, SHORTEST_BIN)
    bins = F.when(F.col("_low") <= F.col("_high"), F.sequence(_bin("_low", width), _bin("_high", width)))
    timeless = F.when(F.col("from_time").isNull() & F.col("to_time").isNull(), F.array(F.lit(NO_TIME)))
    none = F.array().cast("array<bigint>")
    copies = windows.withColumn("_bin", F.explode(F.concat(F.coalesce(bins, none), F.coalesce(timeless, none))))
    binned = near.withColumn("_time", _micros(F.col("time"))).withColumn(
        "_bin", F.coalesce(_bin("_time", width), F.lit(NO_TIME))).drop("_time")
    joined = lookup_join(binned, copies.drop("_low", "_high"), ["dataset_id", "_bin"],
                         salt_by=["dataset_id", "row_idx"], nulls=True)
    return joined.filter(_inside()).drop(*RESOLVED_COLUMNS, "_bin")


def _micros(time: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), time)


def _bin(name: str, width: int) -> Column:
    """The bin of width ``width`` that holds a number, also below zero."""
    return F.expr(f"(`{name}` - pmod(`{name}`, {width}L)) div {width}L")


def dataset_in_bounds(
    observations: DataFrame,
    coverage: DataFrame,
    dataset_id: str,
    request: Bounds | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Rows of one dataset inside its bounds, with every bound pushed to the scan.

    The dataset's single coverage row is read first, so the filters are plain constants.
    """
    one = coverage.filter(F.col("dataset_id") == dataset_id)
    resolved = resolve_bounds(one, request) if request else coverage_bounds(one)
    ends = typed_bounds(resolved, as_of).first()
    if ends is None:
        raise ValueError(f"dataset {dataset_id!r} has no coverage")
    if ends["status"] != "ok":
        raise ValueError(f"dataset {dataset_id!r} has an unreadable time bound")
    return observations.filter((F.col("dataset_id") == dataset_id) & _envelope(ends))


def mask_rows(rows: DataFrame, request: Bounds | None) -> DataFrame:
    """File-server bounds on profile-level ``time``, ``lat`` and ``lon`` columns."""
    if request is None:
        return rows
    moments = {}
    for name in ("min_time", "max_time"):
        text = getattr(request, name)
        moments[name] = as_utc(F.lit(text)) if text else None
    low, high = moments["min_time"], moments["max_time"]
    _require_readable(rows, request)
    tests = []
    if low is not None and high is not None:
        tests.append((low > high) | F.col("time").between(low, high))
    elif low is not None:
        tests.append(F.col("time") >= low)
    elif high is not None:
        tests.append(F.col("time") <= high)
    for axis in ("lat", "lon"):
        a, b = getattr(request, f"min_{axis}"), getattr(request, f"max_{axis}")
        if a is not None and b is not None:
            a, b = min(a, b), max(a, b)
        if a is not None:
            tests.append(F.col(axis) >= a)
        if b is not None:
            tests.append(F.col(axis) <= b)
    for test in tests:
        rows = rows.filter(test)
    return rows


def _require_readable(rows: DataFrame, request: Bounds) -> None:
    given = [text for text in (request.min_time, request.max_time) if text]
    if not given:
        return
    checks = rows.sparkSession.range(1).select(*(as_utc(F.lit(t)) for t in given)).first()
    unread = [text for text, parsed in zip(given, checks) if parsed is None]
    if unread:
        raise ValueError(f"cannot read the time bounds {unread}")
