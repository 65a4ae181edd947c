"""Time expressions. Times are zone-less timestamps in UTC, whatever the session zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"

# A clock followed by an offset or a zone name; a plain Z is UTC already.
_OTHER_ZONE = r":\d{2}.*([+-]\d|[A-Za-z]{2})"

# The units a relative time may use.
RELATIVE_UNITS = ("millis", "second", "minute", "hour", "day", "month", "year")
_RELATIVE = r"^now([+-]\d+)(" + "|".join(RELATIVE_UNITS) + r")s?$"


def _zoneless(instant: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.expr(_EPOCH))


def as_utc(text: Column) -> Column:
    """Parse ISO-8601 text; a missing zone means UTC, unreadable text gives null."""
    zoned = _zoneless(text.try_cast("timestamp"))
    return F.when(text.rlike(_OTHER_ZONE), zoned).otherwise(text.try_cast("timestamp_ntz"))


def microseconds(time: Column) -> Column:
    """The six digits after the second."""
    return F.rpad(F.regexp_extract(time.cast("string"), r"\.(\d+)$", 1), 6, "0")


def clock_text(time: Column, separator: str = " ") -> Column:
    """Date and clock to the second. Read off the value itself, so no zone can shift it."""
    return F.replace(F.substring(time.cast("string"), 1, 19), F.lit(" "), F.lit(separator))


def iso_text(time: Column) -> Column:
    """ISO-8601 text that ``as_utc`` reads back to the same microsecond."""
    return F.concat(clock_text(time, "T"), F.lit("."), microseconds(time), F.lit("Z"))


def zoneless_time(column: Column, data_type: T.DataType) -> Column:
    """Bring a text, zoned or zone-less time column to the zone-less UTC form."""
    if isinstance(data_type, T.TimestampNTZType):
        return column
    if isinstance(data_type, T.TimestampType):
        return _zoneless(column)
    if isinstance(data_type, T.DateType):
        return column.cast("timestamp_ntz")
    return as_utc(column)


def pad_bare_date(text: Column, end_of_day: bool) -> Column:
    """Complete a date without a clock to the first or last second of its day."""
    clock = "T23:59:59Z" if end_of_day else "T00:00:00Z"
    bare = text.rlike(r"^\d") & ~text.contains("T")
    return F.when(bare, F.concat(text, F.lit(clock))).otherwise(text)


def absolute_time(text: Column) -> Column:
    """Time of a bound that starts with a digit; null for blank or relative bounds."""
    return F.when(text.rlike(r"^\d"), as_utc(text))


def resolve_time(text: Column, as_of: Column) -> Column:
    """Time of any bound: ISO text, or ``now``/``now-7days`` counted from ``as_of``.

    Blank text gives null, which the filters read as "no bound".
    """
    spelled = F.replace(
        F.regexp_replace(text, _RELATIVE, "$1 $2"), F.lit("millis"), F.lit("milliseconds")
    )
    return (
        F.when(text == "now", as_of)
        .when(text.rlike(_RELATIVE), as_of + spelled.try_cast("interval"))
        .otherwise(as_utc(text))
    )


def readable_time(text: Column) -> Column:
    """Whether a non-blank bound is ISO text or a relative time."""
    return (text == "now") | text.rlike(_RELATIVE) | as_utc(text).isNotNull()


def short_time(time: Column) -> Column:
    """``7:03<br>5-Sep``, as map labels show it."""
    return F.date_format(time, "H:mm'<br>'d-MMM")
