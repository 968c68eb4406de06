"""Timestamps held as text, and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000

# Extended ISO: date, optional time to the hour or finer, optional offset. The pattern guards
# the cast, which on its own would also take '2026' or '12:00'.
_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d+)?)?)?(?:Z|[+-]\d{2}:\d{2})?)?$"
# The two forms most feeds hold throughout: full to the second without an offset, and whole epoch seconds.
_FULL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d++)?\z"
_WHOLE = r"^\d{9,11}\z"


def read_iso(t: Column) -> Column:
    """Extended ISO text to timestamp; a time without an offset is UTC.

    Compact and week-date spellings are not read and give NULL.
    """
    zone = (
        F.when(F.length(t) == 10, F.lit("T00:00:00Z"))
        .when(t.endswith("Z") | F.substring(t, -6, 1).isin("+", "-"), F.lit(""))
        .otherwise(F.lit("Z"))
    )
    # The cast wants minutes and seconds in front of an offset.
    to_second = F.when(
        F.substring(t, 14, 1).isin("", "Z", "+", "-") & (F.length(t) > 10),
        F.concat(F.substring(t, 1, 13), F.lit(":00:00"), F.substring(t, 14, 32)),
    ).when(
        F.substring(t, 17, 1).isin("", "Z", "+", "-") & (F.length(t) > 10),
        F.concat(F.substring(t, 1, 16), F.lit(":00"), F.substring(t, 17, 32)),
    ).otherwise(t)
    return F.when(t.rlike(_ISO), F.concat(to_second, zone).try_cast("timestamp"))


def _epoch(t: Column, pattern: str) -> Column:
    """Epoch seconds, fractions kept to the microsecond; NULL past year 9999."""
    seconds = F.when(t.rlike(pattern), t.try_cast("decimal(38,6)"))
    return F.when(
        seconds < 253402300800, F.timestamp_micros((seconds * 1_000_000).cast("bigint"))
    )


def _common_first(t: Column, pattern: str) -> Column:
    """Times in the common forms are read at once, others by their patterns, with the same results."""
    return (
        F.when(t.rlike(_FULL), F.concat(t, F.lit("Z")).try_cast("timestamp"))
        .when(t.rlike(_WHOLE), F.timestamp_seconds(t.try_cast("bigint")))
        .when(t.rlike(pattern), _epoch(t, pattern))
        .otherwise(read_iso(t))
    )


def parse_time(t: Column) -> Column:
    """ISO text or epoch seconds of 9 to 11 digits, with or without a fraction (stripped), to
    timestamp; anything else is NULL."""
    return _common_first(t, r"^\d{9,11}(?:\.\d+)?$")


def parse_update_time(t: Column) -> Column:
    """As :func:`parse_time`, but epoch seconds may have any number of digits."""
    return _common_first(t, r"^\d+(?:\.\d+)?$")


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def iso_text(c: Column) -> Column:
    """2026-09-04T19:22:11+00:00, with six fraction digits when there are any."""
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.pmod(F.unix_micros(c), F.lit(1_000_000)) != 0, F.date_format(c, ".SSSSSS"))
        .otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def duration_text(micros: Column) -> Column:
    """'1 day, 2:03:04.000005' for a non-negative duration in microseconds."""

    def part(unit: int, modulus: int) -> Column:
        return F.floor(F.pmod(micros, F.lit(modulus)) / F.lit(unit)).cast("string")

    days = F.floor(micros / F.lit(_DAY_US))
    fraction = F.pmod(micros, F.lit(1_000_000))
    return F.concat(
        F.when(days == 0, F.lit(""))
        .when(days == 1, F.lit("1 day, "))
        .otherwise(F.concat(days.cast("string"), F.lit(" days, "))),
        part(3_600_000_000, _DAY_US),
        F.lit(":"),
        F.lpad(part(60_000_000, 3_600_000_000), 2, "0"),
        F.lit(":"),
        F.lpad(part(1_000_000, 60_000_000), 2, "0"),
        F.when(
            fraction != 0, F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
        ).otherwise(F.lit("")),
    )
