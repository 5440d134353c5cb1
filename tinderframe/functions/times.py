"""Time expressions. Timestamps are UTC instants; hours are whole hours since the epoch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

HOUR_SECONDS = 3600
DAY_SECONDS = 86400

# The accepted text forms, with and without an offset.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
)


def as_timestamp(value: Column | datetime | str) -> Column:
    """A literal (or column) as a TIMESTAMP; text without a zone means UTC."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def hour_number(ts: Column) -> Column:
    """Whole hours since the epoch, rounded down."""
    return F.floor(F.unix_micros(ts) / (HOUR_SECONDS * 1_000_000))


def hour_start(hour: Column) -> Column:
    """The instant at which hour number ``hour`` begins."""
    return F.timestamp_seconds(hour * HOUR_SECONDS)


def micros_between(later: Column, earlier: Column) -> Column:
    return F.unix_micros(later) - F.unix_micros(earlier)


def whole_hours_between(later: Column, earlier: Column) -> Column:
    """Difference cut to whole hours (toward zero), as a long."""
    return (micros_between(later, earlier) / (HOUR_SECONDS * 1_000_000)).cast("long")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts)


def parse_time(text: Column, strict: bool = True) -> Column:
    """Parse any of ``TIME_FORMATS``; ``Z`` stands for ``+00:00``.

    ``strict`` raises on text that fits no format; otherwise it becomes null.
    """
    cleaned = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    parsed = F.coalesce(*[F.try_to_timestamp(cleaned, F.lit(f)) for f in TIME_FORMATS])
    if not strict:
        return parsed
    complaint = F.raise_error(F.concat(F.lit("unsupported time format: "), text))
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(complaint.cast("timestamp"))


def time_range(start, end, step: str = "1 hour") -> Column:
    """Array of regular stamps, both ends included; ``explode`` it for rows."""
    return F.sequence(as_timestamp(start), as_timestamp(end), F.expr(f"interval {step}"))


def valid_time(init: Column, lead_hours: int = 3) -> Column:
    """Instant a forecast refers to: its start plus the lead."""
    return init + F.expr(f"interval {lead_hours} hours")


def local_to_utc(ts: Column, zone: str) -> Column:
    return F.to_utc_timestamp(ts, zone)


def utc_to_local(ts: Column, zone: str) -> Column:
    return F.from_utc_timestamp(ts, zone)


def yearly_anchors(t: Column, nyears: int) -> Column:
    """``t - nyears`` and every whole year after it, up to ``t``.

    Years are added to the *first* anchor, so 29 February gives 28 February throughout.
    """
    first = t - F.make_ym_interval(F.lit(nyears), F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), F.lit(nyears)),
        lambda i: first + F.make_ym_interval(i, F.lit(0)),
    )


def climatology_times(t: Column, nyears: int = 10, ndays: int = 15) -> Column:
    """Array of earlier stamps at the same hour, ``ndays`` around each yearly anchor."""
    offsets = F.sequence(F.lit(-ndays), F.lit(ndays))
    around = F.transform(
        yearly_anchors(t, nyears),
        lambda a: F.transform(offsets, lambda d: a + F.make_dt_interval(d)),
    )
    return F.filter(F.flatten(around), lambda s: s < t)
