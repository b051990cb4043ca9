"""Serial day numbers, ISO 8601 text and number-format predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def _epoch(date1904: bool) -> int:
    """Days from 1970 of day 0: 1899-12-30, or 1904-01-01."""
    return -24107 if date1904 else -25569


def serial_micros(v: Column, date1904: bool = False) -> Column:
    """Microseconds since 1970 of a serial, to whole milliseconds by half-even rounding.

    In the 1900 system, serials under 60 stand a day later, since that system has a 29th of February 1900.
    """
    day = F.floor(v)
    milli = F.bround((v - day) * 86_400_000).cast("long")
    if not date1904:
        day = day + F.when((v > 0) & (v < 60), 1).otherwise(0)
    return (day.cast("long") + _epoch(date1904)) * F.lit(DAY_US).cast("long") + milli * 1000


def from_serial(v: Column, date1904: bool = False) -> Column:
    return F.timestamp_micros(serial_micros(v, date1904)).cast("timestamp_ntz")


def serial_duration_micros(v: Column) -> Column:
    return F.bround(v * 86_400_000).cast("long") * 1000


def to_serial(ts: Column, date1904: bool = False) -> Column:
    """The serial of a timestamp (taken as UTC wall-clock time)."""
    us = F.unix_micros(ts.cast("timestamp"))
    day = F.floor(us / F.lit(DAY_US)).cast("long")
    days = day - _epoch(date1904)
    if not date1904:
        days = days - F.when(days.between(1, 60), 1).otherwise(0)
    return days + F.pmod(us, F.lit(DAY_US).cast("long")) / F.lit(float(DAY_US))


def time_to_days(us: Column) -> Column:
    return us / F.lit(float(DAY_US))


ISO_TIME = r"^(?:(\d{4})-(\d{2})-(\d{2}))?[T ]?(?:(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,6}))?)?)?Z?$"
ISO_DURATION = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,6}))?S)?$"


def _micros(pattern: str, s: Column, first: int) -> Column:
    part = lambda i: F.coalesce(F.regexp_extract(s, pattern, i).try_cast("long"), F.lit(0))
    fraction = F.rpad(F.regexp_extract(s, pattern, first + 3), 6, "0").try_cast("long")
    return (part(first) * 3600 + part(first + 1) * 60 + part(first + 2)) * 1_000_000 + F.coalesce(fraction, F.lit(0))


def parse_iso(s: Column) -> Column:
    """struct(kind, us): date, time, datetime (microseconds since 1970 or midnight) or duration; null for other text."""
    day = F.regexp_extract(s, r"^(\d{4}-\d{2}-\d{2})", 1)
    days = F.unix_date(day.try_cast("date")).cast("long")
    clock = _micros(ISO_TIME, s, 4)
    timed = s.rlike(r"\d{2}:\d{2}")
    out = lambda kind, us: F.struct(F.lit(kind).alias("kind"), us.cast("long").alias("us"))
    date = F.when(s.rlike(ISO_TIME) & (day != "") & days.isNotNull(), F.when(timed, out("datetime", days * DAY_US + clock)).otherwise(out("date", days * DAY_US)))
    return F.when(s.rlike(ISO_DURATION) & (F.length(s) > 2), out("duration", _micros(ISO_DURATION, s, 1))).when(s.rlike(ISO_TIME) & (day == "") & timed, out("time", clock)).otherwise(date)


def _bare(fmt: Column) -> Column:
    """A number format's first section without quoted text, escapes, colours and locales."""
    first = F.regexp_replace(F.split(fmt, ";")[0], r'"[^"]*"|\\.|_.', "")
    return F.regexp_replace(first, r"\[(?!h+\]|m+\]|s+\])[^\]]*\]", "")


def is_date_format(fmt: Column) -> Column:
    return F.coalesce(F.lower(_bare(fmt)).rlike("[dmhysDMHYS]") & (F.lower(fmt) != "general"), F.lit(False))


def is_duration_format(fmt: Column) -> Column:
    return F.coalesce(F.lower(_bare(fmt)).rlike(r"\[(h+|m+|s+)\]"), F.lit(False))


def iso_text(ts: Column) -> Column:
    """ISO 8601 of a timestamp, to whole milliseconds where it has a fraction; the rest is cut off."""
    us = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(us != 0, F.concat(F.lit("."), F.lpad(F.floor(us / 1000).cast("string"), 3, "0"))).otherwise(""))


def days_to_time(v: Column) -> Column:
    """Microseconds since midnight of a part of days, whole days left out."""
    return F.pmod(F.bround(v * DAY_US).cast("long"), F.lit(DAY_US).cast("long"))


def civil_from_days(days: Column) -> Column:
    """struct(year, month, day) of days since 1970."""
    d = F.date_from_unix_date(days.cast("int"))
    return F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"))


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970; null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.unix_date(text.try_cast("date")).cast("long")


#: The number format that a new cell of a type gets. Fixed values.
DEFAULT_FORMATS = {"timestamp": "yyyy-mm-dd h:mm:ss", "timestamp_ntz": "yyyy-mm-dd h:mm:ss", "date": "yyyy-mm-dd", "time": "h:mm:ss", "interval day to second": "[hh]:mm:ss"}
